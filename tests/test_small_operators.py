import subprocess

import numpy as np

from graphloom.operators import diffs, graph, retrieval, verify
from graphloom.schema import EDGES
from graphloom.sources import scan
from graphloom.streaming import watch


def test_edges_are_deleted_by_key(spark):
    rows = [("a", "b", "calls", n, 1, "ast_exact", 1.0, "r", "call", None) for n in (1, 2, 2)]
    edges = spark.createDataFrame(rows, EDGES)
    left = graph.delete_edges(edges, edges.filter("line = 2").limit(1))
    assert [r.line for r in left.collect()] == [1]


def test_git_lists_what_it_does_not_ignore(tmp_path):
    assert scan.git_paths(str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in ((".gitignore", "*.log\n"), ("a.ts", "x"), ("é b.ts", "y"), ("c.log", "z")):
        (tmp_path / name).write_text(text)
    assert scan.git_paths(str(tmp_path)) == [".gitignore", "a.ts", "é b.ts"]


def test_scan_takes_what_git_lists(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in ((".gitignore", "skipped.ts\n"), ("a.ts", "x"), ("skipped.ts", "y")):
        (tmp_path / name).write_text(text)
    assert [r.path for r in scan.scan(spark, str(tmp_path)).collect()] == ["a.ts"]
    assert scan.scan(spark, str(tmp_path), use_git=False).count() == 2
    assert scan.scan_one(spark, str(tmp_path), "a.ts").first().text == "x"


def test_entries_are_found_at_any_depth():
    text = '{"main": "./a.js", "bin": {"x": "b/../c.js", "n": 1}, "exports": {".": {"node": {"import": ["./d.js", {"default": "e.js"}]}, "types": "./f.d.ts"}}}'
    assert scan._targets(text, "pkg") == ["pkg/a.js", "pkg/c.js", "pkg/d.js", "pkg/e.js", "pkg/f.d.ts"]
    assert scan._targets('{"bin": "z.js"}', "") == ["z.js"] and scan._targets("[1", "") == scan._targets("3", "") == scan._targets(None, "") == []


def test_allowed_names(spark, tmp_path):
    (tmp_path / ".allow").write_text("# head\none # two\n\n three\n")
    assert sorted(r.name for r in verify.allow_list(spark, str(tmp_path / ".allow"), ("four", "one")).collect()) == ["four", "one", "three"]


def test_a_stream_keeps_the_last_hash(spark, tmp_path):
    feed = "path string, event_id long, ts timestamp, hash string"
    rows = [[("p", 1, "2024-01-01 00:00:00", "a"), ("p", 2, "2024-01-01 00:01:00", "a"), ("q", 3, "2024-01-01 00:00:00", None)], [("p", 4, "2024-01-02 00:00:00", "b"), ("q", 5, "2024-01-02 00:00:00", None)]]
    from pyspark.sql import functions as F

    for n, part in enumerate(rows):
        spark.createDataFrame(part, "path string, event_id long, ts string, hash string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got: list = []
        changes = watch.hash_gate(spark.readStream.schema(feed).parquet(str(tmp_path / "in")))
        watch.apply_batches(changes, lambda df, _: got.extend((r.event_id, r.action) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
        assert sorted(got) == [[(1, "new"), (2, "touched"), (3, "new")], [(4, "changed"), (5, "touched")]][n]


def test_singular_values_equal_numpy():
    rng = np.random.default_rng(5)
    a = rng.random((12, 9)) * (rng.random((12, 9)) < 0.6) + np.diag(np.arange(12.0, 0, -1))[:, :9] * 3
    rows, cols = np.nonzero(a)
    u, s, v = retrieval.truncated_svd(rows, cols, a[rows, cols], 12, 9, 4)
    want = np.linalg.svd(a)[1][:4]
    assert np.allclose(s, want, rtol=1e-6) and np.allclose(u * s @ v.T, u @ (u.T @ a), atol=1e-3)
    assert all(x[np.argmax(np.abs(x))] > 0 for x in v.T)
    again = retrieval.truncated_svd(rows, cols, a[rows, cols], 12, 9, 4)
    assert all((x == y).all() for x, y in zip((u, s, v), again))


def test_the_index_spread_over_tasks_equals_one_iteration(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}x" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(120)] + [("e", ""), ("f", None)]
    frame = spark.createDataFrame(docs, "id string, text string").repartition(5)
    got = retrieval.lsa_index(frame, 6).toPandas()
    entries = retrieval.tfidf(frame).toPandas()
    ids = sorted(i for i, _ in docs)
    terms = sorted(set(entries["term"]))
    rows, cols = entries["term"].map(terms.index).to_numpy(), entries["id"].map(ids.index).to_numpy()
    order = np.lexsort((rows, cols))
    u, s, v = retrieval.truncated_svd(rows[order], cols[order], entries["val"].to_numpy()[order], len(terms), len(ids), 6)
    sigma = got[got["kind"] == "sigma"]["vec"].iloc[0]
    assert np.allclose(sigma, s, rtol=1e-9)
    for kind, keys, want in (("term", terms, u), ("doc", ids, v * s)):
        part = got[got["kind"] == kind].set_index("key")["vec"]
        assert sorted(part.index) == keys and np.allclose(np.stack(part.loc[keys].to_list()), want, atol=1e-7)
    assert np.allclose(retrieval._start_block(7, 5, 3)[:, 1], retrieval._start_vector(12, 1 + 7919)[7:])
    assert retrieval.lsa_index(frame.limit(0)).count() == 0


def test_latent_ranking_needs_no_shared_word(spark):
    docs = spark.createDataFrame([("auth", "handleUserSession authenticate login credential validatePassword"), ("math", "computeSum addNumbers multiplyMatrix factorial"), ("render", "drawCanvas paintPixels renderFrame displayImage")], "id string, text string")
    index = retrieval.lsa_index(docs)
    got = [[(r.id, r.score) for r in retrieval.top(retrieval.lsa_query(index, docs, q), 3).collect()] for q in ("user login flow", "user login flow")]
    assert got[0][0][0] == "auth" and got[0] == got[1]
    assert [r.id for r in retrieval.top(retrieval.bm25(docs, "login"), 2).collect()] == ["auth"]
    assert retrieval.bm25(docs, "nothing_such").count() == 0 and retrieval.bm25(docs.limit(0), "login").count() == 0


def test_budget_that_skips_equals_a_loop(spark):
    import random

    from graphloom.operators import ranking

    rng = random.Random(4)
    rows = [(f"g{rng.randint(0, 5)}", i, rng.randint(1, 9)) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, rank int, cost int")
    want, used = [], {}
    for g, i, c in rows:
        if g not in used or used[g] + c <= 30:
            want.append(i)
            used[g] = used.get(g, 0) + c
    assert sorted(r.rank for r in ranking.greedy_fit(frame, ["g"], ["g"], "rank", "cost", 30.0).collect()) == want


def test_diffs_leave_the_text_that_they_add(spark):
    diff = "--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,3 @@\n a\n+b\n c\n"
    files = spark.createDataFrame([("x.ts", "a\nc\n")], "path string, text string")
    post = diffs.apply_all(files, spark.createDataFrame([(diff,)], "diff string")).first()
    assert post.post_image == "a\nb\nc\n" and post.error is None
