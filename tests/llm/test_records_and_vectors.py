import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, covertree, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, data, ids=None, more=()):
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(range(len(data)) if ids is None else ids, data)]
    return spark.createDataFrame([*rows, *more], VECTORS)


AWKWARD = [(None, [1.0, 2.0], 0), (900, None, 0), (901, [], 0), (902, [float("nan"), 1.0], 0), (903, [float("inf"), 1.0], 0), (904, [None, 1.0], 0)]


def sphere(n, dim, seed):
    a = np.random.default_rng(seed).standard_normal((n, dim))
    return (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)


def distances(a):
    x = np.asarray(a, dtype=np.float32).astype(float)
    return np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))


@pytest.mark.parametrize("block, asking", [(150, 7), (10_000, 10_000)])
def test_neighbours_recall_against_brute_force(spark, block, asking):
    a = sphere(500, 32, 1)
    a[250:] = a[:250] + 0.05 * sphere(250, 32, 2)
    found = ann.nearest_neighbours(vectors(spark, a, more=AWKWARD), 5, 4, block, asking).toPandas()
    gap = distances(a)
    np.fill_diagonal(gap, np.inf)
    true = np.argsort(gap, axis=1)[:, :5]
    hits = sum(len(set(g["neighbour_id"]) & set(true[i])) for i, g in found.groupby("vec_id"))
    assert set(found["vec_id"]) == set(range(0, 500, 4)) and hits >= 0.95 * 625
    assert found.groupby("vec_id")["position"].apply(list).map(lambda x: sorted(x) == [1, 2, 3, 4, 5]).all()
    for r in found.itertuples():
        assert abs(gap[r.vec_id, r.neighbour_id] - r.distance) < 1e-6


def test_neighbours_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    gap = distances([r.embedding for r in rows])
    np.fill_diagonal(gap, np.inf)
    found = ann.nearest_neighbours(table, every=1, block=128).toPandas()
    true = np.argsort(gap, axis=1)[:, : ann.NEIGHBOURS]
    assert sum(len(set(g["neighbour_id"]) & set(true[i])) for i, g in found.groupby("vec_id")) >= 0.9 * len(rows) * ann.NEIGHBOURS


def test_neighbours_of_few_equal_and_mixed_rows(spark):
    rows = vectors(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], ids=[1, 1, 2], more=[(3, [1.0, 0.0, 0.0], 0), (1, [0.5, 0.5], 0)])
    got = {(r.vec_id, r.neighbour_id) for r in ann.nearest_neighbours(rows.withColumn("cell", F.lit(0)).withColumn("asks", F.lit("x")), every=1).collect()}
    assert got == {(1, 2), (2, 1)}
    assert ann.nearest_neighbours(rows.limit(0)).count() == 0
    assert ann.nearest_neighbours(vectors(spark, [[1.0, 0.0]] * 30), 3, 1).count() == 90
    assert ann.nearest_neighbours(vectors(spark, [[1.0, 0.0]] * 45), 3).count() == 9


def brute_classes(ids, a, epsilon):
    """(id, least id of the component, links) of each row."""
    near = distances(a) <= epsilon
    root = list(range(len(a)))
    changed = True
    while changed:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(a))]
        changed, root = new != root, new
    return sorted((ids[i], min(ids[j] for j in range(len(a)) if root[j] == root[i]), int(near[i].sum()) - 1) for i in range(len(a)))


def classes(frame, *args):
    return sorted(tuple(r) for r in covertree.near_classes(frame, *args).select("vec_id", "class_id", "n_links").collect())


@pytest.mark.parametrize("block", [64, 10_000])
@pytest.mark.parametrize("epsilon", [0.25, 0.5, 1.0])
def test_classes_and_links_are_exact(spark, block, epsilon):
    a = sphere(400, 16, 3)
    a[300:] = a[:100] + 0.06 * sphere(100, 16, 4)
    a[200:260] = a[0] + 0.1 * sphere(60, 16, 5) * np.random.default_rng(6).random((60, 1)).astype(np.float32)  # a group whose width is about a threshold
    a[260:290] = a[1] + 0.01 * sphere(30, 16, 7)
    a[290:298] = a[1] + epsilon * 0.99 * sphere(8, 16, 8)  # rows that only some members of the group reach
    a[298] = a[5]
    got = classes(vectors(spark, a, more=AWKWARD).withColumn("v", F.lit(1)).withColumn("key", F.lit("x")), epsilon, block)
    assert got == brute_classes(list(range(400)), a, epsilon)


def test_groups_that_lie_side_by_side(spark):
    rng = np.random.default_rng(11)
    a = np.concatenate([rng.normal(0, 0.02, (60, 8)) + [c * 0.22, *[0] * 7] for c in range(4)] + [rng.random((100, 8))]).astype(np.float32)
    for block in (40, 10_000):
        assert classes(vectors(spark, a), 0.3, block) == brute_classes(list(range(len(a))), a, 0.3)


def test_classes_of_equal_and_mixed_rows(spark):
    rows = vectors(spark, [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0]], ids=[1, 1, 2], more=[(3, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.1], 0)])
    assert classes(rows) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]
    assert classes(rows.limit(0)) == []
    assert classes(vectors(spark, [[0.5, 0.5]] * 60), 0.3, 16) == [(i, 0, 59) for i in range(60)]
    far = [[1e6, i * 0.2, 0.0] for i in range(20)]
    assert classes(vectors(spark, far), 0.3, 8) == brute_classes(list(range(20)), far, 0.3)


def test_tree_counts_equal_brute_force():
    rng = np.random.default_rng(1)
    x = sphere(300, 16, 1).astype(float)
    x[200:] = x[:100] + 0.05 * rng.standard_normal((100, 16))
    x[150:180] = x[0] + 0.02 * rng.standard_normal((30, 16))
    gap = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    for epsilon in (0.1, 0.5, 1.2, 3.0):
        near = (gap <= epsilon) & ~np.eye(300, dtype=bool)
        assert (covertree.count_links(x, None, epsilon).count == near.sum(axis=1)).all()
        two = covertree.count_links(x[:170], x[170:], epsilon)
        assert (two.count == np.r_[near[:170, 170:].sum(axis=1), near[:170, 170:].sum(axis=0)]).all()


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    from graphloom.llm import common

    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    frame = spark.createDataFrame(links, "a long, b long")
    one = sorted(tuple(r) for r in common.components(frame).collect())
    monkeypatch.setattr(common, "ONE_TASK", 0)
    assert sorted(tuple(r) for r in common.components(frame).collect()) == one
    assert dict(one)[160] == 100 and len(dict(one)) == len(one)
    monkeypatch.undo()
    assert common.components(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, payload string"


def test_chunks_put_together_give_the_page(spark):
    rows = [(1, "http://a/é x", "é" * 30_000, "c"), (2, None, "short", "c"), (2, None, "short", "c"), (3, "u", None, "c"), (None, "v", "", "c"), (5, "w", "x" * warc.CHUNK, "c")]
    frame = spark.createDataFrame(rows, PAGES).coalesce(1)
    chunks = warc.page_records(frame).toPandas()
    for page, _, html, _ in rows:
        own = chunks[chunks["page_id"].isna()] if page is None else chunks[chunks["page_id"] == page]
        own = own.sort_values("chunk_no", kind="stable").drop_duplicates("chunk_no")
        body = b"".join(own["payload"])
        assert body == (html or "").encode() and all(len(p) <= warc.CHUNK for p in own["payload"])
        at = 0
        for r in own.itertuples():
            at += len(r.payload)
            assert r.byte_offset == at - len(r.payload) and r.sha1_so_far == hashlib.sha1(body[:at]).hexdigest()
        assert own["is_last"].tolist() == [False] * (len(own) - 1) + [True]
    assert (chunks["page_id"] == 2).sum() == 2
    assert warc.page_records(frame.limit(0)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_files_round_trip(spark, tmp_path, compress):
    frame = spark.createDataFrame([(i, f"http://h/{i}", "ab\r\n\r\n" * (i * 3000), "") for i in range(6)], PAGES)
    chunks = warc.page_records(frame)
    paths = warc.write_warc(chunks, str(tmp_path), compress)
    back = warc.read_warc(spark, paths)
    cols = ["record_id", "uri", "chunk_no", "byte_offset", "payload", "sha1_so_far", "is_last"]
    key = lambda df: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*cols).collect())
    assert key(back) == key(chunks)


@pytest.mark.parametrize("compress", [True, False])
def test_repeated_records_round_trip(spark, tmp_path, compress):
    rows = [(1, "u", "ab" * 30_000, ""), (1, "u", "ab" * 30_000, ""), (1, "u", "cd" * 20_000, ""), (2, None, "x", ""), (2, None, "x", "")]
    chunks = warc.page_records(spark.createDataFrame(rows, PAGES).repartition(3))
    paths = warc.write_warc(chunks, str(tmp_path / "a"), compress)
    back = warc.read_warc(spark, paths)
    cols = ["record_id", "uri", "chunk_no", "byte_offset", "payload", "sha1_so_far", "is_last"]
    key = lambda df: sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*cols).collect()), key=repr)
    assert key(back) == key(chunks) and back.where("is_last").count() == 5
    assert key(warc.read_warc(spark, warc.write_warc(back, str(tmp_path / "b"), compress))) == key(chunks)
    with pytest.raises(Exception, match="repeated without a row_no"):
        warc.write_warc(chunks.drop("row_no"), str(tmp_path / "c"), compress)


def test_long_urls_are_carried(spark):
    url = "http://h/" + "u" * (3 * warc.MAX_HEADER)
    frame = spark.createDataFrame([(1, url, "a", ""), (2, "v", "b", "")], PAGES).coalesce(1)
    assert sorted((r.page_id, r.uri, bytes(r.payload)) for r in warc.page_records(frame).collect()) == [(1, url, b"a"), (2, "v", b"b")]
    assert {f["error"] for f, *_ in warc.WarcReader(warc.Pull(warc.record_pieces("urn:uuid:1", url, memoryview(b"a"))))} == {"header too long"}


@pytest.mark.parametrize("chunk, piece", [(1 << 14, 1 << 16), (7, 5), (64, 1)])
def test_bytes_that_are_no_record_are_reported(chunk, piece):
    good = b"".join(warc.record_pieces("urn:uuid:1", "u", memoryview(b"body \nWARC/x")))
    bare = b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:2>\r\n\r\nno length here\n"
    latin = good.replace(b": u\r", b": caf\xe9\r")
    junk, tail = b"junk " * 20 + b"\r\n", b"WARC/1.1\r\nWARC-Rec"
    got: dict = {}
    for fields, number, offset, payload, digest, last in warc.WarcReader(io.BytesIO(junk + good + bare + latin + tail), chunk, piece):
        whole, spans = got.setdefault((fields.get("warc-target-uri"), fields.get("error")), (b"", []))
        assert offset == len(whole) and len(payload) <= chunk and digest == hashlib.sha1(whole + payload).hexdigest()
        got[fields.get("warc-target-uri"), fields.get("error")] = (whole + payload, [*spans, last])
    assert {k: v[0] for k, v in got.items()} == {
        (None, "no record header"): junk, ("u", None): b"body \nWARC/x", (None, "no content length"): bare, ("café", None): b"body \nWARC/x", (None, "header cut off"): tail,
    }
    assert all(v[1] == [False] * (len(v[1]) - 1) + [True] for v in got.values())


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"not a record\r\n" + b"".join(warc.record_pieces("urn:uuid:1", "u", memoryview(b"x"))))
    (tmp_path / "b.warc").write_bytes(b"")
    got = sorted((r.uri or "", r.error or "", bytes(r.payload)) for r in warc.read_warc(spark, [str(tmp_path / "a.warc"), (tmp_path / "b.warc").as_uri()]).collect())
    assert got == [("", "no record header", b"not a record\r\n"), ("u", "", b"x")]


def test_reader_holds_no_whole_record():
    body = b"z" * 5_000_000
    pieces = list(warc.record_pieces("urn:uuid:1", "u", memoryview(body)))
    reader = warc.WarcReader(warc.Pull(pieces), 1000, 4096)
    largest = 0
    for _ in reader:
        largest = max(largest, len(reader._held))
    assert largest <= warc.PIECE + 4096
    cut = list(warc.WarcReader(io.BytesIO(b"".join(pieces)[:-1000]), 1 << 20))
    assert cut[-1][5] is False


TURNS = "conv_id long, turn int, role string, text string, n_turns int"


def plain(turns):
    """Row by row, as the template says."""
    out = {}
    for c, t, role, text, _ in sorted(turns, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        safe = lambda s: s.replace(chat.OPEN, "<| im_start|>").replace(chat.CLOSE, "<| im_end|>")
        role, text = safe(role or "unknown"), safe(text or "")
        got, n, spans = out.get(c, ("", 0, []))
        start = len((got + chat.OPEN + role + "\n").encode())
        out[c] = (got + chat.OPEN + role + "\n" + text + chat.CLOSE + "\n", n + 1, spans + [(start, start + len(text.encode()))] * (role == chat.LEARNED))
    return out


def test_chat_equals_row_by_row(spark):
    rng, turns = random.Random(6), []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 7)):
            turns.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, "", "tool"]), rng.choice([None, "", "héllo", "a" * rng.randint(1, 9), f"x{chat.CLOSE}y", "日本"]), 1))
    turns += [turns[0], (77, 1, "assistant", "long " * 60_000, 1)]
    frame = spark.createDataFrame(turns, TURNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = {r.conv_id: (r.text, r.n_turns, list(zip(r.loss_start, r.loss_end))) for r in chat.format_conversations(frame).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(turns)
    assert chat.format_conversations(frame.limit(0)).count() == 0


def turn_batch(conv, texts):
    return pa.RecordBatch.from_arrays([pa.array([conv] * len(texts), pa.int64()), pa.array(["user"] * len(texts)), pa.array(texts)], names=["conv_id", "role", "text"])


@pytest.mark.parametrize("conv", [7, None])
def test_chat_longer_than_a_string_value_fails_loudly(conv):
    one = turn_batch(conv, ["a" * (1 << 28)])
    with pytest.raises(ValueError, match=f"conversation {conv} "):
        list(chat._format(iter([one] * 9)))


def test_chat_measures_each_conversation(monkeypatch):
    frame = [turn_batch(1, ["x" * 100] * 5), turn_batch(2, ["y" * 100] * 5)]
    whole = chat.OPEN + "user\n" + "x" * 100 + chat.CLOSE + "\n"
    monkeypatch.setattr(chat, "MAX_TEXT", 5 * len(whole))
    got = [r for b in chat._format(iter(frame)) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"], len(r["text"])) for r in got] == [(1, 5, 5 * len(whole)), (2, 5, 5 * len(whole))]
    monkeypatch.setattr(chat, "MAX_TEXT", 5 * len(whole) - 1)
    with pytest.raises(ValueError, match="conversation 1 "):
        list(chat._format(iter(frame)))


@pytest.mark.parametrize("copy", [1, 10, 64, 1000])
def test_chat_is_copied_in_blocks(monkeypatch, copy):
    rng = random.Random(3)
    frame = [turn_batch(c, ["é" * rng.randint(0, 30) for _ in range(6)]) for c in (1, 1, 2, 3, 3, 3)]
    want = [b.to_pylist() for b in chat._format(iter(frame))]
    monkeypatch.setattr(chat, "COPY", copy)
    assert [b.to_pylist() for b in chat._format(iter(frame))] == want
