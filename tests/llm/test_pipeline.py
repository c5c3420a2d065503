import random

import corpus_pipeline
from graphloom.llm import mixing, packing, secret_scan, simhash, toxicity


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_stages_equal_plain_python(spark, tmp_path):
    rows = [(i, words(i, 60 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, words(i, 60 + i), "en", "s9", 1) for i in range(5)]
    rows += [(200, "you idiot " * 10, "en", "s0", 1), (201, f'{words(7000, 40)} token="wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY12"', "en", "s1", 1), (202, None, "en", None, None), (203, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    auto, kept = toxicity.build_automaton(), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)
    clean = sorted((r[0], r[1]) for r in rows if r[1] is not None and toxicity.score_text(r[1], auto)[0] < toxicity.THRESHOLD)
    assert kept["toxicity"] == clean and 200 not in {i for i, _ in clean}
    single = [(i, t) for i, t in clean if not 100 <= i < 105]
    assert kept["near_dedup"] == single
    assert kept["secrets"] == [(i, secret_scan.redact(t)) for i, t in single]
    assert {i for i, _ in kept["mixing"]} == {i for i, _ in single}
    packed = docs.toPandas()
    assert packed["length"].sum() == sum(len(t.split()) for _, t in kept["mixing"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert mixing and packing and simhash
