"""Figures that the README gives for the training-data operators: ``python tests/llm/measure.py [FOLDER]`` (default: the sf0.1 tables)."""

from __future__ import annotations

import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graphloom.llm import ann, packing, simhash, toxicity  # noqa: E402
from graphloom.llm.common import joined_roots, table  # noqa: E402
from graphloom.session import build_session  # noqa: E402


def near_duplicates(spark, d: str) -> str:
    """Pairs of fingerprints within the radius that fall into one group, and documents whose fate the others change."""
    docs = table(spark, d, "documents").select("doc_id", simhash.fingerprint_udf("text").alias("fp")).filter("fp is not null").collect()
    fps = sorted({bytes(r.fp) for r in docs})
    raw = np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(-1, 17)
    words, radius = np.ascontiguousarray(raw[:, :16]).view(">u8").astype(np.uint64), raw[:, 16].astype(int)
    a, b = [], []
    for i in range(len(fps)):
        apart = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(axis=1)
        j = np.flatnonzero(apart <= np.minimum(radius[i + 1 :], radius[i])) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    links = simhash.near_links(spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")).collect()
    at = {f: i for i, f in enumerate(fps)}
    found = joined_roots(np.arange(len(fps)), np.array([at[bytes(r.a)] for r in links]), np.array([at[bytes(r.b)] for r in links]))
    true = joined_roots(np.arange(len(fps)), a, b)
    return f"op1: {int((found[a] == found[b]).sum())} of {len(a)} pairs of different fingerprints within the radius share a group; {int((found != true).sum())} of {len(fps)} fingerprints are in another group than by all pairs"


def toxic_terms(spark, d: str) -> str:
    """Terms fitted on one half of the labels, scored on the other."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").filter("toxic is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    terms = toxicity.fit(docs, labels.filter(half))
    rated = labels.filter(~half).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    got = toxicity.scored(docs, terms).join(rated, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= toxicity.THRESHOLD).alias("hit")).collect()
    by = {r.toxic: r for r in got}
    return f"op3: of the other half, {by[True].hit} of {by[True].n} toxic and {by[False].hit} of {by[False].n} clean documents are flagged"


def neighbours(spark, d: str) -> str:
    rows = table(spark, d, "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    found = ann.nearest_neighbours(table(spark, d, "embeddings")).toPandas().groupby("vec_id")["neighbour_id"].apply(set)
    hits = 0
    for q in np.flatnonzero(ids % ann.EVERY == 0):
        gap = np.square(x - x[q]).sum(axis=1)
        gap[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(gap, kind="stable")[: ann.NEIGHBOURS]]))
    return f"op6: recall at {ann.NEIGHBOURS} of {len(found)} queries against {len(ids)} rows: {hits / len(found) / ann.NEIGHBOURS:.4f}"


def bins(spark, d: str) -> str:
    got = packing.pack(table(spark, d, "documents")).groupBy("bin_id").agg(F.sum("length").alias("n")).agg(F.count("*").alias("bins"), F.sum("n").alias("words")).first()
    return f"op4: {got.bins} bins hold {got.words} words, {1 - got.words / got.bins / packing.CAPACITY:.4f} of their room is left"


def main() -> None:
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("measure", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    for measure in (near_duplicates, toxic_terms, neighbours, bins):
        print(measure(spark, d), flush=True)


if __name__ == "__main__":
    main()
