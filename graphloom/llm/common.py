"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links up to which components are found in one task, in memory of a few bytes each.
ONE_TASK = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the session's ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests, a laptop) the driver makes a folder of its own, but only in local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not wanted and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(name: str = "text") -> Column:
    """Number of runs of non-white-space characters; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(r"\S+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def joined_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each vertex's root, the least of its component) after joining ``a`` and ``b``."""
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        new = low < high
        if not new.any():
            break
        np.minimum.at(parent, high[new], low[new])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = a[new], b[new]
    return parent


def _union(kind: pa.DataType):
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            names = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks()
            values = names.unique().sort()
            at = pa.compute.index_in(names, values).to_numpy(zero_copy_only=False)
            root = joined_roots(np.arange(len(values)), at[: len(t)], at[len(t) :])
            yield pa.RecordBatch.from_arrays([values, values.take(pa.array(root))], schema=pa.schema([("v", kind), ("root", kind)]))

    return union


def components(links: DataFrame) -> DataFrame:
    """(v, root) of each connected component of links (a, b), root its least vertex.

    Up to ONE_TASK distinct links one task joins them in memory; more go through alternating large-star and small-star rounds.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(edges)
    if before[0] <= ONE_TASK:
        name = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_union({"bigint": pa.int64(), "binary": pa.binary()}[name]), f"v {name}, root {name}")
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.filter("a <> b").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
