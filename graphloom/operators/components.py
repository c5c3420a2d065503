"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of (a, b): alternating large-star and small-star rounds, lineage cut after each."""
    pairs = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
    last = mark(pairs)
    while last[0]:
        ways = pairs.select("hi", "lo").union(pairs.select("lo", "hi")).toDF("u", "w")
        low = ways.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = ways.filter("w > u").join(low, "u").select(F.col("w").alias("u"), "m").filter("u <> m").distinct()
        low = far.groupBy("u").agg(F.min("m").alias("k"))
        near = far.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("k").alias("lo")), F.struct(F.col("m").alias("hi"), F.col("k").alias("lo")))).alias("e"))
        pairs = cut(near.select("e.hi", "e.lo").filter("hi <> lo").distinct())
        now = mark(pairs)
        if now == last:
            break
        last = now
    return pairs.select(F.col("hi").alias("v"), F.col("lo").alias("root")).union(pairs.select("lo", "lo").distinct())
