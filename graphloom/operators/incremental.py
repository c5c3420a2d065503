"""Change detection between snapshots and along version feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sync_actions(stored: DataFrame, scanned: DataFrame, version: int = 1) -> DataFrame:
    """path, action of every path of either side: removed, new, skipped (same version and time), touched (same hash), changed."""
    s = stored.select("path", F.col("hash").alias("old_hash"), F.col("mtime_ms").alias("old_time"), F.col("analyzer_version").alias("v"))
    n = scanned.select("path", "hash", "mtime_ms")
    fresh = F.coalesce(F.col("v") == version, F.lit(False))
    action = (
        F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "new").when(fresh & F.col("old_time").eqNullSafe(F.col("mtime_ms")), "skipped")
        .when(fresh & F.col("old_hash").eqNullSafe(F.col("hash")), "touched").otherwise("changed")
    )
    return s.withColumn("in_old", F.lit(1)).join(n.withColumn("in_new", F.lit(1)), "path", "full_outer").select("path", action.alias("action"))


def sync_stats(actions: DataFrame) -> DataFrame:
    a = F.col("action")
    return actions.agg(F.count_if(a.isin("new", "changed")).alias("reindexed"), F.count_if(a == "removed").alias("removed"), F.count_if(a.isin("skipped", "touched")).alias("skipped"))


def freshness(stats: DataFrame) -> DataFrame:
    r, m = F.col("reindexed"), F.col("removed")
    text = F.concat(F.lit("# index: "), r.cast("string"), F.lit(" file(s) reindexed, "), m.cast("string"), F.lit(" removed just now"))
    return stats.select(F.when((r == 0) & (m == 0), "# index: fresh").otherwise(text).alias("stamp"))


def two_gates(feed: DataFrame) -> DataFrame:
    """Each version of a path against the one before: new, skipped (same time), touched (same hash) or changed."""
    w = W.partitionBy("path").orderBy("ts", "event_id")
    was_time, was_hash = F.lag("ts").over(w), F.lag("hash").over(w)
    return feed.select("path", "event_id", F.when(was_time.isNull(), "new").when(was_time == F.col("ts"), "skipped").when(was_hash == F.col("hash"), "touched").otherwise("changed").alias("action"))


def debounce(feed: DataFrame, gap_seconds: int) -> DataFrame:
    """path, event_id, n_events: the last event of every burst whose events are less than the gap apart."""
    w = W.partitionBy("path").orderBy("ts", "event_id")
    apart = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) >= gap_seconds * 1_000_000
    burst = F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return feed.withColumn("burst", burst).groupBy("path", "burst").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events")).select("path", "event_id", "n_events")
