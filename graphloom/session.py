"""Session defaults and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "graphloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see; one of our own only where none is set, in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes of input up to which rows are dealt out anew.
SMALL_INPUT = 1 << 28


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt out to all cores, as a file of one row group is one task however long it takes; a large one as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an id and a number or two up to which a table is broadcast; beyond, it is joined by shuffle.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """A table that has been cut, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
