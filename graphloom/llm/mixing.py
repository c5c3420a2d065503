"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule gets the point n * phi mod 1 (phi the golden ratio's fractional part, in 32-bit fixed
point), which the cumulative weights map to a source; the slot's rank among that source's slots picks a block.
A source's documents are shuffled by a seeded hash and cut into blocks of ``block_tokens`` words, a document
belonging to the block in which it starts. The schedule ends at the slot that completes the first pass over the
last source to get through; a source with fewer blocks than slots starts over (``epoch``). So every document is
used at least once and every prefix of the schedule keeps the target weights.

Without explicit weights a source's weight is its number of words to the power ``ALPHA``.

Nothing is ordered in one task: running sums and ranks go by hash or slot buckets whose totals are added up
first, so a hot source is spread over all tasks.

Defined cases: a null source is the source ''; null and empty texts count no words and go with the block they
fall in; a null ``doc_id`` hashes as an empty string; repeated rows have the same place in the shuffled order and
each counts; sources without a target weight, or with one of zero or less, are left out; an empty table gives
an empty table; extra columns of any name are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut, word_count

ALPHA = 0.7
BLOCK_TOKENS = 8192
SEED = "mix-1"
#: The golden ratio's fractional part times 2**32.
PHI32, UNIT = 2654435769, 1 << 32
#: Slots beyond the expected number that a source may need: twice the sequence's discrepancy up to 2**32 points.
SLACK = 24
_CELL_BITS, _SLOT_BUCKET = 20, 1 << 16
#: Hexadecimal digits of the shuffled order that make a bucket: 65,536 in each source.
_BUCKET_DIGITS = 4


def _shuffle_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    key = _shuffle_key(seed)
    return docs.select(
        F.struct("*").alias("_mix_row"), F.coalesce("source", F.lit("")).alias("_mix_src"), word_count("text").alias("_mix_tokens"), key.alias("_mix_key"),
        F.substring(key, 1, _BUCKET_DIGITS).alias("_mix_bucket"),
    )


def _offsets(keyed: DataFrame) -> DataFrame:
    """Words before each (source, bucket) and in all of the source."""
    sums = keyed.groupBy("_mix_src", "_mix_bucket").agg(F.sum("_mix_tokens").alias("t"))
    w = W.partitionBy("_mix_src").orderBy("_mix_bucket")
    return sums.select("_mix_src", "_mix_bucket", (F.sum("t").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("t")).alias("_mix_before"), F.sum("t").over(W.partitionBy("_mix_src")).alias("_mix_total"))


def _sources(offsets: DataFrame, weights: dict[str, float] | None, alpha: float, block_tokens: int) -> DataFrame:
    """src, blocks and the half-open interval [lo, hi) of points that fall to each source."""
    s = offsets.groupBy("_mix_src").agg(F.max("_mix_total").alias("total"))
    if weights is None:
        s = s.withColumn("w", F.pow(F.greatest("total", F.lit(1)).cast("double"), F.lit(alpha)))
    else:
        given = s.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "_mix_src string, w double")
        s = s.join(given, "_mix_src").filter("w > 0")
    all_rows = W.partitionBy(F.lit(0))
    by_name = all_rows.orderBy("_mix_src").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("share", F.greatest(F.lit(1), F.floor(F.col("w") / F.sum("w").over(all_rows.orderBy("_mix_src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * UNIT)).cast("long"))
    s = s.withColumn("hi", F.sum("share").over(by_name))
    last = F.col("_mix_src") == F.max("_mix_src").over(all_rows)
    return s.select(
        F.col("_mix_src").alias("src"), F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("long").alias("blocks"), (F.col("hi") - F.col("share")).alias("lo"),
        F.when(last, F.lit(UNIT)).otherwise(F.least("hi", F.lit(UNIT))).cast("long").alias("hi"), "share",
    )


def schedule(sources: DataFrame) -> DataFrame:
    """slot, src, rank (0-based among the source's slots), blocks, up to the slot that completes the last first pass."""
    spark = sources.sparkSession
    need = sources.agg(F.max(F.ceil((F.col("blocks") + SLACK) * F.lit(float(UNIT)) / F.least("share", F.col("hi") - F.col("lo"))))).first()[0]
    slots = spark.range(int(need or 0)).select(F.col("id").alias("slot"), ((F.pmod("id", F.lit(UNIT)) * PHI32) % UNIT).alias("u"))
    cells = sources.select("src", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", _CELL_BITS), F.shiftright(F.col("hi") - 1, _CELL_BITS))).alias("cell"))
    placed = slots.withColumn("cell", F.shiftright("u", _CELL_BITS)).join(cells, "cell").filter("lo <= u and u < hi").select("slot", "src", "blocks", (F.col("slot") / _SLOT_BUCKET).cast("long").alias("part"))
    counts = placed.groupBy("src", "part").agg(F.count("*").alias("c"))
    before = counts.select("src", "part", (F.sum("c").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("b"))
    ranked = placed.join(before, ["src", "part"]).withColumn("rank", F.col("b") + F.row_number().over(W.partitionBy("src", "part").orderBy("slot")) - 1)
    ranked = cut(ranked.select("slot", "src", "rank", "blocks"))
    end = ranked.filter(F.col("rank") == F.col("blocks") - 1).agg(F.max("slot")).first()[0]
    return ranked.filter(F.col("slot") <= (-1 if end is None else end))


def _positions(keyed: DataFrame, offsets: DataFrame, block_tokens: int) -> DataFrame:
    """``keyed`` with the block in which each row starts; rows move once, by (source, bucket)."""
    running = F.sum("_mix_tokens").over(W.partitionBy("_mix_src", "_mix_bucket").orderBy("_mix_key").rowsBetween(W.unboundedPreceding, 0))
    start = F.col("_mix_before") + F.col("_mix_run") - F.col("_mix_tokens")
    placed = keyed.join(offsets, ["_mix_src", "_mix_bucket"]).withColumn("_mix_run", running)
    last = F.greatest(F.lit(0), F.ceil(F.col("_mix_total") / block_tokens) - 1)
    return placed.withColumn("_mix_block", F.least(F.floor(start / block_tokens), last).cast("long"))


def mixed_schedule(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """slot, epoch, source, block, doc_id, tokens: every document at every slot that uses its block."""
    lean = cut(_keyed(docs.select("doc_id", "text", "source"), seed).select(F.col("_mix_row.doc_id").alias("doc_id"), "_mix_src", "_mix_tokens", "_mix_key", "_mix_bucket"))
    offsets = cut(_offsets(lean))
    slots = schedule(cut(_sources(offsets, weights, alpha, block_tokens)))
    slots = slots.select("slot", F.col("src").alias("_mix_src"), F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("_mix_block"))
    placed = _positions(lean, offsets, block_tokens).select("_mix_src", "_mix_block", "doc_id", "_mix_tokens")
    return placed.join(slots, ["_mix_src", "_mix_block"]).select("slot", "epoch", F.col("_mix_src").alias("source"), F.col("_mix_block").alias("block"), "doc_id", F.col("_mix_tokens").alias("tokens"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule uses its block; columns as they were."""
    keyed = _keyed(docs, seed)
    offsets = cut(_offsets(keyed))
    slots = schedule(cut(_sources(offsets, weights, alpha, block_tokens)))
    used = slots.groupBy(F.col("src").alias("_mix_src")).agg(F.count("*").alias("_mix_slots"), F.max("blocks").alias("_mix_blocks"))
    offsets = cut(offsets.join(used, "_mix_src"))
    times = F.expr("_mix_slots div _mix_blocks + if(_mix_block < _mix_slots % _mix_blocks, 1, 0)")
    return (
        _positions(keyed, offsets, block_tokens)
        .select("_mix_row", times.cast("int").alias("times"))
        .filter("times > 0")
        .select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        .select("_mix_row.*")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS tokens,
                  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s0 AS (SELECT source, sum(tokens)::BIGINT AS total, pow(greatest(sum(tokens), 1)::DOUBLE, {ALPHA}) AS w FROM d GROUP BY source),
s1 AS (SELECT source, greatest(1, ceil(total / {BLOCK_TOKENS}))::BIGINT AS blocks, greatest(1, floor(w / (SELECT sum(w) FROM s0) * {UNIT}))::BIGINT AS share FROM s0),
s2 AS (SELECT source, blocks, share, (sum(share) OVER (ORDER BY source))::BIGINT AS hi FROM s1),
s AS (SELECT source, blocks, share, hi - share AS lo, CASE WHEN source = max(source) OVER () THEN {UNIT} ELSE least(hi, {UNIT}) END AS hi FROM s2),
n AS (SELECT unnest(range((SELECT max(ceil((blocks + {SLACK}) * {UNIT}.0 / least(share, hi - lo)))::BIGINT FROM s))) AS slot),
r AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
      FROM (SELECT slot, (slot * {PHI32}) % {UNIT} AS u FROM n) JOIN s ON lo <= u AND u < hi),
f AS (SELECT slot, source, rank // blocks AS epoch, rank % blocks AS block FROM r WHERE slot <= (SELECT max(slot) FROM r WHERE rank = blocks - 1)),
p AS (SELECT d.*, least((sum(tokens) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - tokens) // {BLOCK_TOKENS}, blocks - 1)::BIGINT AS block FROM d JOIN s USING (source))
SELECT slot, epoch::BIGINT AS epoch, source, block, doc_id, tokens FROM p JOIN f USING (source, block)
"""
