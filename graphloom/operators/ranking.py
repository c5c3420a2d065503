"""Ranking of nodes and selection under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.schema import DEFINITIONS, KIND_WEIGHT, ROLE_WEIGHT, STRENGTH, TRUST, lookup, strength, trust

BALANCE = {"map": 0.15, "signatures": 0.25, "detail": 0.6}
TEST_INTENT = r"(?i)\b(test|spec|coverage)s?\b"


def centrality(edges: DataFrame) -> DataFrame:
    """id, centrality: call sites into each node."""
    return edges.filter("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("centrality"))


def incident(edges: DataFrame) -> DataFrame:
    """id, best: the greatest strength of the provenances at each node; one pass over the edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), strength(F.col("provenance")).alias("s"), trust(F.col("provenance")).alias("t"))
    return ends.groupBy("id").agg(F.max("s").alias("best"), F.max("t").alias("best_trust"))


def node_trust(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    t = F.when(F.col("kind") == "unresolved", TRUST["unresolved"]).otherwise(F.greatest(F.lit(0.4), F.coalesce("best_trust", F.lit(0.0))))
    return nodes.select("id", "kind").join(incident(edges), "id", "left").select("id", t.alias("trust"))


def node_provenance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, provenance: the strongest at the node; ast_inferred where nothing better than unresolved is."""
    name = lookup({i: p for p, i in STRENGTH.items()}, F.col("best"))
    p = F.when(F.col("kind") == "unresolved", "unresolved").when(F.col("best") > 0, name).otherwise("ast_inferred")
    return nodes.select("id", "kind").join(incident(edges), "id", "left").select("id", p.alias("provenance"))


def signal_score(relevance: Column, central: Column, trusted: Column, kind: Column, role: Column, test_intent: bool = False) -> Column:
    weight = lookup(ROLE_WEIGHT, role, 1.0)
    if test_intent:
        weight = F.when(role == "test", 1.0).otherwise(weight)
    return (1 + 3 * relevance) * (1 + F.ln(1 + central)) * (0.4 + 0.6 * trusted) * lookup(KIND_WEIGHT, kind, 0.5) * weight


def rank_nodes(nodes: DataFrame, edges: DataFrame, roles: DataFrame, relevance: DataFrame, test_intent: bool = False) -> DataFrame:
    """id, score, relevance, centrality, trust of the nodes that are neither files nor imports."""
    base = nodes.filter(~F.col("kind").isin("file", "import")).select("id", "kind", "file_path")
    joined = (
        base.join(centrality(edges), "id", "left")
        .join(incident(edges), "id", "left")
        .join(relevance.select("id", F.col("score").alias("relevance")), "id", "left")
        .join(roles.select(F.col("path").alias("file_path"), "role"), "file_path", "left")
    )
    t = F.when(F.col("kind") == "unresolved", 0.0).otherwise(F.greatest(F.lit(0.4), F.coalesce("best_trust", F.lit(0.0))))
    full = joined.select("id", "kind", F.coalesce("role", F.lit("library")).alias("role"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.coalesce("centrality", F.lit(0)).alias("centrality"), t.alias("trust"))
    return full.withColumn("score", signal_score(F.col("relevance"), F.col("centrality"), F.col("trust"), F.col("kind"), F.col("role"), test_intent)).select("id", "score", "relevance", "centrality", "trust")


def position(index: Column, size: Column) -> Column:
    """Where the item of best-first ``index`` (from 0) of ``size`` goes: even ones from the front, odd ones from the back."""
    half = F.floor(index / 2)
    return F.when(index % 2 == 0, half).otherwise(size - 1 - half)


def within_budget(ranked: DataFrame, by: list[str], order: list, cost: str, budget: Column | float) -> DataFrame:
    """The longest prefix of each group whose costs fit; the first row always does."""
    w = W.partitionBy(*by).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return ranked.withColumn("_run", running).withColumn("_rn", F.row_number().over(w)).filter((F.col("_run") <= b) | (F.col("_rn") == 1)).drop("_run", "_rn")


def greedy_fit(ranked: DataFrame, by: list[str], item: list[str], rank: str, cost: str, budget: float) -> DataFrame:
    """Rows of each group taken in rank order, those that no longer fit skipped; the first always taken.

    A group passes through one task row by row, sorted on the way; no more than a batch of it is held.
    """
    item = [i for i in item if i not in by]
    columns = [*by, *item, rank, F.col(cost).cast("double").alias(cost)]
    rows = ranked.select(*columns).repartition(*by).sortWithinPartitions(*by, rank, *item)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0.0
        for batch in batches:
            costs, keep = batch.column(cost).to_pylist(), []
            for key, c in zip(zip(*(batch.column(b).to_pylist() for b in by)), costs):
                first = key != now
                now, used = key, 0.0 if first else used
                keep.append(first or used + c <= budget)
                used += c * keep[-1]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(fit, rows.schema)


def map_tier(ranked: DataFrame, most: int = 8) -> DataFrame:
    """file_path, first_rank, names: the short names of up to ``most`` definitions of each file in rank order (rank from 1)."""
    short = F.substring_index("qualified_name", ".", -1)
    w = W.partitionBy("file_path").orderBy("rank")
    kept = ranked.filter(F.col("kind").isin(*DEFINITIONS)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return kept.groupBy("file_path").agg(F.min("rank").alias("first_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", short.alias("s")))), lambda x: x["s"]), ", ").alias("names"))


def signature_lines(ranked: DataFrame) -> DataFrame:
    """id, rank, line of the definitions."""
    line = F.concat(F.lit("  "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("  "), F.trim(F.coalesce("signature", "qualified_name")))
    return ranked.filter(F.col("kind").isin(*DEFINITIONS)).select("id", "rank", line.alias("line"))


def covered_by(nodes: DataFrame, edges: DataFrame, roles: DataFrame, most: int = 3) -> DataFrame:
    """id, covered_by: up to ``most`` test files whose nodes call a definition, else (none)."""
    tests = roles.filter("role = 'test'").select(F.col("path").alias("file_path"))
    by = nodes.join(tests, "file_path", "left_semi").select(F.col("id").alias("source"), "file_path")
    hits = edges.filter("kind = 'calls'").join(by, "source").select(F.col("target").alias("id"), "file_path").distinct()
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("file_path"))).filter(F.col("r") <= most)
    hits = best.groupBy("id").agg(F.array_sort(F.collect_list("file_path")).alias("f"))
    names = F.when(F.col("f").isNull(), "(none)").otherwise(F.array_join("f", ", "))
    return nodes.filter(F.col("kind").isin(*DEFINITIONS)).select("id").join(hits, "id", "left").select("id", names.alias("covered_by"))


def dynamic_sites(edges: DataFrame) -> DataFrame:
    """id, sites: outgoing calls that end at a dynamic dispatch."""
    return edges.filter("kind = 'calls' and metadata['boundary'] = 'dynamic-dispatch'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("sites"))
