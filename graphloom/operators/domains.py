"""Domains: label propagation over the file graph, names, edges between domains, top symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.components import components

ROUNDS = 10
DOMINANT = 0.6


def first_segment(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(".")


def dominant_segment(files: DataFrame) -> DataFrame:
    """One row: the first segment of more than DOMINANT of the code files (path, role), or null."""
    code = files.filter(~F.col("role").isin("config", "doc")).select(first_segment(F.col("path")).alias("seg"))
    counts = code.groupBy("seg").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).filter(F.col("n") / F.col("total") > DOMINANT).agg(F.max("seg").alias("dominant"))


def seed_labels(files: DataFrame) -> DataFrame:
    """path, label: the first segment, below a dominant one the second."""
    path = F.col("path")
    rest = F.regexp_replace(path, r"^[^/]*/", "")
    label = F.when(F.contains(path, F.lit("/")) & (first_segment(path) == F.col("dominant")), F.substring_index(rest, "/", 1)).otherwise(first_segment(path))
    return files.crossJoin(F.broadcast(dominant_segment(files))).select("path", label.alias("label"))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Sequential propagation inside one component: paths in order, each taking its neighbours' heaviest label at once."""
    label = dict(zip(rows["path"], rows["label"]))
    near = {p: list(zip(n, w)) for p, n, w in zip(rows["path"], rows["near"], rows["weight"])}
    order = sorted(label)
    for _ in range(ROUNDS):
        changed = False
        for p in order:
            weights: dict[str, int] = {}
            for q, w in near[p]:
                weights[label[q]] = weights.get(label[q], 0) + int(w)
            if weights:
                best = min(weights, key=lambda x: (-weights[x], x))
                if best != label[p]:
                    label[p], changed = best, True
        if not changed:
            break
    return pd.DataFrame({"path": order, "label": [label[p] for p in order]})


def propagate(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, label after propagation over ``pairs`` (a, b, weight).

    The sweep depends on its order, but never crosses a component of the graph: components are found first and each is swept by
    one task, all of them side by side.
    """
    both = pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = both.filter("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    near = both.groupBy(F.col("a").alias("path")).agg(F.collect_list(F.struct("b", "weight")).alias("n"))
    roots = components(both.select("a", "b"))
    rows = seeds.join(near, "path").join(roots.withColumnRenamed("v", "path"), "path").select("root", "path", "label", F.col("n.b").alias("near"), F.col("n.weight").alias("weight"))
    swept = rows.groupBy("root").applyInPandas(lambda r: _sweep(r), "path string, label string")
    return swept.unionByName(seeds.join(swept.select("path"), "path", "left_anti").select("path", "label"))


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))


def domains(labels: DataFrame, roles: DataFrame) -> DataFrame:
    """label, name, n_files, n_entrypoints; the name is the files' longest common directory, else the label.

    The common prefix of a set is that of its least and greatest directory, so no list of files is needed.
    """
    d = labels.join(roles.select("path", "role"), "path", "left").withColumn("dirs", _directory(F.col("path")))
    g = d.groupBy("label").agg(F.min("dirs").alias("lo"), F.max("dirs").alias("hi"), F.count("*").alias("n_files"), F.count_if(F.col("role") == "entrypoint").alias("n_entrypoints"))
    same = F.zip_with("lo", "hi", lambda a, b: a.isNotNull() & b.isNotNull() & (a == b))
    length = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.least(F.size("lo"), F.size("hi")).cast("long"))
    prefix = F.array_join(F.slice("lo", F.lit(1), length.cast("int")), "/")
    return g.select("label", F.when(prefix == "", F.col("label")).otherwise(prefix).alias("name"), "n_files", "n_entrypoints")


def domain_edges(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """from_label, to_label, weight between different domains."""
    la, lb = labels.select(F.col("path").alias("a"), F.col("label").alias("from_label")), labels.select(F.col("path").alias("b"), F.col("label").alias("to_label"))
    return pairs.join(la, "a").join(lb, "b").filter("from_label <> to_label").groupBy("from_label", "to_label").agg(F.sum("weight").alias("weight"))


def top_symbols(nodes: DataFrame, edges: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """label, position, id of the ``k`` most called symbols of each domain, ties by id."""
    called = edges.filter("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    placed = nodes.filter("kind <> 'file'").select("id", F.col("file_path").alias("path")).join(labels, "path").join(called, "id", "left").select("label", "id", F.coalesce("n", F.lit(0)).alias("calls"))
    return placed.withColumn("position", F.row_number().over(W.partitionBy("label").orderBy(F.desc("calls"), "id"))).filter(F.col("position") <= k)


def display_names(named: DataFrame) -> DataFrame:
    """label, display: a repeated name gets its number among its like, from the second on."""
    n = F.row_number().over(W.partitionBy("name").orderBy("label"))
    return named.select("label", F.when(n > 1, F.concat("name", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("display"))
