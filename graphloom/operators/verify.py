"""Checks of a change against the graph: four rules over an overlay, one table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import name_suffixes
from graphloom.schema import lookup
from graphloom.session import cut, few

_SCRIPT = tuple("Array Boolean Date Error JSON Map Math Number Object Promise RegExp Set String Symbol clearInterval clearTimeout console fetch isNaN parseFloat parseInt require setInterval setTimeout structuredClone".split())
BUILTINS: dict[str, tuple[str, ...]] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": tuple("append cap clear close copy delete len make max min new panic print println recover".split()),
    "python": tuple("Exception TypeError ValueError dict enumerate filter float getattr hasattr int isinstance len list map open print range set setattr sorted str super tuple type zip".split()),
}
CHANGED_KINDS = ("class", "function", "interface", "method")
FINDING = ("severity", "rule", "file", "line", "message")
SKIPPED_ROLES = ("generated", "vendored")


def allow_list(spark, path: str, more: tuple[str, ...] = ()) -> DataFrame:
    """name: the lines of an allow file without comments and blanks, and ``more``."""
    with open(path, encoding="utf-8") as lines:  # a settings file; Spark's readers pass over names that start with a dot
        names = [x for line in lines if (x := line.partition("#")[0].strip())]
    return spark.createDataFrame([(n,) for n in dict.fromkeys([*names, *more])], "name string")


def in_ranges(rows: DataFrame, ranges: DataFrame, line: str = "line", bin_size: int = 64) -> DataFrame:
    """Rows (file, line) inside a range (file, range_start, range_end); an equality join on line bins."""
    bins = ranges.select("file", "range_start", "range_end", F.explode(F.sequence(F.floor(F.col("range_start") / bin_size), F.floor(F.col("range_end") / bin_size))).alias("bin"))
    keyed = rows.withColumn("bin", F.floor(F.col(line) / bin_size))
    return keyed.join(bins, (keyed["file"] == bins["file"]) & (keyed["bin"] == bins["bin"]) & (keyed[line] >= bins["range_start"]) & (keyed[line] <= bins["range_end"]), "left_semi").drop("bin")


def overlapping(spans: DataFrame, ranges: DataFrame, bin_size: int = 64) -> DataFrame:
    """Spans (file, start_line, end_line, ...) that overlap a range of their file; both sides binned."""
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size))).alias("bin")
    left = spans.withColumn("sid", F.xxhash64(*spans.columns))
    l, r = left.select("sid", "file", "start_line", "end_line", cover("start_line", "end_line")), ranges.select("file", "range_start", "range_end", cover("range_start", "range_end"))
    hit = l.join(r, ["file", "bin"]).filter("start_line <= range_end and range_start <= end_line").select("sid").distinct()
    return left.join(hit, "sid", "left_semi").drop("sid")


def unknown_symbols(calls: DataFrame, nodes: DataFrame, imports: DataFrame, allow: DataFrame) -> DataFrame:
    """Findings for unresolved calls (file, language, line, name) of names that nothing knows; the suffix match is an equality."""
    builtin = F.coalesce(lookup_builtin(), F.array().cast("array<string>"))
    left = calls.join(allow.select("name"), "name", "left_anti").join(imports.select("file", F.col("local_name").alias("name")), ["file", "name"], "left_anti")
    left = cut(left.filter(~F.array_contains(builtin, F.col("name"))))
    ends = nodes.filter("kind <> 'unresolved'").select(F.explode(name_suffixes("qualified_name")).alias("name"))
    known = cut(ends.join(few(cut(left.select("name").distinct())), "name", "left_semi").distinct())  # of all ends only those that are called move
    left = left.join(few(known), "name", "left_anti")
    severity = F.when(F.col("language").isin(*sorted(BUILTINS)), "error").otherwise("info")
    text = F.concat(F.lit("call to '"), "name", F.lit("': nothing of this name is known here"))
    return left.select(severity.alias("severity"), F.lit("unknown-symbol").alias("rule"), "file", "line", text.alias("message"))


def lookup_builtin():
    return F.try_element_at(F.create_map(*[x for k, v in sorted(BUILTINS.items()) for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]), F.col("language"))


def signature_echoes(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings for resolved calls (file, line, target): the callee's signature and place."""
    to = nodes.select(F.col("id").alias("target"), "qualified_name", F.coalesce("signature", "qualified_name").alias("sig"), "file_path", "start_line")
    text = F.concat("qualified_name", F.lit(" is "), "sig", F.lit(" at "), "file_path", F.lit(":"), F.col("start_line").cast("string"))
    return calls.join(to, "target").select(F.lit("info").alias("severity"), F.lit("signature-echo").alias("rule"), "file", "line", text.alias("message"))


def blast_radius(changed: DataFrame, nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Findings for changed definitions (id, file, line, qualified_name) with callers in files outside the change."""
    files = few(cut(changed_files.select(F.col("file").alias("file_path"))))
    outside = nodes.join(files, "file_path", "left_anti").select(F.col("id").alias("source"), F.col("file_path").alias("cf"), F.col("start_line").alias("cl"))
    calls = edges.filter("kind = 'calls'").select("source", F.col("target").alias("id"))
    each = calls.join(changed, "id").distinct().join(outside, "source")  # distinct where the join has dealt them by id already
    w = W.partitionBy("id")
    ranked = each.withColumn("r", F.row_number().over(w.orderBy("cf", "cl", "source"))).withColumn("n", F.count("*").over(w))
    by = ranked.filter(F.col("r") <= 3).groupBy("id", "file", "line", "qualified_name").agg(F.array_sort(F.collect_list(F.struct("cf", "cl"))).alias("c"), F.first("n").alias("n"))
    some = F.array_join(F.transform("c", lambda x: F.concat(x["cf"], F.lit(":"), x["cl"].cast("string"))), ", ")
    text = F.concat("qualified_name", F.lit(" changed, callers outside the change: "), F.col("n").cast("string"), F.lit(" ("), some, F.lit(")"))
    return by.select(F.lit("warn").alias("severity"), F.lit("blast-radius").alias("rule"), "file", "line", text.alias("message"))


def parse_failures(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings for files (file, text, has_extractor) with text but no symbol and no edge."""
    own = nodes.filter("kind <> 'file'").select(F.col("file_path").alias("file"))
    linked = edges.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file")), "source").select("file")
    empty = files.filter("has_extractor and length(text) > 0").join(own.unionByName(linked), "file", "left_anti")
    return empty.select(F.lit("error").alias("severity"), F.lit("parse-failure").alias("rule"), "file", F.lit(1).alias("line"), F.concat("file", F.lit(" gave no symbols, its syntax may be wrong")).alias("message"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "rule", "message")


def severity_counts(findings: DataFrame) -> DataFrame:
    s = F.col("severity")
    return findings.agg(*[F.count_if(s == x).alias(x) for x in ("error", "warn", "info")])
