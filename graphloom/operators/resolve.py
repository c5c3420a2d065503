"""Module paths and imports across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import dirname, normalize_path
from graphloom.session import cut, few

_TRY = ("", *(f".{e}" for e in ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")))
_INDEX = tuple(f"/index.{e}" for e in ("ts", "tsx", "js", "jsx"))
#: Source extensions that an emitted extension may stand for.
_SOURCE = {".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",), ".js": (".ts", ".tsx")}


def candidates(file: Column, spec: Column) -> Column:
    """Paths that a relative specifier may mean, first choice first; null for a bare one."""
    base = normalize_path(F.concat_ws("/", dirname(file), spec))
    literal = F.array(*[F.concat(base, F.lit(x)) for x in (*_TRY, *_INDEX)])
    other = F.array().cast("array<string>")
    for ext, sources in _SOURCE.items():
        stem = F.substring(base, F.lit(1), F.char_length(base) - len(ext))
        other = F.when(base.endswith(ext), F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(other)
    return F.when(spec.startswith("."), F.concat(literal, other))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, module_spec, target_file of the specifiers (file, module_spec) that mean a file (path); first choice wins."""
    specs = imports.select("file", "module_spec").distinct()
    tried = specs.select("file", "module_spec", F.posexplode(candidates(F.col("file"), F.col("module_spec"))).alias("pos", "path"))
    return tried.join(files.select("path"), "path").groupBy("file", "module_spec").agg(F.min_by("path", "pos").alias("target_file"))


def resolve_imports(nodes: DataFrame, edges: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """All edges; unresolved calls of an imported, exported symbol lead to it as ast_inferred.

    The first import row (seq) of the local name counts; a default import needs a file with one export; namespace imports stay.
    """
    # dealt before they are grouped: else a task would sort all the import rows that it makes; the modules are few beside them
    dealt = imports.select("file", "local_name", "imported_name", "module_spec", "seq").repartition("file", "local_name")
    first = dealt.groupBy("file", "local_name").agg(F.min_by(F.struct("imported_name", "module_spec"), "seq").alias("i")).select("file", "local_name", "i.*").filter("imported_name <> '*'")
    placed = first.join(few(cut(resolve_modules(imports, files))), ["file", "module_spec"])
    exported = nodes.filter("is_exported").select(F.col("file_path").alias("target_file"), F.col("qualified_name").alias("imported_name"), F.col("id").alias("new_target"))
    single = exported.groupBy("target_file").agg(F.count("*").alias("n"), F.max("new_target").alias("new_target")).filter("n = 1").select("target_file", F.lit("default").alias("imported_name"), "new_target")
    exported = exported.filter("imported_name <> 'default'").unionByName(single).groupBy("target_file", "imported_name").agg(F.max("new_target").alias("new_target"))
    goal = placed.join(exported, ["target_file", "imported_name"]).select("file", "local_name", "new_target")
    src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"))
    callee = nodes.select(F.col("id").alias("target"), F.regexp_replace("qualified_name", r"^<unresolved>\.", "").alias("local_name"))
    open_calls = edges.filter("kind = 'calls' and provenance = 'unresolved'").join(src, "source").join(callee, "target").join(goal, ["file", "local_name"])
    keys = ["source", "target", "line", "col"]
    new = open_calls.select(*keys, "new_target").distinct()
    joined = edges.join(new, keys, "left")
    hit = F.col("new_target").isNotNull() & (F.col("kind") == "calls") & (F.col("provenance") == "unresolved")
    return joined.select(
        "source", F.when(hit, F.col("new_target")).otherwise(F.col("target")).alias("target"), "kind", "line", "col", F.when(hit, "ast_inferred").otherwise(F.col("provenance")).alias("provenance"),
        F.when(hit, 0.9).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, "import-resolution").otherwise(F.col("resolver")).alias("resolver"), "read_write",
        F.when(hit, F.create_map(F.lit("crossFile"), F.lit("true"))).otherwise(F.col("metadata")).alias("metadata"),
    )
