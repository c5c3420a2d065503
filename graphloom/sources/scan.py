"""Folders of source files as a table, and the tables of an index on disk."""

from __future__ import annotations

import json
import posixpath
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import accepted, basename, dirname, in_ignored_dir, language_of, role_of
from graphloom.schema import ANALYZER_VERSION

TABLES = ("nodes", "edges", "files", "imports")
SCANNED = ("path", "language", "text", "hash", "mtime_ms")


def git_paths(root: str) -> list[str] | None:
    """Tracked and new files that git does not ignore; None outside a work tree."""
    if not (Path(root) / ".git").exists():
        return None
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return sorted(p for p in done.stdout.decode("utf-8", "replace").split("\0") if p)


def scan(spark: SparkSession, root: str, use_git: bool = True) -> DataFrame:
    """path, language, text, hash, mtime_ms of the files a scan takes; contents are read by the tasks.

    The size and name tests come before the content column, so refused files are not read.
    """
    base = Path(root).resolve().as_uri().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    rel = F.url_decode(F.substring(uri, len(base) + 1, 1 << 16)) if "%" in base else F.substring(uri, len(base) + 1, 1 << 16)
    found = raw.withColumn("path", rel).filter(accepted(F.col("path"), F.col("length")) & ~in_ignored_dir(F.col("path")))
    listed = git_paths(root) if use_git else None
    if listed is not None:
        found = found.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi")
    return _scanned(found)


def _scanned(found: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8")
    return found.select("path", language_of(F.col("path")).alias("language"), text.alias("text"), F.sha2("content", 256).alias("hash"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"))


def scan_one(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The same of one file; no row if a scan would not take it."""
    raw = spark.read.format("binaryFile").load(str(Path(root) / path)).withColumn("path", F.lit(path))
    return _scanned(raw.filter(accepted(F.col("path"), F.col("length")) & ~in_ignored_dir(F.col("path"))))


def _targets(text: str | None, folder: str) -> list[str]:
    """Files that a package's main, bin and exports name, as paths of the project."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    found, waiting = [data["main"]] if isinstance(data.get("main"), str) else [], [data.get("exports")]
    bins = data.get("bin")
    found += [b for b in (bins.values() if isinstance(bins, dict) else [bins]) if isinstance(b, str)]
    while waiting:
        value = waiting.pop()
        if isinstance(value, str):
            found.append(value)
        elif isinstance(value, (dict, list)):
            waiting += value.values() if isinstance(value, dict) else value
    return sorted({posixpath.normpath(posixpath.join(folder, f)) for f in found})


def entry_targets(packages: DataFrame) -> DataFrame:
    """path of every file that a package.json (dir, text) names as an entry; the walk through exports has no fixed depth."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in _targets(text, d or "")]
            yield pa.RecordBatch.from_pydict({"path": pa.array(found, pa.string())})

    return packages.select("dir", "text").mapInArrow(read, "path string").distinct()


def with_roles(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``files`` and the role of each; manifests name entry points and their folders."""
    packages = files.filter("language = 'manifest'").select(dirname("path").alias("dir"), "text", basename("path").alias("base"))
    entry = entry_targets(packages.filter("lower(base) = 'package.json'"))
    used = imports.groupBy(F.col("file").alias("path")).agg(F.collect_set("module_spec").alias("specs"))
    joined = (
        files.withColumn("dir", dirname("path"))
        .join(entry.withColumn("is_entry", F.lit(True)), "path", "left")
        .join(packages.select("dir").distinct().withColumn("has_manifest", F.lit(True)), "dir", "left")
        .join(used, "path", "left")
    )
    no = F.lit(False)
    role = role_of(F.col("path"), F.col("text"), F.col("language"), F.col("specs"), F.coalesce("is_entry", no), F.coalesce("has_manifest", no))
    return joined.select(*files.columns, role.alias("role"), F.lit(ANALYZER_VERSION).alias("analyzer_version"))


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
