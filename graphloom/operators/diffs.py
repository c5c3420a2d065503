"""Unified diffs: reading, ranges of added lines, applying."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NULL = "/dev/null"


def _body(lines: list[str], at: int, old: int, new: int) -> int:
    """Index after a hunk's body: its declared lines, or fewer where the header claims too many."""
    while at < len(lines) and (old > 0 or new > 0):
        line = lines[at]
        mark = line[:1]
        if mark not in ("", " ", "+", "-", "\\"):
            break
        plain_header = line.startswith("--- ") and at + 2 < len(lines) and lines[at + 1].startswith("+++ ") and _HUNK.match(lines[at + 2])
        if plain_header:
            break
        if mark != "\\":
            old -= mark != "+"
            new -= mark != "-"
        at += 1
    while at < len(lines) and lines[at][:1] == "\\":
        at += 1
    return at


def _hunks(lines: list[str]) -> Iterator[tuple[int, int, re.Match]]:
    at = 0
    while at < len(lines):
        m = _HUNK.match(lines[at])
        if m:
            end = _body(lines, at + 1, int(m[2] or 1), int(m[4] or 1))
            yield at, end, m
            at = end
        else:
            at += 1


def parse_diff(text: str) -> list[dict]:
    """[{path, created, deleted, hunks: [{old_start, new_start, lines}]}] of every file with a --- and +++ pair."""
    lines = text.split("\n")
    inside = [False] * len(lines)
    for start, end, _ in _hunks(lines):
        inside[start:end] = [True] * (end - start)
    starts, git = [], False
    for i, line in enumerate(lines):
        if inside[i]:
            continue
        if line.startswith("diff --git "):
            git = True
            starts.append(i)
        elif not git and line.startswith("--- ") and i + 2 < len(lines) and lines[i + 1].startswith("+++ ") and lines[i + 2].startswith("@@ "):
            starts.append(i)
    files = []
    for s, e in zip(starts, [*starts[1:], len(lines)]):
        block = lines[s:e]
        before = after = ""
        at = 0
        for at, line in enumerate(block):
            if line.startswith("--- "):
                before = line[4:].strip()
            elif line.startswith("+++ "):
                after = line[4:].strip()
                break
        if not before or not after:
            continue
        name = before if after == _NULL else after
        body = block[at + 1 :]
        hunks = [{"old_start": int(m[1]), "new_start": int(m[3]), "lines": body[a + 1 : b]} for a, b, m in _hunks(body)]
        files.append({"path": re.sub(r"^[ab]/", "", name, count=1), "created": before == _NULL, "deleted": after == _NULL, "hunks": hunks})
    return files


def apply_hunks(original: str, hunks: list[dict]) -> str:
    """The post-image; ValueError where a context or removed line differs."""
    old = original.split("\n") if original else []
    out, at = [], 0
    for h in hunks:
        start = max(at, h["old_start"] - 1)
        out += old[at:start]
        at = start
        for line in h["lines"]:
            mark, rest = line[:1], line[1:]
            if mark == "\\":
                continue
            if mark == "+":
                out.append(rest)
                continue
            if at >= len(old) or old[at] != rest:
                raise ValueError(f"hunk mismatch at line {at + 1}")
            if mark != "-":
                out.append(rest)
            at += 1
    return "\n".join(out + old[at:])


DIFF_LINES = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("created", T.BooleanType()), ("deleted", T.BooleanType()), ("hunk", T.IntegerType()), ("old_start", T.IntegerType()), ("new_start", T.IntegerType()), ("pos", T.IntegerType()), ("mark", T.StringType()), ("content", T.StringType()))])


def diff_lines(diffs: DataFrame) -> DataFrame:
    """One row for each body line of the diffs in column ``diff``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (f["path"], f["created"], f["deleted"], n, h["old_start"], h["new_start"], p, line[:1], line[1:])
                for text in b["diff"].dropna() for f in parse_diff(text) for n, h in enumerate(f["hunks"]) for p, line in enumerate(h["lines"])
            ]
            yield pd.DataFrame(rows, columns=DIFF_LINES.names)

    return diffs.select("diff").mapInPandas(read, DIFF_LINES)


def added_ranges(lines: DataFrame) -> DataFrame:
    """path, range_start, range_end of runs of added lines in the post-image (gaps and islands)."""
    real = lines.filter("mark <> '\\\\'")
    w = W.partitionBy("path", "hunk").orderBy("pos")
    kept = F.sum(F.when(F.col("mark") == "-", 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    numbered = real.select("path", "hunk", "mark", "pos", (F.col("new_start") + kept - 1).alias("line"), F.row_number().over(w).alias("rn"))
    added = numbered.filter("mark = '+'").withColumn("island", F.col("rn") - F.row_number().over(w))
    return added.groupBy("path", "hunk", "island").agg(F.min("line").alias("range_start"), F.max("line").alias("range_end")).select("path", "range_start", "range_end")


def islands(lines: DataFrame, by: str, line: str) -> DataFrame:
    """``by``, range_start, range_end of runs of consecutive line numbers."""
    w = W.partitionBy(by).orderBy(line)
    return lines.select(by, line).distinct().withColumn("g", F.col(line) - F.row_number().over(w)).groupBy(by, "g").agg(F.min(line).alias("range_start"), F.max(line).alias("range_end")).select(by, "range_start", "range_end")


def apply_all(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """path, post_image, error of every file (path, text) in the diffs; a deleted file has no post-image."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f["path"], f["deleted"], [(h["old_start"], h["lines"]) for h in f["hunks"]]) for t in b["diff"].dropna() for f in parse_diff(t)]
            yield pd.DataFrame(rows, columns=["path", "deleted", "hunks"])

    hunks = T.ArrayType(T.StructType([T.StructField("old_start", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))]))
    parsed = diffs.select("diff").mapInPandas(read, T.StructType([T.StructField("path", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("hunks", hunks)]))

    def patch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    post = None if r.deleted else apply_hunks(r.text or "", [{"old_start": h["old_start"], "lines": list(h["lines"])} for h in r.hunks])
                    out.append((r.path, post, None))
                except ValueError as e:
                    out.append((r.path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "post_image", "error"])

    return parsed.join(files.select("path", "text"), "path", "left").mapInPandas(patch, "path string, post_image string, error string")
