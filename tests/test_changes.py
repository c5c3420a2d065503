import datetime as dt

import pytest

from graphloom.operators import diffs as P
from graphloom.operators import incremental as I
from graphloom.operators import verify as Y
from graphloom.streaming import watch

DIFF = """diff --git a/a.txt b/a.txt
--- a/a.txt
+++ b/a.txt
@@ -1,3 +1,4 @@
 one
+new
 two
 three
@@ -5,2 +6,3 @@
 five
+x
 six
diff --git a/new.txt b/new.txt
--- /dev/null
+++ b/new.txt
@@ -0,0 +1,2 @@
+hello
+world
diff --git a/old.txt b/old.txt
--- a/old.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
"""
TEXT = "one\ntwo\nthree\nfour\nfive\nsix"


def test_diff_is_read_and_applied(spark):
    files = {f["path"]: f for f in P.parse_diff(DIFF)}
    assert files["new.txt"]["created"] and files["old.txt"]["deleted"] and len(files["a.txt"]["hunks"]) == 2
    assert P.apply_hunks(TEXT, files["a.txt"]["hunks"]) == "one\nnew\ntwo\nthree\nfour\nfive\nx\nsix"
    with pytest.raises(ValueError):
        P.apply_hunks("other", files["a.txt"]["hunks"])
    diffs = spark.createDataFrame([(DIFF,), (None,)], "diff string")
    ranges = {(r.path, r.range_start, r.range_end) for r in P.added_ranges(P.diff_lines(diffs)).collect()}
    assert ranges == {("a.txt", 2, 2), ("a.txt", 7, 7), ("new.txt", 1, 2)}
    stored = spark.createDataFrame([("a.txt", "wrong"), ("old.txt", "bye")], "path string, text string")
    got = {r.path: (r.post_image, r.error is not None) for r in P.apply_all(stored, diffs).collect()}
    assert got == {"a.txt": (None, True), "new.txt": ("hello\nworld", False), "old.txt": (None, False)}


def test_declared_counts_may_be_wrong():
    text = "--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n a\n--- not a header\n+b\n"
    assert len(P.parse_diff(text)) == 1


def test_unknown_symbols(spark):
    calls = spark.createDataFrame([("a.py", "python", 1, n) for n in ("known", "print", "imported", "allowed", "ghost")] + [("a.rs", "rust", 2, "ghost")], "file string, language string, line int, name string")
    nodes = spark.createDataFrame([("m.known", "function"), ("<unresolved>.ghost", "unresolved")], "qualified_name string, kind string")
    imports = spark.createDataFrame([("a.py", "imported")], "file string, local_name string")
    allow = spark.createDataFrame([("allowed",)], "name string")
    got = {(r.file, r.severity) for r in Y.unknown_symbols(calls, nodes, imports, allow).collect()}
    assert got == {("a.py", "error"), ("a.rs", "info")}


def test_ranges(spark):
    ranges = spark.createDataFrame([("a", 10, 200)], "file string, range_start int, range_end int")
    rows = spark.createDataFrame([("a", 9), ("a", 10), ("a", 200), ("a", 201), ("b", 20)], "file string, line int")
    assert sorted(r.line for r in Y.in_ranges(rows, ranges).collect()) == [10, 200]
    spans = spark.createDataFrame([("a", 1, 9), ("a", 1, 10), ("a", 200, 300), ("a", 201, 300)], "file string, start_line int, end_line int")
    assert sorted((r.start_line, r.end_line) for r in Y.overlapping(spans, ranges).collect()) == [(1, 10), (200, 300)]


def test_sync_actions(spark):
    stored = spark.createDataFrame([("same", "h", 1.0, 1), ("touched", "h", 1.0, 1), ("changed", "h", 1.0, 1), ("gone", "h", 1.0, 1), ("old", "h", 1.0, 0)], "path string, hash string, mtime_ms double, analyzer_version int")
    scanned = spark.createDataFrame([("same", "x", 1.0), ("touched", "h", 2.0), ("changed", "x", 2.0), ("new", "h", 1.0), ("old", "h", 1.0)], "path string, hash string, mtime_ms double")
    got = {r.path: r.action for r in I.sync_actions(stored, scanned).collect()}
    assert got == {"same": "skipped", "touched": "touched", "changed": "changed", "gone": "removed", "new": "new", "old": "changed"}


def test_debounce_batch_and_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, at(h), u, "click", 1.0, '{"k": %d}' % i) for i, (u, h) in enumerate([(1, 0), (1, 2), (1, 20), (2, 1), (3, 200)])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    feed = events.selectExpr("concat(user_id, '/', event_type) as path", "event_id", "cast(ts as timestamp) as ts", "props as hash")
    batch = {(r.path, r.event_id, r.n_events) for r in I.debounce(feed, 6 * 3600).collect()}
    assert batch == {("1/click", 1, 2), ("1/click", 2, 1), ("2/click", 3, 1), ("3/click", 4, 1)}
    stream = watch.run_once(watch.debounced(watch.event_stream(spark, str(tmp_path / "events.parquet"), "*.parquet")))
    closed = {(r.path, r.event_id, r.n_events) for r in stream.collect()}
    assert closed <= batch and ("1/click", 1, 2) in closed
