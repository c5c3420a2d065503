"""Queries of change detection, debouncing and change verification over the lifted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify as C
from graphloom.functions import text as X
from graphloom.operators import diffs as P
from graphloom.operators import incremental as I
from graphloom.operators import verify as Y
from graphloom.plans import sql as S
from graphloom.plans.register import registrar
from graphloom.sources import lift as L

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
WITH = f"WITH {S.GRAPH}"
MIDDLE, GAP_SECONDS = "2024-01-15", 6 * 3600

_FEED = "feed AS (SELECT user_id || '/' || event_type AS path, event_id, ts, sha256(props) AS hash FROM events)"


@query(f"""WITH {_FEED}, l AS (SELECT *, lag(ts) OVER w AS wt, lag(hash) OVER w AS wh FROM feed WINDOW w AS (PARTITION BY path ORDER BY ts, event_id))
SELECT path, event_id, CASE WHEN wt IS NULL THEN 'new' WHEN wt = ts THEN 'skipped' WHEN wh = hash THEN 'touched' ELSE 'changed' END AS action FROM l""")
def two_gate_changes(s, d):
    return I.two_gates(L.version_feed(s, d))


@query(f"""WITH {_FEED}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id)) >= {GAP_SECONDS * 1_000_000}::BIGINT THEN 1 ELSE 0 END AS cut FROM feed),
b AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
SELECT path, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM b GROUP BY path, burst""")
def debounce_sessions(s, d):
    return I.debounce(L.version_feed(s, d), GAP_SECONDS)


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What was stored by the middle of the month, and the files saved since."""
    feed = L.version_feed(s, d)
    last = lambda f: f.groupBy("path").agg(F.max_by(F.struct("hash", "ts"), F.struct("ts", "event_id")).alias("v")).select("path", "v.hash", F.unix_micros("v.ts").cast("double").alias("mtime_ms"))
    before = F.col("ts") < F.lit(MIDDLE).cast("timestamp")
    return last(feed.filter(before)).withColumn("analyzer_version", F.lit(1)), last(feed.filter(~before))


_SYNC = f"""{_FEED}, o AS (SELECT path, arg_max(hash, (ts, event_id)) AS hash, arg_max(ts, (ts, event_id)) AS ts FROM feed WHERE ts < TIMESTAMP '{MIDDLE}' GROUP BY path),
n AS (SELECT path, arg_max(hash, (ts, event_id)) AS hash, arg_max(ts, (ts, event_id)) AS ts FROM feed WHERE ts >= TIMESTAMP '{MIDDLE}' GROUP BY path),
acts AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'new' WHEN o.ts = n.ts THEN 'skipped' WHEN o.hash = n.hash THEN 'touched' ELSE 'changed' END AS action
         FROM o FULL OUTER JOIN n ON o.path = n.path)"""
_STATS = "st AS (SELECT count(*) FILTER (action IN ('new', 'changed')) AS reindexed, count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (action IN ('skipped', 'touched')) AS skipped FROM acts)"


@query(f"WITH {_SYNC} SELECT * FROM acts")
def sync_snapshot_diff(s, d):
    return I.sync_actions(*_snapshots(s, d))


@query(f"WITH {_SYNC}, {_STATS} SELECT * FROM st")
def sync_stats(s, d):
    return I.sync_stats(I.sync_actions(*_snapshots(s, d)))


@query(f"WITH {_SYNC}, {_STATS} SELECT CASE WHEN reindexed = 0 AND removed = 0 THEN '# index: fresh' ELSE '# index: ' || reindexed || ' file(s) reindexed, ' || removed || ' removed just now' END AS stamp FROM st")
def freshness_stamp(s, d):
    return I.freshness(I.sync_stats(I.sync_actions(*_snapshots(s, d))))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM l)
SELECT l_orderkey, min(l_linenumber)::INT AS range_start, max(l_linenumber)::INT AS range_end FROM g GROUP BY l_orderkey, g""")
def added_ranges_islands(s, d):
    return P.islands(L.table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


def _changed_ranges(s: SparkSession, d: str) -> DataFrame:
    """The lines that returned items change in the file of their order."""
    lines = L.table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    rank = F.substring("o_orderpriority", 1, 1)
    path = F.when(rank == "1", "tests/urgent_orders.py").otherwise(F.concat(F.lit("orders/p"), rank, F.lit(".py")))
    orders = L.table(s, d, "orders").select("o_orderkey", path.alias("file"))
    at = F.col("o_orderkey") * 10 + F.col("l_linenumber") + 5
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("file", at.cast("int").alias("range_start"), (at + 1).cast("int").alias("range_end")).distinct()


_RANGES = """ranges AS (SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'tests/urgent_orders.py' ELSE 'orders/p' || substr(o_orderpriority, 1, 1) || '.py' END AS file,
  (o_orderkey * 10 + l_linenumber + 5)::INT AS range_start, (o_orderkey * 10 + l_linenumber + 6)::INT AS range_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""
#: A span of nine lines overlaps ranges of its own order and the one before only.
_HIT = "SELECT DISTINCT n.id, n.file_path AS file, n.start_line, n.end_line, n.qualified_name FROM nodes n JOIN ranges r ON r.file = n.file_path AND r.range_start <= n.end_line AND n.start_line <= r.range_end"


@query(f"{WITH}, {_RANGES} SELECT id, file, start_line, end_line FROM ({_HIT})")
def range_overlap(s, d):
    spans = L.nodes(s, d).select("id", F.col("file_path").alias("file"), "start_line", "end_line")
    return Y.overlapping(spans, _changed_ranges(s, d))


@query(f"{WITH}, {_RANGES} SELECT DISTINCT id, file_path AS file, end_line AS line FROM nodes n SEMI JOIN ranges r ON r.file = n.file_path AND n.end_line BETWEEN r.range_start AND r.range_end")
def range_containment(s, d):
    ends = L.nodes(s, d).select("id", F.col("file_path").alias("file"), F.col("end_line").alias("line"))
    return Y.in_ranges(ends, _changed_ranges(s, d))


ALLOWED = ("the", "hello")
#: What every answer calls, too: two symbols of the graph and one that nothing knows.
CALLED = ("FRANCE", "v1", "no_such_symbol")
_PY = ", ".join(f"'{x}'" for x in Y.BUILTINS["python"])
_MENTIONS = f"""turns AS (SELECT conv_id, turn, role, 'chat/' || conv_id || '.py' AS file, {S.basic('text')} AS k FROM conversations WHERE conv_id IS NOT NULL),
asked AS (SELECT DISTINCT file, unnest(k) AS name FROM turns WHERE role = 'user'),
calls AS (SELECT DISTINCT file, turn AS line, unnest(k) AS name FROM turns WHERE role = 'assistant' UNION SELECT DISTINCT file, turn, unnest([{', '.join(map(repr, CALLED))}]) FROM turns WHERE role = 'assistant'),
ends AS (SELECT DISTINCT array_to_string(string_split(qualified_name, '.')[i:], '.') AS name FROM nodes, range(1, 5) t(i) WHERE i <= len(string_split(qualified_name, '.'))),
unknown AS (SELECT CASE WHEN true THEN 'error' END AS severity, 'unknown-symbol' AS rule, file, line, 'call to ''' || name || ''': nothing of this name is known here' AS message FROM calls
  WHERE name NOT IN ({", ".join(repr(a) for a in ALLOWED)}) AND name NOT IN ({_PY}) AND name NOT IN (SELECT name FROM ends) AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.file = calls.file AND a.name = calls.name))"""


def _unknown(s: SparkSession, d: str) -> DataFrame:
    """An answer's words are calls, the questions' words of the same conversation imports."""
    turns = L.table(s, d, "conversations").filter("conv_id is not null").select(F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file"), "turn", "role", X.basic_tokens("text").alias("k"))
    asked = turns.filter("role = 'user'").select("file", F.explode("k").alias("local_name")).distinct()
    more = F.array(*[F.lit(x) for x in CALLED])
    calls = turns.filter("role = 'assistant'").select("file", F.lit("python").alias("language"), F.col("turn").alias("line"), F.explode(F.concat("k", more)).alias("name")).distinct()
    allow = s.createDataFrame([(a,) for a in ALLOWED], "name string")
    return Y.unknown_symbols(calls, L.nodes(s, d), asked, allow)


@query(f"{WITH}, {_MENTIONS} SELECT * FROM unknown")
def unknown_symbol_anti(s, d):
    return _unknown(s, d)


_ECHO = "echo AS (SELECT 'info' AS severity, 'signature-echo' AS rule, a.file_path AS file, e.line, b.qualified_name || ' is ' || coalesce(b.signature, b.qualified_name) || ' at ' || b.file_path || ':' || b.start_line AS message FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind = 'calls' AND e.provenance <> 'unresolved')"


def _echoes(s: SparkSession, d: str) -> DataFrame:
    nodes = L.packed(L.nodes(s, d), "id")
    own = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"))
    calls = L.packed(L.edges(s, d), "source", "target").filter("kind = 'calls' and provenance <> 'unresolved'").join(own, "source").select("file", "line", "target")
    return Y.signature_echoes(calls, nodes)


@query(f"{WITH}, {_ECHO} SELECT * FROM echo")
def signature_echo(s, d):
    return _echoes(s, d)


_BLAST = f"""{_RANGES}, hit AS ({_HIT}), cfiles AS (SELECT DISTINCT file FROM ranges),
by_ AS (SELECT DISTINCT h.id, h.file, h.start_line AS line, h.qualified_name, c.id AS cid, c.file_path AS cf, c.start_line AS cl FROM hit h JOIN edges e ON e.target = h.id AND e.kind = 'calls' JOIN nodes c ON c.id = e.source WHERE c.file_path NOT IN (SELECT file FROM cfiles)),
blast AS (SELECT 'warn' AS severity, 'blast-radius' AS rule, file, line, qualified_name || ' changed, callers outside the change: ' || count(*) || ' (' || array_to_string(list(cf || ':' || cl ORDER BY cf, cl)[:3], ', ') || ')' AS message FROM by_ GROUP BY id, file, line, qualified_name)"""


def _blast(s: SparkSession, d: str) -> DataFrame:
    nodes, ranges = L.packed(L.nodes(s, d), "id"), _changed_ranges(s, d)
    spans = nodes.filter(F.col("kind").isin(*Y.CHANGED_KINDS)).select("id", F.col("file_path").alias("file"), "start_line", "end_line", "qualified_name")
    changed = Y.overlapping(spans, ranges).select("id", "file", F.col("start_line").alias("line"), "qualified_name")
    return Y.blast_radius(changed, nodes, L.packed(L.edges(s, d), "source", "target"), ranges.select("file").distinct())


@query(f"{WITH}, {_BLAST} SELECT * FROM blast")
def blast_radius(s, d):
    return _blast(s, d)


def _findings(s: SparkSession, d: str) -> DataFrame:
    return _unknown(s, d).unionByName(_echoes(s, d)).unionByName(_blast(s, d))


@query(f"{WITH}, {_MENTIONS}, {_ECHO}, {_BLAST} SELECT * FROM unknown UNION ALL SELECT * FROM echo UNION ALL SELECT * FROM blast")
def findings_union(s, d):
    return Y.ordered(_findings(s, d))


@query(f"{WITH}, {_MENTIONS}, {_ECHO}, {_BLAST} SELECT (SELECT count(*) FROM unknown) AS error, (SELECT count(*) FROM blast) AS warn, (SELECT count(*) FROM echo) AS info")
def severity_counts(s, d):
    return Y.severity_counts(_findings(s, d))


@query("""WITH p AS (SELECT path, regexp_extract(lower(path), '[^/]*$') AS base, text FROM (SELECT source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.py' WHEN 'fr' THEN '.test.ts' ELSE '.min.js' END AS path, text FROM documents))
SELECT path, CASE WHEN base LIKE '%.md' THEN 'markdown' WHEN base LIKE '%.py' THEN 'python' WHEN base LIKE '%.ts' THEN 'typescript' ELSE 'javascript' END AS language,
base NOT LIKE '%.min.%' AND octet_length(encode(coalesce(text, ''))) <= 1000000 AS accepted FROM p""")
def language_classify(s, d):
    files = L.table(s, d, "documents").select(_typed_path().alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return files.select("path", C.language_of(F.col("path")).alias("language"), C.accepted(F.col("path"), F.col("size")).alias("accepted"))


def _typed_path():
    """A document's path as a file of a language: the text's own language chooses it."""
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".py").when(F.col("lang") == "fr", ".test.ts").otherwise(".min.js")
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)


#: A script for every document: a class and its caller, a shadowed name, reads, writes and an unknown callee.
_SCRIPT = (
    "class Box{0} {{\n  find(n: number) {{ return n }}\n  save(n: number) {{ return this.find(n) }}\n}}\n"
    "function helper{0}() {{ return {1} }}\n"
    "export function main{0}(a: number) {{\n  const helper{0} = () => a;\n  let x = helper{0}();\n  x = x + {1};\n  x++;\n  const b = new Box{0}();\n  return b.save(x) + missing{0}(x);\n}}\n"
)
#: (source, target, use, provenance, line) of its edges other than containment; {0} is the document's id.
_SCRIPT_EDGES = (
    ("Box{0}.find", "Box{0}.find.n", "read", "ast_exact", 2), ("Box{0}.save", "Box{0}.find", "call", "ast_inferred", 3), ("Box{0}.save", "Box{0}.save.n", "read", "ast_exact", 3),
    ("main{0}", "main{0}.helper{0}", "write", "ast_exact", 7), ("main{0}.helper{0}", "main{0}.a", "read", "ast_exact", 7), ("main{0}", "main{0}.helper{0}", "call", "ast_exact", 8),
    ("main{0}", "main{0}.x", "write", "ast_exact", 8), ("main{0}", "main{0}.x", "write", "ast_exact", 9), ("main{0}", "main{0}.x", "read", "ast_exact", 9), ("main{0}", "main{0}.x", "readwrite", "ast_exact", 10),
    ("main{0}", "main{0}.b", "write", "ast_exact", 11), ("main{0}", "main{0}.b", "read", "ast_exact", 12), ("main{0}", "Box{0}.save", "call", "ast_inferred", 12), ("main{0}", "main{0}.x", "read", "ast_exact", 12), ("main{0}", "<unresolved>.missing{0}", "call", "unresolved", 12),
)
_EDGE_VALUES = ", ".join(f"('{a}', '{b}', '{u}', '{p}', {n})" for a, b, u, p, n in _SCRIPT_EDGES)


@query(f"""SELECT 'scripts/' || doc_id || '.ts' AS path, replace(e.s, '{{0}}', doc_id::VARCHAR) AS source, replace(e.t, '{{0}}', doc_id::VARCHAR) AS target, e.u AS read_write, e.p AS provenance, e.n AS line
FROM documents, (VALUES {_EDGE_VALUES}) e(s, t, u, p, n)""")
def script_edges(s, d):
    """Calls and references of a script rendered for every document, with the names of their ends."""
    from graphloom.sources import extract

    number, size = F.col("doc_id").cast("string"), F.coalesce(F.char_length("text"), F.lit(0)).cast("string")
    text = F.replace(F.replace(F.replace(F.replace(F.lit(_SCRIPT), F.lit("{0}"), number), F.lit("{1}"), size), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    files = L.table(s, d, "documents").select(F.concat(F.lit("scripts/"), number, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("text"))
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)  # given, as the texts are small for the time that they take
    return extract.named_edges(files.repartition(tasks, "path")).filter("kind <> 'contains'").select("path", "source", "target", "read_write", "provenance", "line")


@query("""SELECT doc_id, CASE WHEN regexp_matches(array_to_string(string_split(text, chr(10))[:20], chr(10)), '@generated|DO NOT EDIT') THEN 'generated' WHEN lang = 'fr' THEN 'test'
WHEN starts_with(text, '#!') THEN 'entrypoint' WHEN lang = 'en' THEN 'doc' ELSE 'library' END AS role FROM documents""")
def role_classify(s, d):
    path, no = _typed_path(), F.lit(False)
    none = F.array().cast("array<string>")
    return L.table(s, d, "documents").select("doc_id", C.role_of(path, F.col("text"), C.language_of(path), none, no, no).alias("role"))


@query(f"""WITH {_FEED}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id)) > {GAP_SECONDS * 1_000_000}::BIGINT THEN 1 ELSE 0 END AS cut FROM feed),
b AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
SELECT path, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM b GROUP BY path, burst HAVING max(ts) + INTERVAL {GAP_SECONDS} SECOND <= (SELECT max(ts) FROM feed) - INTERVAL 1 HOUR""")
def stream_debounce(s, d):
    """The bursts that a stream over the events has closed by the end of its input."""
    from graphloom.streaming import watch

    return watch.run_once(watch.debounced(watch.event_stream(s, d))).select("path", "event_id", "n_events")
