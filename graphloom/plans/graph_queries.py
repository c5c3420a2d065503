"""Queries of the graph, ranking, resolution and domain operators over the lifted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import name_suffixes
from graphloom.operators import domains as D
from graphloom.operators import graph as G
from graphloom.operators import ranking as K
from graphloom.operators import resolve as V
from graphloom.operators import retrieval as R
from graphloom.plans import sql as S
from graphloom.plans.register import registrar
from graphloom.plans.text_queries import fts_sql
from graphloom.schema import DEFINITIONS, KIND_WEIGHT, ROLE_WEIGHT, STRENGTH, TRUST
from graphloom.sources import lift as L

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
WITH = f"WITH RECURSIVE {S.GRAPH}"
_DEFS = ", ".join(f"'{k}'" for k in DEFINITIONS)


def _case(of: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return L.nodes(s, d), L.edges(s, d)


def _packed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return L.packed(L.nodes(s, d), "id"), L.packed(L.edges(s, d), "source", "target")


def _start(s: SparkSession) -> DataFrame:
    """The node of part 1."""
    return s.createDataFrame([("part::1",)], "k string").select(F.substring(F.sha2("k", 256), 1, 24).alias("id"))


START = "start AS (SELECT substr(sha256('part::1'), 1, 24) AS id)"
#: Edges with references taken for calls, so that test files call something.
USES = "uses AS (SELECT source, target, line FROM edges WHERE kind IN ('calls', 'references'))"


def _uses(edges: DataFrame) -> DataFrame:
    return edges.filter("kind in ('calls', 'references')").withColumn("kind", F.lit("calls"))


@query(f"{WITH} SELECT id, kind, qualified_name, file_path, start_line, end_line, is_exported FROM nodes")
def node_ids(s, d):
    return L.nodes(s, d).select("id", "kind", "qualified_name", "file_path", "start_line", "end_line", "is_exported")


@query(f"{WITH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM roles) AS files")
def stats(s, d):
    nodes, edges = _graph(s, d)
    return G.stats(nodes, edges, L.roles(nodes))


@query(f"{WITH} SELECT source, target, kind, line, provenance, row_number() OVER (PARTITION BY source ORDER BY target, kind, line, provenance)::INT AS pos FROM edges")
def outgoing_ordered(s, d):
    return L.unpacked(G.outgoing(_packed(s, d)[1].select("source", "target", "kind", "line", "provenance")), "source", "target")


@query(f"{WITH} SELECT target, source, line, provenance, row_number() OVER (PARTITION BY target ORDER BY source, kind, line, provenance)::INT AS pos FROM edges WHERE kind = 'calls'")
def incoming_kind_filter(s, d):
    return G.incoming(L.edges(s, d), ("calls",)).select("target", "source", "line", "provenance", "pos")


@query(f"{WITH} SELECT target, source, min(line)::INT AS first_line FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM nodes) GROUP BY target, source")
def callers_distinct(s, d):
    return G.callers(*_graph(s, d))


@query(f"{WITH} SELECT source, target, line, provenance, confidence FROM edges WHERE kind = 'references' AND read_write = 'write'")
def refs_rw(s, d):
    return G.references(L.edges(s, d), "write").select("source", "target", "line", "provenance", "confidence")


@query(f"""{WITH}, u AS (SELECT a.file_path AS file, e.target, b.qualified_name AS name, e.provenance, e.kind,
  row_number() OVER (PARTITION BY a.file_path, e.target ORDER BY e.source DESC, e.kind DESC, e.line DESC, e.provenance DESC) AS rn
  FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind IN ('calls', 'references', 'imports') AND a.file_path <> b.file_path)
SELECT file, target, name, provenance, kind FROM u WHERE rn = 1""")
def deps_last_wins(s, d):
    return L.unpacked(G.dependencies(*_packed(s, d)), "target")


@query(f"""{WITH}, {START}, back AS (SELECT DISTINCT target AS id, source AS via FROM edges WHERE kind IN ('calls', 'references')),
walk(id, depth) AS (SELECT id, 0 FROM start UNION SELECT b.via, depth + 1 FROM walk w JOIN back b ON b.id = w.id WHERE depth < 3)
SELECT w.id, qualified_name, min(depth)::INT AS depth FROM walk w JOIN nodes n ON n.id = w.id WHERE w.id NOT IN (SELECT id FROM start) GROUP BY w.id, qualified_name""")
def impact_depth3(s, d):
    return G.impact(*_graph(s, d), _start(s)).select("id", "qualified_name", "depth")


@query(f"""{WITH}, {START}, {USES}, walk(id, depth) AS (SELECT id, 0 FROM start UNION SELECT u.source, depth + 1 FROM walk w JOIN uses u ON u.target = w.id WHERE depth < 2)
SELECT DISTINCT n.id, qualified_name, file_path, start_line FROM walk w JOIN nodes n ON n.id = w.id JOIN roles r ON r.path = n.file_path AND r.role = 'test'""")
def tests_depth2(s, d):
    nodes, edges = _graph(s, d)
    return G.tests_for(nodes, _uses(edges), L.roles(nodes), _start(s))


_STEP = """near{n} AS (SELECT s.id, turn, way, kind, line FROM steps s JOIN front{p} f ON s.at = f.id WHERE s.id NOT IN (SELECT id FROM in{p}) AND s.id IN (SELECT id FROM nodes)),
first{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, way, kind, line) AS rn FROM near{n}) WHERE rn = 1),
turns{n} AS (SELECT turn, coalesce(sum(count(*)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT count(*) FROM in{p}) AS so_far FROM first{n} GROUP BY turn),
front{n} AS (SELECT f.id, row_number() OVER (ORDER BY turn, way, id, kind, line) + (SELECT count(*) FROM in{p}) AS turn FROM first{n} f
             WHERE turn IN (SELECT turn FROM turns{n} WHERE so_far < 60) AND (SELECT count(*) FROM in{p}) < 60),
in{n} AS (SELECT id, turn FROM in{p} UNION ALL SELECT id, turn FROM front{n})"""


@query(f"""{WITH}, {START}, steps AS (SELECT source AS at, target AS id, 0 AS way, kind, line FROM edges WHERE kind IN ('calls', 'references', 'contains')
  UNION ALL SELECT target, source, 1, kind, line FROM edges WHERE kind IN ('calls', 'contains')),
front0 AS (SELECT id, 1 AS turn FROM start), in0 AS (SELECT id, turn FROM front0),
{_STEP.format(n=1, p=0)}, {_STEP.format(n=2, p=1)} SELECT id, turn::INT AS ord FROM in2""")
def spine_d2(s, d):
    return G.spine(*_graph(s, d), _start(s).withColumn("ord", F.lit(1))).select("id", F.col("ord").cast("int").alias("ord"))


NAMES = ("order.o2", "o3", "v1", "ASIA", "FRANCE", "no_such_thing")
_NAMES = "names(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"


def _names(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n,) for n in NAMES], "name string")


@query(f"""{WITH}, {_NAMES}, m AS (SELECT name, id, qualified_name, row_number() OVER (PARTITION BY name ORDER BY qualified_name <> name, id) AS rn FROM names JOIN nodes
  ON (qualified_name = name OR ends_with(qualified_name, '.' || name)) AND kind NOT IN ('file', 'import', 'unresolved'))
SELECT n.name, m.id IS NOT NULL AS found, m.id, m.qualified_name, CASE WHEN m.id IS NOT NULL THEN (SELECT count(*) FROM edges WHERE kind = 'calls' AND target = m.id) END AS callers
FROM names n LEFT JOIN m ON m.name = n.name AND rn = 1""")
def lookup_exact_suffix(s, d):
    return G.lookup(*_graph(s, d), _names(s))


_MISSING = "no_such_brand supplier thing"


@query(f"WITH {fts_sql(_MISSING)} SELECT id, round(score, 6) AS score FROM fts ORDER BY round(score, 6) DESC, id LIMIT 3")
def lookup_suggestions(s, d):
    return R.top(R.fts(L.nodes(s, d).select("id", F.concat_ws(" ", "qualified_name", "signature").alias("text")), _MISSING), 3)


_INVENTORY = """inv AS (SELECT path, role, language, coalesce(s.n, 0) AS symbols, coalesce(i.n, 0) AS inbound_edges FROM roles
  LEFT JOIN (SELECT file_path, count(*) AS n FROM nodes WHERE kind <> 'file' GROUP BY 1) s ON s.file_path = path
  LEFT JOIN (SELECT b.file_path, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.file_path <> b.file_path GROUP BY 1) i ON i.file_path = path)"""


@query(f"{WITH}, {_INVENTORY} SELECT *, inbound_edges = 0 AND role <> 'entrypoint' AS orphaned FROM inv")
def inventory(s, d):
    nodes, edges = _graph(s, d)
    return G.inventory(nodes, edges, L.roles(nodes))


@query(f"{WITH}, {_INVENTORY.replace('FROM edges e', "FROM (FROM edges WHERE kind = 'contains') e")} SELECT path, symbols FROM inv WHERE inbound_edges = 0 AND role <> 'entrypoint'")
def orphans(s, d):
    """Files that no other file contains anything of."""
    nodes, edges = _graph(s, d)
    return G.inventory(nodes, edges.filter("kind = 'contains'"), L.roles(nodes)).filter("orphaned").select("path", "symbols")


@query(f"{WITH} SELECT event_id, 'v' || event_id AS name FROM events WHERE 'v' || event_id NOT IN (SELECT regexp_extract(qualified_name, '[^.]*$') FROM nodes)")
def stale_mentions(s, d):
    mentions = L.table(s, d, "events").select(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("name"), "event_id")
    return G.stale_mentions(mentions, L.nodes(s, d)).select("event_id", "name")


@query(f"{WITH} SELECT id, kind, CASE WHEN kind = 'interface' THEN 'again ' || signature ELSE signature END AS signature FROM nodes")
def upsert_last_wins(s, d):
    nodes = L.nodes(s, d).withColumn("seq", F.lit(0))
    again = nodes.filter("kind = 'interface'").withColumn("signature", F.concat(F.lit("again "), "signature")).withColumn("seq", F.lit(1))
    return G.upsert_nodes(nodes.unionByName(again)).select("id", "kind", "signature")


@query(f"""{WITH}, gone AS (SELECT min(file_path) AS path FROM nodes WHERE file_path LIKE 'parts/%'), g AS (SELECT id, qualified_name FROM nodes WHERE file_path IN (SELECT path FROM gone)),
dn AS (SELECT e.source, n.file_path AS sfile, '<unresolved>.' || CASE WHEN ends_with(g.qualified_name, '1') THEN replace(g.qualified_name, '.', '$') ELSE g.qualified_name END AS name, e.line
       FROM edges e JOIN g ON g.id = e.target JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls' AND n.file_path NOT IN (SELECT path FROM gone))
SELECT source, substr(sha256(sfile || '::' || name), 1, 24) AS target, name, line FROM dn""")
def downgrade_on_remove(s, d):
    """Calls into the first parts file once it is removed; names ending in 1 are imported under another name."""
    nodes, edges = _graph(s, d)
    gone = nodes.filter("file_path like 'parts/%'").agg(F.min("file_path").alias("path"))
    names = nodes.filter("file_path like 'parts/%' and endswith(qualified_name, '1')").select("qualified_name", "file_path")
    callers = nodes.filter("file_path like 'supply/%'").select(F.col("file_path").alias("file")).distinct()
    imports = callers.crossJoin(names).select(
        "file", F.col("qualified_name").alias("imported_name"), F.translate("qualified_name", ".", "$").alias("local_name"), F.col("file_path").alias("target_file"), F.lit(1).alias("seq")
    )
    left_nodes, left_edges = G.remove_files(nodes, edges, imports, gone)
    found = left_edges.filter("resolver = 'downgraded'").join(left_nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("name")), "target")
    return found.select("source", "target", "name", "line")


_PAIRS = "pairs AS (SELECT a.file_path AS a, b.file_path AS b, count(*) AS weight FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.file_path <> b.file_path GROUP BY 1, 2)"
#: No directory holds more than six of ten files, so the seed is the first segment.
_LABELS = """seg AS (SELECT path, role, split_part(path, '/', 1) AS seg FROM roles), dom AS (SELECT seg AS dominant FROM seg GROUP BY seg HAVING count(*) / (SELECT count(*) FROM seg)::DOUBLE > 0.6),
labels_ AS (SELECT path, role, CASE WHEN seg = (SELECT max(dominant) FROM dom) THEN split_part(path, '/', 2) ELSE seg END AS label FROM seg)"""
_DIRS = """dirs AS (SELECT label, min(regexp_replace(path, '/[^/]*$', '')) AS lo, max(regexp_replace(path, '/[^/]*$', '')) AS hi, count(*) AS n_files, count(*) FILTER (role = 'entrypoint') AS n_entrypoints FROM labels_ GROUP BY label),
lcp AS (SELECT *, array_to_string(list_filter(string_split(lo, '/'), lambda x, i: string_split(lo, '/')[:i] = string_split(hi, '/')[:i]), '/') AS prefix FROM dirs),
named AS (SELECT label, CASE WHEN prefix = '' THEN label ELSE prefix END AS name, n_files, n_entrypoints FROM lcp)"""


@query(f"{WITH}, {_PAIRS} SELECT * FROM pairs")
def file_graph(s, d):
    return G.file_pairs(*_graph(s, d))


@query(f"{WITH}, {_LABELS} SELECT path, label FROM labels_")
def seed_labels(s, d):
    return D.seed_labels(L.roles(L.nodes(s, d)))


@query()
def label_propagation(s, d):
    """Pages and their link targets, from the sites they start in."""
    seeds = L.page_files(s, d).withColumn("role", F.lit("library"))
    return D.propagate(D.seed_labels(seeds), L.page_graph(s, d))


@query(f"{WITH}, {_LABELS}, {_DIRS} SELECT * FROM named")
def domain_lcp_name(s, d):
    roles = L.roles(L.nodes(s, d))
    return D.domains(D.seed_labels(roles), roles)


@query(f"{WITH}, {_LABELS}, {_PAIRS} SELECT x.label AS from_label, y.label AS to_label, sum(weight)::BIGINT AS weight FROM pairs JOIN labels_ x ON x.path = a JOIN labels_ y ON y.path = b WHERE x.label <> y.label GROUP BY 1, 2")
def domain_edges(s, d):
    nodes, edges = _graph(s, d)
    return D.domain_edges(D.seed_labels(L.roles(nodes)), G.file_pairs(nodes, edges))


@query(f"""{WITH}, {_LABELS}, t AS (SELECT label, n.id, count(e.target) AS calls FROM nodes n JOIN labels_ ON path = file_path LEFT JOIN (SELECT target FROM edges WHERE kind = 'calls') e ON e.target = n.id WHERE n.kind <> 'file' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY calls DESC, id)::INT AS position FROM t) WHERE position <= 5""")
def top_symbols_per_domain(s, d):
    nodes, edges = _graph(s, d)
    return D.top_symbols(nodes, edges, D.seed_labels(L.roles(nodes)))


@query(f"{WITH}, r AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY path) AS n FROM roles) SELECT path AS label, CASE WHEN n > 1 THEN name || ' (' || n || ')' ELSE name END AS display FROM r")
def name_collision_suffix(s, d):
    roles = L.roles(L.nodes(s, d))
    return D.display_names(roles.select(F.col("path").alias("label"), F.substring_index("path", "/", -1).alias("name")))


_CENTRAL = "cen AS (SELECT target AS id, count(*) AS centrality FROM edges WHERE kind = 'calls' GROUP BY target)"
_INCIDENT = f"""ends AS (SELECT source AS id, provenance FROM edges UNION ALL SELECT target, provenance FROM edges),
inc AS (SELECT id, max({_case('provenance', STRENGTH)}) AS best, max({_case('provenance', TRUST)}::DOUBLE) AS best_trust FROM ends GROUP BY id)"""


@query(f"{WITH}, {_CENTRAL} SELECT * FROM cen")
def centrality(s, d):
    return L.unpacked(K.centrality(_packed(s, d)[1]), "id")


@query(f"{WITH}, {_INCIDENT} SELECT n.id, greatest(0.4, coalesce(best_trust, 0))::DOUBLE AS trust FROM nodes n LEFT JOIN inc ON inc.id = n.id")
def node_trust(s, d):
    return K.node_trust(*_graph(s, d))


@query(f"{WITH}, {_INCIDENT} SELECT n.id, CASE WHEN best > 0 THEN {_case('best::VARCHAR', {i: repr(p) for p, i in STRENGTH.items()})} ELSE 'ast_inferred' END AS provenance FROM nodes n LEFT JOIN inc ON inc.id = n.id")
def node_provenance_label(s, d):
    return K.node_provenance(*_graph(s, d))


#: Relevance in the ranking queries: the share of an order's or part's price in the greatest of its kind.
_REL = "rel AS (SELECT substr(sha256('part::' || p_partkey), 1, 24) AS id, p_retailprice / (SELECT max(p_retailprice) FROM part) AS score FROM part)"
_RANKED = f"""{_CENTRAL}, {_INCIDENT}, {_REL}, ranked AS (SELECT n.id, n.kind, n.qualified_name, n.signature, n.file_path, n.start_line, coalesce(rel.score, 0) AS relevance, coalesce(cen.centrality, 0) AS centrality,
  round((1 + 3 * coalesce(rel.score, 0)) * (1 + ln(1 + coalesce(cen.centrality, 0))) * (0.4 + 0.6 * greatest(0.4, coalesce(best_trust, 0))) * {_case('n.kind', KIND_WEIGHT, '0.5')} * {_case("coalesce(role, 'library')", ROLE_WEIGHT, '1.0')}, 6)::DOUBLE AS score
  FROM nodes n LEFT JOIN cen ON cen.id = n.id LEFT JOIN inc ON inc.id = n.id LEFT JOIN rel ON rel.id = n.id LEFT JOIN roles ON path = n.file_path WHERE n.kind NOT IN ('file', 'import'))"""


def _ranked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(s, d)
    part = L.table(s, d, "part")
    top = part.agg(F.max("p_retailprice").alias("top"))
    rel = part.crossJoin(F.broadcast(top)).select(F.substring(F.sha2(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")), 256), 1, 24).alias("id"), (F.col("p_retailprice") / F.col("top")).alias("score"))
    return nodes, edges, K.rank_nodes(nodes, edges, L.roles(nodes), rel).withColumn("score", F.round("score", 6))


@query(f"{WITH}, {_RANKED} SELECT id, score, centrality FROM ranked")
def signal_score(s, d):
    return _ranked(s, d)[2].select("id", "score", "centrality")


def _placed(s: SparkSession, d: str) -> DataFrame:
    """The ranked nodes with their attributes, their rank in their file from 1 and the tokens of their signature."""
    nodes, _, ranked = _ranked(s, d)
    full = nodes.join(ranked.select("id", "score"), "id")
    rank = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    return full.withColumn("rank", rank).withColumn("cost", F.ceil(F.char_length("signature") / 4))


_PLACED = f"{_RANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id)::INT AS rank, ceil(length(signature) / 4.0)::BIGINT AS cost FROM ranked)"


@query(f"{WITH}, {_PLACED} SELECT id, file_path, (CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE count(*) OVER (PARTITION BY file_path) - 1 - (rank - 1) // 2 END)::BIGINT AS place FROM placed")
def position_order(s, d):
    size = F.count("*").over(W.partitionBy("file_path"))
    return _placed(s, d).select("id", "file_path", K.position(F.col("rank") - 1, size).cast("long").alias("place"))


@query(f"{WITH}, {_PLACED}, r AS (SELECT *, sum(cost) OVER (PARTITION BY file_path ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM placed) SELECT file_path, id, rank, cost FROM r WHERE run <= 200 OR rank = 1")
def prefix_budget(s, d):
    return K.within_budget(_placed(s, d), ["file_path"], ["rank"], "cost", 200).select("file_path", "id", "rank", "cost")


@query(f"""{WITH}, {_PLACED}, walk AS (SELECT file_path, rank, id, cost, cost AS used, true AS taken FROM placed WHERE rank = 1
  UNION ALL SELECT p.file_path, p.rank, p.id, p.cost, CASE WHEN used + p.cost <= 203 THEN used + p.cost ELSE used END, used + p.cost <= 203 FROM walk w JOIN placed p ON p.file_path = w.file_path AND p.rank = w.rank + 1)
SELECT file_path, id, rank, cost::DOUBLE AS cost FROM walk WHERE taken""")
def greedy_skip_budget(s, d):
    return K.greedy_fit(_placed(s, d), ["file_path"], ["id"], "rank", "cost", 203.0).select("file_path", "id", "rank", "cost")


@query(f"{WITH}, {_PLACED}, k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS rn FROM placed WHERE kind IN ({_DEFS})) SELECT file_path, min(rank)::INT AS first_rank, string_agg(regexp_extract(qualified_name, '[^.]*$'), ', ' ORDER BY rank) AS names FROM k WHERE rn <= 8 GROUP BY file_path")
def map_tier(s, d):
    return K.map_tier(_placed(s, d))


@query(f"{WITH}, {_PLACED} SELECT id, rank, '  ' || file_path || ':' || start_line || '  ' || trim(coalesce(signature, qualified_name)) AS line FROM placed WHERE kind IN ({_DEFS})")
def signature_tier(s, d):
    return K.signature_lines(_placed(s, d))


@query(f"""{WITH}, {USES}, hits AS (SELECT DISTINCT u.target AS id, n.file_path FROM uses u JOIN nodes n ON n.id = u.source JOIN roles r ON r.path = n.file_path AND r.role = 'test'),
h AS (SELECT id, array_to_string(list(file_path ORDER BY file_path)[:3], ', ') AS f FROM hits GROUP BY id) SELECT n.id, coalesce(f, '(none)') AS covered_by FROM nodes n LEFT JOIN h ON h.id = n.id WHERE n.kind IN ({_DEFS})""")
def covered_by(s, d):
    nodes, edges = _graph(s, d)
    return K.covered_by(nodes, _uses(edges), L.roles(nodes))


@query(f"{WITH} SELECT source AS id, count(*) AS sites FROM edges WHERE boundary = 'dynamic-dispatch' AND kind = 'calls' GROUP BY source")
def dynamic_call_sites(s, d):
    return K.dynamic_sites(L.edges(s, d))


@query(f"""{WITH}, files AS (SELECT path FROM roles), specs AS (SELECT path AS file, s.spec AS module_spec, s.base FROM files, (VALUES ('../geo', 'geo'), ('./brand_11.js', 'parts/brand_11.js'), ('../supply/france', 'supply/france'), ('./nothing', 'parts/nothing'), ('react', NULL)) s(spec, base) WHERE path LIKE 'parts/%'),
tried AS (SELECT *, unnest([base, base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '.mts', base || '.cts', base || '.mjs', base || '.cjs', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx', regexp_replace(base, '[.]js$', '.ts'), regexp_replace(base, '[.]js$', '.tsx')]) AS target_file, generate_subscripts(range(15), 1) AS pos FROM specs)
SELECT file, module_spec, arg_min(target_file, pos) AS target_file FROM tried JOIN files f ON f.path = target_file GROUP BY 1, 2""")
def resolve_module_first_match(s, d):
    files = L.roles(L.nodes(s, d)).select("path")
    specs = F.explode(F.array(*[F.lit(x) for x in ("../geo", "./brand_11.js", "../supply/france", "./nothing", "react")])).alias("module_spec")
    return V.resolve_modules(files.filter("path like 'parts/%'").select(F.col("path").alias("file"), specs), files)


@query(f"""{WITH} SELECT e.source, e.target, e.line, CASE WHEN p.is_exported AND e.provenance = 'unresolved' THEN 'ast_inferred' ELSE e.provenance END AS provenance,
CASE WHEN p.is_exported AND e.provenance = 'unresolved' THEN 'import-resolution' ELSE 'lift' END AS resolver FROM edges e JOIN nodes p ON p.id = e.target WHERE e.kind = 'calls'""")
def resolve_imports(s, d):
    """Suppliers' files import every part by name from its file; unresolved calls of exported parts lead there."""
    nodes, edges = _packed(s, d)
    parts = nodes.filter("kind = 'interface'").select("qualified_name", F.concat(F.lit("../"), F.regexp_replace("file_path", r"\.ts$", "")).alias("module_spec"))
    files = nodes.filter("kind = 'struct'").select(F.col("file_path").alias("file")).distinct()
    imports = files.crossJoin(parts).select("file", F.col("qualified_name").alias("local_name"), F.col("qualified_name").alias("imported_name"), "module_spec", F.lit(1).alias("seq"))
    resolved = V.resolve_imports(nodes, edges, imports, L.roles(nodes)).filter("kind = 'calls'").select("source", "target", "line", "provenance", "resolver")
    return L.unpacked(resolved, "source", "target")


@query(f"""{WITH}, sp AS (SELECT id, qualified_name, string_split(qualified_name, '.') AS p FROM nodes) SELECT id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS name FROM sp""")
def name_suffix_index(s, d):
    return L.nodes(s, d).select("id", F.explode(name_suffixes("qualified_name")).alias("name"))


@query("""SELECT page_id, unnest(l) AS target, unnest(range(len(l)))::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)""")
def link_extract(s, d):
    return L.page_links(s, d).select("page_id", "target", "pos")
