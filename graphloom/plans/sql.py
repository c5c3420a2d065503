"""DuckDB SQL shared by the oracles: the lifts and the token functions."""

from __future__ import annotations

from graphloom.functions.text import LEXICON, STOP_WORDS

_KEY = "substr(sha256('{0}::' || {1}), 1, 24)"
ID = {t: _KEY.format(t, k) for t, k in {"region": "{0}", "nation": "{0}", "customer": "{0}", "supplier": "{0}", "order": "{0}", "part": "{0}"}.items()}


def nid(kind: str, key: str) -> str:
    return f"substr(sha256('{kind}::' || {key}), 1, 24)"


GRAPH = f"""
nodes AS (
  SELECT {nid('region', 'r_regionkey')} AS id, 'module' AS kind, r_name AS qualified_name, 'geo/index.ts' AS file_path, 'typescript' AS language,
         (r_regionkey + 1)::INT AS start_line, (r_regionkey + 1)::INT AS end_line, 'region ' || r_name AS signature, NULL::VARCHAR AS docstring, true AS is_exported FROM region
  UNION ALL SELECT {nid('nation', 'n_nationkey')}, 'module', r_name || '.' || n_name, 'geo/' || lower(r_name) || '/nations.ts', 'typescript', (n_nationkey + 1)::INT, (n_nationkey + 1)::INT,
         'nation ' || n_name, NULL, true FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {nid('customer', 'c_custkey')}, 'class', n_name || '.' || c_name, 'sales/' || lower(n_name) || '/' || lower(c_mktsegment) || '.py', 'python', (c_custkey + 1)::INT, (c_custkey + 6)::INT,
         'class ' || c_name || '(' || c_mktsegment || ')', NULL, c_acctbal > 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {nid('supplier', 's_suppkey')}, 'struct', n_name || '.' || s_name, 'supply/' || lower(n_name) || '.go', 'go', (s_suppkey + 1)::INT, (s_suppkey + 4)::INT,
         'type ' || s_name || ' struct', NULL, s_acctbal > 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT {nid('order', 'o_orderkey')}, 'function', 'order.o' || o_orderkey,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'tests/urgent_orders.py' ELSE 'orders/p' || substr(o_orderpriority, 1, 1) || '.py' END, 'python', (o_orderkey * 10 + 1)::INT, (o_orderkey * 10 + 9)::INT,
         'def o' || o_orderkey || '()', NULL, o_orderstatus = 'F' FROM orders
  UNION ALL SELECT {nid('part', 'p_partkey')}, 'interface', p_brand || '.' || replace(p_name, ' ', '_') || '.v' || p_partkey, 'parts/' || lower(replace(p_brand, '#', '_')) || '.ts', 'typescript',
         (p_partkey + 1)::INT, (p_partkey + 3)::INT, 'interface ' || p_name, NULL, p_size > 25 FROM part),
edges AS (
  SELECT {nid('region', 'n_regionkey')} AS source, {nid('nation', 'n_nationkey')} AS target, 'contains' AS kind, n_nationkey::INT AS line, 'ast_exact' AS provenance, 1.0::DOUBLE AS confidence,
         NULL::VARCHAR AS read_write, NULL::VARCHAR AS boundary FROM nation
  UNION ALL SELECT {nid('nation', 'c_nationkey')}, {nid('customer', 'c_custkey')}, 'contains', c_custkey::INT, 'ast_exact', 1.0, NULL, NULL FROM customer
  UNION ALL SELECT {nid('nation', 's_nationkey')}, {nid('supplier', 's_suppkey')}, 'contains', s_suppkey::INT, 'ast_exact', 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT {nid('customer', 'o_custkey')}, {nid('order', 'o_orderkey')}, 'calls', o_orderkey::INT, CASE o_orderstatus WHEN 'F' THEN 'ast_exact' WHEN 'O' THEN 'ast_inferred' ELSE 'heuristic' END, 0.85, 'call', NULL FROM orders
  UNION ALL SELECT {nid('order', 'l_orderkey')}, {nid('part', 'l_partkey')}, 'references', l_linenumber, CASE l_returnflag WHEN 'N' THEN 'ast_exact' WHEN 'A' THEN 'ast_inferred' ELSE 'unresolved' END,
         round(1 - l_discount, 2), CASE WHEN l_linestatus = 'O' THEN 'read' ELSE 'write' END, NULL FROM lineitem
  UNION ALL SELECT {nid('supplier', 'l_suppkey')}, {nid('part', 'l_partkey')}, 'calls', l_linenumber, CASE l_returnflag WHEN 'N' THEN 'ast_exact' WHEN 'A' THEN 'ast_inferred' ELSE 'unresolved' END,
         round(1 - l_discount, 2), 'call', CASE WHEN l_discount >= 0.09 THEN 'dynamic-dispatch' END FROM lineitem),
roles AS (SELECT file_path AS path, min(language) AS language,
         CASE WHEN file_path LIKE 'tests/%' THEN 'test' WHEN file_path LIKE '%/index.ts' THEN 'entrypoint' ELSE 'library' END AS role FROM nodes GROUP BY file_path)
"""

SYMBOLS = "real AS (SELECT id, qualified_name FROM nodes WHERE kind NOT IN ('file', 'import', 'unresolved'))"

_CAMEL = "regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_ACRONYM = "regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"


def basic(c: str) -> str:
    spaced = f"regexp_replace({_CAMEL.format(f'coalesce({c}, chr(32))')}, '[-._/\\\\:#]+', ' ', 'g')"
    return f"list_filter(string_split_regex(lower({spaced}), '\\s+'), lambda t: length(t) > 1)"


def semantic(c: str) -> str:
    split = _ACRONYM.format(_CAMEL.format(f"coalesce({c}, chr(32))"))
    spaced = f"regexp_replace({split}, '[-._/\\\\:#<>(){{}}\\[\\],;''\"`=+*&|!?~^%$@]+', ' ', 'g')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split_regex(lower({spaced}), '\\s+'), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


LEX = "lex(word, more) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, v in LEXICON.items() for w in v) + ")"

#: terms(id, term): the expanded distinct terms of every document; sizes(id, len) with documents that have none.
TERMS = f"""
{LEX},
docs AS (SELECT 'd' || lpad(doc_id::VARCHAR, 12, '0') AS id, text FROM documents),
words AS (SELECT id, unnest({semantic('text')}) AS term FROM docs),
terms AS (SELECT id, term FROM words UNION SELECT id, more FROM words JOIN lex ON word = term),
sizes AS (SELECT d.id, count(t.term) AS len FROM docs d LEFT JOIN terms t ON t.id = d.id GROUP BY d.id)
"""


def query_terms(query: str) -> str:
    return f"qw AS (SELECT unnest({semantic(chr(39) + query + chr(39))}) AS term), q AS (SELECT term FROM qw UNION SELECT more FROM qw JOIN lex ON word = term)"


#: scored(id, score) by BM25 for q(term).
BM25 = """
tot AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM sizes),
hit AS (SELECT id, term FROM terms JOIN q USING (term)),
dfq AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (SELECT id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * greatest(len, 1) / avg_len))) AS score
           FROM hit JOIN dfq USING (term) JOIN sizes USING (id), tot GROUP BY id)
"""
