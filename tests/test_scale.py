"""Plans that must not grow faster than their input: what is shuffled, written and read twice."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.schema import EDGES, NODES
from graphloom.sources import lift as L

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_the_lift_writes_nothing_and_reads_what_a_query_needs(spark):
    edges = L.edges(spark, DATA)
    assert {Path(f).parent.name for f in edges.inputFiles()} <= {Path(DATA).name, *(p.name for p in Path(DATA).iterdir())}
    assert "l_orderkey" not in plan(edges.filter("kind = 'contains'")) and "Sort" not in plan(edges)


@pytest.fixture
def cut_plans(monkeypatch):
    """The plans of all that graph operators write on the way."""
    seen, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (seen.append(plan(df)), real(df))[1])
    return seen


def small_graph(spark, n=300):
    nodes = spark.createDataFrame([(f"n{i}", "function", f"f{i}", f"d/{i % 7}.py", "python", 1, 3, None, None, True) for i in range(n)], NODES)
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + k) % n}", "calls", k, 1, "ast_exact", 1.0, "r", "call", None) for i in range(n) for k in range(3)], EDGES)
    return nodes, edges, spark.createDataFrame([("n0",)], "id string")


def test_spine_passes_once_over_the_edges_a_round(spark, cut_plans):
    nodes, edges, start = small_graph(spark)
    got = G.spine(nodes, edges, start.selectExpr("id", "1 as ord"), 2, 60)
    assert got.count() > 10 and got.filter("ord = 1").first()["id"] == "n0"
    over_edges = [p.count("confidence#") for p in cut_plans if "confidence#" in p]
    assert over_edges and set(over_edges) == {1}
    assert not [p for p in cut_plans if "confidence#" in p and "Exchange hashpartitioning" in p]


@needs_tables
def test_centrality_groups_ids_as_bytes(spark):
    from graphloom.plans import registry

    found = registry.QUERIES["centrality"](spark, DATA)
    assert "unhex" in plan(found) and "l_orderkey" not in plan(found) and len(found.first()["id"]) == 24


def test_impact_shuffles_no_edges_from_the_first_round_on(spark, cut_plans):
    nodes, edges, start = small_graph(spark)
    found = G.impact(nodes, edges, start)
    assert cut_plans and not [p for p in cut_plans if "SortMergeJoin" in p]
    assert "SortMergeJoin" not in plan(found) and found.count() > 3


def test_minified_blocks_take_time_in_proportion_to_their_lines(spark):
    rows = spark.createDataFrame([("\n".join(f"    line {i}  " for i in range(6000)),)], "t string")
    began = time.monotonic()
    block = rows.select(X.minify_block("t", 1).alias("b")).first()["b"].split("\n")
    assert time.monotonic() - began < 10 and len(block) == 6000 and block[-1] == " 6000  line 5999"


@needs_tables
@pytest.mark.parametrize("name", ["minify_block", "minify_lines"])
def test_a_block_is_worked_out_once(spark, name):
    from graphloom.plans import registry

    assert plan(registry.QUERIES[name](spark, DATA)).count("filter(transform(split(") <= 1


@needs_tables
def test_scripts_are_read_once(spark):
    from graphloom.plans import registry

    found = plan(registry.QUERIES["script_edges"](spark, DATA))
    assert found.count("MapInArrow") == 1 and "Join" not in found


def test_named_edges_keep_files_apart(spark):
    from graphloom.sources import extract

    files = spark.createDataFrame([(f"f{i}.ts", "typescript", "function a() { return b() }\nfunction b() { return 1 }") for i in range(3)], "path string, language string, text string")
    calls = extract.named_edges(files).filter("kind = 'calls'").select("path", "source", "target", "line").collect()
    assert sorted(tuple(r) for r in calls) == [(f"f{i}.ts", "a", "b", 1) for i in range(3)]


def test_the_index_answers_without_the_texts(spark):
    from graphloom.operators import retrieval as R

    docs = spark.createDataFrame([(f"d{i}", f"user login w{i % 7}x session error") for i in range(40)], "id string, text string")
    index = R.lsa_index(docs, 4)
    asked = R.lsa_query(index, docs, "user login")
    assert plan(asked).count("MapInArrow") == 1 and "text#" not in plan(asked) and asked.count() > 0


def test_singular_values_leave_the_documents_rows_out(spark):
    from graphloom.operators import retrieval as R

    docs = spark.createDataFrame([(f"d{i}", f"user login w{i % 7}x session error") for i in range(40)], "id string, text string").repartition(9)
    index = R.lsa_index(docs, 4)
    assert "MapInArrow" not in plan(index.filter("kind = 'sigma'")) and index.filter("kind = 'doc'").count() == 40


def test_import_rows_are_dealt_before_they_are_sorted(spark):
    from graphloom.operators import resolve as V
    from graphloom.schema import IMPORTS

    nodes, edges, _ = small_graph(spark)
    imports = spark.createDataFrame([("d/1.py", "f3", "f3", "./2.py", 1, 1)], IMPORTS)
    files = spark.createDataFrame([(f"d/{i}.py",) for i in range(7)], "path string")
    assert plan(V.resolve_imports(nodes, edges, imports, files)).count("REPARTITION_BY_COL") == 1


def test_names_meet_only_the_last_dependencies(spark):
    nodes, edges, _ = small_graph(spark)
    found = G.dependencies(nodes, edges)
    assert plan(found).index("Join") < plan(found).index("SortAggregate") and found.count() > 0


def test_names_that_nothing_calls_do_not_move(spark):
    from graphloom.operators import verify as Y

    nodes, _, _ = small_graph(spark)
    calls = spark.createDataFrame([("a.py", "python", 1, n) for n in ("f1", "ghost")], "file string, language string, line int, name string")
    none = spark.createDataFrame([], "file string, local_name string"), spark.createDataFrame([], "name string")
    found = Y.unknown_symbols(calls, nodes, *none)
    assert "Generate" not in plan(found) and "SortMergeJoin" not in plan(found) and [r.severity for r in found.collect()] == ["error"]


@needs_tables
def test_ordered_edges_are_sorted_by_bytes(spark):
    from graphloom.plans import registry

    found = registry.QUERIES["outgoing_ordered"](spark, DATA)
    assert "unhex" in plan(found) and {len(r.source) for r in found.limit(5).collect()} == {24}


@needs_tables
def test_counts_of_findings_carry_bytes_and_no_messages(spark):
    from graphloom.plans import registry

    found = plan(registry.QUERIES["severity_counts"](spark, DATA))
    assert "unhex" in found and " is " not in found


def test_blast_radius_deals_no_nodes_by_file(spark):
    from graphloom.operators import verify as Y

    nodes, edges, _ = small_graph(spark)
    changed = nodes.filter("file_path = 'd/1.py'").selectExpr("id", "file_path as file", "start_line as line", "qualified_name")
    found = Y.blast_radius(changed, nodes, edges.unionByName(edges), changed.select("file").distinct())
    assert "hashpartitioning(file_path" not in plan(found)
    assert {r.message.split(": ")[1].split(" ")[0] for r in found.collect()} <= {"1", "2", "3"} and found.count() > 0


def test_covering_tests_shuffle_no_edges_from_the_first_round_on(spark, cut_plans):
    nodes, edges, start = small_graph(spark)
    roles = spark.createDataFrame([("d/3.py", "test")], "path string, role string")
    found = G.tests_for(nodes, edges, roles, start)
    assert cut_plans and not [p for p in cut_plans if "SortMergeJoin" in p] and found.count() >= 0
