import random

from graphloom.operators import domains as D
from graphloom.operators import graph as G
from graphloom.operators import ranking as K
from graphloom.operators import resolve as V
from graphloom.operators.components import components
from graphloom.schema import EDGES, IMPORTS, NODES


def nodes(spark, rows):
    """rows: (id, kind, name, file, exported)"""
    return spark.createDataFrame([(i, k, q, f, "typescript", 1, 3, None, None, x) for i, k, q, f, x in rows], NODES)


def edges(spark, rows):
    """rows: (source, target, kind, line, provenance)"""
    return spark.createDataFrame([(s, t, k, n, 1, p, 1.0, "r", "call" if k == "calls" else None, None) for s, t, k, n, p in rows], EDGES)


A = [("fa", "function", "charge", "a.ts", True), ("fb", "function", "pay", "b.ts", True), ("ft", "function", "checks", "t.test.ts", False)]
E = [("fb", "fa", "calls", 1, "ast_exact"), ("fb", "fa", "calls", 2, "ast_exact"), ("ft", "fb", "calls", 1, "ast_inferred"), ("fb", "gone", "calls", 9, "ast_exact")]


def test_callers_lookup_and_impact(spark):
    n, e = nodes(spark, A), edges(spark, E)
    assert [(r.target, r.source, r.first_line) for r in G.callers(n, e).filter("target = 'fa'").collect()] == [("fa", "fb", 1)]
    names = spark.createDataFrame([("charge",), ("nothing",)], "name string")
    assert {r.name: (r.found, r.callers) for r in G.lookup(n, e, names).collect()} == {"charge": (True, 2), "nothing": (False, None)}
    start = spark.createDataFrame([("fa",)], "id string")
    assert {r.id: r.depth for r in G.impact(n, e, start).collect()} == {"fb": 1, "ft": 2}
    roles = spark.createDataFrame([("t.test.ts", "test"), ("a.ts", "library"), ("b.ts", "library")], "path string, role string")
    assert [r.id for r in G.tests_for(n, e, roles, start).collect()] == ["ft"]
    covered = {r.id: r.covered_by for r in K.covered_by(n, e, roles).collect()}
    assert covered["fb"] == "t.test.ts" and covered["fa"] == "(none)"


def test_removed_file_leaves_an_unresolved_call(spark):
    n, e = nodes(spark, A), edges(spark, E)
    imports = spark.createDataFrame([("b.ts", "pay_charge", "charge", "a.ts", 1)], "file string, local_name string, imported_name string, target_file string, seq int")
    left, kept = G.remove_files(n, e, imports, spark.createDataFrame([("a.ts",)], "path string"))
    down = kept.filter("provenance = 'unresolved'").collect()
    assert len(down) == 2 and {r.line for r in down} == {1, 2}
    assert {r.qualified_name for r in left.filter("kind = 'unresolved'").collect()} == {"<unresolved>.pay_charge"}


def test_imports_resolve_or_stay(spark):
    n = nodes(spark, [("fa", "function", "charge", "src/a.ts", True), ("fb", "function", "pay", "src/b.ts", True), ("u", "unresolved", "<unresolved>.c", "src/b.ts", False), ("v", "unresolved", "<unresolved>.log", "src/b.ts", False)])
    e = edges(spark, [("fb", "u", "calls", 1, "unresolved"), ("fb", "v", "calls", 2, "unresolved")])
    imports = spark.createDataFrame([("src/b.ts", "c", "charge", "./a.js", 1, 1), ("src/b.ts", "log", "log", "node:util", 2, 2)], IMPORTS)
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string")
    got = {r.line: (r.target, r.provenance) for r in V.resolve_imports(n, e, imports, files).collect()}
    assert got == {1: ("fa", "ast_inferred"), 2: ("v", "unresolved")}


def test_budgets_and_positions(spark):
    rows = spark.createDataFrame([("g", i + 1, c) for i, c in enumerate((5, 9, 3, 2, 8))], "g string, rank int, cost int")
    assert [r.rank for r in K.greedy_fit(rows, ["g"], ["g"], "rank", "cost", 11.0).orderBy("rank").collect()] == [1, 3, 4]
    assert [r.rank for r in K.within_budget(rows, ["g"], ["rank"], "cost", 14).collect()] == [1, 2]
    from pyspark.sql import functions as F

    placed = spark.range(7).select(K.position(F.col("id"), F.lit(7)).alias("p")).collect()
    assert [r.p for r in placed] == [0, 6, 1, 5, 2, 4, 3]


def test_propagation_equals_one_sweep_over_all(spark):
    rng = random.Random(3)
    paths = [f"d{i % 5}/f{i:02d}" for i in range(40)]
    pairs = [(a, b, rng.randint(1, 4)) for a, b in (rng.sample(paths, 2) for _ in range(45))]
    label = {p: p.split("/")[0] for p in paths}
    near = {p: {} for p in paths}
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    for _ in range(10):
        changed = False
        for p in sorted(paths):
            score = {}
            for q, w in near[p].items():
                score[label[q]] = score.get(label[q], 0) + w
            if score and (best := min(score, key=lambda x: (-score[x], x))) != label[p]:
                label[p], changed = best, True
        if not changed:
            break
    seeds = spark.createDataFrame([(p, p.split("/")[0]) for p in paths], "path string, label string")
    got = {r.path: r.label for r in D.propagate(seeds, spark.createDataFrame(pairs, "a string, b string, weight long")).collect()}
    assert got == label


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r.v: r.root for r in components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 23
    assert components(links.limit(0)).count() == 0
