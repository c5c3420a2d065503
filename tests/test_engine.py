import json

import pytest

from graphloom.engine import Engine
from graphloom.operators import incremental
from graphloom.sources import extract

FILES = {
    "package.json": json.dumps({"main": "src/main.ts", "dependencies": {"left-pad": "1"}}),
    "src/main.ts": "import { charge } from './pay';\nexport function main() {\n  charge(3);\n}\n",
    "src/pay.ts": "export function charge(n: number) {\n  return check(n);\n}\nfunction check(n: number) {\n  return n > 0;\n}\n",
    "src/pay.test.ts": "import { charge } from './pay';\nimport { it } from 'vitest';\nfunction checks() {\n  charge(1);\n}\n",
    "docs/x.md": "Use `charge` and `goneFn` as in [pay](../src/pay.ts).\n```\n`alsoGone`\n```\n",
    "node_modules/dep/index.js": "function no() {}\n",
    "vendor.min.js": "x()",
    "lib/tool.py": "from os import path\n\nclass Tool:\n    def run(self):\n        return helper(1)\n\ndef helper(n):\n    return print(n)\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return Engine.index(spark, str(root))


def test_scan_roles_and_lookup(engine):
    roles = {r.path: r.role for r in engine.files.collect()}
    assert roles == {"package.json": "config", "src/main.ts": "entrypoint", "src/pay.ts": "library", "src/pay.test.ts": "test", "docs/x.md": "doc", "lib/tool.py": "library"}
    hit = engine.lookup("charge").first()
    assert hit.found and hit.callers == 2
    assert {r.qualified_name for r in engine.impact("check").join(engine.nodes.select("id"), "id").collect()} == {"charge", "main", "checks"}
    assert [r.qualified_name for r in engine.tests_for("charge").collect()] == ["checks"]
    assert [(r.file, r.line, r.name) for r in engine.stale_docs().collect()] == [("docs/x.md", 1, "goneFn")]
    assert {r.path for r in engine.inventory().filter("orphaned").collect()} >= {"lib/tool.py"}


def test_slice_fits_its_budget(engine):
    rows = engine.understand("charge a payment", budget=600).collect()
    text = "\n".join(r.line for r in rows)
    assert "charge" in text and "covered-by: src/pay.test.ts" in text
    assert sum(-(-len(r.line) // 4) for r in rows) <= 600
    with pytest.raises(ValueError):
        engine.understand("charge", scope="nowhere")


def test_verify_leaves_the_index_alone(engine):
    before = engine.stats().first()
    diff = "--- a/src/pay.ts\n+++ b/src/pay.ts\n@@ -1,3 +1,4 @@\n export function charge(n: number) {\n+  ghost(n);\n   return check(n);\n }\n"
    found = {(r.severity, r.rule) for r in engine.verify(diff).collect()}
    assert ("error", "unknown-symbol") in found and ("warn", "blast-radius") in found
    assert ("error", "unknown-symbol") not in {(r.severity, r.rule) for r in engine.verify(diff, ("ghost",)).collect()}
    assert {r.rule for r in engine.verify(diff.replace("check(n)", "other(n)")).collect()} == {"parse-failure"}
    assert engine.stats().first() == before


def test_sync_reads_what_moved(spark, engine):
    from pyspark.sql import functions as F

    text = "export function other() {}\n"
    stay = engine.files.select("path", "language", "text", "hash", "mtime_ms").filter("path <> 'lib/tool.py'")
    moved = stay.withColumn("text", F.when(F.col("path") == "src/pay.ts", text).otherwise(F.col("text"))).withColumn("hash", F.sha2("text", 256)).withColumn("mtime_ms", F.when(F.col("path") == "src/pay.ts", 1.0).otherwise(F.col("mtime_ms")))
    after, actions = engine.sync(moved)
    assert {r.path: r.action for r in actions.filter("action <> 'skipped'").collect()} == {"src/pay.ts": "changed", "lib/tool.py": "removed"}
    assert incremental.sync_stats(actions).first()["reindexed"] == 1
    assert not after.lookup("charge").first().found
    assert {r.provenance for r in after.edges.filter("kind = 'calls'").collect()} == {"unresolved"}


def test_readers_of_single_formats():
    rows = lambda p, lang, t: extract.extract(p, lang, t)
    go = {r["qualified_name"] for r in rows("go.mod", "manifest", "require (\n github.com/a/b v1.2.0\n)") if r["what"] == "node"}
    assert "github.com/a/b" in go
    tf = [r for r in rows("m.tf", "terraform", 'resource "aws_x" "a" {\n  v = aws_x.b.id\n  w = var.gone\n}\nresource "aws_x" "b" {\n}\n') if r["what"] == "edge" and r["kind"] == "references"]
    assert [(r["line"], r["provenance"]) for r in tf] == [(2, "ast_exact"), (3, "unresolved")]
    mcp = rows("mcp.json", "mcp", '{"mcpServers": {"s": {"command": "npx", "args": ["-y", "pkg"], "env": {"K": "v"}}}}')
    assert {r["qualified_name"] for r in mcp if r["what"] == "node"} == {"<file>", "s", "pkg"}
    vue = [r for r in rows("a.vue", "vue", "<template/>\n<script>\nfunction go() {}\n</script>") if r["what"] == "node" and r["kind"] == "function"]
    assert [(r["qualified_name"], r["start_line"]) for r in vue] == [("go", 3)]
    assert len(rows("package.json", "manifest", "{broken")) == 1 and len(rows("a.ts", "typescript", None)) == 1 and rows("a.bin", None, "x") == []
    py = [(r["qualified_name"], r["kind"]) for r in rows("t.py", "python", FILES["lib/tool.py"]) if r["what"] == "node"]
    assert ("Tool.run", "function") in py and ("helper", "function") in py
