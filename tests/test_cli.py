import io
import json
import subprocess
import time

import pytest

from graphloom import cli, server
from graphloom.engine import Engine

FILES = {
    "package.json": json.dumps({"main": "./src/main.ts", "exports": {".": {"import": ["./src/deep/entry.ts"]}}, "bin": {"x": "bin/x.js"}}),
    "src/main.ts": "import { charge } from './pay';\nexport function main() {\n  charge(3);\n}\n",
    "src/pay.ts": "export function charge(n: number) {\n  let total = n;\n  total = total + 1;\n  return check(total);\n}\nfunction check(n: number) {\n  return n > 0;\n}\n",
    "src/pay.test.ts": "import { charge } from './pay';\nfunction checks() {\n  charge(1);\n}\n",
    "src/deep/entry.ts": "export function entry() {}\n",
    "src/gen.ts": "// @generated\nexport function made() {}\n",
    "docs/x.md": "Use `charge` and `goneFn`.\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def ask(spark, root, *argv, status=0):
    said = []
    assert cli.run(["-C", str(root), *argv], said.append, spark) == status
    return "\n".join(said)


def test_commands(spark, root):
    assert ask(spark, root, "status") == "nodes=0 edges=0 files=0 fingerprint="
    assert "Indexed 7 file(s)" in ask(spark, root, "index")
    assert "Indexed 0 file(s)" in ask(spark, root, "index") and Engine.has_index(str(root))
    assert json.loads(ask(spark, root, "--json", "status"))["files"] == 7
    rows = [json.loads(x) for x in ask(spark, root, "--json", "inventory").split("\n")]
    assert [r["path"] for r in rows] == sorted(FILES) and {r["path"]: r["role"] for r in rows}["src/deep/entry.ts"] == "entrypoint"
    assert "src/pay.ts  library  typescript" in ask(spark, root, "inventory")
    assert ask(spark, root, "lookup", "charge").startswith("charge  [function]\nexport function charge(n: number)\nsrc/pay.ts:1\ncallers: 2")
    missing = ask(spark, root, "lookup", "chargeCard")
    assert missing.startswith("NOT FOUND") and "src/pay.ts:1  charge" in missing
    assert ask(spark, root, "callers", "charge") in ("src/main.ts:2  main\nsrc/pay.test.ts:2  checks", "src/pay.test.ts:2  checks\nsrc/main.ts:2  main")
    assert ask(spark, root, "tests", "charge") == "src/pay.test.ts:2  checks"
    assert "src/main.ts:2  main" in ask(spark, root, "impact", "check")
    assert ask(spark, root, "refs", "total", "--write") == "2  write  <- total\n3  write  <- total"
    assert "charge  [ast_inferred/calls]" in ask(spark, root, "deps", "src/main.ts")
    assert "charge" in ask(spark, root, "search", "charge") and ask(spark, root, "callers", "nothing_like_it") == "(none)"
    assert ask(spark, root, "docs", "--stale") == "docs/x.md:1  mentions 'goneFn', no such symbol"
    assert ask(spark, root, "map").endswith("## dependencies") or "→" in ask(spark, root, "map")
    assert ask(spark, root, "map", "--mermaid").startswith("flowchart LR")
    assert "mcpServers" in ask(spark, root, "install", "cursor")
    with pytest.raises(SystemExit):
        ask(spark, root, "verify")


def test_slices(spark, root):
    text = ask(spark, root, "understand", "charge", "a", "payment", "-b", "900")
    assert text.startswith("# index: fresh\n# Slice for: charge a payment\n") and "# DETAIL" in text and "covered-by: src/pay.test.ts" in text
    got = json.loads(ask(spark, root, "--json", "understand", "charge", "--flat", "-b", "400"))
    assert got["tokensEstimate"] <= 400 and got["anchors"] and "// src/pay.ts:1-5  charge  [ast_exact]" in got["text"] and "# MAP" not in got["text"]


def test_checks(spark, root, tmp_path):
    diff = "--- a/src/pay.ts\n+++ b/src/pay.ts\n@@ -6,3 +6,4 @@\n function check(n: number) {\n+  ghost(n);\n   return n > 0;\n }\n--- a/src/gen.ts\n+++ b/src/gen.ts\n@@ -1,2 +1,3 @@\n // @generated\n+ghost(2);\n export function made() {}\n"
    (tmp_path / "d.diff").write_text(diff)
    text = ask(spark, root, "verify", "--diff", str(tmp_path / "d.diff"), status=1)
    assert "src/pay.ts:7  error  unknown-symbol" in text and "1 error(s)" in text and text.endswith("skipped for its role: src/gen.ts")
    (root / ".graphloom-allow").write_text("# names\nghost\n")
    assert "0 error(s)" in ask(spark, root, "verify", "--diff", str(tmp_path / "d.diff"))
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src", "docs", "package.json")
    git("commit", "-qm", "x")
    (root / "src/pay.ts").write_text(FILES["src/pay.ts"].replace("return n > 0", "return phantom(n)"))
    git("add", "src/pay.ts")
    assert "error  unknown-symbol" in ask(spark, root, "verify", "--staged", status=1)
    (root / "src/pay.ts").write_text(FILES["src/pay.ts"])


def test_server(spark, root):
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "lookup", "arguments": {"name": "charge"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "none"}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "understand", "arguments": {"task": "charge", "scope": "nowhere"}}}, {"jsonrpc": "2.0", "id": 6, "method": "what"},
    ]
    out = io.StringIO()
    server.serve(spark, str(root), io.StringIO("".join(json.dumps(x) + "\n" for x in asked) + "broken\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert [t["name"] for t in got[2]["result"]["tools"]] == list(server.LISTED) and len(server.TOOLS) == 9
    assert "callers: 2" in got[3]["result"]["content"][0]["text"] and got[4]["result"]["isError"] and "no domain" in got[5]["result"]["content"][0]["text"]
    assert got[6]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700


def test_files_are_reindexed_one_by_one(spark, root):
    engine, _ = Engine.of_project(spark, str(root))
    assert engine.reindex_file("docs/x.md") == (engine, "skipped") and engine.reindex_file("src/pay.ts")[1] == "skipped"
    semantic = engine.semantic
    assert engine.refresh()[0].semantic is semantic
    seen = []
    watcher = engine.watch(lambda path, result: seen.append((path, result)))
    (root / "src/new.ts").write_text("export function brandNew() {}\n")
    until = time.time() + 90
    while not seen and time.time() < until:
        time.sleep(0.1)
    watcher.stop()
    assert seen == [("src/new.ts", "reindexed")] and watcher.engine.lookup("brandNew").first().found
    (root / "src/new.ts").unlink()
    after, result = watcher.engine.reindex_file("src/new.ts")
    assert result == "removed" and not after.lookup("brandNew").first().found
    again, stats = after.refresh()
    assert stats == {"reindexed": 0, "removed": 0} and again is after
