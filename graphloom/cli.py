"""The command line: ``python -m graphloom COMMAND``. Answers are brought up to date with the folder first."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import incremental, slices

CLIENTS = ("claude-code", "cline", "codex", "cursor", "gemini", "kiro", "opencode", "pi", "windsurf")
PLACE = ("qualified_name", "kind", "file_path", "start_line")


def session() -> SparkSession:
    from graphloom.session import build_session

    spark = build_session("graphloom", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def stamp(stats: dict) -> str:
    return "# index: fresh" if not stats["reindexed"] + stats["removed"] else f"# index: {stats['reindexed']} file(s) reindexed, {stats['removed']} removed just now"


def places(engine: Engine, ids: DataFrame, order: list[str]) -> list[dict]:
    """Name, kind and place of the nodes ``ids`` (id, ...)."""
    return rows_of(ids.join(engine.nodes.select("id", *PLACE), "id").orderBy(*order).select("id", *PLACE))


def lines_of(found: list[dict], kind: bool = False) -> str:
    return "\n".join(f"{r['file_path']}:{r['start_line']}  {r['qualified_name']}" + f"  [{r['kind']}]" * kind for r in found) or "(none)"


def callers(engine: Engine, symbol: str) -> list[dict]:
    return places(engine, engine.callers(symbol).select(F.col("source").alias("id")), ["id"])


def impact(engine: Engine, symbol: str) -> list[dict]:
    return places(engine, engine.impact(symbol).select("id", "depth"), ["depth", "id"])


def dependencies(engine: Engine, path: str) -> list[dict]:
    return rows_of(engine.deps(path).orderBy("name", "target").select("name", "provenance", "kind"))


def references(engine: Engine, symbol: str, use: str | None) -> list[dict]:
    return rows_of(engine.refs(symbol, use).orderBy("source", "line").select("source", "target", "line", "read_write", "provenance"))


def install_text(client: str | None) -> str:
    """What to put into a client's configuration so that it starts the tool server."""
    server = json.dumps({"mcpServers": {"graphloom": {"command": sys.executable, "args": ["-m", "graphloom", "mcp"]}}}, indent=2)
    if client is not None and client not in CLIENTS:
        return f"unknown client {client!r}; known are: {', '.join(CLIENTS)}"
    return f"# {client or 'any client'}: add this server\n{server}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Questions to a folder of source files")
    top.add_argument("--json", action="store_true", help="machine-readable output")
    top.add_argument("-C", "--root", default=".", help="the project's folder")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *names: str, many: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for n in names:
            p.add_argument(n, nargs="+" if many else None)
        return p

    command("index", "build or update the index").add_argument("path", nargs="?")
    command("status", "numbers of nodes, edges and files")
    command("inventory", "role, language, symbols and inbound edges of each file")
    p = command("understand", "the slice for a task", "task", many=True)
    p.add_argument("-b", "--budget", type=int, default=6000)
    p.add_argument("-s", "--scope")
    p.add_argument("--flat", action="store_true")
    p = command("verify", "check a diff against the graph")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--diff")
    p.add_argument("--allow", nargs="+", default=[])
    command("search", "search symbols", "query", many=True)
    command("deps", "what a file uses", "file")
    p = command("refs", "references to a symbol", "symbol")
    p.add_argument("--write", action="store_true")
    p.add_argument("--read", action="store_true")
    command("callers", "what calls a symbol", "symbol")
    command("tests", "tests that exercise a symbol", "symbol")
    command("lookup", "a symbol's fact or NOT FOUND", "name")
    command("impact", "what a change of a symbol touches", "symbol")
    command("docs", "mentions in documents").add_argument("--stale", action="store_true")
    command("map", "domains and what is between them").add_argument("--mermaid", action="store_true")
    command("watch", "keep the index up to date")
    command("install", "configuration of a client").add_argument("agent", nargs="?")
    command("mcp", "serve tools over standard input and output")
    return top


def run(argv: list[str], out: Callable[[str], None] = print, spark: SparkSession | None = None) -> int:
    """Runs a command; the exit status is 1 where a check finds an error."""
    args = parser().parse_args(argv)
    say = lambda found, text: out(json.dumps(found, ensure_ascii=False, default=str) if args.json else text)
    if args.command == "install":
        out(install_text(args.agent))
        return 0
    if args.command == "docs" and not args.stale:
        out("docs --stale lists mentions in documents that no symbol matches")
        return 0
    if args.command == "verify" and not args.staged and not args.diff:
        raise SystemExit("verify needs --staged or --diff FILE (- reads standard input)")
    spark = spark or session()
    root = str(Path((args.path if args.command == "index" else None) or args.root).resolve())
    if args.command == "mcp":
        from graphloom.server import serve

        serve(spark, root, sys.stdin, sys.stdout)
        return 0
    if args.command == "index":
        before = Engine.open(spark, str(Engine._kept(root)), root) if Engine.has_index(root) else None
        engine = Engine.index(spark, root)
        moved = incremental.sync_stats(incremental.sync_actions(before.files, engine.files)).first() if before else None
        if before is None or moved["reindexed"] or moved["removed"]:
            engine.keep()
        s = engine.stats().first()
        parsed = moved["reindexed"] if moved else s["files"]
        found = {"scanned": s["files"], "parsed": parsed, "skipped": s["files"] - parsed, "nodes": s["nodes"], "edges": s["edges"]}
        say(found, f"Indexed {parsed} file(s), {s['nodes']} nodes, {s['edges']} edges ({found['skipped']} unchanged).")
        return 0
    if args.command == "status":
        engine = Engine.open(spark, str(Engine._kept(root)), root) if Engine.has_index(root) else None
        found = engine.stats().first().asDict() | {"fingerprint": engine.fingerprint().first()[0]} if engine else {"nodes": 0, "edges": 0, "files": 0, "fingerprint": ""}
        say(found, f"nodes={found['nodes']} edges={found['edges']} files={found['files']} fingerprint={found['fingerprint'][:16]}")
        return 0
    engine, fresh = Engine.of_project(spark, root)
    if args.command == "inventory":
        if args.json:
            out("\n".join(r["value"] for r in engine.inventory_lines().collect()))
        else:
            found = rows_of(engine.inventory().orderBy("path"))
            out("\n".join(f"{r['path']}  {r['role']}  {r['language']}  symbols={r['symbols']}  in={r['inbound_edges']}" + " [orphaned]" * r["orphaned"] for r in found))
    elif args.command == "understand":
        got = engine.slice(" ".join(args.task), args.budget, args.scope, "flat" if args.flat else "harmonic")
        text = got.text()
        say({"tokensEstimate": slices.tokens_of(text), "anchors": got.anchors, "text": text, "fresh": fresh}, f"{stamp(fresh)}\n{text}")
    elif args.command == "verify":
        if args.staged:
            inputs = engine.staged_inputs()
            paths = [i["path"] for i in inputs]
            findings = rows_of(engine.verify_inputs(inputs, tuple(args.allow)))
        else:
            from graphloom.operators.diffs import parse_diff

            diff = sys.stdin.read() if args.diff == "-" else Path(args.diff).read_text()
            paths = [f["path"] for f in parse_diff(diff)]
            findings = rows_of(engine.verify(diff, tuple(args.allow)))
        skipped = engine.skipped_inputs(paths)
        say({"findings": findings, "skipped": skipped}, "\n".join([slices.findings_text(findings), *(f"skipped for its role: {p}" for p in skipped)]))
        return int(any(f["severity"] == "error" for f in findings))
    elif args.command == "search":
        found = rows_of(engine.search(" ".join(args.query), 20))
        say(found, lines_of(found, True))
    elif args.command == "deps":
        found = dependencies(engine, args.file)
        say({"file": args.file, "dependencies": found}, "\n".join(f"{d['name']}  [{d['provenance']}/{d['kind']}]" for d in found) or "(none)")
    elif args.command == "refs":
        found = references(engine, args.symbol, "write" if args.write else "read" if args.read else None)
        say(found, "\n".join(f"{r['line']}  {r['read_write']}  <- {args.symbol}" for r in found) or "(none)")
    elif args.command in ("callers", "impact", "tests"):
        found = callers(engine, args.symbol) if args.command == "callers" else impact(engine, args.symbol) if args.command == "impact" else places(engine, engine.tests_for(args.symbol).select("id"), ["file_path", "start_line"])
        say(found, lines_of(found))
    elif args.command == "lookup":
        found = engine.lookup_fact(args.name)
        say(found, slices.lookup_text(found))
    elif args.command == "docs":
        found = rows_of(engine.stale_docs().orderBy("file", "line", "name"))
        say(found, "\n".join(f"{r['file']}:{r['line']}  mentions '{r['name']}', no such symbol" for r in found) or "(none)")
    elif args.command == "map":
        found = engine.map_found()
        say(found, slices.map_mermaid(found) if args.mermaid else slices.map_markdown(found))
    elif args.command == "watch":
        out("Watching for changes (Ctrl-C ends)...")
        watcher = engine.watch(lambda path, result: out(f"{result}: {path}"))
        try:
            while True:
                time.sleep(3600)
        except KeyboardInterrupt:
            watcher.stop()
    return 0


def main() -> None:
    raise SystemExit(run(sys.argv[1:]))
