"""Tools over standard input and output: JSON-RPC messages, one a line, answered one at a time in order of arrival."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from graphloom import cli
from graphloom.engine import Engine
from graphloom.operators import slices

PROTOCOL = "2024-11-05"
LISTED = ("understand", "lookup", "verify", "map")
INSTRUCTIONS = "Ask understand before an edit, lookup before using a name you have not seen, verify before applying a diff. Only ast_exact facts are certain."


def _schema(required: tuple[str, ...] = (), **kinds: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in kinds.items()}, "required": list(required)}


def _text(args: dict, name: str) -> str:
    value = args.get(name)
    return value if isinstance(value, str) else ""


def _understand(e: Engine, a: dict, stamp: str) -> str:
    budget = a.get("budget")
    return f"{stamp}\n{e.slice(_text(a, 'task'), int(budget) if isinstance(budget, (int, float)) else 6000, _text(a, 'scope') or None).text()}"


#: name: (description, schema, handler of engine, arguments and freshness)
TOOLS: dict[str, tuple[str, dict, Callable[[Engine, dict, str], str]]] = {
    "understand": ("The slice of the code that matters for a task, with provenance. Call it first.", _schema(("task",), task="string", budget="number", scope="string"), _understand),
    "search": ("Search of symbols; gives places.", _schema(("query",), query="string"), lambda e, a, _: cli.lines_of(cli.rows_of(e.search(_text(a, "query"), 20)), True)),
    "deps": ("What a file's symbols use outside it.", _schema(("file",), file="string"), lambda e, a, _: "\n".join(f"{d['name']}  [{d['provenance']}/{d['kind']}]" for d in cli.dependencies(e, _text(a, "file"))) or "(none)"),
    "refs": ("References to a symbol, by use if given.", _schema(("symbol",), symbol="string", readWrite="string"), lambda e, a, _: "\n".join(f"{r['line']}  {r['read_write']}  {r['provenance']}" for r in cli.references(e, _text(a, "symbol"), _text(a, "readWrite") or None)) or "(none)"),
    "callers": ("What calls a symbol.", _schema(("symbol",), symbol="string"), lambda e, a, _: cli.lines_of(cli.callers(e, _text(a, "symbol")))),
    "impact": ("What a change of a symbol touches, directly or through others.", _schema(("symbol",), symbol="string"), lambda e, a, _: cli.lines_of(cli.impact(e, _text(a, "symbol")))),
    "lookup": ("A symbol's signature and place, or NOT FOUND.", _schema(("name",), name="string"), lambda e, a, _: slices.lookup_text(e.lookup_fact(_text(a, "name")))),
    "verify": ("Check of a unified diff: unknown symbols, signatures of what it calls, callers of what it changes.", _schema(("diff",), diff="string"), lambda e, a, _: slices.findings_text(cli.rows_of(e.verify(_text(a, "diff"))))),
    "map": ("Domains, entry points, top symbols and what is between domains.", _schema(), lambda e, a, _: e.map_markdown()),
}


class Server:
    """Holds the latest engine; every call refreshes it before it answers."""

    def __init__(self, spark: SparkSession, root: str):
        self.engine, _ = Engine.of_project(spark, root)

    def listed(self) -> list[dict]:
        names = TOOLS if os.environ.get("GRAPHLOOM_TOOLS") == "all" else LISTED
        return [{"name": n, "description": TOOLS[n][0], "inputSchema": TOOLS[n][1]} for n in names]

    def call(self, name: str, args: dict) -> dict:
        if name not in TOOLS:
            return {"content": [{"type": "text", "text": f"Unknown tool: {name}"}], "isError": True}
        try:
            self.engine, stats = self.engine.refresh()
            return {"content": [{"type": "text", "text": TOOLS[name][2](self.engine, args, cli.stamp(stats))}]}
        except Exception as e:  # the caller gets the reason, the server goes on
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    def answer(self, message: dict) -> dict | None:
        """The response to a request; none to a notification."""
        method, number = message.get("method"), message.get("id")
        params = message.get("params") or {}
        if number is None:
            return None
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}, "instructions": INSTRUCTIONS}
        elif method == "tools/list":
            result = {"tools": self.listed()}
        elif method == "tools/call":
            result = self.call(params.get("name", ""), params.get("arguments") or {})
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(spark: SparkSession, root: str, source: TextIO, out: TextIO) -> None:
    server = Server(spark, root)
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            response = server.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        except ValueError:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if response is not None:
            out.write(json.dumps(response, ensure_ascii=False) + "\n")
            out.flush()
