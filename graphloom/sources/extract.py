"""Extractors: a table of files becomes nodes, edges and imports.

Each file is read by itself, so extraction is one pass without a shuffle. Documents, manifests, server configurations,
Terraform, scripts (``script``: scopes, receiver types, reads and writes) and the script blocks of single-file
components have readers of their own. Other code is read by a lexer that blanks comments and strings and finds definitions,
calls and imports by the patterns of its language. There a call's bare name means the first definition of that name in its
file (``ast_exact``); a call on a receiver is a dynamic dispatch, any other name an unresolved placeholder.

Defined cases: a null or empty text has a file node only; an unknown language is passed over; a file that can't be read
as its format (broken JSON) gives its file node.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import EXTENSIONS
from graphloom.sources.script import read_script

FILE, PACKAGES, DOC_REFS, WIKI = "<file>", "<packages>", "<docref>", "<wiki>"
ROW = (
    "path string, seq int, what string, id string, kind string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, "
    "is_exported boolean, source string, target string, line int, provenance string, confidence double, resolver string, boundary string, read_write string, local_name string, imported_name string, module_spec string"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ROW.split(", "))])


def node_id(file: str, name: str) -> str:
    return hashlib.sha256(f"{file}::{name}".encode("utf-8", "surrogatepass")).hexdigest()[:24]


class Out:
    """The rows of one file; an edge repeats only on another line."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.rows, self._edges, self._nodes = path, language, [], set(), set()
        self.file = self.node("file", FILE, 1, text.count("\n") + 1)

    def _add(self, what: str, **values) -> None:
        self.rows.append({"path": self.path, "seq": len(self.rows), "what": what, **values})

    def node(self, kind: str, name: str, start: int, end: int | None = None, file: str | None = None, signature: str | None = None, docstring: str | None = None, exported: bool = False) -> str:
        file = self.path if file is None else file
        i = node_id(file, name)
        if i not in self._nodes:
            self._nodes.add(i)
            self._add("node", id=i, kind=kind, qualified_name=name, file_path=file, language=self.language, start_line=start, end_line=start if end is None else end, signature=signature, docstring=docstring, is_exported=exported)
        return i

    def edge(self, source: str, target: str, kind: str, line: int, provenance: str, confidence: float, resolver: str, boundary: str | None = None, read_write: str | None = None) -> None:
        key = (source, target, kind, line, read_write)
        if key not in self._edges:
            self._edges.add(key)
            self._add("edge", source=source, target=target, kind=kind, line=line, provenance=provenance, confidence=confidence, resolver=resolver, boundary=boundary, read_write=read_write or ("call" if kind == "calls" else None))

    def unresolved(self, source: str, name: str, line: int, boundary: str, resolver: str = "none") -> None:
        self.edge(source, self.node("unresolved", f"<unresolved>.{name}", line), "calls", line, "unresolved", 0.0, resolver, boundary)

    def package(self, name: str, line: int = 1, provenance: str = "ast_exact", confidence: float = 1.0, source: str | None = None) -> None:
        self.edge(source or self.file, self.node("module", name, 1, file=PACKAGES, exported=True), "references", line, provenance, confidence, "manifest-dep")

    def imported(self, local: str, name: str, spec: str, line: int) -> None:
        self._add("import", local_name=local, imported_name=name, module_spec=spec, line=line)


_LINK = re.compile(r"\[[^\]\n]*\]\(([^)\s#]+)(?:#[^)\s]*)?\)")
_WIKI = re.compile(r"\[\[([^\]|#\n]+)[^\]\n]*\]\]")
_CODE = re.compile(r"`([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?:\(\))?`")
_FILE_LIKE = re.compile(r"\.(?:" + "|".join(sorted({e for es in EXTENSIONS.values() for e in es.split()} | {"md", "json", "yml", "yaml", "toml", "txt"})) + r")$")


def read_docs(out: Out, text: str) -> None:
    """Links and wiki links anywhere, names in back ticks outside fences; each target once a document."""
    fenced, seen = False, set()
    folder = out.path.rpartition("/")[0]
    for n, line in enumerate(text.split("\n"), 1):
        for m in _LINK.finditer(line):
            if "://" not in m[1] and not m[1].startswith("mailto:") and ("link", m[1]) not in seen:
                seen.add(("link", m[1]))
                parts: list[str] = []
                for p in f"{folder}/{m[1]}".split("/"):
                    if p == ".." and parts:
                        parts.pop()
                    elif p not in ("", ".", ".."):
                        parts.append(p)
                target = "/".join(parts)
                out.edge(out.file, node_id(target, FILE), "references", n, "ast_exact", 1.0, "docs-link")
        for m in _WIKI.finditer(line):
            name = m[1].strip()
            if ("wiki", name) not in seen:
                seen.add(("wiki", name))
                out.edge(out.file, out.node("module", name, 1, file=WIKI, exported=True), "references", n, "heuristic", 0.5, "docs-wiki")
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            for m in _CODE.finditer(line):
                if len(m[1]) >= 3 and not _FILE_LIKE.search(m[1]) and ("name", m[1]) not in seen:
                    seen.add(("name", m[1]))
                    out.edge(out.file, out.node("unresolved", f"{DOC_REFS}.{m[1]}", 1, file=DOC_REFS), "references", n, "heuristic", 0.4, "docs-inline")


def read_manifest(out: Out, text: str) -> None:
    base, names = out.path.rpartition("/")[2].lower(), []
    if base == "package.json":
        data = json.loads(text)
        for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            names += list(data.get(group) or {})
    elif base == "go.mod":
        names = re.findall(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-/]+)\s+v\d", text)
    elif base == "pom.xml":
        names = [f"{g}:{a}" for g, a in re.findall(r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>", text)]
    elif base == "cargo.toml":
        for block in re.findall(r"(?ms)^\[(?:[\w.\-']*\.)?(?:dev-|build-)?dependencies\]\s*$(.*?)(?=^\[|\Z)", text):
            names += re.findall(r"(?m)^([\w\-]+)\s*=", block)
    elif base == "pyproject.toml":
        for block in re.findall(r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]", text):
            names += re.findall(r"[\"']([A-Za-z0-9][\w.\-]*)", block)
        for block in re.findall(r"(?ms)^\[tool\.poetry\.(?:[\w.\-]*)dependencies\]\s*$(.*?)(?=^\[|\Z)", text):
            names += [n for n in re.findall(r"(?m)^([\w\-]+)\s*=", block) if n != "python"]
    else:
        names = re.findall(r"(?m)^\s*-\s+([\w./@\-]+)", text)
    for name in dict.fromkeys(names):
        out.package(name)


def read_servers(out: Out, text: str) -> None:
    data = json.loads(text)
    for name, entry in (data.get("mcpServers") or data.get("servers") or {}).items():
        env = ", ".join(sorted((entry.get("env") or {})))
        server = out.node("module", name, 1, signature=" ".join([str(entry.get("command", "")), *map(str, entry.get("args") or [])]).strip(), docstring=f"env: {env}" if env else None, exported=True)
        out.edge(out.file, server, "contains", 1, "ast_exact", 1.0, "config")
        command = str(entry.get("command") or "").rpartition("/")[2]
        args = [a for a in map(str, entry.get("args") or []) if not a.startswith("-") and a not in ("dlx", "run", "tool", "install")]
        package = args[0] if command in ("npx", "uvx", "pnpm", "yarn", "bunx", "uv", "pipx") and args else command
        if package:
            out.package(package, provenance="heuristic", confidence=0.7, source=server)


_BLOCK = re.compile(r'(?m)^(resource|data|module|variable|output|provider|locals)\b((?:\s+"[^"]+")*)\s*\{')
_TRAVERSAL = re.compile(r"(?<![\w.\"])([a-z_][\w\-]*(?:\.[A-Za-z_][\w\-]*)+)")


def read_terraform(out: Out, text: str) -> None:
    """Blocks are named by their labels; a traversal means the longest name it starts with."""
    blocks = []
    for m in _BLOCK.finditer(text):
        labels = re.findall(r'"([^"]+)"', m[2])
        prefix = {"resource": [], "variable": ["var"]}.get(m[1], [m[1]])
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        if m[1] == "locals":
            for k in re.finditer(r"(?m)^\s*([\w\-]+)\s*=", text[m.end() : at]):
                blocks.append((f"local.{k[1]}", "variable", m.end() + k.start(1), m.end() + k.end()))
        elif labels:
            blocks.append((".".join([*prefix, *labels]), "variable" if m[1] in ("variable", "output") else "class", m.start(), at))
    line = lambda i: text.count("\n", 0, i) + 1
    ids = {n: out.node(k, n, line(s), line(e), signature=text[s:e].split("\n")[0].strip()[:200], exported=True) for n, k, s, e in blocks}
    for name, _, s, e in blocks:
        out.edge(out.file, ids[name], "contains", line(s), "ast_exact", 1.0, "terraform")
        for t in _TRAVERSAL.finditer(text, s, e):
            parts = t[1].split(".")
            for size in (3, 2):
                goal = ids.get(".".join(parts[:size])) if len(parts) >= size else None
                if goal:
                    if goal != ids[name]:
                        out.edge(ids[name], goal, "references", line(t.start()), "ast_exact", 1.0, "terraform")
                    break
            else:
                if parts[0] not in ("path", "terraform", "each", "count", "self"):
                    out.edge(ids[name], out.node("unresolved", f"<unresolved>.{'.'.join(parts[:2])}", line(t.start())), "references", line(t.start()), "unresolved", 0.0, "none", "unresolved-callee")


_W = r"([A-Za-z_$][\w$]*)"
#: Before a name with parameters and a body: types and modifiers, but no word that begins a statement.
_TYPED = r"(?:(?!(?:return|new|else|throw|await|case|goto|delete|in|not|and|or|using|package|import)\b)[\w.:<>\[\],?*&~@]+\s+[*&]*)+"
_METHOD = (rf"(?:(?m:^)|(?<=[{{}};]))[ \t]*{_TYPED}{_W}\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w., ]+|where[^{{;]+|const|noexcept|override|final)*\s*(?:\{{|=>|;)", "method")
_BODY = (rf"(?:(?m:^)|(?<=[{{}};:]))[ \t]*{_TYPED}(?:\w+::)*{_W}\s*\([^;{{}}]*?\)\s*(?:const|noexcept|override|final|->\s*[\w:<>&*]+)*\s*\{{", "function")
_LET = [(r"(?m)^[ \t]*(?:let|and)\s+(?:rec\s+)?([a-z_][\w']*)", "function")]
#: (pattern of a definition's name, kind) by language; further languages share the last entry.
RULES: dict[str, list[tuple[str, str]]] = {
    "python": [(rf"(?m)^[ \t]*class\s+{_W}", "class"), (rf"(?m)^[ \t]*(?:async\s+)?def\s+{_W}", "function")],
    "go": [(rf"(?m)^func\s+\([^)]*\)\s*{_W}", "method"), (rf"(?m)^func\s+{_W}", "function"), (rf"(?m)^type\s+{_W}", "struct")],
    "rust": [(rf"\bfn\s+{_W}", "function"), (rf"\bstruct\s+{_W}", "struct"), (rf"\benum\s+{_W}", "enum"), (rf"\btrait\s+{_W}", "interface")],
    "java": [(rf"\bclass\s+{_W}", "class"), (rf"(?<!@)\binterface\s+{_W}", "interface"), _METHOD],
    "c_sharp": [(rf"\bclass\s+{_W}", "class"), (rf"\binterface\s+{_W}", "interface"), (rf"\bstruct\s+{_W}", "struct"), _METHOD],
    "php": [(rf"\bclass\s+{_W}", "class"), (rf"\bfunction\s+&?{_W}", "function")],
    "ruby": [(rf"(?m)^\s*class\s+{_W}", "class"), (rf"(?m)^\s*module\s+{_W}", "module"), (r"(?m)^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "method")],
    "c": [_BODY],
    "cpp": [(rf"\bclass\s+{_W}(?=[^;()]*\{{)", "class"), (rf"\bstruct\s+{_W}(?=[^;()]*\{{)", "struct"), _BODY],
    "swift": [(rf"\bfunc\s+{_W}", "function"), (rf"\b(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b|let\b){_W}", "class"), (rf"\bprotocol\s+{_W}", "interface")],
    "kotlin": [(rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_W}", "function"), (rf"\b(?:class|interface)\s+{_W}", "class")],
    "scala": [(rf"\bdef\s+{_W}", "function"), (rf"\bobject\s+{_W}", "module"), (rf"\bclass\s+{_W}", "class"), (rf"\btrait\s+{_W}", "interface")],
    "zig": [(rf"\bfn\s+{_W}", "function")],
    "lua": [(rf"\bfunction\s+(?:\w+[.:])*{_W}", "function"), (rf"\b{_W}\s*=\s*function\b", "function")],
    "solidity": [(rf"\bfunction\s+{_W}", "function"), (rf"\bcontract\s+{_W}", "class"), (rf"\bstruct\s+{_W}", "struct")],
    "objc": [(rf"(?m)^@(?:interface|implementation)\s+{_W}", "class"), (rf"(?m)^\s*[-+]\s*\([^)]*\)\s*{_W}", "method")],
    "bash": [(r"(?m)^[ \t]*(?:function\s+)?([A-Za-z_][\w.\-]*)\s*\(\)", "function"), (r"(?m)^[ \t]*function\s+([A-Za-z_][\w.\-]*)", "function")],
    "ocaml": _LET, "rescript": _LET,
    "elixir": [(r"\bdef(?:module|protocol|impl)\s+([\w.]+)", "module"), (r"\bdef(?:p|macro|macrop|guard|guardp|delegate)?\s+([a-z_]\w*[?!]?)", "function")],
    "": [(rf"\b(?:class|object|trait)\s+{_W}", "class"), (rf"\binterface\s+{_W}", "interface"), (rf"\bstruct\s+{_W}", "struct"), (rf"\b(?:fun|func|fn|def|function|sub)\s+{_W}", "function"), _BODY],
}
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in RULES.items()}
_NOT_CALLS = frozenset("if for while switch catch return function typeof await new def class elif lambda not and or in is with assert func fn match when unless sizeof defer select case returns do else super constructor fun import require defmodule defp end raise throw yield print_ del except foreach using lock fixed guard repeat until elseif local let rec then begin fi done esac".split())
#: Words that look like a method's name before its parameters.
_CONTROL = frozenset("if for while switch catch return function else do new typeof await throw foreach using lock synchronized try rec in sizeof".split())
_CALL = re.compile(r"(?:([\w$\])?!]+)\s*(\?\.|\.|::|->|:)\s*)?\b([A-Za-z_$][\w$]*)[?!]?\s*\(")
#: Calls where they aren't written with parentheses; the callee is the third group.
_OTHER_CALLS: dict[str, re.Pattern] = {
    "bash": re.compile(r"(?m)(?:^|[;&|(`{]|\b(?:then|do|else|if|while|until)\b)()()[ \t]*([A-Za-z_][\w.\-]*)(?=[ \t\n;)&|]|\Z)(?!\s*(?:\(\)|=))"),
    "objc": re.compile(r"\[()()\s*(?:[\w.]+|\[[^\[\]]*\])\s+([A-Za-z_]\w*)"),
    "ocaml": re.compile(r"(?<![\w.'~?])()()([a-z_][\w']*)[ \t]+(?=[\w(\[~?])(?!(?:in|then|else|do|done|with|of|and|as|when|to|downto|mod|land|lor|lxor|lsl|lsr|asr|rec|end)\b)"),
}
_OCAML_HEAD = re.compile(r"\b(?:let|and|fun)\b[^=\n]*?(?:=|->)")
_HASH = frozenset("python ruby elixir bash php".split())
_INDENTED = frozenset("python ruby elixir lua ocaml".split())
_NOISE = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|/\*[\s\S]*?\*/|//[^\n]*')
_NOISE_HASH = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*')
#: Quotes of these are lifetimes, type variables or primes, and their comments have other signs.
_NOISES = {
    "ocaml": re.compile(r'"(?:\\.|[^"\\])*"|\(\*[\s\S]*?\*\)'), "lua": re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|--\[\[[\s\S]*?\]\]|--[^\n]*'),
    "rust": re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\[^\n]|[^\'\\\n])\'|/\*[\s\S]*?\*/|//[^\n]*'), "bash": re.compile(r'"(?:\\.|[^"\\])*"|\'[^\']*\'|(?:^|(?<=\s))#[^\n]*'),
}
_FROM = re.compile(r"(?m)^\s*from\s+([\w.]+)\s+import\s+([^\n(]+|\([^)]*\))")


def _goes_on(blank: str, start: int, stop: int) -> bool:
    """Whether a head goes on after the line that ends at ``stop``: a bracket is open, or a brace or an indented clause follows."""
    head = blank[start:stop]
    return head.count("(") > head.count(")") or bool(re.match(r"\s*(?:\{|where\b|throws\b|extends\b|implements\b|:|->)", blank[stop : stop + 200]))


def _ends(text: str, blank: str, start: int, language: str) -> int:
    """Where a definition that starts at ``start`` ends: its block's closing brace, or for Python its indentation."""
    if language in _INDENTED:
        begin = text.rfind("\n", 0, start) + 1
        indent = len(text[begin:start]) - len(text[begin:start].lstrip())
        at = text.find("\n", start)
        last = len(text) if at < 0 else at
        while 0 <= at < len(text):
            stop = text.find("\n", at + 1)
            stop = len(text) if stop < 0 else stop
            line = text[at + 1 : stop]
            if line.strip() and len(line) - len(line.lstrip()) <= indent and not line.strip().startswith(")"):
                if language in ("ruby", "elixir", "lua") and re.match(r"\s*end\b", line):
                    last = stop
                break
            if line.strip():
                last = stop
            at = stop
        return last
    at, stop = blank.find("{", start), blank.find("\n", start)
    semicolon = blank.find(";", start)
    if at < 0 or (0 <= semicolon < at) or (0 <= stop < at and not _goes_on(blank, start, stop)):
        ends = [x for x in (stop, semicolon + 1 if semicolon >= 0 else -1) if x >= 0]
        return min(ends) if ends else len(text)
    depth = 0
    for i in range(at, len(blank)):
        depth += {"{": 1, "}": -1}.get(blank[i], 0)
        if not depth:
            return i + 1
    return len(text)


def read_code(out: Out, text: str, shift: int = 0) -> None:
    language = out.language
    noise = _NOISES.get(language) or (_NOISE_HASH if language in _HASH else _NOISE)
    blank = noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda i: text.count("\n", 0, i) + 1 + shift
    found: dict[int, tuple[str, str, int, int]] = {}
    for pattern, kind in _COMPILED.get(language, _COMPILED[""]):
        for m in pattern.finditer(blank):
            if m[1] not in _CONTROL and m.start(1) not in found:
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                found[m.start(1)] = (m[1], kind, begin, _ends(text, blank, begin, language))
    definitions = sorted((b, e, n, k, at) for at, (n, k, b, e) in found.items())
    placed, stack, by_name = [], [], {}
    for begin, end, name, kind, at in definitions:
        while stack and stack[-1][1] <= begin:
            stack.pop()
        full = ".".join([*(s[2] for s in stack), name])
        if kind == "function" and language == "php" and stack and stack[-1][3] == "class":
            kind = "method"
        head = text[text.rfind("\n", 0, begin) + 1 : begin + 200]
        exported = bool(re.match(r"\s*(?:export|pub)\b", head)) if language == "rust" else name[:1].isupper() if language == "go" else not name.startswith("_")
        i = out.node(kind, full, line(begin), line(max(begin, end - 1)), signature=text[begin:end].split("{")[0].split("\n")[0].strip()[:200], exported=exported and not stack)
        out.edge(stack[-1][4] if stack else out.file, i, "contains", line(begin), "ast_exact", 1.0, language)
        stack.append((begin, end, name, kind, i))
        placed.append((begin, end, i))
        if language != "elixir" or kind != "module":
            by_name.setdefault(name, i)  # the first definition of a name counts
    names_at = set(found)
    starts = iter([*placed, (1 << 60, 0, "")])
    upcoming, open_ = next(starts), []
    heads = [m.span() for m in _OCAML_HEAD.finditer(blank)] if language == "ocaml" else []
    head = 0
    for m in _OTHER_CALLS.get(language, _CALL).finditer(blank):
        while upcoming[0] <= m.start(3):
            open_.append(upcoming)
            upcoming = next(starts)
        while head < len(heads) and heads[head][1] <= m.start(3):
            head += 1
        name = m[3]
        if name in _NOT_CALLS or m.start(3) in names_at or head < len(heads) and heads[head][0] <= m.start(3):
            continue
        while open_ and open_[-1][1] <= m.start(3):
            open_.pop()
        owner = open_[-1][2] if open_ else out.file
        sign = m[2] if m[2] != ":" or language == "lua" else ""
        if sign and m[1] not in ("this", "self", "Self", "$this"):
            out.unresolved(owner, name, line(m.start(3)), "dynamic-dispatch", language)
        elif name in by_name:
            out.edge(owner, by_name[name], "calls", line(m.start(3)), "ast_exact", 1.0, language)
        else:
            out.unresolved(owner, name, line(m.start(3)), "unresolved-callee", language)
    if language == "python":
        for m in _FROM.finditer(text):
            for item in (x.strip() for x in m[2].strip("()").split(",") if x.strip()):
                name, _, local = item.partition(" as ")
                out.imported((local or name).strip(), name.strip(), m[1], line(m.start(1)))


_SCRIPT_BLOCK = re.compile(r"(?is)<script\b[^>]*>(.*?)</script>|\A---\n(.*?)\n---")


def read_component(out: Out, text: str) -> None:
    """Every script block as TypeScript with its lines shifted; such files import nothing."""
    language, out.language = out.language, "typescript"
    for m in _SCRIPT_BLOCK.finditer(text):
        group = 1 if m[1] is not None else 2
        read_script(out, m[group], text.count("\n", 0, m.start(group)))
    out.language = language
    out.rows = [r for r in out.rows if r["what"] != "import"]


READERS = {"typescript": read_script, "javascript": read_script, "markdown": read_docs, "manifest": read_manifest, "mcp": read_servers, "terraform": read_terraform, **dict.fromkeys(("vue", "svelte", "astro"), read_component)}


def extract(path: str, language: str | None, text: str | None) -> list[dict]:
    if not language:
        return []
    out = Out(path, language, text or "")
    if text:
        try:
            READERS.get(language, read_code)(out, text)
        except (ValueError, AttributeError):  # not what its name says
            del out.rows[1:]
    return out.rows


def extract_files(files: DataFrame) -> DataFrame:
    """All rows of ``files`` (path, language, text); ``what`` tells nodes, edges and imports apart."""

    return files.select("path", "language", "text").mapInArrow(lambda batches: _batches(map(lambda f: extract(*f), _files(batches)), _ARROW), ROW)


#: Rows of extracted files that are handed on at once; a file's rows stay together.
_ROWS = 4096


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(3)))


def _batches(lists: Iterable[list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for rows in lists:
        held += rows
        if len(held) >= _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


NAMED = "path string, source string, target string, kind string, read_write string, provenance string, line int"
_NAMED = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in NAMED.split(", "))])


def _named(path: str, language: str | None, text: str | None) -> list[dict]:
    rows = extract(path, language, text)
    names = {r["id"]: r["qualified_name"] for r in rows if r["what"] == "node"}  # an id once a file
    edges = (r for r in rows if r["what"] == "edge" and r["source"] in names and r["target"] in names)
    return [{"path": path, **{c: r[c] for c in ("kind", "read_write", "provenance", "line")}, "source": names[r["source"]], "target": names[r["target"]]} for r in edges]


def named_edges(files: DataFrame) -> DataFrame:
    """The edges of ``files`` (path, language, text) between nodes of one file, by the names of their ends; each file is read once."""
    return files.select("path", "language", "text").mapInArrow(lambda batches: _batches(map(lambda f: _named(*f), _files(batches)), _NAMED), NAMED)


def graph_of(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (of an id written by several files the last in path order), edges and imports."""
    from graphloom.operators.graph import upsert_nodes

    cols = "id kind qualified_name file_path language start_line end_line signature docstring is_exported".split()
    nodes = upsert_nodes(extracted.filter("what = 'node'").select(*cols, F.struct("path", "seq").alias("order")), "order")
    edges = extracted.filter("what = 'edge'").select(
        "source", "target", "kind", "line", F.lit(1).alias("col"), "provenance", "confidence", "resolver", "read_write",
        F.when(F.col("boundary").isNotNull(), F.create_map(F.lit("boundary"), F.col("boundary"))).alias("metadata"),
    )
    imports = extracted.filter("what = 'import'").select(F.col("path").alias("file"), "local_name", "imported_name", "module_spec", "line", "seq")
    return nodes, edges, imports
