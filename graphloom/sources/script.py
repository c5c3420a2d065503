"""TypeScript and JavaScript without a compiler: tokens, brackets, declarations, function scopes, calls and references.

Tokens are matched to brackets first. A scan over them finds what declares a name (functions, classes and their
methods, interfaces, types, enums, variables, parameters) and what opens a scope (anything with a body of its own:
functions, methods, arrow functions). Items are then nested by their extent, which gives every name its scope and
its dotted path. A last pass looks at every identifier: a bare call means the innermost declaration of its name; a
call on a receiver means a method of the receiver's class where that is ``this``, annotated or made by ``new``; any
other identifier that leads to a variable, parameter, type or the like is a reference, marked by what is done to it.

Defined cases: names taken apart by patterns are not declared; parameters of bare type signatures are not declared;
brackets that don't match end with the text; what can't be read is passed over, never an error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>[\s﻿]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<name>\#?[A-Za-z_$ª-￿][\w$]*)|(?P<number>\d[\w.]*)"""
    r"""|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')"""
    r"""|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[\s\S])"""
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, frozenset(")]}")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || ?? += + - * % < > return typeof case in of delete void throw new do else".split())
_COMPOUND = frozenset("+= -= *= **= /= %= <<= >>= >>>= &= |= ||= &&= ??= ^=".split())
_JOINS = frozenset(". ?. = + - * / % & | ^ < > ? : , && || ?? == != === !== <= >= => ( [ { in of instanceof extends new typeof await return".split()) | _COMPOUND
_MODIFIERS = frozenset("public private protected static readonly abstract override async declare get set accessor export default".split())
_WORDS = frozenset(
    "if else for while do switch case return function class const let var new typeof instanceof in of await async yield throw try catch finally delete void this super import export from as default extends implements "
    "interface type enum null true false undefined break continue with debugger static public private protected readonly abstract declare namespace keyof is infer satisfies get set".split()
)


@dataclass
class Item:
    """A stretch of tokens that declares a name, opens a scope, or both."""

    start: int
    end: int
    name: str | None = None
    kind: str = ""
    at: int = -1
    exported: bool = False
    scope: bool = False
    pushes: bool = False
    type: str | None = None
    init: int = -1
    body: int = -1
    id: str = ""


@dataclass
class Scope:
    owner: str
    parent: Scope | None
    names: dict[str, Item] = field(default_factory=dict)

    def find(self, name: str) -> Item | None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.parent
        return None


def tokens_of(source: str) -> list[tuple[str, int, int, str]]:
    """(text, start, end, kind) of each token; template strings are one token a stretch, with ``${`` and ``}`` as brackets."""
    out: list[tuple[str, int, int, str]] = []
    at, size, open_ = 0, len(source), []  # open_: for each template part that is open, the braces inside it

    def template(at: int) -> int:
        end = _TEMPLATE.match(source, at).end()
        if source.startswith("${", end):
            out.append(("${", end, end + 2, "sign"))
            open_.append(0)
            return end + 2
        return end + 1

    while at < size:
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if kind == "skip":
            at = m.end()
            continue
        if text == "`":
            out.append(("`", at, at + 1, "text"))
            at = template(at + 1)
            continue
        if text in ("/", "/=") and (not out or out[-1][0] in _BEFORE_REGEX) and (r := _REGEX.match(source, at)):
            out.append((r[0], at, r.end(), "text"))
            at = r.end()
            continue
        out.append((text, at, m.end(), kind))
        at = m.end()
        if open_ and text == "{":
            open_[-1] += 1
        elif open_ and text == "}":
            if open_[-1]:
                open_[-1] -= 1
            else:
                open_.pop()
                at = template(at)
    return out


class Script:
    def __init__(self, source: str):
        self.source = source
        self.tokens = tokens_of(source)
        self.text = [t[0] for t in self.tokens]
        self.lines = [i for i, c in enumerate(source) if c == "\n"]
        self.match = self._brackets()
        self.items: list[Item] = []
        self.classes: list[tuple[int, int, str]] = []
        self.imports: list[tuple[str, str, str, int]] = []
        self.names_at: set[int] = set()

    def line(self, token: int) -> int:
        return bisect_right(self.lines, self.tokens[token][1] - 1) + 1

    def _brackets(self) -> list[int]:
        match, stack = [len(self.text) - 1] * len(self.text), []
        for i, t in enumerate(self.text):
            if self.tokens[i][3] != "sign":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                while stack and _OPEN[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    match[i], match[j] = j, i
        return match

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.tokens[i][3] == "name"

    def is_at(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.text) and self.text[i] in texts

    def new_line(self, i: int) -> bool:
        """Whether a statement may end before token i: it starts a line, and neither side goes on."""
        if not 0 < i < len(self.text):
            return i >= len(self.text)
        a, b = self.tokens[i - 1][2], self.tokens[i][1]
        return "\n" in self.source[a:b] and self.text[i - 1] not in _JOINS and self.text[i] not in _JOINS - {"new", "typeof", "await", "return", "(", "[", "{"}

    def past_type(self, i: int) -> int:
        """The token after a type that starts at i."""
        depth, first = 0, i
        while i < len(self.text):
            t = self.text[i]
            if t in _OPEN:
                if t == "{" and i > first and depth == 0 and self.text[i - 1] not in ("|", "&", ":", "=>", ",", "<", "extends", "keyof", "readonly"):
                    return i
                i = self.match[i] + 1
                if self.is_at(i, "=>") and depth == 0 and t == "(":
                    i += 1
                continue
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth < 0:
                    return i
            elif depth == 0 and (t in ("=", ",", ";", ")", "]", "}", "=>", "of", "in") or i > first and self.new_line(i) and t not in ("|", "&")):
                return i
            i += 1
        return i

    def past_expression(self, i: int) -> int:
        """The token after an expression that starts at i: a comma, a semicolon, a closing bracket or a line's end."""
        first = i
        while i < len(self.text):
            t = self.text[i]
            if self.tokens[i][3] == "sign":
                if t in (",", ";") or t in _CLOSE:
                    return i
                if t in _OPEN:
                    i = max(i, self.match[i]) + 1
                    if self.new_line(i):
                        return i
                    continue
            if i > first and self.new_line(i):
                return i
            i += 1
        return i

    def past_angles(self, i: int) -> int:
        if not self.is_at(i, "<"):
            return i
        depth = 0
        for j in range(i, min(i + 200, len(self.text))):
            depth += {"<": 1, ">": -1}.get(self.text[j], 0)
            if not depth:
                return j + 1
        return i

    # --- finding items

    def add(self, **values) -> Item:
        item = Item(**values)
        if item.at >= 0 and item.name != "constructor":
            self.names_at.add(item.at)
        self.items.append(item)
        return item

    def parameters(self, open_: int) -> None:
        i, close = open_ + 1, self.match[open_]
        while i < close:
            while self.is_at(i, "@"):
                i = self.past_angles(i + 2)
                i = self.match[i] + 1 if self.is_at(i, "(") else i
            while self.is_at(i, "...") or self.text[i] in _MODIFIERS and self.is_name(i + 1):
                i += 1
            start, name, kind = i, None, None
            if self.is_name(i) and self.text[i] != "this":
                name = self.text[i]
            i = self.match[i] + 1 if self.text[i] in ("{", "[") else i + 1
            i += self.is_at(i, "?")
            if self.is_at(i, ":"):
                end = self.past_type(i + 1)
                kind, i = self.text[i + 1] if self.is_name(i + 1) and not self.is_at(i + 2, ".") else None, end
            if self.is_at(i, "="):
                i = self.past_expression(i + 1)
            if name:
                self.add(start=start, end=i, name=name, kind="variable", at=start, type=kind)
            while i < close and self.text[i] != ",":
                i = self.match[i] + 1 if self.text[i] in _OPEN else i + 1
            i += 1

    def body_after(self, close: int) -> tuple[int, int]:
        """(token of the body's brace or -1, token after the whole) of a parameter list that ends at ``close``."""
        i = close + 1
        if self.is_at(i, ":"):
            i = self.past_type(i + 1)
        if self.is_at(i, "{"):
            return i, self.match[i] + 1
        return -1, i

    def function(self, i: int, start: int, exported: bool) -> None:
        """``function`` at i."""
        j = i + 1 + self.is_at(i + 1, "*")
        name = self.text[j] if self.is_name(j) and not self.is_at(j, "(") else None
        open_ = self.past_angles(j + 1 if name else j)
        if not self.is_at(open_, "("):
            return
        body, end = self.body_after(self.match[open_])
        declares = name and self._starts_statement(start)
        self.add(start=start if declares else i, end=end, name=name if declares else None, kind="function", at=j if declares else -1, exported=exported, scope=True, pushes=bool(declares), body=body)
        self.parameters(open_)

    def _starts_statement(self, i: int) -> bool:
        return i == 0 or self.text[i - 1] in ("{", "}", ";", ")", "else", ":") or self.new_line(i) or self.tokens[i - 1][3] == "text" or self.text[i - 1] == "]"

    def arrow(self, i: int) -> None:
        """``=>`` at i; an arrow in a type opens a scope without names, which does no harm."""
        j, open_ = i - 1, -1
        if self.is_at(j, ")"):
            open_ = self.match[j]
        elif self.is_name(j) and not self.is_at(j - 1, ":", ".", "|", "&", "is", ">"):
            open_ = -2
        else:
            for k in range(j, max(-1, j - 80), -1):
                if self.is_at(k, ":") and self.is_at(k - 1, ")"):
                    open_ = self.match[k - 1]
                    break
        if open_ == -1:
            return
        start = j if open_ == -2 else open_
        if start > 0 and self.text[start - 1] == ">" and open_ >= 0:
            for k in range(start - 1, max(-1, start - 40), -1):
                if self.text[k] == "<" and self.past_angles(k) == start:
                    start = k
                    break
        start -= self.is_at(start - 1, "async")
        end = self.match[i + 1] + 1 if self.is_at(i + 1, "{") else self.past_expression(i + 1)
        self.add(start=start, end=end, scope=True, body=i + 1)
        if open_ == -2:
            self.add(start=j, end=i, name=self.text[j], kind="variable", at=j)
        else:
            self.parameters(open_)

    def variables(self, i: int) -> None:
        """``const``, ``let`` or ``var`` at i."""
        const, i = self.text[i] == "const", i + 1
        while self.is_name(i) or self.is_at(i, "{", "["):
            start, name, kind, init = i, self.text[i] if self.is_name(i) else None, None, -1
            i = i + 1 if name else self.match[i] + 1
            i += self.is_at(i, "!")
            if self.is_at(i, ":"):
                kind = self.text[i + 1] if self.is_name(i + 1) and not self.is_at(i + 2, ".") else None
                i = self.past_type(i + 1)
            if self.is_at(i, "="):
                init = i + 1
                if kind is None and self.is_at(init, "new") and self.is_name(init + 1) and not self.is_at(init + 2, "."):
                    kind = self.text[init + 1]
                i = self.past_expression(init)
            if name:
                self.add(start=start, end=i, name=name, kind="constant" if const else "variable", at=start, type=kind, init=init)
            if not self.is_at(i, ","):
                break
            i += 1

    def members(self, open_: int, of_class: bool) -> None:
        """Methods between the braces of a class or an object."""
        i, close = open_ + 1, self.match[open_]
        while i < close:
            while self.is_at(i, "@"):
                i += 2
                while self.is_at(i, "."):
                    i += 2
                i = self.match[i] + 1 if self.is_at(i, "(") else i
            start = i
            while i < close and (self.text[i] in _MODIFIERS and (self.is_name(i + 1) or self.is_at(i + 1, "*", "[", "{") or self.tokens[i + 1][3] == "text") or self.text[i] == "*"):
                i += 1
            if of_class and self.is_at(i, "{"):  # a static block
                i = self.match[i] + 1
                continue
            named = self.is_name(i)
            at = i
            i = self.match[i] + 1 if self.is_at(i, "[") else i + 1
            j = self.past_angles(i + (self.is_at(i, "?") or self.is_at(i, "!")))
            if self.is_at(j, "(") and j < close:
                body, end = self.body_after(self.match[j])
                if body >= 0 or of_class:
                    if named and not self.text[at].startswith("#"):
                        self.add(start=start, end=end, name=self.text[at], kind="method", at=at, scope=True, pushes=True, body=body)
                    else:
                        self.add(start=start, end=end, scope=True, body=body)
                    self.parameters(j)
                    i = end
            while i < close and not self.is_at(i, ";", ","):
                if of_class and self.new_line(i) and i > at + 1 and not self.is_at(i - 1, "=", ":"):
                    break
                i = max(i, self.match[i]) + 1 if self.text[i] in _OPEN else i + 1
            while self.is_at(i, ";", ","):
                i += 1

    def imported(self, i: int) -> None:
        """``import`` at i."""
        j, local, named, line = i + 1, None, [], self.line(i)
        if self.is_at(j, "(", "."):
            return
        j += self.is_at(j, "type") and (self.is_name(j + 1) and not self.is_at(j + 1, "from") or self.is_at(j + 1, "{", "*"))
        if self.is_name(j):
            local, j = self.text[j], j + 1
            j += self.is_at(j, ",")
        if self.is_at(j, "*") and self.is_at(j + 1, "as"):
            named.append((self.text[j + 2], "*"))
            j += 3
        elif self.is_at(j, "{"):
            k, end = j + 1, self.match[j]
            while k < end:
                k += self.is_at(k, "type") and self.is_name(k + 1) and not self.is_at(k + 1, "as")
                name = self.text[k]
                k, other = (k + 3, self.text[k + 2]) if self.is_at(k + 1, "as") else (k + 1, name)
                named.append((other, name.strip("\"'")))
                k += self.is_at(k, ",")
            j = end + 1
        if not self.is_at(j, "from") or j + 1 >= len(self.text) or self.tokens[j + 1][3] != "text":
            return
        spec = self.text[j + 1][1:-1]
        self.imports += [(a, b, spec, line) for a, b in ([(local, "default")] if local else []) + named]
        self.names_at.update(range(i, j + 1))

    def find_items(self) -> None:
        text = self.text
        for i, t in enumerate(text):
            if self.tokens[i][3] != "name":
                if t == "=>" and self.tokens[i][3] == "sign":
                    self.arrow(i)
                elif t == "{" and i and text[i - 1] in ("(", ",", "=", "[", "return", ":", "?") and not self._after_case(i):
                    self.members(i, False)
                continue
            if self.is_at(i - 1, ".", "?.") or self.is_at(i + 1, ":") and t not in ("default",):
                continue
            start = i
            while start > 0 and text[start - 1] in ("export", "default", "async", "abstract", "declare"):
                start -= 1
            exported = "export" in text[start:i]
            if t == "function":
                self.function(i, start, exported)
            elif t == "class":
                name = text[i + 1] if self.is_name(i + 1) and text[i + 1] not in ("extends", "implements") else None
                j = i + 1
                while j < len(text) and text[j] != "{":
                    j = self.match[j] + 1 if text[j] in ("(", "[") else j + 1
                if j < len(text):
                    if name and self._starts_statement(start):
                        self.add(start=start, end=self.match[j] + 1, name=name, kind="class", at=i + 1, exported=exported, pushes=True)
                        self.classes.append((start, self.match[j] + 1, name))
                    self.members(j, True)
            elif t in ("interface", "enum") and self.is_name(i + 1) and self._starts_statement(start - self.is_at(start - 1, "const")):
                j = i + 2
                while j < len(text) and text[j] != "{":
                    j += 1
                if j < len(text):
                    self.add(start=start, end=self.match[j] + 1, name=text[i + 1], kind=t, at=i + 1, exported=exported)
            elif t == "type" and self.is_name(i + 1) and self.is_at(self.past_angles(i + 2), "=") and self._starts_statement(start):
                self.add(start=start, end=self.past_type(self.past_angles(i + 2) + 1), name=text[i + 1], kind="type_alias", at=i + 1, exported=exported)
            elif t in ("const", "let", "var") and not self.is_at(i + 1, "enum"):
                self.variables(i)
            elif t == "catch" and self.is_at(i + 1, "(") and self.is_name(i + 2):
                self.add(start=i + 2, end=i + 3, name=text[i + 2], kind="variable", at=i + 2)
            elif t == "import":
                self.imported(i)

    def _after_case(self, i: int) -> bool:
        """Whether the brace at i opens a block after a label or case rather than an object."""
        return self.text[i - 1] == ":" and self.is_at(i - 3, "case") or self.is_at(i - 2, "default")


def _signature(text: str) -> str:
    head = text.partition("{")[0] if "{" in text else text.partition("\n")[0]
    return head.strip()[:200]


def read_script(out, source: str, shift: int = 0) -> None:
    """Adds nodes, edges and imports of a script to ``out``; ``shift`` lines come before it in its file."""
    s = Script(source)
    s.find_items()
    tokens, text = s.tokens, s.text
    line = lambda i: s.line(min(i, len(tokens) - 1)) + shift
    starts_function = {i.start for i in s.items if i.scope and not i.name}
    order = sorted(range(len(s.items)), key=lambda n: (s.items[n].start, -s.items[n].end, n))
    root = Scope(out.file, None)
    open_: list[tuple[int, Scope, str | None]] = [(1 << 60, root, None)]
    scopes: list[tuple[int, int, Scope]] = []
    owners: dict[int, str] = {}
    methods: dict[str, dict[str, str]] = {}
    for n in order:
        item = s.items[n]
        while open_[-1][0] <= item.start:
            open_.pop()
        scope = open_[-1][1]
        if item.name:
            full = ".".join([*(o[2] for o in open_ if o[2]), item.name])
            kind = "function" if item.init in starts_function and item.init >= 0 else item.kind
            a, b = tokens[item.start][1], tokens[max(item.start, item.end - 1)][2]
            item.kind = kind
            item.id = out.node(kind, full, line(item.start), line(max(item.start, item.end - 1)), signature=_signature(source[a:b]), exported=item.exported)
            scope.names[item.name] = item
            out.edge(scope.owner, item.id, "contains", line(item.start), "ast_exact", 1.0, "ts-scope")
            if kind == "method":
                owner, _, short = full.rpartition(".")
                methods.setdefault(owner, {})[short] = item.id
            if item.init >= 0 and kind == "function":
                owners[item.init] = item.id
        if item.scope:
            scope = Scope(item.id or owners.get(item.start) or scope.owner, scope)
            scopes.append((item.start, item.end, scope))
        if item.scope or item.pushes:
            open_.append((item.end, scope, item.name if item.pushes else None))
    writes = {i.at: i for i in s.items if i.init >= 0}
    here, pending, inside = [(1 << 60, root)], iter([*scopes, (1 << 60, 0, root)]), 0
    upcoming = next(pending)
    classes = sorted(s.classes)
    open_classes: list[tuple[int, str]] = []
    for i, t in enumerate(text):
        while upcoming[0] <= i:
            while here[-1][0] <= upcoming[0]:
                here.pop()
            here.append((upcoming[1], upcoming[2]))
            upcoming = next(pending)
        while here[-1][0] <= i:
            here.pop()
        while inside < len(classes) and classes[inside][0] <= i:
            open_classes.append((classes[inside][1], classes[inside][2]))
            inside += 1
        while open_classes and open_classes[-1][0] <= i:
            open_classes.pop()
        if tokens[i][3] != "name":
            continue
        scope = here[-1][1]
        if i in writes:
            found = scope.find(t)
            if found:
                out.edge(scope.owner, found.id, "references", line(i), "ast_exact", 1.0, "ts-scope", read_write="write")
            continue
        after = s.past_angles(i + 1) if s.is_at(i + 1, "<") else i + 1
        called = s.is_at(after, "(") or s.is_at(i + 1, "?.") and s.is_at(i + 2, "(")
        if s.is_at(i - 1, ".", "?."):
            if not called or s.is_at(i - 2, "super") or _made_by_new(s, i):
                continue
            receiver, bare = text[i - 2] if i > 1 else "", not s.is_at(i - 3, ".", "?.")
            kind = None
            if receiver == "this" and bare:
                kind = open_classes[-1][1] if open_classes else None
            elif bare and i > 1 and tokens[i - 2][3] == "name" and (found := scope.find(receiver)):
                kind = found.type
            goal = methods.get(kind or "", {}).get(t)
            at = line(_first_of_chain(s, i))
            if goal:
                out.edge(scope.owner, goal, "calls", at, "ast_inferred", 0.85, "ts-type", read_write="call")
            else:
                out.unresolved(scope.owner, t, at, "dynamic-dispatch", "ts-type")
            continue
        if i in s.names_at or t in _WORDS:
            continue
        found = scope.find(t)
        if called and not s.is_at(i - 1, "new", "function"):
            if found:
                out.edge(scope.owner, found.id, "calls", line(i), "ast_exact", 1.0, "ts-scope", read_write="call")
            else:
                out.unresolved(scope.owner, t, line(i), "unresolved-callee", "ts-scope")
            continue
        if not found or found.kind in ("function", "class") or found.id == scope.owner or s.is_at(i + 1, ":") and s.is_at(i - 1, "{", ","):
            continue
        use = "write" if s.is_at(i + 1, "=") else "readwrite" if s.is_at(i + 1, "++", "--") or s.is_at(i - 1, "++", "--") or i + 1 < len(text) and text[i + 1] in _COMPOUND else "read"
        out.edge(scope.owner, found.id, "references", line(i), "ast_exact", 1.0, "ts-scope", read_write=use)
    for local, name, spec, at in s.imports:
        out.imported(local, name, spec, at + shift)


def _first_of_chain(s: Script, i: int) -> int:
    """The first token of the expression a.b.c that ends at i."""
    while s.is_at(i - 1, ".", "?."):
        i -= 2
        while i > 0 and s.text[i] in (")", "]") and s.tokens[i][3] == "sign":
            i = min(i, s.match[i])
            i -= s.is_name(i - 1) or s.is_at(i - 1, ")", "]")
        if i <= 0:
            return 0
    return i


def _made_by_new(s: Script, i: int) -> bool:
    """Whether the name at i ends a dotted name after ``new``."""
    while s.is_at(i - 1, ".") and s.is_name(i - 2):
        i -= 2
    return s.is_at(i - 1, "new")
