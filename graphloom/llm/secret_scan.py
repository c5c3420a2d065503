"""Secret scan by linking the parts of a credential.

Three kinds of part are located as character spans of the whole text: access identifiers (key ids, labelled
users or clients, mail addresses), secrets (labelled values, provider formats, private keys, bare high-entropy
strings) and endpoints (URLs, IPv4 addresses, labelled hosts). The scope is the whole document: its spans, widened
by a window, are interval-joined by searches in their sorted starts and ends, so parts on neighbouring lines meet
(``.env``, INI and YAML files put each on a line of its own). A strong secret is reported by itself. Every weaker part is reported only where complementary parts co-occur: a weak secret next to an
identifier or endpoint, an identifier or endpoint next to a secret that is reported.

Labels are words between ``_``, ``-`` or the humps of camelCase. A labelled value may be of any length; a short one
is weak like any other. A URL with user information (``scheme://user:password@host``, read up to the last ``@`` before
the path) is an identifier, a secret and an endpoint that starts at the host. A private key reaches to the END line of its label,
whatever its length and headers; without one it takes the rest of the text.

Defined cases: null, empty and blank texts have no findings; overlapping candidates of a kind keep the one that
starts first, then the longest; findings of one row do not depend on other rows, so repeated rows repeat theirs;
a null ``doc_id`` is carried along; an empty table gives no findings; extra columns are neither read nor changed.
Scopes never cross documents, so the join needs no shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that may lie between two parts of one credential.
WINDOW = 160
#: Bits per character from which a value counts as random.
MIN_ENTROPY = 3.0
#: Characters from which a labelled random value is strong by itself.
STRONG_LENGTH = 20
MASK = "[REDACTED]"

_VALUE = re.compile(r"[:=][ \t]*[\"'`]?([A-Za-z0-9_\-+/=.@~!#%^&*]+)")
_LABEL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SECRET_LABEL = re.compile(r"(?i)(?:^|[_\-])(?:secret|token|passw(?:or)?d|passwd|pwd|passphrase|api[_\-]?key|apikey|private[_\-]?key|secret[_\-]?key|auth|credential|bearer)s?(?:$|[_\-])")
_ID_LABEL = re.compile(r"(?i)(?:^|[_\-])(?:client[_\-]?id|access[_\-]?key(?:[_\-]?id)?|key[_\-]?id|user(?:[_\-]?name)?|login|account(?:[_\-]?id)?|tenant(?:[_\-]?id)?)$")
_HOST_LABEL = re.compile(r"(?i)(?:^|[_\-])(?:host(?:name)?|endpoint|server|url|uri|region|bucket)$")
_PROVIDER = re.compile(r"\b(?:ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[abpr]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20,})")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
_KEY_ID = re.compile(r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}\b")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{32,}={0,2}(?![A-Za-z0-9+/_\-])")
_DIGIT = re.compile("[0-9]")
_LONG = re.compile(r"[A-Za-z0-9+/_\-]{32,}")
_MAIL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+")
_URL = re.compile(r"\b[a-z][a-z0-9+.\-]{1,15}://[^\s\"'<>]+")
_USERINFO = re.compile(r"://([^\s\"'<>/?#]*)@")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.]*\d)")

Part = tuple[int, int, str, str, bool]  # start, end, kind, rule, strong


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _is_label(kind: re.Pattern, name: str) -> bool:
    """``dbPassword`` counts as ``db_Password``; whole names count as they are."""
    return bool(kind.search(name) or kind.search(_HUMP.sub("_", name)))


def _label_before(text: str, end: int) -> str:
    """The word before ``end``, whatever its length; blanks and a quote may lie between. Words of values don't overlap."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    at = end
    while at and text[at - 1] in _LABEL_CHARS:
        at -= 1
    return text[at:end].lstrip("0123456789_-")


def _url_parts(text: str) -> tuple[list[Part], list[tuple[int, int]]]:
    """The parts of every URL, and the spans in which no other labelled value or mail address starts."""
    out: list[Part] = []
    taken: list[tuple[int, int]] = []
    for m in _URL.finditer(text):
        a, b = m.span()
        info = _USERINFO.match(text, text.index("://", a), b)
        if not info:
            out.append((a, b, "endpoint", "url", False))
            taken.append((a, a + 1))
            continue
        user, colon, password = info.group(1).partition(":")
        at, host = info.start(1), info.end()
        if user:
            out.append((at, at + len(user), "access_id", "userinfo", False))
        if password:
            out.append((at + len(user + colon), host - 1, "secret", "userinfo", False))
        if host < b:
            out.append((host, b, "endpoint", "url", False))
        taken.append((a, host))
    return out, taken


def _private_keys(text: str) -> list[tuple[int, int]]:
    """From each BEGIN line to the next END line of the same label, or to the end of the text."""
    out: list[tuple[int, int]] = []
    marks = list(_PEM.finditer(text))
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in marks:
        if m.group(1) == "END":
            ends.setdefault(m.group(2), []).append(m.span())
    last = 0
    for m in marks:
        if m.group(1) == "BEGIN" and m.start() >= last:
            own = ends.get(m.group(2), [])
            i = bisect.bisect_left(own, m.span())
            last = own[i][1] if i < len(own) else len(text)
            out.append((m.start(), last))
    return out


def find_parts(text: str) -> list[Part]:
    """Every candidate span, without overlap inside a kind, in order of start."""
    out: list[Part] = []
    taken: list[tuple[int, int]] = []
    if "://" in text:
        urls, taken = _url_parts(text)
        out += urls

    def free(at: int) -> bool:
        i = bisect.bisect_right(taken, (at, len(text))) - 1
        return i < 0 or at >= taken[i][1]

    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            name = _label_before(text, m.start())
            if not name or not free(m.start(1)):
                continue
            value, a = m.group(1).rstrip(".,"), m.start(1)
            b = a + len(value)
            if not value.strip("="):
                continue
            if _is_label(_SECRET_LABEL, name):
                out.append((a, b, "secret", "labelled", len(value) >= STRONG_LENGTH and entropy(value) >= MIN_ENTROPY))
            elif _is_label(_ID_LABEL, name):
                out.append((a, b, "access_id", "labelled", False))
            elif _is_label(_HOST_LABEL, name):
                out.append((a, b, "endpoint", "labelled", False))
    if "_" in text or "-" in text or "AIza" in text:
        out += [(*m.span(), "secret", "provider", True) for m in _PROVIDER.finditer(text)]
        if "-----BEGIN" in text:
            out += [(*span, "secret", "private_key", True) for span in _private_keys(text)]
    if "@" in text:
        out += [(*m.span(), "access_id", "mail", False) for m in _MAIL.finditer(text) if free(m.start())]
    out += [(*m.span(), "endpoint", "ipv4", False) for m in _IP.finditer(text)]
    if _LONG.search(text):
        out += [(*m.span(), "access_id", "key_id", False) for m in _KEY_ID.finditer(text)]
        out += [(*m.span(), "secret", "bare", False) for m in _BARE.finditer(text) if _DIGIT.search(text, *m.span()) and entropy(m.group()) >= MIN_ENTROPY]
    elif "A" in text:
        out += [(*m.span(), "access_id", "key_id", False) for m in _KEY_ID.finditer(text)]
    kept, last = [], {}
    for p in sorted(out, key=lambda p: (p[0], not p[4], -p[1], p[2], p[3])):
        if p[0] >= last.get(p[2], 0):
            kept.append(p)
            last[p[2]] = p[1]
    return kept


def link(parts: list[Part], window: int = WINDOW) -> list[tuple]:
    """(start, end, kind, rule, confidence, link_start, link_end) of what is reported, in order."""
    secrets = [p for p in parts if p[2] == "secret"]
    others = [p for p in parts if p[2] != "secret"]
    if not secrets:
        return []
    kinds = []  # spans of one kind don't overlap, so their ends are sorted as their starts are
    for kind in ("access_id", "endpoint"):
        at = [i for i, p in enumerate(others) if p[2] == kind]
        kinds.append((at, [others[i][0] for i in at], [others[i][1] for i in at]))
    found: list[tuple] = []
    touched: dict[int, Part] = {}
    for s in secrets:
        near = sorted(
            i for at, starts, ends in kinds for i in at[bisect.bisect_left(ends, s[0] - window) : bisect.bisect_right(starts, s[1] + window)]
            if not (others[i][0] < s[1] and s[0] < others[i][1])
        )
        if near:
            best = min(near, key=lambda i: (max(others[i][0] - s[1], s[0] - others[i][1]), i))
            found.append((*s[:4], "strong" if s[4] else "linked", *others[best][:2]))
            for i in near:
                touched.setdefault(i, s)
        elif s[4]:
            found.append((*s[:4], "strong", None, None))
    found += [(*others[i][:4], "linked", *s[:2]) for i, s in touched.items()]
    return sorted(found, key=lambda f: (f[0], f[1], f[2]))


def scan_document(text: str | None, window: int = WINDOW) -> list[tuple]:
    """What is reported of a text."""
    return link(find_parts(text), window) if text else []


_NUMBERS = {"span_start", "span_end", "link_start", "link_end"}
_FIELDS = ("span_start", "span_end", "part", "rule", "confidence", "link_start", "link_end", "value_sha256")
FINDING = T.StructType([T.StructField(x, T.IntegerType() if x in _NUMBERS else T.StringType()) for x in _FIELDS])


@F.pandas_udf(T.ArrayType(FINDING))
def scan_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[dict(zip(_FIELDS, (*f, hashlib.sha256(t[f[0] : f[1]].encode("utf-8", "surrogatepass")).hexdigest()))) for f in scan_document(t)] for t in batch], dtype=object)


def redact(text: str | None) -> str | None:
    """The text with every reported secret and access identifier replaced by a mask; endpoints stay."""
    found = [f for f in scan_document(text) if f[2] != "endpoint"]
    if not found:
        return text
    out, at = [], 0
    for start, end, *_ in found:
        if end > at:
            out += [text[at : max(at, start)], MASK]
            at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def redact_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([redact(t) for t in batch], dtype=object)


def secret_findings(docs: DataFrame) -> DataFrame:
    """One row for each reported part; values are given by their digest only."""
    return docs.select("doc_id", F.explode(scan_udf("text")).alias("_llm_f")).select("doc_id", "_llm_f.*")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``, reported parts masked in ``text`` and ``n_chars`` brought up to date."""
    new = docs.withColumn("text", redact_udf("text"))
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else new
