"""Main-content extraction from HTML by smoothed text-to-tag ratios.

The standard library's parser is fed the page piece by piece and its events build lines: a line ends at a newline
of the source or where a block element opens or closes. A line's ratio is its characters of text divided by its
tags (one at least); script, style and other invisible content counts no text. The ratios are smoothed by a
normalised Gaussian kernel and lines are split into two clusters at a threshold, LAMBDA times their mean; lines
with text in the upper cluster are the content, in order, joined by newlines.

Defined cases: null and empty pages have an empty text and no lines; a page without tags is one cluster and
kept whole; malformed markup is read as the parser recovers it, a comment, script or style without an end takes the rest
of the page, and a tag without one is text like what follows it (found in one pass, so long broken pages cost their length); a head without
an end ends at the first tag or text that can't be in it; character references are resolved; rows do not
depend on each other, so repeated rows repeat their result; a null ``page_id`` is carried along; an empty table
gives an empty table; extra columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGMA, LAMBDA = 1.0, 0.6
PIECE = 1 << 16
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head script style noscript template svg iframe object select".split())
#: What may be in a head; anything else ends it, as in browsers.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_TAG = re.compile(r"<[^<>]*>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class LineBuilder(HTMLParser):
    """Collects (text, tags) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self._parts: list[str] = []
        self._count = 0
        self._hidden: list[str] = []

    def _break(self) -> None:
        if self._parts or self._count:
            self.texts.append(" ".join("".join(self._parts).split()))
            self.tags.append(self._count)
            self._parts, self._count = [], 0

    def _end_head(self) -> None:
        if self._hidden and self._hidden[-1] == "head":
            self._hidden.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self._hidden.clear()
        elif tag not in _IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            self._break()
        self._count += 1
        if tag in HIDDEN and tag not in _VOID or tag == "title" and self._hidden and self._hidden[-1] == "head":
            self._hidden.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            self._break()
        self._count += 1

    def handle_endtag(self, tag: str) -> None:
        self._count += 1
        if tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
        if tag in BLOCK:
            self._break()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self._hidden or not data:
            return
        if "\n" not in data:
            self._parts.append(data)
            return
        first, *rest = data.split("\n")
        self._parts.append(first)
        for line in rest:
            self._break()
            if line:
                self._parts.append(line)

    def take_rest(self, rest: str) -> None:
        """The end of a page in which no tag or comment can close any more, in one pass."""
        at = 0
        for m in _TAG.finditer(rest):
            self.handle_data(unescape(rest[at : m.start()]))
            self._count += 1
            at = m.end()
        self.handle_data(unescape(rest[at:]))

    def lines(self) -> tuple[list[str], list[int]]:
        self.close()
        self._break()
        return self.texts, self.tags


def parse_lines(html: str, piece: int = PIECE) -> tuple[list[str], list[int]]:
    """Lines of a page; its parser is fed pieces that end with a tag, the longer the more of them it still holds."""
    parser = LineBuilder()
    closed, at = html.rfind(">") + 1, 0
    while at < closed:
        end = html.find(">", min(at + max(piece, len(parser.rawdata)), closed) - 1) + 1
        parser.feed(html[at:end])
        at = end
    rest, parser.rawdata = parser.rawdata + html[closed:], ""
    if parser.cdata_elem is None and not rest.startswith(("<!", "<?")):
        parser.take_rest(rest)
    return parser.lines()


def kernel(sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def select(texts: list[str], tags: list[int], sigma: float = SIGMA, lam: float = LAMBDA) -> np.ndarray:
    """Which lines are content."""
    if not texts:
        return np.zeros(0, dtype=bool)
    size = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
    ratio = size / np.maximum(1, tags)
    k = kernel(sigma)
    reach = len(k) // 2
    padded = np.pad(ratio, reach, mode="edge")
    smooth = np.convolve(padded, k, mode="valid")
    return (smooth >= lam * smooth.mean()) & (size > 0)


def extract(html: str | None) -> tuple[str, int, int]:
    """(content, lines with text, lines kept)."""
    if not html:
        return "", 0, 0
    texts, tags = parse_lines(html)
    keep = select(texts, tags)
    kept = [t for t, k in zip(texts, keep) if k]
    return "\n".join(kept), sum(map(bool, texts)), len(kept)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_kept", T.IntegerType())]))
def extract_udf(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        yield pd.DataFrame([extract(x) for x in batch], columns=["text", "n_lines", "n_kept"])


def extract_content(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines, n_kept of every page."""
    return pages.select("page_id", extract_udf("html").alias("_llm_x")).select("page_id", "_llm_x.text", "_llm_x.n_lines", "_llm_x.n_kept")
