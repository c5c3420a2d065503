"""Scalar text functions as column expressions: identifier tokens, synonyms, ids, paths, blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say the same in code, by word; their order is that in which they join a text's terms.
LEXICON: dict[str, tuple[str, ...]] = {
    word: tuple(more.split())
    for word, more in {
        "auth": "authenticate authentication login signin credential",
        "config": "configuration settings options",
        "create": "add new make insert",
        "delete": "remove destroy rm drop",
        "error": "err fail failure exception",
        "fetch": "get load retrieve query read",
        "login": "auth authenticate signin session",
        "logout": "signout session",
        "parse": "decode read extract",
        "remove": "delete destroy rm",
        "render": "draw paint display",
        "update": "edit modify patch set",
        "user": "account member profile",
        "validate": "check verify assert",
    }.items()
}
STOP_WORDS: tuple[str, ...] = tuple("and const for from function into let return that the this var with".split())

_CAMEL = (r"([a-z0-9])([A-Z])", r"$1 $2")
_ACRONYM = (r"([A-Z]+)([A-Z][a-z])", r"$1 $2")
#: The characters of a regular expression's space class.
_SPACE = " \t\n\x0b\f\r"
_BASIC_BREAKS = r"[-._/\\:#]+"
_WIDE_BREAKS = r"[-._/\\:#<>(){}\[\],;'\"`=+*&|!?~^%$@]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: F.char_length(t) > 1)


def basic_tokens(c: Column | str) -> Column:
    """Lower-case words of an identifier or phrase, in order, repeats kept; null has none."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), *_CAMEL), _BASIC_BREAKS, " ")
    return _words(spaced)


def _spaced(c: Column | str) -> Column:
    x = F.coalesce(_col(c), F.lit(""))
    for pattern, by in (_CAMEL, _ACRONYM):
        x = F.regexp_replace(x, pattern, by)
    return F.regexp_replace(x, _WIDE_BREAKS, " ")


def split_identifier(c: Column | str) -> Column:
    """Lower-case words, acronyms split from the word after them, stop words dropped."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(_words(_spaced(c)), lambda t: ~F.array_contains(stop, t))


def distinct_words(c: Column | str) -> Column:
    """The distinct words of split_identifier by first appearance; the set operation is compiled, the lambda sees each word once."""
    words = F.array_except(F.split(F.lower(_spaced(c)), r"\s+"), F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.filter(words, lambda t: F.char_length(t) > 1)


def expand_synonyms(tokens: Column) -> Column:
    """Distinct tokens, then the words each adds, in order of first appearance."""
    keys = F.array_intersect(tokens, F.array(*[F.lit(k) for k in LEXICON]))  # few, so only these are looked up
    words = F.create_map(*[x for k, v in LEXICON.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.array_union(tokens, F.flatten(F.transform(keys, lambda t: F.try_element_at(words, t))))


def doc_tokens(c: Column | str) -> Column:
    """The terms under which a text is found; each occurs once."""
    return expand_synonyms(distinct_words(c))


def node_id(file: Column | str, name: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(_col(file), F.lit("::"), _col(name)), 256), 1, 24)


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def token_estimate(c: Column | str) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.char_length(_col(c)) / 4)


def basename(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", -1)


def dirname(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")


def extname(c: Column | str) -> Column:
    """Last dot and what follows in the file name; a leading dot starts none."""
    return F.lower(F.regexp_extract(basename(c), r"[^.]\.?.*?(\.[^.]*)$", 1))


def normalize_path(c: Column | str) -> Column:
    """Folds ``.`` and ``..`` segments; ``..`` at the front stays."""
    parts = F.filter(F.split(_col(c), "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == up) & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)),
    )
    return F.array_join(folded, "/")


def name_suffixes(c: Column | str) -> Column:
    """A dotted name and all it ends in: a.b.c, b.c, c. Turns a suffix match into an equality."""
    parts = F.split(_col(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def first_line(c: Column | str, size: int = 200) -> Column:
    return F.substring(F.trim(F.substring_index(_col(c), "\n", 1)), 1, size)


def signature(c: Column | str, size: int = 200) -> Column:
    """What precedes the first brace, else the first line."""
    c = _col(c)
    return F.substring(F.trim(F.when(F.instr(c, "{") > 1, F.substring_index(c, "{", 1)).otherwise(F.substring_index(c, "\n", 1))), 1, size)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often and however deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kept_lines(c: Column | str, start_line: Column | int) -> Column:
    """(l, n) of the lines of a block that hold more than space, with their numbers."""
    start = F.lit(start_line) if isinstance(start_line, int) else start_line
    return F.filter(F.transform(F.split(_col(c), "\n"), lambda l, i: F.struct(l.alias("l"), (i + start).alias("n"))), lambda x: x["l"].rlike(r"\S"))


def minify_block(c: Column | str, start_line: Column | int) -> Column:
    """Numbered lines of a block without blank lines, trailing space and common indentation."""
    lead = lambda x: F.char_length(x["l"]) - F.char_length(F.ltrim(x["l"], F.lit(" \t")))
    number = lambda x: F.lpad(x["n"].cast("string"), F.greatest(F.lit(5), F.char_length(x["n"].cast("string"))), F.lit(" "))
    line = lambda x, indent: F.concat(number(x), F.lit("  "), F.rtrim(F.substring(x["l"], indent + 1, F.char_length(x["l"])), F.lit(_SPACE)))
    joined = lambda kept: _let(F.array_min(F.transform(kept, lead)), lambda indent: F.array_join(F.transform(kept, lambda x: line(x, indent)), "\n"))
    return _let(kept_lines(c, start_line), joined)


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: halves go up on both sides of zero."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale
