"""Toxicity by a weighted lexicon.

Text is lower-cased, homoglyphs and accents are folded to Latin letters and digits to the letters they stand
in for. One Aho-Corasick automaton finds lexicon terms and exception phrases in one pass over the whole text;
a term counts only as a whole word and only outside every exception phrase. The summed weight is divided by
the number of words, so a long text needs proportionally more of it.

The lexicon has a written part and a fitted one. The fitted terms come from the ``labels`` table: words of at least
MIN_SUPPORT labelled toxic texts, of which labelled clean texts have at most MAX_CLEAN as many, weigh
FITTED_WEIGHT. They carry terms of languages that the written part lacks; an accent can tell two words of those
apart, so fitted terms are sought in a text whose accents stay. The fit reads a bounded sample, the
MAX_LABELLED labelled ids of least hash (all of them, if fewer); identical texts count once, so that copies
are not evidence. Without labels the written part stands alone.

Defined cases: null labels and labels of unknown documents are left out, an id with several labels is toxic if one
is; a null, empty or blank text has score 0 and is not toxic; every row is scored on its own, so
repeated rows and ties give the same score each; an empty table gives an empty table; a null ``doc_id`` is
carried along; extra columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight in tenths of each term, already folded.
LEXICON: dict[str, int] = {
    "idiot": 10, "idiots": 10, "idiotic": 8, "moron": 10, "morons": 10, "moronic": 8, "imbecile": 10, "imbeciles": 10,
    "stupid": 8, "dumbass": 10, "scum": 10, "scumbag": 10, "scumbags": 10, "trash": 7, "loser": 8, "losers": 8,
    "clown": 7, "clowns": 7, "pathetic": 8, "worthless": 8, "disgusting": 8, "vermin": 9, "subhuman": 10,
    "bastard": 9, "bastards": 9, "bitch": 10, "bitches": 10, "asshole": 10, "assholes": 10, "fuck": 9, "fucking": 9,
    "fucker": 10, "shithead": 10, "shit": 7, "retard": 10, "retarded": 9, "degenerate": 8, "lowlife": 9,
    "dummkopf": 9, "vollidiot": 10, "idioten": 10, "arschloch": 10, "abschaum": 10, "schwachkopf": 10,
    "abruti": 9, "cretin": 9, "connard": 10, "salaud": 9, "encule": 10,
    "estupido": 8, "imbecil": 10, "gilipollas": 10, "cabron": 10, "escoria": 9,
}
#: Phrases in which a term is harmless, already folded; their words are one space apart.
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "clown car", "circus clown", "pond scum",
    "sore loser", "loser bracket", "idiot proof", "stupid question", "pathetic fallacy", "degenerate matter",
    "degenerate case", "degenerate orbital", "flame retard",
)
#: Weight per 100 words, in whole terms, from which a text is rejected.
THRESHOLD = 0.5
#: Labelled ids that the fit reads at most.
MAX_LABELLED = 20_000
#: Toxic texts that a fitted term needs, and clean ones it may have for each of them.
MIN_SUPPORT, MAX_CLEAN = 5, 0.15
#: Weight in tenths of a fitted term, half that of a written one: one of a hundred words reaches the threshold.
FITTED_WEIGHT = 5

_LOOKALIKES = {
    "a": "àáâãäåāăąаαɑａ", "b": "ьｂ", "c": "çćčсϲｃ", "d": "ďԁｄ", "e": "èéêëēęěеёεｅ", "f": "ｆ", "g": "ğɡｇ", "h": "һｈ",
    "i": "ìíîïīįıіїιｉ", "j": "јｊ", "k": "кκｋ", "l": "łľｌ", "m": "мｍ", "n": "ñńňｎ", "o": "òóôõöøōőоοσｏ", "p": "рρｐ",
    "q": "ԛｑ", "r": "řｒ", "s": "śšѕｓ", "t": "ťтτｔ", "u": "ùúûüūůűυｕ", "v": "νѵｖ", "w": "ѡԝωｗ", "x": "хχｘ", "y": "ýÿуγｙ", "z": "źżžｚ",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
FOLD_FROM = "".join(_LOOKALIKES.values()) + "".join(_DIGITS)
FOLD_TO = "".join(k * len(v) for k, v in _LOOKALIKES.items()) + "".join(_DIGITS.values())
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
#: The same without accents: letters of other scripts and digits only.
_LIGHT = [(a, b) for a, b in zip(FOLD_FROM, FOLD_TO) if not unicodedata.normalize("NFD", a).startswith(b)]
LIGHT_FROM, LIGHT_TO = ("".join(x) for x in zip(*_LIGHT))
_LIGHT_TABLE = str.maketrans(LIGHT_FROM, LIGHT_TO)


def fold(text: str) -> str:
    """Lower case, then look-alike letters and digits replaced one for one."""
    return text.lower().translate(_TABLE)


def build_automaton(lexicon: dict[str, int] = LEXICON, exceptions: tuple[str, ...] = EXCEPTIONS):
    """The automaton of terms and phrases; none where there are none."""
    import ahocorasick

    if not lexicon:
        return None
    auto = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        auto.add_word(term, (len(term), weight, term))
    for phrase in exceptions:
        auto.add_word(phrase, (len(phrase), 0, phrase))
    auto.make_automaton()
    return auto


def matches(folded: str, auto) -> list[tuple[int, int, int, str]]:
    """Whole-word hits (start, end, weight, term) that no exception phrase covers."""
    found, covered, last = [], [], len(folded)
    for end, (size, weight, term) in auto.iter(folded):
        start, stop = end + 1 - size, end + 1
        if start and ((c := folded[start - 1]).isalnum() or c == "_"):
            continue
        if stop < last and ((c := folded[stop]).isalnum() or c == "_"):
            continue
        (found if weight else covered).append((start, stop, weight, term))
    if covered and found:
        covered.sort()
        kept, at, reach = [], 0, -1
        for m in sorted(found):  # reach: the furthest end of the phrases that start before the term or with it
            while at < len(covered) and covered[at][0] <= m[0]:
                reach = max(reach, covered[at][1])
                at += 1
            if m[1] > reach:
                kept.append(m)
        found = kept
    return found


def score_text(text: str | None, auto, fitted=None) -> tuple[float, str]:
    """(weight per 100 words, the distinct terms sorted and joined by commas); ``fitted`` is the automaton of the fitted terms."""
    if not text:
        return 0.0, ""
    lower = text.lower()
    hits = matches(lower.translate(_TABLE), auto)
    if fitted is not None:
        hits += matches(lower.translate(_LIGHT_TABLE), fitted)
    if not hits:
        return 0.0, ""
    words = len(text.split()) or 1
    return round(10.0 * sum(h[2] for h in hits) / words, 4), ",".join(sorted({h[3] for h in hits}))


_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("terms", T.StringType())])


def toxicity_udf(fitted: tuple[str, ...] = ()):
    """The scoring function over the written lexicon and ``fitted`` terms; a task builds its automata once."""

    @F.pandas_udf(_RESULT)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto, more = build_automaton(), build_automaton(dict.fromkeys(fitted, FITTED_WEIGHT), ())
        for batch in texts:
            yield pd.DataFrame([score_text(t, auto, more) for t in batch], columns=["score", "terms"])

    return score


def fitted_terms(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """term, toxic, clean of the words that labelled toxic texts have and clean ones hardly, none of them a written term."""
    rated = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sample = rated.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(F.md5("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.any_value("text").alias("text"))
    folded = F.translate(F.lower("text"), LIGHT_FROM, LIGHT_TO)
    words = texts.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("term"))
    counts = words.groupBy("term").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    return counts.filter((F.col("toxic") >= MIN_SUPPORT) & (F.col("clean") <= F.col("toxic") * MAX_CLEAN)).filter(~F.translate("term", FOLD_FROM, FOLD_TO).isin(*LEXICON))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[str, ...]:
    """The fitted terms, sorted; the sample's bound bounds their number."""
    return tuple(sorted(r["term"] for r in fitted_terms(docs, labels, most).select("term").collect()))


def scored(docs: DataFrame, fitted: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, terms of every row."""
    return docs.select("doc_id", toxicity_udf(fitted)("text").alias("_llm_tox")).select("doc_id", "_llm_tox.score", "_llm_tox.terms")


def toxic_documents(docs: DataFrame, fitted: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and terms of the rows whose score reaches ``threshold``."""
    return scored(docs, fitted).filter(F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, fitted: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays under ``threshold``, with their columns as they were; no shuffle."""
    return docs.select(F.struct("*").alias("row"), toxicity_udf(fitted)("text").alias("tox")).filter(F.col("tox.score") < threshold).select("row.*")


def oracle(threshold: float = THRESHOLD) -> str:
    """The same by DuckDB: tokens of the folded text outside exception phrases, joined with the lexicon."""
    lexicon = ", ".join(f"('{t}', {w})" for t, w in LEXICON.items())
    phrases = "|".join(sorted(EXCEPTIONS, key=lambda p: (-len(p), p)))
    return f"""
WITH written(term, w) AS (VALUES {lexicon}),
rated AS (SELECT doc_id, max(toxic) > 0 AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {MAX_LABELLED}),
rtext AS (SELECT text, max(toxic) AS toxic FROM documents JOIN rated USING (doc_id) GROUP BY text),
rword AS (SELECT toxic, unnest(list_distinct(regexp_extract_all(translate(lower(text), '{LIGHT_FROM}', '{LIGHT_TO}'), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM rtext),
fitted AS (SELECT term FROM rword GROUP BY term HAVING count(*) FILTER (toxic) >= {MIN_SUPPORT} AND count(*) FILTER (NOT toxic) <= count(*) FILTER (toxic) * {MAX_CLEAN}),
folded AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n,
                  regexp_replace(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '\\b({phrases})\\b', ' ', 'g') AS f, translate(lower(text), '{LIGHT_FROM}', '{LIGHT_TO}') AS g FROM documents),
tok AS (SELECT doc_id, n, unnest(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM folded),
tog AS (SELECT doc_id, n, unnest(regexp_extract_all(g, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM folded),
hit AS (SELECT doc_id, n, term, w FROM tok JOIN written USING (term)
        UNION ALL SELECT doc_id, n, term, {FITTED_WEIGHT} FROM tog JOIN fitted USING (term) WHERE translate(term, '{FOLD_FROM}', '{FOLD_TO}') NOT IN (SELECT term FROM written))
SELECT doc_id, round(10.0 * sum(w) / any_value(n), 4) AS score, array_to_string(list_sort(list_distinct(list(term))), ',') AS terms
FROM hit GROUP BY doc_id HAVING round(10.0 * sum(w) / any_value(n), 4) >= {threshold}
"""
