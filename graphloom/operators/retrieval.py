"""Text retrieval: postings, BM25, TF-IDF, latent-semantic index, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import basic_tokens, distinct_words, doc_tokens, expand_synonyms
from graphloom.session import cut, spread

K1, B = 1.5, 0.75
FTS_K1, FTS_B = 1.2, 0.75
MAX_VOCABULARY, MAX_RANK, POWER_STEPS = 2000, 96, 64


def tokenised(docs: DataFrame, tokens: Callable[[str], Column] = doc_tokens) -> DataFrame:
    """id, toks, len. One projection for each step, so that no step is worked out again for the next."""
    docs = spread(docs)
    if tokens is doc_tokens:
        toks = docs.select("id", distinct_words("text").alias("words")).select("id", expand_synonyms(F.col("words")).alias("toks"))
    else:
        toks = docs.select("id", tokens("text").alias("toks"))
    return toks.select("id", "toks", F.size("toks").alias("len"))


def exploded(sized: DataFrame) -> DataFrame:
    """id, len, term. The outer form, as the inner one would have its input tested below the projections that make it."""
    return sized.select("id", "len", F.explode_outer("toks").alias("term")).filter("term is not null")


def postings(docs: DataFrame, tokens: Callable[[str], Column] = doc_tokens, counted: bool = False) -> DataFrame:
    """id, term, tf, len. Without ``counted`` the tokens are distinct already, so no shuffle is needed."""
    each = exploded(tokenised(docs, tokens))
    return each.groupBy("id", "term", "len").agg(F.count("*").alias("tf")) if counted else each.withColumn("tf", F.lit(1).cast("long"))


def query_terms(query: str, spark, tokens=doc_tokens) -> DataFrame:
    return spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"))


def bm25_lists(docs: DataFrame, queries: list[str], k1: float = K1, b: float = B, tokens=doc_tokens, counted: bool = False) -> list[DataFrame]:
    """id, score > 0 of the documents for each query.

    The texts are read and tokenised once for all queries: what stays of a document is its length and the tokens that some query
    has. Totals, document frequencies and scores come from that lean table.
    """
    spark = docs.sparkSession
    terms = [sorted(r["term"] for r in query_terms(q, spark, tokens).collect()) for q in queries]
    wanted = F.array(*[F.lit(t) for t in sorted({t for ts in terms for t in ts})]).cast("array<string>")
    hits = F.filter("toks", lambda t: F.array_contains(wanted, t)) if counted else F.array_intersect("toks", wanted)
    lean = cut(tokenised(docs, tokens).select("id", "len", hits.alias("hits")))
    total = lean.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).first()
    each = lean.filter(F.size("hits") > 0).select("id", "len", F.explode("hits").alias("term"))
    tf = each.groupBy("id", "len", "term").agg(F.count("*").alias("tf")) if counted else each.withColumn("tf", F.lit(1))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("len", F.lit(1)) / F.lit(total["avg_len"] or 1.0)))
    idf = F.ln(1 + (F.lit(total["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = tf.join(F.broadcast(df.select("term", idf.alias("idf"))), "term").select("id", "term", part.alias("part"))  # a row for each term of the queries
    return [scored.filter(F.col("term").isin(*ts) if ts else F.lit(False)).groupBy("id").agg(F.sum("part").alias("score")).filter("score > 0") for ts in terms]


def bm25(docs: DataFrame, query: str, k1: float = K1, b: float = B, tokens=doc_tokens, counted: bool = False) -> DataFrame:
    """id, score > 0 of the documents for a query."""
    return bm25_lists(docs, [query], k1, b, tokens, counted)[0]


def fts(docs: DataFrame, query: str) -> DataFrame:
    """BM25 over plain identifier tokens with true term counts."""
    return bm25(docs, query, FTS_K1, FTS_B, basic_tokens, counted=True)


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The best k by rounded score, then id."""
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "id").limit(k)


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (id, score)."""
    ranked = [x.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("r")) for x in lists]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("r"))).alias("score"))


def relevance(lists: list[DataFrame]) -> DataFrame:
    """Fused score over the best fused score."""
    fused = rrf(lists)
    return fused.crossJoin(F.broadcast(fused.agg(F.max("score").alias("best")))).select("id", (F.col("score") / F.col("best")).alias("score"))


def vocabulary(docs: DataFrame, size: int = MAX_VOCABULARY) -> DataFrame:
    """term, df, idf of the most frequent terms, ties by term."""
    return _vocabulary(tokenised(docs), docs.count(), size)


def _vocabulary(sized: DataFrame, n_docs: int, size: int) -> DataFrame:
    kept = exploded(sized).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(size)
    return kept.select("term", "df", F.ln(1 + F.lit(n_docs) / F.col("df")).alias("idf"))


def tfidf(docs: DataFrame, size: int = MAX_VOCABULARY) -> DataFrame:
    """id, term, val over the kept vocabulary; a document's length counts all its terms. Texts are tokenised once."""
    sized = cut(tokenised(docs))
    known = F.broadcast(_vocabulary(sized, sized.count(), size))  # ``size`` rows at most
    return exploded(sized).join(known, "term").select("id", "term", (F.col("idf") / F.greatest("len", F.lit(1))).alias("val"))


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """id, score: cosine of each vector (id, vec) with the one row of ``query`` (q)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot("vec", "vec")) * F.sqrt(dot("q", "q"))
    return vectors.crossJoin(F.broadcast(query)).select("id", F.when(size == 0, 0.0).otherwise(dot("vec", "q") / size).alias("score"))


def _start_vector(n: int, seed: int) -> np.ndarray:
    out, state = np.empty(n), (seed & 0xFFFFFFFF) or 1
    for i in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = state / 0xFFFFFFFF * 2 - 1
    return out


def _stable(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), np.floor(x * 1e12 + 0.5) / 1e12, 0.0)


def truncated_svd(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, m: int, n: int, k: int, seed: int = 1, steps: int = POWER_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U (m, k), S (k), V (n, k) of a sparse matrix by power iteration with deflation; the same input gives the same output."""
    times = lambda x: np.bincount(rows, vals * x[cols], minlength=m)
    back = lambda y: np.bincount(cols, vals * y[rows], minlength=n)
    us, ss, vs = [], [], []

    def clear(x: np.ndarray) -> np.ndarray:
        for v in vs:
            x = x - (x @ v) * v
        return x

    for c in range(min(k, m, n)):
        x = clear(_start_vector(n, seed + 7919 * c))
        size = np.linalg.norm(x)
        x = x / size if size else _start_vector(n, seed + c + 1)
        for _ in range(steps):
            y = clear(back(times(x)))
            size = np.linalg.norm(y)
            if not size:
                break
            x = y / size
        ax = times(x)
        sigma = float(np.linalg.norm(ax))
        sign = -1.0 if len(x) and x[np.argmax(np.abs(x))] < 0 else 1.0
        vs.append(x * sign)
        us.append(ax * (sign / sigma) if sigma else np.zeros(m))
        ss.append(sigma)
    k = len(ss)
    return _stable(np.array(us).reshape(k, m).T), _stable(np.array(ss)), _stable(np.array(vs).reshape(k, n).T)


LSA = "kind string, key string, vec array<double>"
_MASK = 0xFFFFFFFF
#: Documents whose dense rows are held at once.
_DOCS = 512


def _start_block(first: int, size: int, k: int, seed: int = 1) -> np.ndarray:
    """Elements first, ..., first + size - 1 of the start vectors of k components, without those before them."""
    power, total, base, step = 1, 0, 1664525, 1013904223  # state after n steps: power * state + total
    n = first
    while n:
        if n & 1:
            power, total = power * base & _MASK, (total * base + step) & _MASK
        base, step = base * base & _MASK, (step * base + step) & _MASK
        n >>= 1
    seeds = np.array([(seed + 7919 * c & _MASK) or 1 for c in range(k)], dtype=np.uint64)
    state = (seeds * np.uint64(power) + np.uint64(total)) & np.uint64(_MASK)
    out = np.empty((size, k))
    for i in range(size):
        state = (state * np.uint64(1664525) + np.uint64(1013904223)) & np.uint64(_MASK)
        out[i] = state
    return out / _MASK * 2 - 1


def _dense(batch: pa.RecordBatch, terms: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row in the batch and the dense rows from there on, some at a time."""
    kept, length = batch.column("kept"), np.maximum(batch.column("len").to_numpy(zero_copy_only=False), 1)
    at = pc.index_in(kept.flatten(), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(pc.list_value_length(kept).to_numpy(zero_copy_only=False))]
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    for s in range(0, batch.num_rows, _DOCS):
        e = min(s + _DOCS, batch.num_rows)
        d = np.zeros((e - s, len(terms)))
        part = slice(ends[s], ends[e])
        d[row[part] - s, at[part]] = idf[at[part]] / length[row[part]]
        yield s, d


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where a part ends, as a task may read several parts."""
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for s, e in zip([0, *ends], ends):
            if e > s:
                yield batch.slice(s, e - s)


def _gram(terms: pa.Array, idf: np.ndarray, first: dict[int, int], k: int):
    """Products of the terms over a task's documents, and of the terms with the start vectors: a row for each term."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = len(terms), None
        for batch in _runs(batches):
            index = first[int(batch.column("part")[0].as_py())] + batch.column("position").to_numpy(zero_copy_only=False)
            for s, d in _dense(batch, terms, idf):
                total = np.zeros((m, m + k)) if total is None else total
                total[:, :m] += d.T @ d
                total[:, m:] += d.T @ _start_block(int(index[s]), len(d), k)
        for s in range(0, m if total is not None else 0, 64):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, min(s + 64, m)), pa.int32()), pa.array(list(total[s : s + 64]), pa.list_(pa.float64()))], names=["t", "vec"])

    return gram


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:  # the parts of a term come sorted by partition, so that their sum is the same every time
        for t, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = v.values.to_numpy(zero_copy_only=False)
            sums[t] = sums[t] + v if t in sums else v
    for t, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["t", "vec"])


def _components(g: np.ndarray, z0: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, S and the (terms, k) matrix that a document's row is multiplied by to give its row of V, signs aside.

    Power iteration on the documents' side, x -> A'Ax with the components so far taken out, told in terms alone: with z = Ax the next z
    is Gw / |A'w|, where w is z without those components and |A'w| the root of w'Gw. In the basis of G's eigenvectors a product with G
    is one with a diagonal, so a step costs no more than the components taken out.
    """
    values, basis = np.linalg.eigh(g)
    values, z0 = np.maximum(values, 0), basis.T @ z0
    m, k = z0.shape
    us, ss, ws = np.zeros((m, k)), np.zeros(k), np.zeros((m, k))

    def clear(z: np.ndarray, c: int) -> np.ndarray:
        return z - us[:, :c] @ (us[:, :c].T @ z)

    for c in range(k):
        z, w = clear(z0[:, c], c), np.zeros(m)
        for _ in range(steps):
            now = clear(z, c)
            gw = values * now
            size = np.sqrt(max(now @ gw, 0.0))
            if not size > 1e-300:
                break
            z, w = gw / size, now / size
        ss[c] = np.linalg.norm(z)
        us[:, c], ws[:, c] = (z / ss[c] if ss[c] else z), w
    return basis @ us, ss, basis @ ws


_ENDS = "c int, size double, at long, value double"


def _largest(terms: pa.Array, idf: np.ndarray, first: dict[int, int], ws: np.ndarray):
    """For each component the largest entry of V in a partition, the first of equals."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, float]] = {}
        for batch in batches:
            position = batch.column("position").to_numpy(zero_copy_only=False)
            for s, d in _dense(batch, terms, idf):
                v = d @ ws
                at = np.abs(v).argmax(axis=0)
                begin = first[int(batch.column("part")[0].as_py())]
                for c, i in enumerate(at):
                    new = (float(abs(v[i, c])), begin + int(position[s + i]), float(v[i, c]))
                    if c not in best or new[0] > best[c][0]:
                        best[c] = new
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *(pa.array([b[i] for b in best.values()], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.float64())))], names=["c", "size", "at", "value"])

    return largest


def _latent(terms: pa.Array, idf: np.ndarray, ws: np.ndarray, ss: np.ndarray):
    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, d in _dense(batch, terms, idf):
                vec = _stable(d @ ws) * ss
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s, len(d)), pa.array(list(vec), pa.list_(pa.float64()))], names=["key", "vec"])

    return latent


def lsa_index(docs: DataFrame, rank: int = MAX_RANK) -> DataFrame:
    """Rows ('term', term, U row), ('idf', term, its weight), ('doc', id, S * V row) and ('sigma', '', S).

    The vocabulary is capped, so the products of its terms are one matrix of at most 2,000 rows: the tasks add it up over the
    documents, the driver iterates on it, and the documents' rows come from a second pass. Nothing grows with the documents.
    """
    spark = docs.sparkSession
    sized = cut(tokenised(docs))
    n_docs = sized.count()
    known = _vocabulary(sized, n_docs, MAX_VOCABULARY).orderBy("term").collect()
    if not known:
        return spark.createDataFrame([], LSA)
    names, idf = [r["term"] for r in known], np.array([r["idf"] for r in known])
    terms, k = pa.array(names, pa.string()), max(1, min(rank, len(names), n_docs))
    lean = sized.select("id", "len", F.array_intersect("toks", F.array(*[F.lit(t) for t in names])).alias("kept")).orderBy("id")
    number = F.monotonically_increasing_id()
    lean = cut(lean.select("id", "len", "kept", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND((1 << 33) - 1).alias("position")))
    first, before = {}, 0
    for r in lean.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        first[r["part"]], before = before, before + r["n"]
    tasks = lean.coalesce(spark.sparkContext.defaultParallelism)  # each sends a whole matrix, so as many as can run and not one for each partition
    parts = tasks.mapInArrow(_gram(terms, idf, first, k), "t int, vec array<double>").withColumn("part", F.spark_partition_id())
    sums = parts.repartition("t").sortWithinPartitions("t", "part").select("t", "vec").mapInArrow(_summed, "t int, vec array<double>").orderBy("t").toArrow()
    both = np.stack([v.values.to_numpy(zero_copy_only=False) for v in sums.column("vec")])
    us, ss, ws = _components(both[:, : len(names)], both[:, len(names) :], POWER_STEPS)
    ends = lean.mapInArrow(_largest(terms, idf, first, ws), _ENDS).groupBy("c").agg(F.max_by("value", F.struct("size", (-F.col("at")).alias("at"))).alias("value")).collect()
    sign = np.ones(k)
    for r in ends:
        sign[r["c"]] = -1.0 if r["value"] < 0 else 1.0
    us, ss, ws = _stable(us * sign), _stable(ss), ws * sign
    fixed = spark.createDataFrame([("term", t, u) for t, u in zip(names, us.tolist())] + [("idf", t, [w]) for t, w in zip(names, idf.tolist())] + [("sigma", "", ss.tolist())], LSA)
    rows = lean.mapInArrow(_latent(terms, idf, ws, ss), "key string, vec array<double>").select(F.lit("doc").alias("kind"), "key", "vec")
    return fixed.unionByName(rows)  # of a constant kind, so that whoever asks for another kind does not run them


def lsa_query(index: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """id, score > 0: cosine of the documents with the query in latent space. The index has all that is needed of the texts."""
    spark = docs.sparkSession
    terms = query_terms(query, spark)
    length = terms.agg(F.greatest(F.count("*"), F.lit(1)).alias("len"))
    known = index.filter("kind = 'idf'").select(F.col("key").alias("term"), F.col("vec")[0].alias("idf"))
    weighted = terms.join(known, "term").crossJoin(length).select(F.col("term").alias("key"), (F.col("idf") / F.col("len")).alias("w"))
    parts = index.filter("kind = 'term'").join(weighted, "key").select(F.posexplode(F.transform("vec", lambda x: x * F.col("w"))).alias("p", "x"))
    q = parts.groupBy("p").agg(F.sum("x").alias("x")).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("l")).select(F.transform("l", lambda s: s["x"]).alias("q"))
    vectors = index.filter("kind = 'doc'").select(F.col("key").alias("id"), "vec")
    return cosine(vectors, q.filter(F.size("q") > 0)).filter("score > 0")
