"""SimHash near-duplicates with an exact Gray-order hierarchical index.

A text's features are its distinct lower-cased words; each is hashed to 128 bits, and a fingerprint bit is set
where more than half of the words have it set. Two fingerprints are near when they differ in at most ``K`` bits
(``K_SMALL`` where either stands for fewer than ``SMALL`` words, whose fingerprints scatter more). Documents with equal
or near fingerprints, directly or through others, form a group.

Index. The search is exact: no pair within its radius is left out. The bits are cut into BLOCKS blocks, and a near pair has a
block in which it differs in 2 bits at most (3 in the last), and in the half of the code from there on, going round, in 11 or 12
(``block_radius``). Up to SHARE fingerprints each task holds all of them and searches for some of the values of each block, dealt out from the
most frequent; more are dealt into shares by hash, each two of which meet in a task. There the members are in Gray rank; those that agree in a block form a node, which is compared with the nodes whose
block lies within its radius, first by that half of the code and then by all of it. A run of many near members becomes a tree of Gray
neighbours whose nodes hold the bits all members share: a search adds up the differences on those masked bits and drops a whole group
once they exceed ``K``, and each member is compared only with those not yet reached. What is already of one group is not compared
again, so thousands of copies cost little more than their number, and a task hands on a spanning star rather than all its pairs.

Defined cases: a null text, or one without a word, has no fingerprint and is never a duplicate; exact copies and
repeated rows share a fingerprint and form a group; the row kept is the one with the least ``doc_id`` (nulls
last), then the least hash of its text; of repeated rows of that id and text one stays; an empty table gives
an empty table; extra columns of any name are carried along untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import components, cut

#: Bits in which near fingerprints may differ, of 128.
K = 24
#: The same for texts of fewer than SMALL distinct words.
K_SMALL, SMALL = 18, 32
#: Cuts of a fingerprint, of so many bits each.
BLOCKS, BLOCK_BITS = 8, 16
#: Members from which a run may be searched by the tree, and near ones each of them then has on average.
LARGE_RUN = 64
#: Gray neighbours below one lowest node of the tree.
LEAF = 16
#: Members up to which all pairs of a node are compared.
TOGETHER = 1 << 15
#: Fingerprints up to which a task takes all, else two shares of them, each two of which meet; NODES tasks at least, for parts of the values.
SHARE, NODES = 3 << 20, 12
#: Pairs and rows compared at once, which fit the processor's cache, and pairs held for the second half of the comparison.
_PAIRS_AT_ONCE, _ROWS, _HELD = 1 << 16, 32, 1 << 16
#: Characters of texts whose words are read together.
_CHARS_AT_ONCE = 1 << 21
#: Words hashed together, so that the state of them all fits the processor's cache.
_HASHED_AT_ONCE = 1 << 12
_OTHER = re.compile(r"\W+")
#: ASCII of other characters than those of words to spaces; bytes of longer characters stay.
_SPACES = bytes(c if c > 127 or c == 95 or chr(c).isalnum() else 32 for c in range(256))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [turns[i % 4] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]


def md5_rows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MD5 of byte strings in ``data``, 16 bytes each; those that fit one block of it side by side."""
    out = np.empty((len(starts), 16), dtype=np.uint8)
    for i in np.flatnonzero(sizes > 55).tolist():
        out[i] = np.frombuffer(hashlib.md5(data[starts[i] : starts[i] + sizes[i]].tobytes(), usedforsecurity=False).digest(), dtype=np.uint8)
    short = np.flatnonzero(sizes <= 55)
    for at in range(0, len(short), _HASHED_AT_ONCE):
        some = short[at : at + _HASHED_AT_ONCE]
        n, size = len(some), sizes[some]
        block = np.zeros((n, 64), dtype=np.uint8)
        column = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        block[np.repeat(np.arange(n), size), column] = data[np.repeat(starts[some], size) + column]
        block[np.arange(n), size] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T, dtype=np.uint32)
        words[14] = size * 8
        used = words.any(axis=1).tolist()
        first = [np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (x.copy() for x in first)
        f, spare = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = 7 * i % 16
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _SINES[i]
            if used[g]:
                f += words[g]
            np.left_shift(f, np.uint32(_TURNS[i]), out=spare)
            f >>= np.uint32(32 - _TURNS[i])
            f |= spare
            f += b
            a, b, c, d, f = d, f, b, c, a
        out[some] = np.stack([x + y for x, y in zip((a, b, c, d), first)], axis=1).astype("<u4").view(np.uint8)
    return out


def _spaced(text: str) -> bytes:
    """The lower-cased text with a space for whatever is not of a word."""
    text = text.lower()
    if not text.isascii():
        other = [c for c in set(text) if c > "\x7f" and not c.isalnum()]
        if len(other) > 16:
            text = _OTHER.sub(" ", text)
        else:
            for c in other:
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).strip()


def fingerprints(texts: list[str | None]) -> list[bytes | None]:
    """16 bytes of SimHash of each text and one with the radius within which others are near."""
    out: list[bytes | None] = [None] * len(texts)
    at = 0
    while at < len(texts):
        own, spaced, size = [], [], 0
        while at < len(texts) and size < _CHARS_AT_ONCE:
            if texts[at]:
                size += len(texts[at])
                if line := _spaced(texts[at]):
                    own.append(at)
                    spaced.append(line)
            at += 1
        if not own:
            continue
        lists = pa.compute.ascii_split_whitespace(pa.array(spaced, pa.large_binary()).view(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        hashes = md5_rows(np.frombuffer(words.buffers()[2], dtype=np.uint8), ends[:-1], np.diff(ends))
        keys = np.repeat(np.arange(len(own)) * len(words), np.diff(lists.offsets.to_numpy())) + coded.indices.to_numpy()
        keys.sort()
        text, word = np.divmod(keys[np.r_[True, keys[1:] != keys[:-1]]], len(words))
        cuts = np.searchsorted(text, np.arange(len(own) + 1)).tolist()
        for i, s, e in zip(own, cuts[:-1], cuts[1:]):
            counts = np.zeros(128, dtype=np.int64)
            for a in range(s, e, 255):  # sums of up to 255 bits fit a byte
                counts += np.add.reduce(np.unpackbits(hashes[word[a : min(e, a + 255)]]).reshape(-1, 128), axis=0, dtype=np.uint8)
            out[i] = np.packbits(counts * 2 > e - s).tobytes() + bytes([K if e - s >= SMALL else K_SMALL])
    return out


def fingerprint(text: str | None) -> bytes | None:
    return fingerprints([text])[0]


@F.pandas_udf(T.BinaryType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(fingerprints(batch.tolist()), dtype=object)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each 128-bit code (two big-endian uint64) in the reflected Gray sequence, as two uint64."""
    hi, lo = words[:, 0].copy(), words[:, 1].copy()
    for s in (1, 2, 4, 8, 16, 32):
        hi ^= hi >> np.uint64(s)
        lo ^= lo >> np.uint64(s)
    lo ^= np.where(hi & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return np.stack([hi, lo], axis=1)


class GrayTree:
    """Codes in Gray order below nodes that hold the bits shared by LEAF, LEAF**2, ... neighbours."""

    def __init__(self, words: np.ndarray, radius: np.ndarray):
        self.words, self.radius, self.levels = words, radius, []
        both, some = words, words
        while len(both) > LEAF:
            at = np.arange(0, len(both), LEAF)
            both, some = np.bitwise_and.reduceat(both, at, axis=0), np.bitwise_or.reduceat(some, at, axis=0)
            self.levels.append((both, ~(both ^ some)))

    def within(self, code: np.ndarray, k: int, alive: np.ndarray) -> np.ndarray:
        """Positions of the living members within ``k`` bits, and their own radius, of ``code``."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else None
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            differences = np.bitwise_count((pattern[nodes] ^ code) & mask[nodes]).sum(axis=1)
            nodes = nodes[differences <= k]
            size = len(self.levels[depth - 1][0]) if depth else len(self.words)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < size]
        at = np.flatnonzero(alive) if nodes is None else nodes[alive[nodes]]
        return at[np.bitwise_count(self.words[at] ^ code).sum(axis=1) <= np.minimum(self.radius[at], k)]


def _run_links(words: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each connected component of one large run, which is in Gray order."""
    tree, alive, links = GrayTree(words, radius), np.ones(len(words), dtype=bool), []
    for seed in range(len(words)):
        if not alive[seed]:
            continue
        alive[seed] = False
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            near = tree.within(words[at], int(radius[at]), alive)
            alive[near] = False
            links += [(at, int(x)) for x in near]
            frontier += near.tolist()
    return links


def block_radius(block: int) -> int:
    """Bits by which near fingerprints may differ in ``block``: these and one each add up to K + 1.

    So no near pair exceeds all of them; and as the differences less these and one each add up to less than nothing, a near pair
    has a block from which on, going round, every sum of them is below nothing. The search asks this of that block and of the
    half of the code that begins with it.
    """
    return (K + 1) // BLOCKS - 1 + (block >= BLOCKS - (K + 1) % BLOCKS)


def half_from(words: np.ndarray, block: int) -> np.ndarray:
    """The 64 bits of each code that begin with ``block``, going round."""
    shift = block % (BLOCKS // 2) * BLOCK_BITS
    a, b = (words[:, 0], words[:, 1]) if block < BLOCKS // 2 else (words[:, 1], words[:, 0])
    return a << np.uint64(shift) | b >> np.uint64(64 - shift) if shift else np.ascontiguousarray(a)


class _Node:
    """Codes in Gray order, the groups found among them, and the comparison of some with others."""

    def __init__(self, words: np.ndarray, radius: np.ndarray):
        self.words, self.radius, self.parent = words, radius.astype(np.uint8), np.arange(len(words))
        self.halves = [np.ascontiguousarray(words[:, i]) for i in (0, 1)]
        self.half, self.limit = self.halves[0], K
        self.room = [np.empty(_PAIRS_AT_ONCE + 8, dtype=kind) for kind in (np.uint64, np.uint8, np.bool_)]
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.holds = 0

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            up = self.parent[root]
            if (up == root).all():
                return root
            root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            _, first = np.unique(y, return_index=True)  # one link of each group at a time
            for i, j in zip(x[first].tolist(), y[first].tolist()):
                i, j = _find(self.parent, i), _find(self.parent, j)
                if i != j:
                    self.parent[max(i, j)] = min(i, j)

    def walk(self, run: np.ndarray) -> None:
        """Join the groups of a run, in Gray order, by the tree if its members have many near ones, going by some of them."""
        if len(run) < LARGE_RUN:
            return
        some = run[:: max(1, len(run) // LARGE_RUN)][:LARGE_RUN]
        apart = np.bitwise_count(self.words[some][:, None] ^ self.words[run]).sum(axis=2)
        near = apart <= np.minimum(self.radius[some][:, None], self.radius[run])
        if near.sum() - len(some) >= LARGE_RUN * len(some):
            links = np.array(_run_links(self.words[run], self.radius[run]), dtype=np.int64).reshape(-1, 2)
            self.join(run[links[:, 0]], run[links[:, 1]])

    def settle(self) -> None:
        """Join those of the held pairs that are near."""
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.holds = [], 0
            apart = np.bitwise_count(self.halves[0][a] ^ self.halves[0][b]) + np.bitwise_count(self.halves[1][a] ^ self.halves[1][b])
            close = apart <= np.minimum(self.radius[a], self.radius[b])
            self.join(a[close], b[close])

    def tile(self, rows: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Hold the pairs within the limit of the half now looked at, which is ``a`` and ``b``."""
        size = len(rows) * len(others)
        bits, apart, near = (x[:size].reshape(len(rows), -1) for x in self.room)
        np.bitwise_xor(a[:, None], b, out=bits)
        np.less_equal(np.bitwise_count(bits, out=apart), self.limit, out=near)
        self.room[2][size : size + 8] = False
        eights = self.room[2][: size + 7 & -8]
        some = eights.view(np.uint64).nonzero()[0]  # of eight pairs at once, as few are near
        if len(some):
            which, rest = eights.reshape(-1, 8)[some].nonzero()
            row, column = np.divmod(some[which] * 8 + rest, len(others))
            self.held.append((rows[row], others[column]))
            self.holds += len(row)
            if self.holds > _HELD:
                self.settle()

    def compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        """All of ``rows`` with all of ``others``; of many rows, what is of one group is not compared again."""
        alike, many = rows is others, len(rows) >= LARGE_RUN
        if many:
            rows = rows[np.argsort(self.roots(rows), kind="stable")]
            others = rows if alike else others
        a, b = self.half[rows], self.half[others]
        for at in range(0, len(rows), _ROWS):
            some, rest, half = rows[at : at + _ROWS], *((others[at:], b[at:]) if alike else (others, b))
            if many:
                root = self.roots(some)
                if (root == root[0]).all():
                    apart = self.roots(rest) != root[0]
                    rest, half = rest[apart], half[apart]
            step = _PAIRS_AT_ONCE // len(some)
            for start in range(0, len(rest), step):
                self.tile(some, rest[start : start + step], a[at : at + _ROWS], half[start : start + step])

    def search(self, block: int, values: np.ndarray, left: np.ndarray | None, right: np.ndarray | None, part: int, parts: int) -> None:
        """Join the near pairs that differ in at most ``block_radius`` bits of ``values``: of members of ``left`` and ``right``, or of all.

        Of pairs whose first (without ``left``: whose lesser) value falls to this of ``parts``, to which values are dealt from the most frequent.
        """
        dealt = np.argsort(-np.bincount(values, minlength=1 << BLOCK_BITS), kind="stable")
        here = np.zeros(1 << BLOCK_BITS, dtype=bool)
        here[dealt[part::parts]] = True
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0, True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s >= LARGE_RUN and here[values[order[s]]]:
                self.walk(order[s:e])
        mine = order if left is None else order[left[order]]
        theirs = order if right is None else order[right[order]]
        if not len(mine) or not len(theirs):
            return
        counts = np.bincount(values[theirs], minlength=1 << BLOCK_BITS)
        starts = np.cumsum(counts) - counts
        masks = np.arange(1 << BLOCK_BITS)
        masks = masks[np.bitwise_count(masks) <= block_radius(block)]
        self.half, self.limit = half_from(self.words, block), sum(block_radius(j % BLOCKS) + 1 for j in range(block, block + BLOCKS // 2)) - 1
        cuts = np.flatnonzero(np.r_[True, np.diff(values[mine]) != 0, True])
        for s, e, value in zip(cuts[:-1].tolist(), cuts[1:].tolist(), values[mine[cuts[:-1]]].tolist()):
            if not here[value]:
                continue
            near = masks ^ value
            if left is None:
                near = near[near >= value]
            sizes = counts[near]
            ends = sizes.cumsum()
            if ends[-1]:
                self.compare(mine[s:e], theirs[(starts[near] - ends + sizes).repeat(sizes) + np.arange(ends[-1])])


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def node_links(codes: np.ndarray, *blocks: int, side: np.ndarray | None = None, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(member, star centre) of the groups among (n, 17) codes, by the near pairs that agree well enough in one of ``blocks``.

    With ``side``, pairs of different sides are sure to be joined, others need not be. Of several ``parts``, all together find all pairs.
    """
    words = np.ascontiguousarray(codes[:, :16]).view(">u8").astype(np.uint64)
    rank = gray_rank(words)
    order = np.lexsort((rank[:, 1], rank[:, 0]))
    codes, words = codes[order], words[order]
    del rank
    node = _Node(words, codes[:, 16])
    left, right = (None, None) if side is None else (side[order] == 0, side[order] == 1)
    del order, words
    if len(codes) <= TOGETHER:  # all pairs, as one run
        every = np.arange(len(codes))
        node.walk(every)
        node.limit = K // 2  # which one of the halves keeps to
        for node.half in node.halves:
            node.compare(*(every, every) if side is None else (every[left], every[right]))
    else:
        for block in blocks:
            values = codes[:, 2 * block].astype(np.uint16) << 8 | codes[:, 2 * block + 1]
            node.search(block, values, left, right, part, parts)
    node.settle()
    roots = node.roots(np.arange(len(codes)))
    moved = np.flatnonzero(roots != np.arange(len(codes)))
    return codes[moved], codes[roots[moved]]


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _search(parts: int):
    """A function of batches sorted by (node, side): a node is searched once all of it has come."""

    def out(rows: list[np.ndarray], sides: list[int], node: int) -> Iterator[pa.RecordBatch]:
        side = np.repeat(np.array(sides, dtype=np.uint8), [len(x) for x in rows])
        codes = [np.concatenate(rows)]
        rows.clear()  # as memory is dear here
        if len(side) > 1:
            a, b = node_links(codes.pop(), *range(BLOCKS), side=None if (side == 2).all() else side, part=node % parts, parts=parts)
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in y[at : at + (1 << 16)]], pa.binary()) for y in (a, b)], schema=_LINKS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sides: list[int] = []
        node = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 17)
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and keys[s] >> 2 != node:
                    yield from out(held, sides, node)
                    held, sides = [], []
                node = int(keys[s]) >> 2
                held.append(codes[s:e])
                sides.append(int(keys[s]) & 3)
        if held:
            yield from out(held, sides, node)

    return search


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) links whose connected components are the groups of the distinct fingerprints in column ``fp``."""
    n = fingerprints.count()
    share = 1 if n <= SHARE else -(-2 * n // SHARE)
    parts = 1 if n <= TOGETHER else -(-NODES // (share * (share + 1) // 2))

    def key(i: Column) -> Column:
        """The node of this share and another, for one part of the values; below it 0 or 1 for the side, 2 if the two are one."""
        other = (i / parts).cast("int")
        node = (F.least("own", other) * share + F.greatest("own", other)) * parts + i % parts
        return node * 4 + F.when(F.col("own") == other, 2).otherwise((F.col("own") > other).cast("int"))

    keys = F.transform(F.sequence(F.lit(0), F.lit(share * parts - 1)), key)
    return (
        fingerprints.select("fp", F.pmod(F.xxhash64("fp"), F.lit(share)).cast("int").alias("own"))
        .select(F.explode(keys).alias("key"), "fp")
        .repartitionById(share * share * parts, F.shiftright("key", 2))
        .sortWithinPartitions("key")
        .mapInArrow(_search(parts), "a binary, b binary")
    )


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), grp, n, kept_id, kept_th of every row that shares its group with another."""
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint_udf("text").alias("fp")).filter("fp is not null"))
    roots = components(near_links(prints.select("fp").distinct()))
    placed = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("doc_id", "th", F.coalesce("root", "fp").alias("grp"))
    best = placed.groupBy("grp").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("th").alias("t"))).alias("k")
    )
    return placed.join(best.filter("n > 1"), "grp").select("doc_id", "th", "grp", "n", F.col("k.i").alias("kept_id"), F.col("k.t").alias("kept_th"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): every row that goes, and the document of its group that stays."""
    g = groups(docs)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    others = g.filter(~same).select("doc_id", F.col("kept_id").alias("duplicate_of"))
    repeats = g.filter(same).groupBy("grp").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("c")).filter("c > 1")
    return others.unionByName(repeats.select("doc_id", F.col("doc_id").alias("duplicate_of"), F.explode(F.sequence(F.lit(2), F.col("c"))).alias("_")).drop("_"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, every other row as it was; the text is shuffled once, for join and repeats together."""
    g = groups(docs)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    fate = g.groupBy(*keys, "th").agg(F.max(same).alias("stays"))
    names = ["id", "none", "th"]
    joined = docs.select(F.struct("*").alias("row"), *keys, F.xxhash64("text").alias("th")).join(fate, names, "left").filter("stays is null or stays")
    turn = F.row_number().over(W.partitionBy(*names).orderBy(*names))  # partitioned and sorted as the join leaves it
    return joined.withColumn("turn", turn).filter("stays is null or turn = 1").select("row.*")


ORACLE = f"""
WITH RECURSIVE words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM documents),
hashed AS (SELECT word, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS hi, ('0x' || substr(md5(word), 17, 16))::UBIGINT AS lo FROM (SELECT DISTINCT word FROM words)),
sized AS (SELECT doc_id, CASE WHEN count(*) >= {SMALL} THEN {K} ELSE {K_SMALL} END AS radius FROM words GROUP BY doc_id),
bits AS (SELECT doc_id, i, sum(CASE WHEN i < 64 THEN (hi >> (63 - i)) & 1 ELSE (lo >> (127 - i)) & 1 END) * 2 > count(*) AS bit
         FROM words JOIN hashed USING (word), range(128) r(i) GROUP BY doc_id, i),
prints AS (SELECT doc_id, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i) || lpad(bin(any_value(radius)), 8, '0') AS fp
           FROM bits JOIN sized USING (doc_id) GROUP BY doc_id),
fps AS (SELECT DISTINCT fp, CASE WHEN substr(fp, 129) = lpad(bin({K}), 8, '0') THEN {K} ELSE {K_SMALL} END AS radius FROM prints),
near AS (SELECT a.fp AS a, b.fp AS b FROM fps a JOIN fps b ON a.fp <> b.fp
         WHERE bit_count(xor(substr(a.fp, 1, 128)::BIT, substr(b.fp, 1, 128)::BIT)) <= least(a.radius, b.radius)),
reach AS (SELECT fp AS a, fp AS b FROM fps UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
root AS (SELECT a AS fp, min(b) AS grp FROM reach GROUP BY a),
placed AS (SELECT doc_id, grp, min(doc_id) OVER (PARTITION BY grp) AS kept FROM prints JOIN root USING (fp))
SELECT doc_id, kept AS duplicate_of FROM placed WHERE doc_id <> kept
"""
