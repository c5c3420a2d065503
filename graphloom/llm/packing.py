"""Best-fit packing by minimum bin slack.

A text of n words is cut at multiples of ``capacity``; whole cuts fill bins of their own and the remainder is a
piece to pack. The longest piece left opens a bin; a subset-sum dynamic program over the lengths still
available, kept as one bitset, finds the fullest combination that holds it, and those pieces are removed. As
long as the pieces last, the same combination stays the fullest, so it is taken at once as often as they allow.

Documents are dealt by hash to shards of about ``shard_rows`` rows, each packed by one task from lengths alone;
a shard wastes at most what its last bins leave open, so the bins of a document depend on the table's size (in rows with
words), the share of them left open hardly does. Packing needs no text after the words are counted.

Defined cases: null, empty and blank texts have no piece and no row; equal lengths are taken in order of doc_id
(nulls first), then of the text's hash; repeated rows are packed one by one; a null ``doc_id`` is carried along;
an empty table gives an empty table; extra columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, word_count

#: Words in a bin.
CAPACITY = 2048
SHARD_ROWS = 8192


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """[(length, how many)] of the fullest combination within ``capacity`` that holds the longest length."""
    lengths = sorted((x for x, c in counts.items() if c), reverse=True)
    first = lengths[0]
    room = capacity - first
    reach, full, steps = 1, 1 << room, []
    limit = (full << 1) - 1
    for x in lengths:
        if x > room:
            continue
        most = min(counts[x] - (x == first), room // x)
        for _ in range(most):
            new = (reach | reach << x) & limit
            if new == reach:
                break
            steps.append((x, reach))
            reach = new
        if reach & full:
            break
    left, taken = reach.bit_length() - 1, {first: 1}
    for x, before in reversed(steps):
        if not before >> left & 1:  # not reachable without this piece
            left -= x
            taken[x] = taken.get(x, 0) + 1
    return sorted(taken.items(), reverse=True)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each length (0 < length <= capacity)."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    if not len(lengths):
        return bins, offsets
    order = np.argsort(lengths, kind="stable")
    values, starts, sizes = np.unique(lengths[order], return_index=True, return_counts=True)
    at = dict(zip(values.tolist(), starts.tolist()))
    counts = dict(zip(values.tolist(), sizes.tolist()))
    number = 0
    while counts:
        combination = fullest(counts, capacity)
        for _ in range(min(counts[x] // m for x, m in combination)):
            offset = 0
            for x, m in combination:
                members = order[at[x] : at[x] + m]
                at[x] += m
                bins[members], offsets[members] = number, offset + x * np.arange(m)
                offset += x * m
                counts[x] -= m
            number += 1
        for x, _ in combination:
            if not counts[x]:
                del counts[x]
    return bins, offsets


SCHEMA = "doc_id long, piece int, start long, length int, bin_id long, bin_offset int"


def _pack_shard(capacity: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "th"], na_position="first", kind="stable")
        n, ids = rows["n"].to_numpy(), rows["doc_id"].to_numpy()
        whole, rest = n // capacity, n % capacity
        packed = np.flatnonzero(rest)
        bins, offsets = pack_lengths(rest[packed], capacity)
        base = np.repeat(np.arange(len(n)), whole)
        number = np.arange(len(base)) - np.repeat(np.cumsum(whole) - whole, whole)
        first = int(bins.max()) + 1 if len(bins) else 0
        out = pd.DataFrame({
            "doc_id": np.r_[ids[base], ids[packed]], "piece": np.r_[number, whole[packed]], "start": np.r_[number, whole[packed]] * capacity,
            "length": np.r_[np.full(len(base), capacity), rest[packed]], "bin_id": np.r_[first + np.arange(len(base)), bins] + (int(key[0]) << 32), "bin_offset": np.r_[np.zeros(len(base), dtype=np.int64), offsets],
        })
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], dtype="Int64")
        return out

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, start (word of the text), length, bin_id, bin_offset of every piece."""
    lean = cut(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("th"), word_count("text").alias("n")).filter("n > 0"))
    shards = max(1, -(-lean.count() // shard_rows))
    return lean.withColumn("shard", F.pmod("th", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_pack_shard(capacity), SCHEMA)
