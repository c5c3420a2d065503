"""Approximate nearest neighbours by collision counting.

Every vector is projected on PROJECTIONS directions (rows of random orthogonal matrices); each projection is one
sorted array. A query's windows are centred on its own projections and widened round by round (virtual
rehashing: a wider bucket is the same array read further out). A vector that falls into the windows of at least the
threshold number of projections is verified by its true distance. With search radius R the windows reach WIDTH * R
times the spread of a unit vector's projection, and the threshold is the MISS quantile of the collisions of a vector
exactly R away, so such a vector is missed with probability MISS. A query ends when its k-th best verified distance is
within R. Narrow windows are read out of the sorted arrays; wide ones are counted by asking each vector for its place
in them, kept as one byte (a 256th of the array), with the window's ends rounded outward.

Queries are the rows whose id is divisible by EVERY. All rows are indexed: they fall to cells around pivots fitted on a
bounded sample (``vectors.SAMPLE_ROWS``), and each part of a cell has sorted arrays of its own. A query's k-th distance in the sample
bounds its k-th distance in the table from above; it is sent only to cells that hold space within that bound, beyond the planes
between the pivots, and no search goes further out. Cells larger than a block are split by hash, and so are the queries that meet in
one cell; the best k of each part and of the sample are merged. How many cells a query meets depends on how much structure the vectors have:
without any it is most of them, and the work grows as queries times rows.

Defined cases: rows without id, without vector, or with a null, NaN or infinite element are left out; vectors of
different length are never neighbours; identical rows count once; a vector is no neighbour of rows with its own
id; several vectors of one id are rows of their own; equal distances are ordered by neighbour id; with fewer than k others all are returned; an empty table gives
an empty table; extra columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import cut
from graphloom.llm.vectors import SAMPLE_ROWS, Pivots, by_dim, row_hash, sample_of, squares, to_matrix, valid_vectors

NEIGHBOURS = 10
#: Every so manieth id is a query.
EVERY = 20
PROJECTIONS, WIDTH, MISS = 64, 1.0, 0.03
FIRST_RADIUS, GROWTH, PROBES = 0.9, 1.5, 32
#: Share of the sorted arrays that windows may hold to be read out of them.
RING = 0.02
#: Rows in a part of a cell, and queries that meet it in one task.
BLOCK, ASKING = 8192, 8192
#: Queries verified by one product.
_TOGETHER = 64
SEED = 7


@lru_cache(maxsize=4)
def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    """(dim, m) unit columns, orthogonal within each run of ``dim``."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))], axis=1)[:, :m]


@lru_cache(maxsize=4)
def collision_threshold(dim: int, m: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that all but a share ``miss`` of the vectors at the search radius reach."""
    rng = np.random.default_rng(SEED + 1)
    u = rng.standard_normal((8192, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return int(np.quantile((np.abs(u @ directions(dim, m)) <= width / math.sqrt(dim)).sum(axis=1), miss, method="lower"))


class CollisionIndex:
    """The sorted array of each projection, and the place of every vector in it as one byte."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, k: int = NEIGHBOURS):
        self.data, self.ids, self.dim = data, ids, data.shape[1]
        n = len(data)
        p = data @ directions(self.dim)
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32)
        #: All sorted arrays in one: each lies a span above the one before, so one search finds the ends of all windows.
        self.span = 4 * float(np.abs(p).max(initial=1.0))
        self.starts = np.arange(p.shape[1]) * n
        self.sorted = (np.take_along_axis(p.T, self.order, axis=1) + np.arange(p.shape[1])[:, None] * self.span).ravel()
        self.place = np.empty(self.order.shape, dtype=np.uint8)
        np.put_along_axis(self.place, self.order, (np.arange(n) * 256 // max(1, n)).astype(np.uint8)[None, :], axis=1)
        self._shifted, self._inside = np.empty_like(self.place), np.empty(self.place.shape, dtype=bool)
        self.threshold = collision_threshold(self.dim)
        self.scale = self._first_radius(k)

    def _first_radius(self, k: int) -> float:
        """FIRST_RADIUS of the median distance of PROBES rows from their k-th neighbour."""
        n = len(self.data)
        if n < 2:
            return 1.0
        at = np.unique(np.linspace(0, n - 1, PROBES).astype(int))
        kth = min(k, n - 1)
        return FIRST_RADIUS * float(np.sqrt(np.median(np.partition(squares(self.data[at], self.data), kth, axis=1)[:, kth]))) or 1.0

    def _ends(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where ``at`` falls in each sorted array; beyond a span's reach is an array's end."""
        reach = self.span / 2
        return self.sorted.searchsorted(np.clip(at, -reach, reach) + np.arange(len(at)) * self.span, side) - self.starts

    def collisions(self, at: np.ndarray, radius: float) -> np.ndarray:
        """In how many windows around the projections ``at`` each vector lies (wide windows: at least as many)."""
        n, m = len(self.data), len(self.order)
        w = WIDTH * radius / math.sqrt(self.dim)
        lo, hi = self._ends(at - w, "left"), self._ends(at + w, "right")
        if (hi - lo).sum() <= RING * n * m:
            return np.bincount(np.concatenate([self.order[j, lo[j] : hi[j]] for j in range(m)]), minlength=n)
        first = lo * 256 // n
        wide = np.where(hi > lo, (np.maximum(hi, 1) - 1) * 256 // n - first + 1, 0)
        np.subtract(self.place, first.astype(np.uint8)[:, None], out=self._shifted)  # unsigned: what is below comes out far above
        inside = np.less_equal(self._shifted, np.clip(wide - 1, 0, 255).astype(np.uint8)[:, None], out=self._inside)
        inside[wide == 0] = False
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if m < 256 else np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, most: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, distances) of the best k verified within ``most`` of each row of ``q``, in order; none of its ``own`` id."""
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        radius = np.minimum(self.scale, most)
        at = q @ directions(self.dim)
        waiting = np.arange(len(q))
        while len(waiting):
            again = []
            for s in range(0, len(waiting), _TOGETHER):
                some = waiting[s : s + _TOGETHER]
                gaps = squares(q[some], self.data)
                for row, i in zip(gaps, some):
                    new = np.flatnonzero(self.collisions(at[i], radius[i]) >= self.threshold)
                    new = new[self.ids[new] != own[i]]
                    square = row[new]
                    kth = np.sqrt(np.partition(square, k - 1)[k - 1]) if len(new) >= k else np.inf
                    if kth <= radius[i] or radius[i] >= most[i] or len(new) + (self.ids == own[i]).sum() == len(self.ids):
                        near = new[square <= (min(kth, most[i]) + 1e-6) ** 2] if min(kth, most[i]) < np.inf else new
                        exact = np.sqrt(np.square(self.data[near] - q[i]).sum(axis=1))
                        best = np.lexsort((self.ids[near], exact))[:k]
                        out[i] = near[best], exact[best]
                    else:
                        radius[i] = min(radius[i] * GROWTH, max(kth, radius[i] * 1.01), most[i])
                        again.append(i)
            waiting = np.array(again, dtype=np.int64)
        return out


RESULT = "vec_id long, query_hash long, neighbour_id long, neighbour_hash long, distance double"
_ARROW = pa.schema([(c, pa.int64()) for c in ("vec_id", "query_hash", "neighbour_id", "neighbour_hash")] + [("distance", pa.float64())])


def _search_part(k: int):
    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("h", "ascending")])
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        vec, ids, hashes, most = to_matrix(rows), rows.column("vec_id").to_numpy(), rows.column("h").to_numpy(), rows.column("most").to_numpy()
        found: list[tuple] = []
        if asks.any() and not asks.all():
            index, told = CollisionIndex(vec[~asks], ids[~asks], k), hashes[~asks]
            for i, (near, distance) in zip(np.flatnonzero(asks), index.search(vec[asks], ids[asks], most[asks], k)):
                found.append((np.full(len(near), ids[i]), np.full(len(near), hashes[i]), index.ids[near], told[near], distance))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 5
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)

    return search


_PLACED = pa.schema([("vec_id", pa.int64()), ("h", pa.int64()), ("vec", pa.list_(pa.float64())), ("dim", pa.int32()), ("asks", pa.bool_()), ("most", pa.float64()), ("cells", pa.list_(pa.int32())), ("known", pa.list_(pa.int64())), ("known_hash", pa.list_(pa.int64())), ("gaps", pa.list_(pa.float64()))])
_PLACED_DDL = "vec_id long, h long, vec array<double>, dim int, asks boolean, most double, cells array<int>, known array<long>, known_hash array<long>, gaps array<double>"


def _place(pivots: dict[int, Pivots], sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], every: int, k: int):
    """Each row with its cell; each query a second time, with the bound of its k-th distance and the cells to be searched."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in by_dim(batch) if batch.num_rows else ():
                x, ids = to_matrix(rows), rows.column("vec_id").to_numpy(zero_copy_only=False)
                asks = np.flatnonzero(ids % every == 0)
                best, gap, told = np.zeros((len(asks), 0), np.int64), np.zeros((len(asks), 0)), np.zeros((len(asks), 0), np.int64)
                if dim in pivots:
                    p, (known, others, hashes) = pivots[dim], sample[dim]
                    gaps = p.gaps(x)
                    home = gaps.argmin(axis=1)
                    most = np.full(len(asks), np.inf)
                    if len(known) > k:
                        best, gap, told = np.zeros((len(asks), k), np.int64), np.zeros((len(asks), k)), np.zeros((len(asks), k), np.int64)
                        for s in range(0, len(asks), 256):
                            part = asks[s : s + 256]
                            square = squares(x[part], others)
                            square[ids[part][:, None] == known[None]] = np.inf
                            at = np.argpartition(square, k - 1, axis=1)[:, :k]
                            best[s : s + 256], told[s : s + 256] = known[at], hashes[at]
                            gap[s : s + 256] = np.sqrt(np.square(others[at] - x[part][:, None]).sum(axis=2))
                            gap[s : s + 256][np.take_along_axis(square, at, axis=1) == np.inf] = np.inf
                        most = gap.max(axis=1) + 1e-6
                    norm = 1e-7 * np.sqrt(np.square(x[asks]).sum(axis=1))[:, None]
                    reached = p.margins(gaps[asks], home[asks], norm) <= most[:, None] + norm
                else:  # a length that the sample lacks is one cell
                    home, most, reached = np.zeros(len(x), np.int64), np.full(len(asks), np.inf), np.ones((len(asks), 1), dtype=bool)
                reach = np.r_[0, reached.sum(axis=1).cumsum()]
                ends = np.arange(len(asks) + 1) * best.shape[1]
                for own, at, bound, cells, which, more in ((rows, False, np.full(len(x), np.inf), np.arange(len(x) + 1), home, np.zeros(len(x) + 1)), (rows.take(pa.array(asks)), True, most, reach, np.nonzero(reached)[1], ends)):
                    lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in ((cells, which.astype(np.int32)), *((more, v.ravel() if at else v[:0].ravel()) for v in (best, told, gap)))]
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("h"), own.column("vec"), own.column("dim"), pa.array(np.full(own.num_rows, at)), pa.array(bound), *lists], schema=_PLACED)

    return place


def nearest_neighbours(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, block: int = BLOCK, asking: int = ASKING) -> DataFrame:
    """vec_id, neighbour_id, position (from 1), distance: the k nearest found, among all rows, for every row whose id is divisible by ``every``."""
    rows = cut(valid_vectors(table).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("h", row_hash()))
    n, longest = rows.agg(F.count("*"), F.max("dim")).first()
    sample = sample_of(rows, longest or 1)
    pivots = {d: Pivots(m, -(-n // block)) for d, (_, m, _) in sample.items()}
    placed = cut(rows.select("vec_id", "h", "vec", "dim").mapInArrow(_place(pivots, sample, every, k), _PLACED_DDL))
    seen = placed.filter("asks").select("vec_id", F.col("h").alias("query_hash"), F.explode(F.arrays_zip("known", "known_hash", "gaps")).alias("s")).select("vec_id", "query_hash", F.col("s.known").alias("neighbour_id"), F.col("s.known_hash").alias("neighbour_hash"), F.col("s.gaps").alias("distance")).filter(F.col("distance") < F.lit(float("inf")))
    placed = placed.drop("known", "known_hash", "gaps").withColumn("cell", F.explode("cells")).drop("cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count_if(~F.col("asks")) / block).cast("int").alias("parts"), F.ceil(F.count_if("asks") / asking).cast("int").alias("chunks")).filter("parts > 0 and chunks > 0")
    if (longest or 1) <= SAMPLE_ROWS:  # a row for each pivot, and for each length of vector
        sizes = F.broadcast(sizes)
    own = F.pmod("h", F.when(F.col("asks"), F.col("chunks")).otherwise(F.col("parts"))).cast("int")
    met = placed.join(sizes, ["dim", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("parts")).otherwise(F.col("chunks")) - 1)))
    part, chunk = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    met = met.select("vec_id", "h", "vec", "dim", "asks", "most", "cell", part.alias("part"), chunk.alias("chunk"))
    found = met.groupBy("dim", "cell", "part", "chunk").applyInArrow(_search_part(k), RESULT).unionByName(seen)
    found = found.groupBy("vec_id", "query_hash", "neighbour_id", "neighbour_hash").agg(F.min("distance").alias("distance"))
    best = W.partitionBy("vec_id", "query_hash").orderBy("distance", "neighbour_id")
    return found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k).select("vec_id", "neighbour_id", "position", "distance")
