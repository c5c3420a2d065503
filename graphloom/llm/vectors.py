"""Vector tables: validation, a bounded sample, and cells around pivots fitted on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and numbers that a sample holds at most (8 MB), whatever the table's size and the vectors' length.
SAMPLE_ROWS, SAMPLE_VALUES = 1 << 14, 1 << 20
#: Rounds in which pivots move to the middle of their cells.
_LLOYD = 3


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vec, dim of the distinct rows that have an id and a non-empty vector of finite numbers."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select(F.col("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0)).filter(fine.isNull() | fine).filter(F.col("vec").isNotNull()).select("vec_id", "vec", F.size("vec").alias("dim")).distinct()


def row_hash() -> Column:
    return F.xxhash64("vec_id", "vec")


def to_matrix(table: pa.Table | pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """(rows, dim) of a list column whose rows have one length."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def by_dim(batch: pa.RecordBatch) -> list[tuple[int, pa.RecordBatch]]:
    """The rows of each length."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    kinds = np.unique(dims)
    return [(int(d), batch if len(kinds) == 1 else batch.filter(pa.array(dims == d))) for d in kinds]


def sample_of(rows: DataFrame, longest: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, hashes) for each length, of the rows of least hash: as many as the bounds allow."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, longest)))
    taken = rows.orderBy("h", "vec_id").limit(most).select("vec_id", "vec", "dim", "h").toArrow()
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in taken.combine_chunks().to_batches():
        for dim, part in by_dim(batch):
            out[dim] = (part.column("vec_id").to_numpy(zero_copy_only=False), to_matrix(part), part.column("h").to_numpy(zero_copy_only=False))
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


class Pivots:
    """Centres whose nearest rows form cells."""

    def __init__(self, sample: np.ndarray, count: int):
        centres = sample[np.unique(np.linspace(0, len(sample) - 1, max(1, min(count, len(sample)))).astype(int))]
        for _ in range(_LLOYD if len(centres) > 1 else 0):
            home = squares(sample, centres).argmin(axis=1)
            used, at, sizes = np.unique(home, return_inverse=True, return_counts=True)
            sums = np.zeros((len(used), sample.shape[1]))
            np.add.at(sums, at, sample)
            centres = sums / sizes[:, None]
        self.centres = np.unique(centres, axis=0)
        self.between = np.sqrt(squares(self.centres, self.centres))

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from all centres."""
        return squares(x, self.centres)

    def margins(self, gaps: np.ndarray, home: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Distance of each row from the plane between its own cell and each other; 0 for its own.

        No row of another cell is nearer than that. A little less is given than computed, against rounding at ``norm``.
        """
        own = gaps[np.arange(len(gaps)), home][:, None]
        apart = np.maximum(self.between[home], 1e-300)
        out = (gaps - own - 1e-9 * (1 + gaps + own) - norm * norm) / (2 * apart)
        out[np.arange(len(gaps)), home] = 0
        return np.maximum(out, 0)
