"""Chat formatting by columnar byte assembly.

A conversation becomes one text in a turn-delimited template, together with the byte spans a trainer computes
loss on. Rows arrive sorted by conversation and turn; for a batch, segment lengths, their cumulative offsets and
the scatter indices are computed in numpy, and headers, contents and footers are copied into one preallocated
buffer that becomes the Arrow string column as it is.

Template of a turn: ``<|im_start|>ROLE\\nCONTENT<|im_end|>\\n``. The control strings inside a role or content are
broken by a space after ``<|`` so that content can't open or close a turn.

Defined cases: a null or empty role is ``unknown``; a null text is empty content; rows with a null ``conv_id``
form one conversation; turns are ordered by ``turn`` (nulls first), then role, then text, so ties and repeated
rows have one order and repeated rows are all kept; a conversation whose text can't be one string value of Spark (2 GiB)
raises an error that names it; an empty table gives an empty table; extra columns are neither
read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role whose content is learned.
LEARNED = "assistant"
#: Bytes of the longest string value, as the JVM's arrays bound it.
MAX_TEXT = (1 << 31) - 16
#: Bytes copied by one set of index arrays.
COPY = 1 << 24

SCHEMA = "conv_id long, text string, n_turns int, loss_start array<long>, loss_end array<long>"
_TURNS = pa.schema([("conv_id", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("text", pa.large_string()), ("n_turns", pa.int32()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def _safe(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets (one more than rows) of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy data[start_i : start_i + size_i] to out[to_i :] for every i."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = int(ends[at] - size[at])
        upto = max(at + 1, int(np.searchsorted(ends, done + COPY, side="right")))
        if upto == at + 1:
            n = int(size[at])
            out[to[at] : to[at] + n] = data[start[at] : start[at] + n]
        else:
            s = size[at:upto]
            step = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
            out[np.repeat(to[at:upto], s) + step] = data[np.repeat(start[at:upto], s) + step]
        at = upto


def _too_long(conv: int, known: bool) -> ValueError:
    return ValueError(f"conversation {int(conv) if known else None} is longer than a string value may be ({MAX_TEXT} bytes)")


def assemble(conv: np.ndarray, known: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row for each run of equal conversations; ``known`` is false where the id is null."""
    n = len(conv)
    role_data, role_off = _bytes_of(roles)
    text_data, text_off = _bytes_of(texts)
    fixed = [np.frombuffer(x.encode(), dtype=np.uint8) for x in (OPEN, "\n", CLOSE + "\n")]
    role_size, text_size = np.diff(role_off), np.diff(text_off)
    zero = np.zeros(n, dtype=np.int64)
    segments = [(fixed[0], zero, zero + len(fixed[0])), (role_data, role_off[:-1], role_size), (fixed[1], zero, zero + 1), (text_data, text_off[:-1], text_size), (fixed[2], zero, zero + len(fixed[2]))]
    sizes = np.stack([s[2] for s in segments], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    first = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])]) if n else zero
    last = np.r_[first[1:], n]
    starts = begins[first, 0]
    for i in np.flatnonzero(ends[last - 1, -1] - starts > MAX_TEXT)[:1] if n else ():
        raise _too_long(conv[first[i]], known[first[i]])
    out = np.empty(int(ends[-1, -1]) if n else 0, dtype=np.uint8)
    for k, (data, start, size) in enumerate(segments):
        _scatter(out, begins[:, k], data, start, size)
    learned = np.array(roles.to_pylist(), dtype=object) == LEARNED
    which = np.flatnonzero(learned)
    of = np.searchsorted(first, which, side="right") - 1
    list_off = np.searchsorted(which, np.r_[first, n]).astype(np.int32)
    offsets = np.r_[starts, len(out)].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(conv[first], pa.int64(), mask=~known[first]),
            pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out)),
            pa.array((last - first).astype(np.int32)),
            pa.ListArray.from_arrays(list_off, pa.array(begins[which, 3] - starts[of])),
            pa.ListArray.from_arrays(list_off, pa.array(ends[which, 3] - starts[of])),
        ],
        schema=_ARROW,
    )


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(0)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The conversation still open at the end of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with offsets of 64 bits the rows become one batch whatever their size
        for whole in pa.Table.from_batches(rows).cast(_TURNS).combine_chunks().to_batches():
            if whole.num_rows != sum(r.num_rows for r in rows):
                raise ValueError("turns could not be put into one batch")
            yield assemble(*_ids(whole), whole.column(1), whole.column(2))

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, known = _ids(batch)
        if held:
            a, k = _ids(held[-1])
            if (a[-1], k[-1]) != (conv[0], known[0]):
                yield from flush(held)
                held, size = [], 0
        open_at = int(np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])])[-1])
        if open_at:
            yield from flush([*held, batch.slice(0, open_at)])
            held, size = [], 0
        held.append(batch.slice(open_at))
        size += pc.sum(pc.binary_length(held[-1].column(2))).as_py() or 0
        if size > MAX_TEXT:
            raise _too_long(conv[-1], known[-1])
    if held:
        yield from flush(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, text, n_turns and the byte spans [loss_start, loss_end) of the learned contents."""
    role = F.when(F.coalesce("role", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role"))
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), _safe(role).alias("role"), _safe(F.coalesce("text", F.lit(""))).alias("text"), F.col("turn").alias("turn"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_format, SCHEMA)
    )


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, replace(replace(coalesce(nullif(role, ''), 'unknown'), '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') AS role,
                  replace(replace(coalesce(text, ''), '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') AS text FROM conversations),
s AS (SELECT *, '{OPEN}' || role || chr(10) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
p AS (SELECT *, coalesce(sum(strlen(head) + strlen(text) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + strlen(head) AS pos FROM s)
SELECT conv_id, string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY n) AS text, count(*)::INTEGER AS n_turns,
       coalesce(list(pos ORDER BY n) FILTER (WHERE role = '{LEARNED}'), []::BIGINT[]) AS loss_start,
       coalesce(list(pos + strlen(text) ORDER BY n) FILTER (WHERE role = '{LEARNED}'), []::BIGINT[]) AS loss_end
FROM p GROUP BY conv_id
"""
