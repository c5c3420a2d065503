"""WARC records as a table of chunks.

A record's payload never is one value in memory: it becomes rows of record id and chunk number, each with at most
``CHUNK`` bytes, the bytes before it, and the digest of everything up to and with it (one running SHA-1, copied
at each chunk, so the last row's digest is the record's). The reader pulls fixed pieces from any byte stream,
plain or gzip with a member for each record, and the writer takes chunk rows in order and puts out pieces.

Files are read and written by the tasks through paths or URIs that all executors see.

Defined cases: a null or empty payload is one empty chunk; a null url has no WARC-Target-URI; repeated rows give
repeated records; a null ``page_id`` is carried along; a record cut off by the end of its file is reported with
what came and ``is_last`` false on its last row; bytes of a file that are no record (junk between records, a header of
over ``MAX_HEADER``, one cut off, or one without a length) become chunk rows without record id whose ``error`` says why, and reading goes
on at the next line that starts a record; a header that isn't UTF-8 is read as Latin-1; a page's url may be of any length; an
empty table gives an empty table; extra columns are neither read nor returned.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 14
PIECE = 1 << 16
MAX_HEADER = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


class Pull:
    """A read(n) over an iterable of byte pieces; holds no more than one piece."""

    def __init__(self, pieces: Iterable[bytes]):
        self._pieces, self._now, self._at = iter(pieces), b"", 0

    def read(self, n: int) -> bytes:
        while self._at >= len(self._now):
            nxt = next(self._pieces, None)
            if nxt is None:
                return b""
            self._now, self._at = nxt, 0
        out = self._now[self._at : self._at + n]
        self._at += len(out)
        return out


def inflate(stream, piece: int = PIECE) -> Iterator[bytes]:
    """Pieces of the members of a gzip stream, one after another."""
    d, data = zlib.decompressobj(31), b""
    while True:
        data = data or stream.read(piece)
        if not data:
            return
        out = d.decompress(data, piece)
        data = d.unconsumed_tail
        if out:
            yield out
        if d.eof:
            data, d = d.unused_data, zlib.decompressobj(31)


def header(record_id: str, uri: str | None, length: int, kind: str = "resource", mime: str = "text/html") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + " ".join(uri.split()))
    return ("\r\n".join([*lines, f"Content-Type: {mime}", f"Content-Length: {length}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record_pieces(record_id: str, uri: str | None, payload: memoryview, piece: int = PIECE) -> Iterator[bytes]:
    yield header(record_id, uri, len(payload))
    for at in range(0, len(payload), piece):
        yield bytes(payload[at : at + piece])
    yield b"\r\n\r\n"


class WarcReader:
    """Iterates over (fields, chunk_no, offset, payload, digest, is_last); bytes that are no record have the field ``error`` only."""

    def __init__(self, stream, chunk: int = CHUNK, piece: int = PIECE, max_header: int | None = MAX_HEADER):
        self._stream, self._chunk, self._piece, self._held, self._max_header = stream, chunk, piece, bytearray(), max_header

    def _more(self) -> bool:
        data = self._stream.read(self._piece)
        self._held += data
        return bool(data)

    def _skipped(self, error: str) -> Iterator[tuple[dict[str, str], int, int, bytes, str, bool]]:
        """What comes before the next line that starts a record."""
        at, number, digest, ended = 0, 0, hashlib.sha1(usedforsecurity=False), False
        while not ended:
            while len(self._held) < self._chunk + 6 and self._more():
                pass
            end = self._held.find(b"\nWARC/", 0, self._chunk + 5) + 1
            payload = bytes(self._held[: end or self._chunk])
            del self._held[: len(payload)]
            digest.update(payload)
            ended = end > 0 or not self._held
            yield {"error": error}, number, at, payload, digest.copy().hexdigest(), ended
            at, number = at + len(payload), number + 1

    def _header(self) -> dict[str, str] | None:
        seen = 0
        while True:
            if not seen:
                del self._held[: len(self._held) - len(self._held.lstrip(b"\r\n"))]
            end = self._held.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0:
                break
            seen = len(self._held)
            if seen >= 5 and not self._held.startswith(b"WARC/"):
                return {"error": "no record header"}
            if self._max_header is not None and seen > self._max_header:
                return {"error": "header too long"}
            if not self._more():
                return {"error": "header cut off"} if self._held else None
        if not self._held.startswith(b"WARC/"):
            return {"error": "no record header"}
        raw = bytes(self._held[:end])
        try:
            lines = raw.decode("utf-8").split("\r\n")
        except UnicodeDecodeError:
            lines = raw.decode("latin-1").split("\r\n")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return {"error": "no content length"}
        fields.pop("error", None)
        del self._held[: end + 4]
        return fields

    def __iter__(self) -> Iterator[tuple[dict[str, str], int, int, bytes, str, bool]]:
        while (fields := self._header()) is not None:
            if "error" in fields:
                yield from self._skipped(fields["error"])
                continue
            length, at, number, digest = int(fields["content-length"]), 0, 0, hashlib.sha1(usedforsecurity=False)
            while True:
                want = min(self._chunk, length - at)
                while len(self._held) < want and self._more():
                    pass
                payload = bytes(self._held[:want])
                del self._held[:want]
                digest.update(payload)
                cut_off = len(payload) < want
                last = at + len(payload) == length
                yield fields, number, at, payload, digest.copy().hexdigest(), last
                at, number = at + len(payload), number + 1
                if last or cut_off:
                    break


def record_id(page_id: int | None, url: str | None) -> str:
    name = f"{'' if page_id is None else page_id}|{url or ''}".encode("utf-8", "surrogatepass")
    return uuid.UUID(bytes=hashlib.md5(name, usedforsecurity=False).digest()).urn


CHUNKS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("byte_offset", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("sha1_so_far", T.StringType()), T.StructField("is_last", T.BooleanType()), T.StructField("row_no", T.LongType())])
_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("chunk_no", pa.int32()), ("byte_offset", pa.int64()), ("payload", pa.binary()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_()), ("row_no", pa.int64())])


def _row_numbers() -> Iterator[int]:
    """Numbers for the records of a task, distinct over all tasks."""
    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 33)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` payload bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[5]) + 256
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as one WARC stream, read back chunk by chunk."""

    def rows() -> Iterator[tuple]:
        numbers, row_no = _row_numbers(), -1
        for batch in batches:
            pages, urls, html = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)

            def stream(urls=urls, pages=pages, html=html) -> Iterator[bytes]:
                for i, (p, u) in enumerate(zip(pages, urls)):
                    body = html[i].as_buffer() if html[i].is_valid else None
                    yield from record_pieces(record_id(p, u), u, memoryview(body) if body is not None else memoryview(b""))

            at = -1
            for fields, number, offset, payload, digest, last in WarcReader(Pull(stream()), max_header=None):
                if number == 0:
                    at, row_no = at + 1, next(numbers)
                yield pages[at], fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"), number, offset, payload, digest, last, row_no

    yield from _batches(rows(), _ARROW)


def page_records(pages: DataFrame) -> DataFrame:
    """The chunk table of the WARC records of ``pages``; ``row_no`` tells repeated records apart."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_encode, CHUNKS)


def write_warc(chunks: DataFrame, folder: str, compress: bool = True) -> list[str]:
    """WARC files of the records of a chunk table, one for each partition; returns the paths written.

    Rows need record_id, uri, chunk_no, payload, and row_no where records share an id; chunks that don't make up whole records
    raise an error. A record's length is summed up first so that its header can go ahead of its chunks.
    """
    numbered = chunks if "row_no" in chunks.columns else chunks.withColumn("row_no", F.lit(0).cast("long"))
    record = ["record_id", "row_no"]
    # a window, not a join: row_no depends on the partitions, so the rows are read once
    sized = numbered.select(*record, "uri", "chunk_no", "payload").repartition(*record).withColumn("size", F.sum(F.octet_length("payload")).over(W.partitionBy(*record)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
        files, at = _file_system(folder)
        files.create_dir(at, recursive=True)
        path = f"{at.rstrip('/')}/{name}"
        out = raw = before = None
        for batch in batches:
            for r in batch.to_pylist():
                if raw is None:
                    raw = files.open_output_stream(path + ".tmp", compression=None)
                now = (r["record_id"], r["row_no"], r["chunk_no"])
                if now != (*before[:2], before[2] + 1) if before and before[:2] == now[:2] else now[2] != 0:
                    raise ValueError(f"chunks of {r['record_id']} are missing or repeated without a row_no")
                before = now
                if r["chunk_no"] == 0:
                    if out is not None:
                        out.write(b"\r\n\r\n")
                        if compress:
                            out.close()
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if compress else raw
                    out.write(header(r["record_id"], r["uri"], r["size"]))
                out.write(r["payload"])
        if raw is not None:
            out.write(b"\r\n\r\n")
            if compress:
                out.close()
            raw.close()
            files.move(path + ".tmp", path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"]})

    ordered = sized.sortWithinPartitions(*record, "chunk_no")
    return sorted(r[0] for r in ordered.mapInArrow(write, "path string").collect())


def read_warc(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """The chunk table of WARC files, a task for each file; ``page_id`` is null, ``error`` only where bytes are no record."""
    schema = _ARROW.append(pa.field("error", pa.string()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            numbers, row_no = _row_numbers(), -1
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    files, at = _file_system(path)
                    with files.open_input_stream(at, compression=None) as raw:
                        stream = Pull(inflate(raw)) if path.endswith(".gz") else raw
                        for fields, number, offset, payload, digest, last in WarcReader(stream, chunk):
                            row_no = next(numbers) if number == 0 else row_no
                            record = fields.get("warc-record-id")
                            yield None, record and record.strip("<>"), fields.get("warc-target-uri"), number, offset, payload, digest, last, row_no, fields.get("error")

        yield from _batches(rows(), schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(read, T.StructType([*CHUNKS, T.StructField("error", T.StringType())]))


def page_record_text(pages: DataFrame) -> DataFrame:
    """``page_records`` with the payload in base64, for sinks without binary columns."""
    return page_records(pages).drop("row_no").withColumn("payload", F.translate(F.base64("payload"), "\r\n", ""))


ORACLE = f"""
WITH p AS (SELECT page_id, 'urn:uuid:' || (md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, ''))::UUID)::VARCHAR AS record_id, url AS uri,
                  hex(encode(coalesce(html, ''))) AS h FROM pages),
c AS (SELECT *, unnest(range(greatest(1, (length(h) // 2 + {CHUNK - 1}) // {CHUNK}))) AS i FROM p)
SELECT page_id, record_id, uri, i::INTEGER AS chunk_no, i * {CHUNK} AS byte_offset, base64(unhex(substr(h, (i * {2 * CHUNK} + 1)::BIGINT, {2 * CHUNK}))) AS payload,
       sha1(unhex(substr(h, 1, ((i + 1) * {2 * CHUNK})::BIGINT))) AS sha1_so_far, (i + 1) * {2 * CHUNK} >= length(h) AS is_last FROM c
"""
