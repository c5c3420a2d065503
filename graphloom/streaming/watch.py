"""A version feed as a stream: debounced changes, applied batch by batch."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions.classify import IGNORED_DIRS
from graphloom.session import shared_folder


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """path, event_id, ts, hash of event files as they come."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.sha2("props", 256).alias("hash"))


def debounced(feed: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """path, start, end, event_id, n_events of every burst that has ended by the watermark."""
    bursts = feed.withWatermark("ts", delay).groupBy("path", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events")).select("path", "w.start", "w.end", "event_id", "n_events")


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    hashes = rows["hash"].fillna("")
    before = hashes.shift(1)
    before.iloc[0] = state.get[0] if state.exists else None
    action = np.where(before.isna(), "new", np.where(before == hashes, "touched", "changed"))
    state.update((hashes.iloc[-1],))
    yield pd.DataFrame({"path": key[0], "event_id": rows["event_id"].to_numpy(), "action": action})


def hash_gate(feed: DataFrame) -> DataFrame:
    """path, event_id, action: each version against the last hash kept in state."""
    return feed.groupBy("path").applyInPandasWithState(_changes, "path string, event_id long, action string", "hash string", "append", GroupStateTimeout.NoTimeout)


def apply_batches(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``apply``, once the one before is done; resumes from ``checkpoint``."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(result: DataFrame) -> DataFrame:
    """Run a stream over all input there is and read back its rows; files go to the session's shared folder."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = result.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")


class FolderWatcher:
    """Watches a project's folder and reindexes each file a while after its last change; one file at a time, in order of path."""

    def __init__(self, engine, on_change: Callable[[str, str], None] | None = None, debounce: float = 0.15, interval: float = 0.05):
        self.engine, self.on_change, self.debounce, self.interval = engine, on_change, debounce, interval
        self._stop, self._thread = threading.Event(), None

    def _state(self) -> dict[str, tuple[int, int]]:
        out = {}
        for folder, dirs, files in os.walk(self.engine.root):
            dirs[:] = [d for d in dirs if d not in IGNORED_DIRS and not d.startswith(".")]
            for name in files:
                path = os.path.join(folder, name)
                try:
                    status = os.stat(path)
                except OSError:
                    continue
                out[os.path.relpath(path, self.engine.root).replace(os.sep, "/")] = (status.st_mtime_ns, status.st_size)
        return out

    def _run(self, last: dict[str, tuple[int, int]]) -> None:
        waiting: dict[str, float] = {}
        while not self._stop.wait(self.interval):
            now = self._state()
            for path in {p for p in now.keys() | last.keys() if now.get(p) != last.get(p)}:
                waiting[path] = time.monotonic() + self.debounce  # every change starts the time anew
            last = now
            for path in sorted(p for p, due in waiting.items() if due <= time.monotonic()):
                del waiting[path]
                self.engine, result = self.engine.reindex_file(path)
                if self.on_change:
                    self.on_change(path, result)

    def start(self) -> FolderWatcher:
        self._thread = threading.Thread(target=self._run, args=(self._state(),), daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
