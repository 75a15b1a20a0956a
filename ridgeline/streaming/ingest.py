"""Structured Streaming into a store: append in micro-batches, decide what is newest when reading."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.schema import DELETE
from ridgeline.sources.store import Conflict, Store


class Maintenance:
    """Flush and compaction of a store beside its writers, one at a time; what fails is raised by wait()."""

    def __init__(self, store: Store, compact: bool = False):
        self.spark, self.path, self.compact = store.spark, store.path, compact
        self.thread: threading.Thread | None = None
        self.error: Exception | None = None

    def _run(self) -> None:
        try:
            store = Store.open(self.spark, self.path)
            if self.compact:
                store.compact_if_needed()
            else:
                store.flush()
        except Conflict:
            pass  # another flush took these segments; the next one has the rest
        except Exception as e:
            self.error = e

    def start(self) -> bool:
        """False if the last one is still running."""
        if self.thread is not None and self.thread.is_alive():
            return False
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return True

    def wait(self) -> None:
        if self.thread is not None:
            self.thread.join()
        if self.error is not None:
            error, self.error = self.error, None
            raise error


def ingest(stream: DataFrame, store: Store, source: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds", flush_every: int = 0, most: int = 0, maintenance: Maintenance | None = None) -> StreamingQuery:
    """Appends a stream of change-log rows to store. Every micro-batch is one commit under (source, batch id), so
    a batch that is replayed after a failure is not applied twice.

    most: rows of one commit at most; a larger micro-batch is several commits in order of seq, 0 no bound.
    flush_every: batches between flushes, 0 never. With maintenance, which may compact instead, they run beside the
    stream and no micro-batch waits for them.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        while True:
            try:
                if most:
                    store.refresh().append_bounded(batch, most, source, batch_id)
                else:
                    store.refresh().append(batch, source=source, batch_id=batch_id)
                break
            except Conflict:  # a flush or compaction published first
                continue
        if flush_every and (batch_id + 1) % flush_every == 0:
            if maintenance is None:
                store.flush()
            else:
                maintenance.start()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def live_view(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A small live table kept in memory under `name`, for dashboards: state is one row per key."""
    newest = stream.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("row"))
    rows = newest.select("key", "row.seq", "row.value", "row.op").where(F.col("op") != DELETE).drop("op")
    return rows.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
