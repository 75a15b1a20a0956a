"""A keyspace at a path: immutable Parquet segments and a versioned manifest.

A write becomes visible when the next manifest is published, never before, so a failed or half-written segment
is never read. Segments of level 0 are appended batches; flush and compact write sorted ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import lookup
from ridgeline.operators.segments import statistics
from ridgeline.operators.vector import batch_top_k, top_k
from ridgeline.plans.state import as_of, compacted, live, numbered, ordered_run
from ridgeline.schema import CHANGELOG, COLUMNS, DELETE, deletes, key_bytes, puts
from ridgeline.sources.files import Folder

#: Level-0 segments that make a compaction worthwhile.
COMPACT_FROM = 4
#: Rows per batch number in a sequence number: seq = batch << ORDINAL_BITS | ordinal.
ORDINAL_BITS = 32
#: Bits of a bounded commit's place in its batch: source number = batch << COMMIT_BITS | place.
COMMIT_BITS = 20
#: Segments from which a manifest may name an older one for those that both have, rather than list them again.
SHARE_FROM = 64


class Conflict(RuntimeError):
    """Another writer published first; nothing of this write is visible."""


@dataclass
class Segment:
    id: str
    level: int
    rows: int
    tombstones: int
    min_key: str
    max_key: str
    min_seq: int
    max_seq: int


@dataclass
class Manifest:
    version: int = 0
    next_batch: int = 1
    low_water: int = -1
    segments: list[Segment] = field(default_factory=list)
    sources: dict[str, int] = field(default_factory=dict)
    #: The version whose `shared` segments come first and are not listed again; 0 if all are listed.
    base: int = 0
    shared: int = 0

    @staticmethod
    def parse(data: bytes) -> Manifest:
        d = json.loads(data)
        return Manifest(**{**d, "segments": [Segment(**s) for s in d["segments"]]})

    def dump(self) -> bytes:
        return json.dumps({**vars(self), "segments": [vars(s) for s in self.segments[self.shared :]]}).encode()

    def share(self, old: Manifest) -> None:
        """Takes over what old lists or shares if only segments were added to it. What is listed stays below the
        square root of all, so that both the listed segments and the whole manifests are few over many commits."""
        base, shared = (old.base, old.shared) if old.base else (old.version, len(old.segments))
        added = len(self.segments) - shared
        if shared >= SHARE_FROM and 0 <= added and added**2 <= len(self.segments) and self.segments[:shared] == old.segments[:shared]:
            self.base, self.shared = base, shared


class Store:
    """put, get, delete, put_vector and search_vector for single keys; put_many, delete_many, multi_get, live and
    batch_search for sets. Single-key writes are one commit each: use the set forms for bulk."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Folder(spark, f"{self.path}/manifest")
        self._segments = Folder(spark, f"{self.path}/segments")
        self.manifest = self._newest()

    # Opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The store at path as last published; an empty one if there is none."""
        return cls(spark, path)

    def refresh(self) -> Store:
        self.manifest = self._newest()
        return self

    def close(self) -> None:
        """Nothing is buffered: every acknowledged write is already published."""

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _newest(self) -> Manifest:
        versions = [n for n in self._manifests.names() if n.endswith(".json")]
        if not versions:
            return Manifest()
        newest = Manifest.parse(self._manifests.read(versions[-1]))
        if newest.base:
            newest.segments = Manifest.parse(self._manifests.read(f"{newest.base:020d}.json")).segments[: newest.shared] + newest.segments
        return newest

    def _publish(self, new: Manifest) -> None:
        new.version = self.manifest.version + 1
        new.share(self.manifest)
        if not self._manifests.add(f"{new.version:020d}.json", new.dump()):
            raise Conflict(f"version {new.version} exists; refresh() and retry")
        self.manifest = new

    def _changed(self, **values) -> Manifest:
        m = self.manifest
        return Manifest(**{**{f: getattr(m, f) for f in ("version", "next_batch", "low_water")}, "segments": list(m.segments), "sources": dict(m.sources), **values})

    # Segments

    def _write(self, rows: DataFrame, level: int) -> Segment | None:
        """A segment of rows, with its statistics; None if there are none."""
        name = uuid.uuid4().hex
        target = f"{self.path}/segments/{name}"
        writer = rows.select(*COLUMNS).write
        if level:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.block.size", 16 << 20)
        writer.parquet(target)
        s = statistics(self.spark.read.schema(CHANGELOG).parquet(target)).first()
        if not s["rows"]:
            self._segments.remove(name)
            return None
        return self._segment(name, level, s)

    def _write_each(self, rows: DataFrame, by: str) -> dict[int, Segment]:
        """A segment of level 0 for each value of `by`, all written by one job and measured by another. rows must
        be durable: they are read once for either."""
        name = uuid.uuid4().hex
        rows.select(*COLUMNS, by).write.partitionBy(by).parquet(f"{self.path}/segments/{name}")
        return {s[by]: self._segment(f"{name}/{by}={s[by]}", 0, s) for s in statistics(rows, [by]).collect()}

    @staticmethod
    def _segment(name: str, level: int, s) -> Segment:
        return Segment(name, level, s["rows"], s["tombstones"], bytes(s["min_key"]).hex(), bytes(s["max_key"]).hex(), s["min_seq"], s["max_seq"])

    def _read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*[f"{self.path}/segments/{s.id}" for s in segments])

    def changelog(self, key=None, low=None, high=None) -> DataFrame:
        """All versions; with a key or bounds, only segments whose key range can hold them are opened."""
        low = key if key is not None else low
        a = bytes(key_bytes(low)).hex() if low is not None else ""
        b = bytes(key_bytes(key)).hex() if key is not None else None
        end = bytes(key_bytes(high)).hex() if high is not None else None
        return self._read([s for s in self.manifest.segments if s.max_key >= a and (b is None or s.min_key <= b) and (end is None or s.min_key < end)])

    # Writes

    def _sequenced(self, rows: DataFrame, batch: int, order: str | None) -> DataFrame:
        base = F.lit(batch << ORDINAL_BITS)
        if order is None:
            return rows.withColumn("seq", base)
        o = F.col(order).cast("long")
        legal = (o >= 0) & (o < 1 << ORDINAL_BITS)
        return rows.withColumn("seq", base + F.when(legal, o).otherwise(F.raise_error(F.lit("order must be from 0 to 2**32 - 1")).cast("long")))

    def append(self, changes: DataFrame, source: str | None = None, batch_id: int | None = None, verify: bool = False) -> bool:
        """Publishes change-log rows as one level-0 segment. With source and batch_id, a batch that was published
        before is skipped, so a replayed stream changes nothing. False if skipped or empty.

        (key, seq) must be unique, else it is open which version is newest. verify checks it on the written
        segment, before anything is visible, at the price of a shuffle of the keys.
        """
        if source is not None and batch_id is not None and batch_id <= self.manifest.sources.get(source, -1):
            return False
        segment = self._write(changes, 0)
        if verify and segment and not self._read([segment]).groupBy("key", "seq").count().where("count > 1").isEmpty():
            self._segments.remove(segment.id)
            raise ValueError("a key has two versions with one seq; give an order")
        self._publish(self._with(segment, source, batch_id))
        return segment is not None

    def _with(self, segment: Segment | None, source: str | None, batch_id: int | None) -> Manifest:
        """The manifest with one more segment of level 0, if any, and the source's newest number."""
        sources = {**self.manifest.sources, **({source: batch_id} if source is not None else {})}
        segments = [*self.manifest.segments, *([segment] if segment else [])]
        top = max(self.manifest.next_batch, (segment.max_seq >> ORDINAL_BITS) + 1 if segment else 0)
        return self._changed(segments=segments, sources=sources, next_batch=top)

    def append_bounded(self, changes: DataFrame, most: int, source: str, batch_id: int) -> int:
        """Publishes change-log rows in order of (seq, key) as commits of at most `most` rows; the number of commits.

        The segments of all commits are written together, so the rows are read a fixed number of times however many
        commits they make. Then each is published by a manifest of its own, in order. Flushes, compactions and
        writers of other sources may publish in between; a second writer of this source gets Conflict.

        A batch that was cut short by a failure goes on behind its last published commit when it is replayed: a
        commit's number is the batch and its place in it.
        """
        placed = numbered(changes.select(*COLUMNS), "seq", "key", "op", name="__number")
        commits = -(-placed.count() // most)
        if commits >= 1 << COMMIT_BITS:
            raise ValueError(f"a batch has at most 2**{COMMIT_BITS} commits")
        start = batch_id << COMMIT_BITS
        at = self.manifest.sources.get(source, -1)
        done = max(at + 1 - start, 0)
        if done >= commits:
            return 0
        segments = self._write_each(placed.where(F.col("__number") >= done * most).withColumn("commit", F.expr(f"__number div {most}")), "commit")
        for k in range(done, commits):
            while True:
                try:
                    self._publish(self._with(segments[k], source, start + k))
                    break
                except Conflict:
                    if self.refresh().manifest.sources.get(source, -1) != at:
                        raise
            at = start + k
        return commits - done

    def put_many(self, rows: DataFrame, order: str | None = None, **commit) -> bool:
        """Puts of (key, value[, vec]). Keys must be unique, or `order` tells which of equal keys is newest."""
        return self.append(puts(self._sequenced(rows, self.manifest.next_batch, order)), **commit)

    def delete_many(self, keys: DataFrame, **commit) -> bool:
        """Tombstones for every distinct key in keys."""
        return self.append(deletes(self._sequenced(keys.select("key").distinct(), self.manifest.next_batch, None)), **commit)

    def put(self, key, value, vec: list[float] | None = None) -> bool:
        """One key. A null value is rejected, an empty one is live."""
        if key is None or value is None:
            return False
        row = [(key_bytes(key), key_bytes(value), [float(x) for x in vec] if vec else None)]
        return self.put_many(self.spark.createDataFrame(row, "key binary, value binary, vec array<float>"))

    def put_vector(self, key, value, vec: list[float]) -> bool:
        if not vec:
            raise ValueError("vec must not be null or empty")
        return self.put(key, value, vec)

    def delete(self, key) -> bool:
        if key is None:
            return False
        return self.delete_many(self.spark.createDataFrame([(key_bytes(key),)], "key binary"))

    # Reads

    def live(self) -> DataFrame:
        """The newest version of every key that is not deleted.

        A full compaction leaves one version per key (level 2): it is read without a shuffle, and with later
        segments only their keys are resolved anew.
        """
        base = [s for s in self.manifest.segments if s.level == 2]
        tail = [s for s in self.manifest.segments if s.level != 2]
        if len(base) != 1:
            return live(self.changelog())
        rows = self._read(base)
        return lookup.live_over_base(rows, self._read(tail)).select(*COLUMNS) if tail else rows.where(F.col("op") != DELETE)

    def as_of(self, seq: int) -> DataFrame:
        """The live rows after change seq; exact while compaction has not removed versions up to it."""
        return as_of(self.changelog(), seq)

    def get(self, key) -> bytes | None:
        if key is None:
            return None
        row = lookup.get(self.changelog(key=key), key).first()
        return None if row is None else bytes(row["value"])

    def query(self, key) -> tuple[bytes, list[float] | None] | None:
        row = lookup.query(self.changelog(key=key), key).first()
        return None if row is None else (bytes(row["value"]), row["vec"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(self.changelog(), keys)

    def range(self, low=None, high=None) -> DataFrame:
        return lookup.key_range(self.changelog(low=low, high=high), low, high)

    def prefix(self, prefix) -> DataFrame:
        return lookup.key_prefix(self.changelog(low=prefix), prefix)

    def search_vector(self, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
        """(key, value, score) of the k nearest live vectors, exact."""
        return top_k(self.live(), query, k, metric).select("key", "value", "score")

    def batch_search(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        return batch_top_k(self.live(), queries, k, metric)

    # Maintenance

    def _replace(self, old: list[Segment], rows: DataFrame, level: int) -> None:
        """Puts one segment in the place of others. Writers may append meanwhile: as long as the old segments are
        still listed, the newest manifest takes the change."""
        new = self._write(ordered_run(rows), level)
        gone = {s.id for s in old}
        while True:
            try:
                return self._publish(self._changed(segments=[*[s for s in self.manifest.segments if s.id not in gone], *([new] if new else [])]))
            except Conflict:
                if not gone <= {s.id for s in self.refresh().manifest.segments}:
                    if new:
                        self._segments.remove(new.id)
                    raise

    def flush(self) -> bool:
        """Level-0 batches become one sorted segment with all versions; False if there are none."""
        tail = [s for s in self.manifest.segments if s.level == 0]
        if tail:
            self._replace(tail, self._read(tail), 1)
        return bool(tail)

    def compact(self, full: bool = True, low_water: int | None = None) -> bool:
        """Newest versions of all segments, or of the level-0 ones only. Tombstones are dropped only by a full
        compaction, and with low_water only up to it: a writer that is late beyond it could bring a key back."""
        old = list(self.manifest.segments) if full else [s for s in self.manifest.segments if s.level == 0]
        if not old:
            return False
        covers_older = full or all(s.level == 0 for s in self.manifest.segments)
        self._replace(old, compacted(self._read(old), covers_older, low_water), 2 if full else 1)
        if full and low_water is not None:
            self._publish(self._changed(low_water=max(self.manifest.low_water, low_water)))
        return True

    def compact_if_needed(self) -> bool:
        """The caller's scheduler decides when; this decides whether."""
        return sum(s.level == 0 for s in self.manifest.segments) >= COMPACT_FROM and self.compact(full=False)

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> list[str]:
        """Deletes segments that the newest manifest does not list, and older manifests, past an age that
        running readers and writers need."""
        keep = {s.id for s in self.manifest.segments}
        together = {n.split("/")[0] for n in keep if "/" in n}
        found = [n for name in self._segments.names() for n in ([f"{name}/{k}" for k in Folder(self.spark, f"{self.path}/segments/{name}").names() if "=" in k] if name in together else [name])]
        gone = [n for n in found if n not in keep and self._segments.age_seconds(n) >= older_than_seconds]
        for n in gone:
            self._segments.remove(n)
        for n in self._manifests.names():
            if n not in {f"{v:020d}.json" for v in (self.manifest.version, self.manifest.base)} and self._manifests.age_seconds(n) >= older_than_seconds:
                self._manifests.remove(n)
        return gone

    def statistics(self) -> dict[str, int]:
        rows = [asdict(s) for s in self.manifest.segments]
        return reduce(lambda acc, s: {**acc, "rows": acc["rows"] + s["rows"], "tombstones": acc["tombstones"] + s["tombstones"]}, rows, {"segments": len(rows), "rows": 0, "tombstones": 0})
