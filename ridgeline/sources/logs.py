"""Import and export of framed logs, sorted tables and vector files.

Executors read and write the files themselves, through Arrow's file systems (local or mounted paths, HDFS, S3, GCS);
the driver lists names and publishes what finished tasks have written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import tables
from ridgeline.functions.frames import POINTER, encode, replay, valid_length
from ridgeline.schema import COLUMNS, DELETE
from ridgeline.sources.files import Folder

RECORD = "file string, number long, op byte, key binary, value binary, pointer binary"
#: Bytes of a log file, or a vector file's stretch that one task reads.
FILE_BYTES = 64 << 20


def _place(uri: str):
    """(file system, path) for Arrow from a path as Hadoop writes it."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", uri):
        uri = uri.removeprefix("file:")
    elif uri.startswith("file:///"):
        uri = uri.removeprefix("file://")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _listed(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, str]]:
    """(name, full path) of the files in a folder, in name order."""
    folder = Folder(spark, path)
    return [(n, folder.full(n)) for n in folder.names() if re.fullmatch(pattern, n)]


def _files(spark: SparkSession, listed: list[tuple]) -> DataFrame:
    """(place, path), one file per task; the table has one row per file."""
    rows = spark.createDataFrame([(k, p) for k, (_, p) in enumerate(listed)], "place long, path string")
    return rows.repartitionByRange(max(1, len(listed)), "place")


def _records(read: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of read(file, size), some thousands at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for place, path in zip(df["place"], df["path"]):
                fs, at = _place(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for number, (op, key, value, pointer) in enumerate(read(file, file.size())):
                        rows.append((path, (int(place) << 32) + number, op, key, value, pointer or None))
                        held += len(key) + len(value)
                        if len(rows) >= 10_000 or held > 8 << 20:
                            yield pd.DataFrame(rows, columns=["file", "number", "op", "key", "value", "pointer"])
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "number", "op", "key", "value", "pointer"])

    return run


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, op, key, value, pointer) of every frame of the valid prefix of each log file under path.

    Files replay in name order: seq is the file's place and the frame's number. One file is one task, read frame by frame.
    """
    frames = _records(lambda file, size: (x[1:] for x in replay(file)))
    return _files(spark, _listed(spark, path, r".*\.log")).mapInPandas(frames, RECORD).withColumnRenamed("number", "seq")


def _oldest_first(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    def age(named: tuple[str, str]) -> tuple[int, int]:
        level, number = re.findall(r"\d+", named[0])
        return -int(level), int(number)

    return sorted(_listed(spark, path, r"L\d+-\d+\.sst"), key=age)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, op, key, value, pointer) of every entry of the sorted tables L<level>-<number>.sst under path.

    A larger number is newer and a lower level is newer than a higher one: seq rises in that order. A file without
    its closing mark is an unfinished one and raises an error.
    """
    def read(file, size):
        table = tables.open_table(file, size)
        return tables.entries(file, 0, table.filter_at)

    return _files(spark, _oldest_first(spark, path)).mapInPandas(_records(read), RECORD).withColumnRenamed("number", "seq")


def repair_log(spark: SparkSession, path: str) -> dict[str, int]:
    """Cuts every log file under path to its longest valid prefix, so that later appends are replayed; the new length
    of each file that was cut. Executors copy the prefix, the driver renames it over the file."""
    listed = _listed(spark, path, r".*\.log")
    mark = uuid.uuid4().hex

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for place, full in zip(df["place"], df["path"]):
                fs, at = _place(full)
                with fs.open_input_file(at) as file:
                    end, size = valid_length(file), file.size()
                    if end < size:
                        file.seek(0)
                        with fs.open_output_stream(f"{at.rsplit('/', 1)[0]}/_{mark}-{place}.tmp") as out:
                            left = end
                            while left:
                                part = file.read(min(left, 8 << 20))
                                out.write(part)
                                left -= len(part)
                yield pd.DataFrame({"place": [place], "end": [end], "size": [size]})

    folder, done = Folder(spark, path), {}
    for r in _files(spark, listed).mapInPandas(cut, "place long, end long, size long").toLocalIterator():
        if r["end"] < r["size"]:
            name = listed[r["place"]][0]
            folder.replace(f"_{mark}-{r['place']}.tmp", name)
            done[name] = r["end"]
    return done


def _number(pointer: Column, at: int, width: int) -> Column:
    """Big-endian bytes of a pointer; null if it is no legal place."""
    return F.conv(F.hex(F.substring(pointer, at, width)), 16, 10).try_cast("decimal(20,0)").try_cast("long")


def vectors_of(pointers: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """pointers (…, pointer) with vec, read from files vlog-<n>.data under path (big-endian floats).

    A pointer to a missing file or past its end gives a null vec. Pointers are dealt by stretches of a file and
    sorted by offset, so that files of any size are read in order, a vector at a time.
    """
    listed = [(int(re.search(r"\d+", n)[0]), p) for n, p in _listed(spark, path, r"vlog-\d+\.data")]
    blobs = spark.createDataFrame(listed, "blob long, vlog_path string")
    asked = pointers.withColumns({"blob": F.when(F.octet_length("pointer") == POINTER.size, _number(F.col("pointer"), 1, 8)), "vlog_offset": _number(F.col("pointer"), 9, 8), "vlog_dim": _number(F.col("pointer"), 17, 4)})
    found = asked.join(F.broadcast(blobs) if len(listed) <= 100_000 else blobs, "blob", "left")
    stretch = F.floor(F.col("vlog_offset") / FILE_BYTES)
    dealt = found.repartition("blob", stretch, F.when(F.col("blob").isNull(), F.xxhash64(*pointers.columns))).sortWithinPartitions("blob", "vlog_offset")

    @F.pandas_udf("array<float>")
    def floats(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        name, file = None, None
        for paths, offsets, dims in batches:
            out = []
            for p, offset, dim in zip(paths, offsets, dims):
                if p is None or offset != offset or dim != dim or offset is None or dim is None:
                    out.append(None)
                    continue
                if p != name:
                    if file is not None:
                        file.close()
                    fs, at = _place(p)
                    name, file = p, fs.open_input_file(at)
                offset, dim = int(offset), int(dim)
                if offset < 0 or offset + 4 * dim > file.size():
                    out.append(None)
                    continue
                file.seek(offset)
                out.append(np.frombuffer(file.read(4 * dim), ">f4").astype(np.float32))
            yield pd.Series(out, dtype=object)
        if file is not None:
            file.close()

    return dealt.withColumn("vec", floats("vlog_path", "vlog_offset", "vlog_dim")).drop("blob", "vlog_path", "vlog_offset", "vlog_dim")


def changes_of(records: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Change-log rows of records from read_log or read_tables; vectors come from the vector files under path."""
    return vectors_of(records, spark, path).select(*COLUMNS)


# Export


class _Vectors:
    """A task's vector file, opened with its first vector."""

    def __init__(self, fs, path: str, number: int):
        self.fs, self.path, self.number, self.at, self.out = fs, path, number, 0, None

    def pointer(self, vec) -> bytes:
        if vec is None:
            return b""
        if self.out is None:
            self.out = self.fs.open_output_stream(self.path)
        data = np.asarray(vec, ">f4").tobytes()
        self.out.write(data)
        self.at += len(data)
        return POINTER.pack(self.number, self.at - len(data), len(data) // 4)

    def close(self) -> bool:
        if self.out is not None:
            self.out.close()
        return self.out is not None


def _exported(rows: DataFrame, path: str, task: Callable) -> int:
    """Runs task(frames, fs, folder, mark, number) -> (temporary name, name), and publishes what it names.

    A task that is run again writes other temporary files; only those of the run that counts get their names, and
    no file is ever replaced. The number of files.
    """
    spark = rows.sparkSession
    folder = Folder(spark, path)
    folder.make()
    if any(re.fullmatch(r".*\.(log|sst)|vlog-\d+\.data", n) for n in folder.names()):
        raise FileExistsError(f"{path} has such files already")
    target, mark = folder.full(""), f"_{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = _place(target)
        for pair in task(frames, fs, at, f"{mark}-{context.partitionId()}-{context.taskAttemptId()}", context.partitionId()):
            yield pd.DataFrame([pair], columns=["temporary", "name"])

    files = 0
    for r in rows.mapInPandas(run, "temporary string, name string").toLocalIterator():  # names only
        if not folder.publish(r["temporary"], r["name"]):
            raise FileExistsError(r["name"])
        files += 1
    for n in folder.names():
        if n.startswith(mark):  # of tasks that were run again
            folder.remove(n)
    return files


def write_log(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> int:
    """Change-log rows (seq, op, key, value[, vec]) as log files that replay in the same order, and their vectors as
    vector files. The folder must not have such files. Rows are dealt by ranges of (seq, key), so that a great many
    rows of one seq are shared out; a task writes files of about file_bytes."""
    vec = F.col("vec") if "vec" in rows.columns else F.lit(None).cast("array<float>")
    dealt = rows.select("seq", "op", "key", "value", vec.alias("vec")).repartitionByRange("seq", "key").sortWithinPartitions("seq", "key")

    def task(frames, fs, folder, mark, number):
        vectors, out, size, count = _Vectors(fs, f"{folder}/{mark}-v.tmp", number), None, 0, 0
        names = []
        for df in frames:
            for op, k, v, x in zip(df["op"], df["key"], df["value"], df["vec"]):
                if out is None:
                    names.append((f"{mark}-{count}.tmp", f"wal_{number:06d}_{count:06d}.log"))
                    out, size, count = fs.open_output_stream(f"{folder}/{names[-1][0]}"), 0, count + 1
                data = encode(int(op), bytes(k), bytes(v), vectors.pointer(x))
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if vectors.close():
            yield f"{mark}-v.tmp", f"vlog-{number}.data"
        yield from names

    return _exported(dealt, path, task)


def write_tables(rows: DataFrame, path: str, level: int = 0) -> int:
    """Rows (op, key, value[, vec]) with one version per key as sorted tables, and their vectors as vector files: one
    table per range of keys."""
    vec = F.col("vec") if "vec" in rows.columns else F.lit(None).cast("array<float>")
    dealt = rows.select("op", "key", "value", vec.alias("vec")).repartitionByRange("key").sortWithinPartitions("key")

    def task(frames, fs, folder, mark, number):
        vectors = _Vectors(fs, f"{folder}/{mark}-v.tmp", number)
        every = ((int(op), bytes(k), bytes(v), vectors.pointer(x)) for df in frames for op, k, v, x in zip(df["op"], df["key"], df["value"], df["vec"]))
        with fs.open_output_stream(f"{folder}/{mark}.tmp") as out:
            n = tables.write(out, every)
        if vectors.close():
            yield f"{mark}-v.tmp", f"vlog-{number}.data"
        if n:
            yield f"{mark}.tmp", f"L{level}-{number + 1:06d}.sst"

    return _exported(dealt, path, task)


def find_in_tables(spark: SparkSession, path: str, key: bytes | str) -> DataFrame:
    """(op, value, pointer) of a key in the sorted tables under path: the newest answer, or no row if the newest is
    a tombstone. Each file is asked by bounds, filter, index and one block."""
    wanted = key.encode() if isinstance(key, str) else bytes(key)
    def read(file, size):
        found = tables.find(file, tables.open_table(file, size), wanted)
        return [] if found is None else [found]

    hits = _files(spark, _oldest_first(spark, path)).mapInPandas(_records(read), RECORD)
    return hits.orderBy(F.desc("number")).limit(1).where(F.col("op") != DELETE).select("op", "value", "pointer")


__all__ = ["changes_of", "find_in_tables", "read_log", "read_tables", "repair_log", "vectors_of", "write_log", "write_tables"]
