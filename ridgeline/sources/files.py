"""Small files of a store through Hadoop's file systems, so that a store can be wherever Spark can write."""

from __future__ import annotations

import os
import uuid
from functools import cached_property
from pathlib import Path

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name) if name else self.path

    def names(self) -> list[str]:
        if not self.fs.exists(self.path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path))

    def full(self, name: str) -> str:
        """The whole path with its file system."""
        return self.fs.makeQualified(self._at(name)).toString()

    def make(self) -> None:
        self.fs.mkdirs(self.path)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()

    def _rename(self, old: str, new: str, replace: bool) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind, int(replace))
        if replace:
            self.jvm.java.lang.reflect.Array.set(options, 0, next(x for x in kind.getEnumConstants() if x.name() == "OVERWRITE"))
        context.rename(self.fs.makeQualified(self._at(old)), self.fs.makeQualified(self._at(new)), options)

    def replace(self, temporary: str, name: str) -> None:
        """Renames over name, at once where the file system's rename is atomic. A local checksum of the old file goes."""
        checksum = self._at(f".{name}.crc")
        if self.fs.exists(checksum):
            self.fs.delete(checksum, False)
        self._rename(temporary, name, True)

    def publish(self, temporary: str, name: str) -> bool:
        """Renames without replacing; False if name exists. Atomic where the file system's rename is."""
        if self.fs.exists(self._at(name)):
            return False
        try:
            self._rename(temporary, name, False)
        except Exception:
            if self.fs.exists(self._at(name)):
                return False
            raise
        return True

    @cached_property
    def _local(self) -> Path | None:
        """The folder, if it is on this machine."""
        whole = self.fs.makeQualified(self.path).toUri()
        return Path(whole.getPath()) if whole.getScheme() == "file" else None

    def _link(self, name: str, data: bytes) -> bool | None:
        """add() for a local folder by a hard link, which is atomic and never replaces; None where there are no links."""
        temporary = self._local / f"_{uuid.uuid4().hex}.tmp"
        try:
            self._local.mkdir(parents=True, exist_ok=True)
            with temporary.open("xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.link(temporary, self._local / name)
            return True
        except FileExistsError:
            return False
        except OSError:
            return None
        finally:
            temporary.unlink(missing_ok=True)

    def add(self, name: str, data: bytes) -> bool:
        """A new file that is seen whole or not at all; False if name exists. Hadoop's local file system starts several
        processes for one rename, so local folders do without it."""
        added = self._link(name, data) if self._local else None
        if added is None:
            temporary = f"_{uuid.uuid4().hex}.tmp"
            self.write(temporary, data)
            added = self.publish(temporary, name)
            if not added:
                self.remove(temporary)
        return added

    def remove(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)

    def age_seconds(self, name: str) -> float:
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self._at(name)).getModificationTime()) / 1000
