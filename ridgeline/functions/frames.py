"""Log frames: the size of a record, its encoding, and replay of the longest valid prefix.

Fixed values of the format, all big-endian: a header of CRC-32 of the payload and its size (4 bytes each), then
the payload: op (1 byte), lengths of key, value and pointer (4 bytes each), key, value, pointer. A pointer is
file (8), offset (8) and dimension (4). A payload is at most 100 MiB.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER, FIXED, POINTER = struct.Struct(">II"), struct.Struct(">bIII"), struct.Struct(">qqi")
MOST = 100 << 20


def frame_bytes(key: Column, value: Column, has_vector: Column) -> Column:
    """Size of a record's frame."""
    return F.octet_length(key) + F.octet_length(value) + HEADER.size + FIXED.size + F.when(has_vector, POINTER.size).otherwise(0)


def big_endian(number: Column, width: int) -> Column:
    """A number that is not negative as `width` bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def frame(op: Column, key: Column, value: Column, pointer: Column | None = None) -> Column:
    """A record's frame, made by built-in expressions; a null pointer is none."""
    key, value = key.cast("binary"), value.cast("binary")
    to = F.lit(b"") if pointer is None else F.coalesce(pointer, F.lit(b""))
    payload = F.concat(big_endian(op, 1), *[big_endian(F.octet_length(x), 4) for x in (key, value, to)], key, value, to)
    return F.concat(big_endian(F.crc32(payload), 4), big_endian(F.octet_length(payload), 4), payload)


def encode(op: int, key: bytes, value: bytes, pointer: bytes = b"") -> bytes:
    payload = FIXED.pack(op, len(key), len(value), len(pointer)) + key + value + pointer
    return HEADER.pack(zlib.crc32(payload), len(payload)) + payload


def replay(stream: BinaryIO) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(end offset, op, key, value, pointer) of each frame of the longest valid prefix, one frame in memory.

    Replay stops at the first frame with a short header, an impossible size, a missing tail, a wrong checksum or
    lengths that do not add up; what follows is never trusted.
    """
    at = 0
    while len(head := stream.read(HEADER.size)) == HEADER.size:
        crc, size = HEADER.unpack(head)
        if not FIXED.size <= size <= MOST:
            return
        payload = stream.read(size)
        if len(payload) < size or zlib.crc32(payload) != crc:
            return
        op, k, v, p = FIXED.unpack_from(payload)
        if FIXED.size + k + v + p != size:
            return
        at += HEADER.size + size
        a = FIXED.size
        yield at, op, payload[a : a + k], payload[a + k : a + k + v], payload[a + k + v :]


def decode(data: bytes) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    return replay(io.BytesIO(data))


def valid_length(data: bytes | BinaryIO) -> int:
    """Where a torn log has to be cut."""
    end = 0
    for end, *_ in replay(io.BytesIO(data) if isinstance(data, bytes) else data):
        pass
    return end
