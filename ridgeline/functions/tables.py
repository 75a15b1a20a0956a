"""Sorted table files: entries, bloom filter, sparse index and footer.

Fixed values of the format, all big-endian. A file is data, filter, index, smallest key, largest key, footer.
Entry: op (1 byte), lengths of key, value and pointer (4 bytes each), then these; keys ascend as unsigned bytes.
Blocks of at most 4096 bytes follow each other without padding. Filter: bits (4), hashes (4), the bits as bytes, lowest
first, without trailing zero bytes. Hash k of a key is the polynomial in 31 over its signed bytes that starts from k, in
32 bits; its low 31 bits modulo the bits are the place. Index, per block: length of the largest key (4), the key, 8 (4),
offset (8). Each of the two keys: length (4), key. Footer: offsets of filter, index, smallest and largest key, the mark.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

ENTRY, FOOTER, INT, LONG = struct.Struct(">bIII"), struct.Struct(">qqqqq"), struct.Struct(">I"), struct.Struct(">q")
MARK = 0x436172696E614442
BLOCK = 4096
FALSE_POSITIVES = 0.01


# Bloom filter


def _start(key: bytes) -> tuple[int, int]:
    """The polynomial from 0, and what a start value is multiplied by: all hashes of a key follow from these."""
    total, power = 0, 1
    for b in key:
        total = (total * 31 + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
        power = power * 31 & 0xFFFFFFFF
    return total, power


def places(key: bytes, bits: int, hashes: int) -> list[int]:
    total, power = _start(key)
    return [((total + k * power) & 0x7FFFFFFF) % bits for k in range(hashes)]


@dataclass
class Bloom:
    bits: int
    hashes: int
    data: bytearray

    @staticmethod
    def sized(keys: int, rate: float = FALSE_POSITIVES) -> Bloom:
        keys = max(keys, 1)
        bits = max(1, int(-keys * math.log(rate) / math.log(2) ** 2))
        return Bloom(bits, max(1, round(bits / keys * math.log(2))), bytearray(-(-bits // 8)))

    def add(self, key: bytes) -> None:
        for at in places(key, self.bits, self.hashes):
            self.data[at >> 3] |= 1 << (at & 7)

    def may_contain(self, key: bytes) -> bool:
        return all(at >> 3 < len(self.data) and self.data[at >> 3] >> (at & 7) & 1 for at in places(key, self.bits, self.hashes))

    def pack(self) -> bytes:
        return INT.pack(self.bits) + INT.pack(self.hashes) + bytes(self.data).rstrip(b"\0")

    @staticmethod
    def unpack(data: bytes) -> Bloom:
        return Bloom(INT.unpack_from(data)[0], INT.unpack_from(data, 4)[0], bytearray(data[8:]))


# Writing


def write(out: BinaryIO, entries: Iterable[tuple[int, bytes, bytes, bytes]]) -> int:
    """Writes (op, key, value, pointer) in ascending order of keys and returns their number. An entry larger than a
    block is a block of its own. What is held is one block, the index and the keys."""
    index: list[tuple[bytes, int]] = []
    keys: list[bytes] = []
    block, at = bytearray(), 0

    def flush() -> None:
        nonlocal at
        if block:
            index.append((keys[-1], at))
            out.write(bytes(block))
            at += len(block)
            block.clear()

    for op, key, value, pointer in entries:
        entry = ENTRY.pack(op, len(key), len(value), len(pointer)) + key + value + pointer
        if keys and key < keys[-1]:
            raise ValueError("keys must ascend")
        if len(block) + len(entry) > BLOCK:
            flush()
        keys.append(key)
        block += entry
    flush()
    if not keys:
        return 0
    bloom = Bloom.sized(len(keys))
    for key in keys:
        bloom.add(key)
    ends = [at]
    for part in (bloom.pack(), b"".join(INT.pack(len(k)) + k + INT.pack(8) + LONG.pack(x) for k, x in index), INT.pack(len(keys[0])) + keys[0]):
        out.write(part)
        ends.append(ends[-1] + len(part))
    out.write(INT.pack(len(keys[-1])) + keys[-1] + FOOTER.pack(*ends, MARK))
    return len(keys)


# Reading


@dataclass
class Table:
    """A file's directory: read once, so that a lookup reads one block."""

    size: int
    filter_at: int
    index_at: int
    low: bytes
    high: bytes
    last_keys: list[bytes]
    offsets: list[int]
    bloom: Bloom


def open_table(file: BinaryIO, size: int) -> Table:
    """Raises ValueError for what is not a finished table."""

    def part(a: int, b: int) -> bytes:
        file.seek(a)
        return file.read(b - a)

    if size < FOOTER.size:
        raise ValueError("too short for a table")
    end = size - FOOTER.size
    filter_at, index_at, low_at, high_at, mark = FOOTER.unpack(part(end, size))
    if mark != MARK:
        raise ValueError("the mark of a table is missing")
    if not 0 <= filter_at <= index_at <= low_at <= high_at <= end:
        raise ValueError("offsets of a table do not ascend")
    index, keys, offsets, at = part(index_at, low_at), [], [], 0
    while at < len(index):
        n = INT.unpack_from(index, at)[0]
        keys.append(index[at + 4 : at + 4 + n])
        offsets.append(LONG.unpack_from(index, at + 8 + n)[0])
        at += 16 + n
    return Table(size, filter_at, index_at, part(low_at, high_at)[4:], part(high_at, end)[4:], keys, offsets, Bloom.unpack(part(filter_at, index_at)))


def entries(file: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(op, key, value, pointer) of the data between two offsets, one entry in memory."""
    file.seek(start)
    while start < stop:
        head = file.read(ENTRY.size)
        if len(head) < ENTRY.size:
            raise ValueError("an entry ends early")
        op, k, v, p = ENTRY.unpack(head)
        body = file.read(k + v + p)
        if len(body) < k + v + p:
            raise ValueError("an entry ends early")
        start += ENTRY.size + k + v + p
        yield op, body[:k], body[k : k + v], body[k + v :]


def find(file: BinaryIO, table: Table, key: bytes) -> tuple[int, bytes, bytes, bytes] | None:
    """The newest entry of a key: bounds, filter, index, then one block. A tombstone is an answer."""
    if not table.low <= key <= table.high or not table.bloom.may_contain(key):
        return None
    block = bisect_left(table.last_keys, key)  # the first block whose last key is not below
    if block == len(table.offsets):
        return None
    stop = table.offsets[block + 1] if block + 1 < len(table.offsets) else table.filter_at
    return next((e for e in entries(file, table.offsets[block], stop) if e[1] == key), None)
