"""CRC32, CRC64 and SHA-256 of binary columns."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reflected polynomial of CRC-64/XZ.
POLYNOMIAL = 0xC96C5795D7870F42
ONES = np.uint64(2**64 - 1)
#: Bytes of a lane: values are cut into lanes that are summed side by side. Bytes of the values that are at hand at once.
LANE, PART = 256, 4 << 20


def crc32(data: Column) -> Column:
    return F.crc32(data)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


@functools.cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        t = np.where(t & np.uint64(1), t >> np.uint64(1) ^ np.uint64(POLYNOMIAL), t >> np.uint64(1))
    return t


@functools.cache
def _wide_table() -> np.ndarray:
    """What two bytes at once do to a sum."""
    t = np.arange(1 << 16, dtype=np.uint64)
    for _ in range(2):
        t = _table()[(t & np.uint64(255)).astype(np.uint8)] ^ t >> np.uint64(8)
    return t


@functools.lru_cache(64)
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a sum, by each of its 8 bytes: 8 tables of 256."""
    byte = np.arange(256, dtype=np.uint64)
    each = np.stack([byte << np.uint64(8 * i) for i in range(8)])
    if power == 0:
        return _table()[(each & np.uint64(255)).astype(np.uint8)] ^ each >> np.uint64(8)
    return _after(_after(each, power - 1), power - 1)


def _after(sums: np.ndarray, power: int) -> np.ndarray:
    """Sums with 2**power zero bytes after what they stand for."""
    tables = _zeros(power)
    out = tables[0][(sums & np.uint64(255)).astype(np.uint8)]
    for i in range(1, 8):
        out = out ^ tables[i][(sums >> np.uint64(8 * i) & np.uint64(255)).astype(np.uint8)]
    return out


def _after_lengths(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sum with its own number of zero bytes after it."""
    out = sums.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        which = lengths >> power & 1 == 1
        out[which] = _after(out[which], power)
    return out


def combine(first: int, second: int, length: int) -> int:
    """The CRC64 of two parts from that of each; length is the second's."""
    return int(_after_lengths(np.array([first], np.uint64), np.array([length], np.int64))[0]) ^ second


def _plain_sums(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums without a start value of values that lie one after the other in data: zeros before a value change nothing, so all are filled up to whole lanes."""
    lanes = -(-lengths // LANE)
    filled = np.zeros(int(lanes.sum()) * LANE, np.uint8)
    shift = np.repeat(np.cumsum(lanes * LANE) - np.cumsum(lengths), lengths)
    filled[np.arange(len(data)) + shift] = data
    sums = np.zeros(len(filled) // LANE, np.uint64)
    low, table = sums.view("<u2")[::4], _wide_table()  # the lowest two bytes of each sum
    for column in np.ascontiguousarray(filled.view("<u2").reshape(-1, LANE // 2).T):
        sums[:] = table[low ^ column] ^ sums >> np.uint64(16)
    power = LANE.bit_length() - 1
    while lanes.max(initial=0) > 1:  # neighbours join, from the right; an odd one out meets zeros
        odd = lanes % 2 == 1
        sums = np.insert(sums, (np.cumsum(lanes) - lanes)[odd], 0)
        sums = _after(sums[::2], power) ^ sums[1::2]
        lanes, power = (lanes + 1) // 2, power + 1
    out = np.zeros(len(lengths), np.uint64)
    out[lanes == 1] = sums
    return out


def crc64_many(values: list[bytes]) -> np.ndarray:
    """The CRC64 of each of many values, all at once."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    plain, at = np.zeros(len(values), np.uint64), 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), PART, "right")) + at)
        plain[at:stop] = _plain_sums(np.frombuffer(b"".join(values[at:stop]), np.uint8), lengths[at:stop])
        at = stop
    return plain ^ _after_lengths(np.full(len(values), ONES), lengths) ^ ONES


def crc64_of(data: bytes, crc: int = 0) -> int:
    """CRC64 of bytes that follow others with the given sum."""
    return combine(crc, int(crc64_many([data])[0]), len(data))


def check_of(data: bytes, check: int) -> bytes:
    """A block's check by its id in the format."""
    if check == 10:
        return hashlib.sha256(data).digest()
    return {0: lambda: b"", 1: lambda: zlib.crc32(data).to_bytes(4, "little"), 4: lambda: crc64_of(data).to_bytes(8, "little")}[check]()


def crc64(data: Column) -> Column:
    """CRC64 as 16 hex digits; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        sums = crc64_many([b"" if v is None else bytes(v) for v in values])
        return pd.Series([None if v is None else f"{s:016x}" for v, s in zip(values, sums.tolist(), strict=True)], dtype=object)

    return run(data)
