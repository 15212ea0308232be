"""Byte filters: delta, and branch converters of executable code."""

from __future__ import annotations

import lzma

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from blocklake.errors import XzDataError
from blocklake.functions.arm64 import arm64
from blocklake.operators.blocks import RAW_IDS, by_value


def delta_column(data: Column, distance: int = 1) -> Column:
    """Every byte of a value minus the byte `distance` before it (0 before the first), by expressions over its own bytes. Null stays null."""
    n = F.octet_length(data)

    def coded(codes: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(0), distance), codes), F.lit(1), n)
        return F.zip_with(codes, before, lambda x, y: F.char(x - y + 256))  # char takes a number's lowest 8 bits

    codes = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), F.ascii)  # there a byte is a character, and each is found once
    whole = F.get(F.transform(F.array(codes), lambda x: F.encode(F.array_join(coded(x), ""), "ISO-8859-1")), 0)
    return F.when(n > 0, whole).otherwise(data)


def machine_code(words: int = 2048) -> bytes:
    """Code by rule to try the branch converters on: IA-64 bundles, then 4-byte words with branches and page addresses of the other machines."""
    out = bytearray()
    for i in range(words // 8):
        branch = 5 << 37 | (i * 40503 & 0xFFFFF) << 13 | i & 0x1C0
        out += (0x10 | branch << 87).to_bytes(16, "little")
    for i in range(words):
        w = (i * 2654435761 + 12345) & 0xFFFFFFFF
        made = {
            0: b"\xe8" + (w & 0xFFFFFF).to_bytes(3, "little"), 1: bytes((w & 0xFF if w & 1 else 0, 0, 0, 0)), 2: (0x48000001 | w & 0x03FFFFFC).to_bytes(4, "big"), 3: (w & 0xFFFFFF).to_bytes(3, "little") + b"\xeb",
            4: (0xF000 | w & 0x7FF).to_bytes(2, "little") + (0xF800 | w >> 11 & 0x7FF).to_bytes(2, "little"), 5: (0x40000000 | w & 0x3FFFFF).to_bytes(4, "big"),
            6: (0x94000000 | w & 0x3FFFFFF).to_bytes(4, "little"), 7: (0x90000000 | w & 0x60000000 | (w & 0x7FF) << 5 | w & 31).to_bytes(4, "little"),
        }
        out += made.get(i % 9, w.to_bytes(4, "little"))
    return bytes(out)


def _delta(data: bytes, distance: int, encode: bool) -> bytes:
    body = np.frombuffer(data, np.uint8)
    if encode:
        out = body.copy()
        out[distance:] -= body[:-distance] if len(body) > distance else body[:0]
        return out.tobytes()
    padded = np.concatenate([body, np.zeros(-len(body) % distance, np.uint8)]).reshape(-1, distance)
    return np.cumsum(padded, axis=0, dtype=np.uint8).reshape(-1)[: len(body)].tobytes()


def _branch(data: bytes, name: str, start: int, encode: bool) -> bytes:
    """A converter of the standard library; it has them only before a compressor, whose work is undone at once."""
    own = {"id": RAW_IDS[name], "start_offset": start}
    plain = [{"id": lzma.FILTER_LZMA2, "preset": 0}]
    if encode:
        return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=[own, *plain]), lzma.FORMAT_RAW, filters=plain)
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=plain), lzma.FORMAT_RAW, filters=[own, *plain])


def byte_filter(column: Column, name: str, encode: bool = True, distance: int = 1, start: int = 0) -> Column:
    """A filter over each whole value: delta, arm64 or one of x86, powerpc, ia64, arm, armthumb, sparc. Null stays null."""
    if name not in ("delta", "arm64", *RAW_IDS):
        raise ValueError(f"no filter {name}")
    if name == "delta" and not 1 <= distance <= 256:
        raise XzDataError("delta distance is 1 to 256")

    def one(v):
        if v is None:
            return None
        if name == "delta":
            return _delta(v, distance, encode)
        return arm64(v, start, encode) if name == "arm64" else _branch(v, name, start, encode)

    return by_value(one)(column)
