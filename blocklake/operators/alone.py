"""Legacy .lzma values: one stream without blocks, index or check."""

from __future__ import annotations

import lzma

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklake.errors import XzDataError, XzFormatError, XzLimitError
from blocklake.functions import sizes

UNKNOWN = 2**64 - 1


def lzma_compress(column: Column, preset: int = 6) -> Column:
    """A value as .lzma with its size in the header; the dictionary is a power of two. Null stays null.

    The library ends its data with a marker, which readers that know the size leave unread.
    """

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            size = 1 << (min(max(len(v), 4096), sizes.PRESETS[preset][1] * 1024) - 1).bit_length()
            filters = [{"id": lzma.FILTER_LZMA1, "preset": preset, "dict_size": size}]
            whole = lzma.compress(v, lzma.FORMAT_ALONE, filters=filters)
            return whole[:5] + len(v).to_bytes(8, "little") + whole[13:]

        return values.map(one)

    return run(column.cast("binary"))


def _decode(v: bytes, limit: int | None) -> bytes:
    if len(v) < 13:
        raise XzDataError("header cut off")
    if v[0] >= 225:
        raise XzFormatError("property byte")
    declared = int.from_bytes(v[5:13], "little")
    if declared != UNKNOWN and limit is not None and declared > limit:
        raise XzLimitError(f"{declared} bytes, {limit} allowed")
    most = declared if declared != UNKNOWN else -1 if limit is None else limit + 1
    if most == 0:
        return b""
    # with an unknown size in its place the library accepts data with and without a marker
    reader = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    try:
        out = reader.decompress(v[:5] + b"\xff" * 8 + v[13:], most)
    except lzma.LZMAError as e:
        raise XzDataError(str(e)) from None
    if declared == UNKNOWN and limit is not None and len(out) > limit:
        raise XzLimitError(f"over {limit} bytes")
    if len(out) < declared and (declared != UNKNOWN or not reader.eof):
        raise XzDataError("data cut off")
    return out


def lzma_decompress(column: Column, limit: int | None = None) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _decode(v, limit))

    return run(column)


def lzma_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """df with lc, lp, pb, dict_size and declared_size (null if unknown) of each .lzma value, by expressions alone."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(content), i, 1)), 16, 10).cast("long")
    props = byte(1)
    dictionary = sum((byte(2 + i) * 256**i for i in range(1, 4)), byte(2))
    size = sum((byte(6 + i).cast("decimal(20,0)") * F.lit(256**i).cast("decimal(20,0)") for i in range(1, 8)), byte(6).cast("decimal(20,0)")).cast("decimal(20,0)")
    unknown = F.hex(F.substring(F.col(content), 6, 8)) == "F" * 16
    return df.withColumns({"lc": (props % 9).cast("int"), "lp": (F.floor(props / 9) % 5).cast("int"), "pb": F.floor(props / 45).cast("int"), "dict_size": dictionary, "declared_size": F.when(~unknown, size)})
