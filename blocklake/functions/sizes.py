"""Arithmetic of the formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encoder presets: dictionary KiB, search depth (normal, extreme), longest match tried, nice length, finder and parser.
PRESETS = (
    (0, 64, 8, 32, 128, 2, "hc4", "greedy"),
    (1, 1024, 8, 32, 128, 2, "hc4", "greedy"),
    (2, 2048, 16, 64, 273, 2, "hc4", "greedy"),
    (3, 4096, 16, 64, 273, 32, "hc4", "lazy"),
    (4, 4096, 32, 128, 273, 32, "hc4", "lazy"),
    (5, 8192, 32, 128, 273, 32, "hc4", "lazy"),
    (6, 8192, 64, 256, 273, 64, "hc4", "lazy"),
    (7, 16384, 64, 256, 273, 64, "bt4", "optimal"),
    (8, 32768, 128, 512, 273, 64, "bt4", "optimal"),
    (9, 65536, 128, 512, 273, 64, "bt4", "optimal"),
)


def max_compressed_size(n: Column) -> Column:
    """An upper bound of the compressed size; null for a negative size."""
    return F.when(n >= 0, n + F.floor(n / 64) + 128)


def check_bytes(check: Column) -> Column:
    """Size of a check by its id; null outside 0 to 15."""
    return F.when(check == 0, 0).when((check >= 1) & (check <= 15), (4 * F.pow(F.lit(2), F.floor((check - 1) / 3))).cast("int"))


def dict_bytes(code: Column) -> Column:
    """Dictionary size of a property byte; null above 40."""
    doubled = (2 + code % 2) * F.pow(F.lit(2), F.floor(code / 2) + 11)
    return F.when(code == 40, F.lit(2**32 - 1)).when(code.between(0, 39), doubled).cast("long")


def dict_code(size: Column) -> Column:
    """The least property byte whose dictionary holds a size."""
    codes = F.array(*[F.lit((2 | c & 1) << c // 2 + 11) for c in range(40)])
    return F.when(size > (3 << 30), 40).otherwise(F.size(F.filter(codes, lambda d: d < size)))


def props_byte(lc: Column, lp: Column, pb: Column) -> Column:
    return lc + 9 * (lp + 5 * pb)


def props_fields(byte: Column) -> Column:
    """lc, lp and pb of a property byte; null from 225 on."""
    return F.when(byte.between(0, 224), F.struct((byte % 9).alias("lc"), F.floor(byte / 9).alias("rest"), (F.floor(byte / 9) % 5).alias("lp"), F.floor(byte / 45).alias("pb")))


def padding4(n: Column) -> Column:
    return F.pmod(-n, F.lit(4))


def vli_length(n: Column) -> Column:
    """Bytes of a variable-length integer."""
    out = F.lit(1)
    for bits in range(7, 63, 7):
        out = out + F.when(n >= F.lit(1 << bits), 1).otherwise(0)
    return out


def preset_dict(preset: Column) -> Column:
    return F.get(F.array(*[F.lit(p[1] * 1024) for p in PRESETS]), preset.cast("int"))


def effective_dict(length: Column, preset: Column) -> Column:
    """A value's dictionary: its length, from 4 KiB to the preset's."""
    return F.least(F.greatest(length, F.lit(4096)), preset_dict(preset))


def default_block(dictionary: Column) -> Column:
    return F.greatest(2 * dictionary, F.lit(1 << 20))


def chunk_limit(dictionary: Column) -> Column:
    """The data of an LZMA2 chunk: twice the dictionary, from 4 KiB to 64 KiB."""
    return F.greatest(F.least(F.lit(1 << 16), 2 * dictionary), F.lit(4096))


def alone_dict(length: Column, preset: Column) -> Column:
    """The dictionary in a .lzma header: the effective one rounded up to a power of two."""
    return F.pow(F.lit(2), F.ceil(F.log2(effective_dict(length, preset).cast("double")))).cast("long")
