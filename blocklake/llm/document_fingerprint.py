"""Document fingerprints from prefix polynomial hashes.

For code points c the prefix array is P[i] = sum(c[j] * B**j for j < i) mod p.
A span [i, i + n) has the hash (P[i + n] - P[i]) * B**-i mod p, so any two spans
compare in constant time and the longest common extension is a binary search.
Two primes together keep unequal spans apart (62 bits).

The fingerprint is a sketch of the hashes of all spans of WIDTH code points:
they fall into BINS bins by their high bits and each bin keeps its least hash,
so the share of agreeing bins estimates the spans that two texts share.
"""

from __future__ import annotations

import collections
import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows, unused

#: Primes under 2**31, so that products fit 64 bits, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1812433253 % 2147483629)
INVERSES = tuple(pow(base, prime - 2, prime) for base, prime in zip(BASES, PRIMES, strict=True))
WIDTH, BINS = 16, 64
#: Stands for a null key, and for the least hash.
NULL = -(2**63)


def reduced(x: np.ndarray, prime: int) -> np.ndarray:
    """x mod prime. NumPy divides by a constant much faster than it finds remainders."""
    return x - x // prime * prime


@functools.lru_cache(maxsize=128)  # a few bases, a size for each power of two: twice the longest in all
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    """base**i mod prime for i < size (a power of two), by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < size:
        out = np.concatenate([out, reduced(out * (int(out[-1]) * base % prime), prime)])
    return out


def powers(base: int, prime: int, n: int) -> np.ndarray:
    return _powers(base, prime, 1 << max(12, n.bit_length()))[: n + 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


class Prefix:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        c = code_points(text)
        self.n, self.rows = len(c), []
        for base, prime in zip(BASES, PRIMES, strict=True):
            # terms stay under 2**31, so a 64-bit sum of 2**32 of them can't overflow
            sums = np.cumsum(reduced(c * powers(base, prime, self.n)[: self.n], prime))
            self.rows.append(np.concatenate([np.zeros(1, np.int64), reduced(sums, prime)]))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The hashes of length code points from start, the same wherever they stand."""
        out = []
        for row, inverse, prime in zip(self.rows, INVERSES, PRIMES, strict=True):
            back = pow(inverse, start, prime)
            out.append(int(row[start + length] - row[start]) % prime * back % prime)
        return tuple(out)

    def spans(self, width: int) -> np.ndarray:
        """The hashes of all spans of a width, as 62-bit numbers; of the whole text if it is shorter."""
        width = min(width, self.n)
        count = self.n - width + 1
        out = np.zeros(count, np.int64)
        for row, inverse, prime in zip(self.rows, INVERSES, PRIMES, strict=True):
            back = powers(inverse, prime, self.n)[:count]
            out = (out << 31) ^ reduced(reduced(row[width:] - row[:count], prime) * back, prime)
        return out


def same_span(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether length code points from i in a equal those from j in b; False beyond an end."""
    if min(i, j, length) < 0 or i + length > a.n or j + length > b.n:
        return False
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """The length of the longest common extension from i in a and j in b, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same_span(a, i, b, j, mid) else (low, mid - 1)
    return low


def sketch(prefix: Prefix) -> str:
    """BINS groups of 4 hex digits and the whole text's hash; an empty text has its own."""
    spans = prefix.spans(WIDTH) if prefix.n else np.zeros(0, np.int64)
    mixed = spans.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()  # so the least of a bin is its first
    first = np.searchsorted(mixed, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    empty = np.diff(first, append=len(mixed)) == 0
    bins = np.append(mixed, np.uint64(0))[first] & np.uint64((1 << 58) - 1)
    folded = (bins ^ (bins >> np.uint64(23)) ^ (bins >> np.uint64(41))) & np.uint64(0xFFFF)
    digits = folded.astype(">u2").tobytes().hex()
    cells = [digits[4 * i : 4 * i + 4] for i in range(BINS)] if not empty.any() else ["----" if e else digits[4 * i : 4 * i + 4] for i, e in enumerate(empty.tolist())]
    whole = prefix.span(0, prefix.n)
    return "".join(cells) + f"{whole[0]:08x}{whole[1]:08x}{prefix.n:x}"


def likeness(a: str, b: str) -> float:
    """Of the bins that either text fills, the share that agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = ([s[4 * i : 4 * i + 4] for i in range(BINS)] for s in (a, b))
    filled = sum(p != "----" or q != "----" for p, q in zip(x, y, strict=True))
    return sum(p == q != "----" for p, q in zip(x, y, strict=True)) / max(1, filled)


def fingerprint_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), n_chars and fingerprint, a row per row; other columns are left out."""
    kind = docs.schema[key].dataType.simpleString()

    def row(k, t):
        prefix = Prefix(t)
        return k, t, prefix.n, sketch(prefix)

    columns = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return map_rows(columns, row, f"key {kind}, text string, n_chars long, fingerprint string").withColumnRenamed("key", key)


def range_cuts(keys: DataFrame, key: str, tie: str, per_partition: int, per_range: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of rows of nearly equal size begin, by descending key and then by a hash of tie: keys (inverted, so that they ascend) and hashes.

    Approximate percentiles of the keys, which are keys of the data, are the cuts. A key that is several of them
    has rows for several ranges: its rows are cut by even ranges of the hash, each of which begins with its least
    one. Other cuts have the least number for a hash. At most 10,000 cuts come to the driver.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(NULL))
    n = keys.count()
    parts = min(10_000, max(per_partition * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // per_range))
    found = keys.agg(F.percentile_approx(own, [i / parts for i in range(1, parts)], 10_000).alias("cuts"), F.max(own).alias("top")).first()
    counts = collections.Counter(found["cuts"] or [])
    hot = [(k, c) for k, c in counts.items() if c > 1]
    cuts = {(~k, NULL) for k in (*counts, *([] if found["top"] is None else [found["top"]])) if counts[k] < 2}
    if hot:
        many = keys.sparkSession.createDataFrame(hot, "own long, ranges int")  # a row for every second cut at most
        rows = keys.select(own.alias("own"), F.xxhash64(tie).alias("h")).join(F.broadcast(many), "own")
        firsts = rows.groupBy("own", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("ranges")).alias("part")).agg(F.min("h").alias("h"))
        cuts |= {(~r["own"], r["h"]) for r in firsts.collect()}
    order = sorted(cuts)
    return np.array([k for k, _ in order], np.int64), np.array([h for _, h in order], np.int64)


def with_next(rows: DataFrame, keys: DataFrame, key: str, carry: list[str], per_partition: int = 4, per_range: int = 50_000) -> DataFrame:
    """rows with carry's values of the next row by descending integer key as next_<name>; after the last row comes the first.

    Rows fall into ranges (range_cuts() over keys, the same rows before any work on them). The first row of a range
    is known from its cut and also goes to the end of the range before it. One shuffle by range, and no task sees
    more than its ranges. Null keys come last and a lone row follows itself; rows of an equal key stand in the
    order of a hash of their first carried value and then of the values. Only equal rows stay in one range.
    """
    kind = rows.schema[key].dataType.simpleString()
    assert kind in ("bigint", "int", "smallint", "tinyint"), kind
    cut_keys, cut_hashes = range_cuts(keys, key, carry[0], per_partition, per_range)
    repeated = np.unique(cut_keys[cut_hashes != NULL])

    @F.pandas_udf("array<int>")
    def ranges(own: pd.Series, hashes: pd.Series) -> pd.Series:
        k, h = ~own.to_numpy(np.int64), hashes.to_numpy(np.int64)
        at = np.searchsorted(cut_keys, k, "right") - 1
        for x in np.intersect1d(k, repeated):
            low, high = np.searchsorted(cut_keys, x, "left"), np.searchsorted(cut_keys, x, "right")
            which = k == x
            at[which] = low + np.searchsorted(cut_hashes[low:high], h[which], "right") - 1
        first = (k == cut_keys[at]) & ((cut_hashes[at] == NULL) | (h == cut_hashes[at]))
        return pd.Series([[int(a), (int(a) - 1) % len(cut_keys)] if f else [int(a)] for a, f in zip(at, first, strict=True)])

    (tie,) = unused(rows, "tie")
    hashed = rows.withColumn(tie, F.xxhash64(carry[0]))
    slots = ranges(F.coalesce(F.col(key).cast("long"), F.lit(NULL)), F.col(tie)) if len(cut_keys) else F.array(F.lit(0))
    placed = hashed.select("*", F.posexplode(slots).alias("ghost", "slot"))
    window = Window.partitionBy("slot").orderBy("ghost", F.col(key).desc_nulls_last(), tie, *carry)
    # column by column: of a struct Spark would shuffle a second copy
    following = {f"next_{c}": F.coalesce(F.lead(c).over(window), F.first(c).over(window)) for c in carry}
    return placed.withColumns(following).where("ghost = 0").drop("ghost", "slot", tie)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside an edited one, whose last third is the beginning of the next text by descending key.

    key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and common_prefix (code
    points that text and edited text share from the start, by binary search on their prefix arrays), a row per row.
    Empty texts have a fingerprint of their own, which is like no other; near is 1 between equal texts.
    """
    kind = docs.schema[key].dataType.simpleString()
    third = F.floor(F.col("n_chars") / 3).cast("int")
    keys = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("text"))
    paired = with_next(fingerprint_texts(docs, key, text), keys, key, ["text", "fingerprint"])
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))

    def row(k, n, digest, own, following, t, e):
        a, b = Prefix(t), Prefix(e)
        other = own if t == e else sketch(b)
        return k, n, digest, own, other, likeness(own, other), likeness(own, following), common_extension(a, 0, b, 0)

    columns = edited.select(F.col(key).alias("key"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256), "fingerprint", "next_fingerprint", "text", "edited")
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return map_rows(columns, row, schema).withColumnRenamed("key", key)
