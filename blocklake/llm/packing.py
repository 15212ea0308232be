"""Packing into optimal length buckets.

The lengths of all texts make an exact histogram. Dynamic programming over it
chooses the bucket boundaries with the least padding, and each bucket is cut into
batches that hold up to a budget of tokens, padding included.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklake.llm.common import written

BUCKETS, BUDGET = 16, 65_536
#: Rows that are numbered in one group; a bucket of any size is dealt into groups of about this many.
GROUP = 50_000


def word_count(text: str | Column) -> Column:
    """Words between white space (space and tab to carriage return); a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The greatest lengths of the buckets, ascending, with the least padding in all; from a histogram in order of length.

    A bucket over lengths i..j pads every text to length j. Of the best cut before i only a line over the
    greatest length matters: slope minus the texts before i, height the padding and the tokens before i. Slopes
    fall and lengths grow, so the least line moves one way only and a layer takes time in proportion to the lengths.
    """
    n = len(lengths)
    if not n:
        return []
    before = [0, *accumulate(counts)]
    tokens = [0, *accumulate(a * b for a, b in zip(lengths, counts, strict=True))]
    best: list[float] = [0, *[float("inf")] * n]
    origins = []
    for _ in range(min(buckets, n)):
        new, origin, hull, at = [float("inf")] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] != float("inf"):
                line = (before[i], best[i] + tokens[i], i)
                while len(hull) - at >= 2 and (line[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-2][0]):
                    hull.pop()
                hull.append(line)
            if at >= len(hull):
                continue
            top = lengths[j - 1]
            value = lambda x: x[1] - top * x[0]  # noqa: B023, E731
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            new[j], origin[j] = value(hull[at]) + top * before[j] - tokens[j], hull[at][2]
        origins.append(origin)
        best = new
    # with as many buckets as lengths there is no padding; fewer never pad less
    out, j = [], n
    for origin in reversed(origins):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = origin[j]
    return out[::-1]


def pack(docs: DataFrame, length: Column, key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, n_tokens, bucket, bucket_tokens (what its texts are padded to), batch, slot and padding, a row per row of docs.

    length is what a token is counted by: word_count(), or a column of byte_bpe's token counts.
    Batches are numbered within a bucket; every one but the last holds budget // bucket_tokens texts (one at
    least, so a text beyond the budget is a batch of its own). Empty texts have 0 tokens and count as one each in
    a batch. Equal rows, null keys and ties get slots of their own. Texts stay behind; only keys and lengths move. What comes to the driver is the histogram, a
    row for each different length.
    """
    rows = written(docs.select(F.col(key).alias("key"), length.cast("long").alias("n_tokens")).withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = sorted(map(tuple, rows.groupBy("n_tokens").count().collect()))
    tops = boundaries([a for a, _ in histogram], [n for _, n in histogram], buckets)
    if not tops:
        return rows.select(F.col("key").alias(key), "n_tokens", F.lit(0).alias("bucket"), F.col("n_tokens").alias("bucket_tokens"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
    sizes = [0] * len(tops)
    for length_, n in histogram:
        sizes[bisect_left(tops, length_)] += n
    bucket = F.lit(0)
    for i, top in enumerate(tops[:-1]):
        bucket = bucket + F.when(F.col("n_tokens") > top, 1).otherwise(0)
    per_bucket = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("bucket"))
    groups = per_bucket([max(1, -(-n // GROUP)) for n in sizes])
    dealt = rows.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("row"), groups).cast("int"))
    # numbers run through the groups of a bucket: where each begins is a running sum over the groups' sizes
    counts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    begins = written(counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("begin")), "groups")
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_tokens", "row")) - 1 + F.col("begin")
    each = per_bucket([max(1, budget // max(1, t)) for t in tops]).cast("long")
    placed = dealt.join(begins, ["bucket", "part"]).select("key", "n_tokens", "bucket", per_bucket([int(t) for t in tops]).cast("long").alias("bucket_tokens"), each.alias("each"), number.alias("number"))
    return placed.select(
        F.col("key").alias(key), "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("number") / F.col("each")).alias("batch"),
        (F.col("number") % F.col("each")).cast("int").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
