"""SimHash near-duplicates by the generalised pigeonhole principle.

If the bits fall into m groups with thresholds t_i (-1 or more) that sum to
T - m + 1, then two fingerprints at T or fewer differing bits differ in t_i or
fewer bits of some group. Correlated bits share a group, and dynamic programming
gives each group the threshold that makes the estimated work least: -1 (never
probed) for skewed groups, more for even ones. Fingerprints meet under the values
of their groups and their neighbours, and every meeting is verified.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows, settled, utf8, written
from blocklake.llm.components import components

BITS = 64
#: Of keys with more fingerprints than this, these meet again under more bits, and at last through their neighbours of half the distance.
CROWD = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the runs of `width` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # of bytes: only A-Z change, only space and \\t-\\r part
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes as a signed 64-bit integer: a bit is set if over half of them set it; without any it is 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: bytes, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key and fp of every row; a null or empty text has 0."""
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text")), lambda k, t: (k, simhash(t, width)), f"key {kind}, fp long").withColumnRenamed("key", key)


def bit_pairs(unique: DataFrame) -> np.ndarray:
    """How many fingerprints set both of two bits, 64 x 64 (on the diagonal: one bit), counted over all of them."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "n": total.ravel()})

    out = np.zeros((BITS, BITS), np.int64)
    for row in unique.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        out[row["i"], row["j"]] = row["n"]
    return out


def group_bits(pairs: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """The bits in groups of nearly equal size: each grows by the bit that correlates most with it."""
    p = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = math.ceil(len(left) / (groups - g))
        first = max(left, key=lambda b: (correlation[b, left].max(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (correlation[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def neighbours(bits: list[int], distance: int) -> list[int]:
    """Masks of up to `distance` of the bits, none included."""
    return [mask_of(list(c)) for d in range(distance + 1) for c in itertools.combinations(bits, d)]


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 on that sum to total with the least cost; costs[i][t + 1] is group i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, own in enumerate(group, -1):
                new = (cost + own, [*chosen, t])
                if done + t not in following or new < following[done + t]:
                    following[done + t] = new
        best = following
    return best[total][1]


def plan_groups(unique: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is to be probed, by estimates over all fingerprints.

    Pairs that agree in a group are counted from the sizes of its values; those at distance d of it are estimated
    from them and how evenly each bit splits. To candidates the cost adds the rows that probing makes.
    """
    pairs = bit_pairs(unique)
    n = unique.count()
    p = np.diag(pairs) / max(n, 1)
    odds = 2 * p * (1 - p) / (p**2 + (1 - p) ** 2)  # of two fingerprints: chance to differ in a bit to chance to agree
    options = {m: group_bits(pairs, n, m) for m in range(2, distance + 2)} if distance else {1: [list(range(BITS))]}
    flat = [(m, g, mask_of(bits)) for m, groups in options.items() for g, bits in enumerate(groups)]
    values = unique.select("fp", F.inline(_rows([(i, mask) for i, (_, _, mask) in enumerate(flat)], ("i", "mask")))).select("i", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    sizes = values.groupBy("i", "v").agg(F.count("*").alias("c")).groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    agreeing = {row["i"]: row["pairs"] for row in sizes.collect()}  # a row per group
    best = None
    for m, groups in options.items():
        costs = []
        for g, bits in enumerate(groups):
            agree, own = agreeing.get(flat.index((m, g, mask_of(bits))), 0.0), [0.0]
            ways = np.array([1.0])
            for b in bits:  # elementary symmetric sums: chances of d differing bits
                ways = np.convolve(ways, [1.0, odds[b]])
            for t in range(distance - m + 1 + m):
                rows = sum(math.comb(len(bits), d) for d in range(t + 1))
                own.append(agree * ways[: t + 1].sum() + n * (rows + (t > 0)))
            costs.append(own)
        chosen = allocate(costs, distance - m + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _rows(rows: list[tuple], names: tuple[str, ...]) -> F.Column:
    """Fixed rows as one array of structs."""
    return F.array(*[F.struct(*[F.lit(x).cast("long" if isinstance(x, int) and not isinstance(x, bool) else "boolean").alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])


def _met(members: DataFrame, by: list[str], name: str) -> DataFrame:
    """members of keys with two fingerprints or more, with their count c."""
    return written(members.join(members.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1"), by), name)


def _near_pairs(met: DataFrame, by: list[str], distance: int) -> DataFrame:
    """a < b: pairs under one key within the distance."""
    near = lambda x, y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= distance)
    few = met.groupBy(*by).agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return few.select(F.inline(pairs))


def links(unique: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all at `distance` or fewer differing bits.

    Under a key with up to `crowd` fingerprints all pairs are verified. Others meet again: beside the bits of the
    key the rest is within the distance too, so it is equal in one of distance + 1 parts. What still crowds,
    whatever its number, links exactly and without pairs: two fingerprints are that near just if some point lies
    within half the distance of both (rounded up for one), and a point has a bounded number of those, so each
    links to the least there.
    """
    plan = plan_groups(unique, distance)
    keys = [(g, mask_of(bits), m) for g, (bits, t) in enumerate(plan) for m in neighbours(bits, t)]
    members = unique.select("fp", F.inline(_rows(keys, ("g", "mask", "flip")))).select("fp", "g", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("v"))
    met = _met(members, ["g", "v"], "met")
    found = _near_pairs(met.where(F.col("c") <= crowd), ["g", "v"], distance)
    crowded = met.where(F.col("c") > crowd)
    if crowded.isEmpty():
        return found.distinct()

    rest = [[b for b in range(BITS) if b not in bits] for bits, _ in plan]
    parts = [(g, p, mask_of(r[p :: distance + 1])) for g, r in enumerate(rest) for p in range(distance + 1)]
    finer = crowded.select("fp", "g", "v", F.inline(_rows(parts, ("own", "p", "part")))).where("g = own").select("fp", "g", "v", "p", F.col("fp").bitwiseAND(F.col("part")).alias("w"))
    again = _met(finer, ["g", "v", "p", "w"], "met-again")
    found = found.union(_near_pairs(again.where(F.col("c") <= crowd), ["g", "v", "p", "w"], distance))

    crowded = again.where(F.col("c") > crowd).select("fp").distinct()
    inner = len(neighbours(list(range(BITS)), distance // 2))
    flips = [(m, i < inner) for i, m in enumerate(neighbours(list(range(BITS)), (distance + 1) // 2))]
    points = crowded.select("fp", F.inline(_rows(flips, ("flip", "inner")))).select("fp", "inner", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    points = points.groupBy("point").agg(F.collect_list("fp").alias("fps"), F.min(F.when(F.col("inner"), F.col("fp"))).alias("a")).where("a IS NOT NULL AND size(fps) > 1")
    large = points.select("a", F.explode("fps").alias("b")).where("a != b")
    return found.union(large).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """key, fp and component_id (the smallest key reachable over links, its own included) of every row of docs.

    Copies share a fingerprint, which is grouped first, so any number of them is one row in the search. Texts
    without words have fingerprint 0 and link like others. Rows with a null key count as members, but give no
    component its number; a component of such rows only has null. Rows of an equal key stay rows.
    """
    marked = written(fingerprints(docs, key, text, width), "fingerprints")
    unique = written(marked.groupBy("fp").agg(F.min(key).alias("first")), "unique")
    linked = settled(docs.sparkSession, lambda: components(links(unique, distance)), "linked")
    grouped = unique.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(grouped.join(least, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select(key, "fp", "component_id")
