"""Near-duplicates by the exact Jaccard similarity of shingle sets: SimHash links first, then a prefix filter.

Fingerprints within a few bits give most links at little cost, but similar texts can
lie further apart. If the shingles of all texts are in one order, two sets of a
similarity of SHARE or more have a shingle in common among the first
n - ceil(SHARE * n) + 1 of each, so texts meet under those and no similar pair is
missed. The order is free: shingles that many texts share come last, so passages
seldom bring texts together. Only what is not connected yet is compared, first with
one text for each shingle, and every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklake.llm import simhash
from blocklake.llm.common import if_small, map_rows, settled, utf8, written
from blocklake.llm.components import components
from blocklake.llm.line_dedup import BLOCK

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
SHARE = (4, 5)
#: Bits of the parities of a set, and of those that long sets are compared by before they meet as a whole.
PARITIES, WIDE = 1024, 8192
#: Shingles under which more sets meet come last in the order; so many of them at most. Both change the work, never the result.
COMMON, MOST_COMMON = 32, 1 << 20
#: Rounds in which every shingle's sets are compared with one of them, another in each round, before the rest is compared in blocks.
ROUNDS = 2
#: An odd number with even bits, to mix hashes.
MIX = np.uint64(0x9E3779B97F4A7C15)


def parities(found: np.ndarray, bits: int) -> np.ndarray:
    """The parities of how many hashes fall on each bit."""
    return np.packbits((np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view("<i8")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64 bits of the runs of `width` words, repeats included; of all words if there are fewer. Each word's XXH64 is found once and mixed with those after it."""
    words = text.lower().split()  # of bytes: only A-Z change, only space and \\t-\\r part
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = own[:n].copy()
    for i in range(1, min(width, len(words)) + 1):  # every step can be undone, so only chance makes different runs equal
        out = (out ^ out >> np.uint64(32)) * MIX
        if i < min(width, len(words)):
            out += own[i : i + n]
    return out ^ out >> np.uint64(29)


def distinct_shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of a text's shingle hashes, in the order of the unsigned numbers."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def shingle_set(text: bytes, width: int = WIDTH) -> tuple[int, int, int]:
    """128 bits of the set of a text's shingle hashes, and the text's fingerprint."""
    hashes = shingle_hashes(text, width)
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(np.unique(hashes).astype("<u8").tobytes()), "<i8").tolist()
    return h1, h2, simhash.majority(hashes)


def first_shingles(found: np.ndarray, share: tuple[int, int], common: np.ndarray) -> np.ndarray:
    """The shingles under which a set meets others: the first ones, common ones (in order) last."""
    n = len(found)
    if len(common):  # looked up one by one: np.isin would sort all common ones for every set
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: n - -(-share[0] * n // share[1]) + 1]


def _sized(p, q, share: tuple[int, int]) -> Column:
    """Whether the sizes and the places of the shingle under which they meet allow the similarity."""
    both = F.least(p["i"], q["i"]) + 1 + F.least(p["n"] - p["i"], q["n"] - q["i"]) - 1
    return both * (share[0] + share[1]) >= (p["n"] + q["n"]) * share[0]


def _even(x: Column, y: Column, n: Column, share: tuple[int, int]) -> Column:
    """Whether parities differ in no more bits than sets of n shingles together may have apart."""
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    return apart * (share[0] + share[1]) <= n * (share[1] - share[0])


def _pair(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class Similar:
    """The links between the distinct sets of one table of texts.

    Sets are found from the texts wherever they are needed: hashes take several times the disk of packed texts.
    """

    def __init__(self, texts: DataFrame, unique: DataFrame, width: int, share: tuple[int, int], common: int):
        self.texts, self.unique, self.width, self.share = texts.select("id", "text"), unique, width, share
        copies = written(texts.select("id").join(unique.select("id"), "id", "left_anti"), "copies")  # mostly far fewer than the texts that stay
        own = self.texts.join(if_small(copies), "id", "left_anti")
        sets = map_rows(own, lambda i, t: (i, len(f := distinct_shingles(t, width)), f), "id long, n int, found array<long>")
        plain = sets.select(F.explode(F.expr(f"slice(found, 1, n - cast(ceil({share[0]} * n / {share[1]}) AS int) + 1)")).alias("k"))
        often = plain.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > common).orderBy(F.desc("c"), "k").limit(MOST_COMMON)
        often = written(often.select("k"), "common-shingles")
        late = unique.sparkSession.sparkContext.broadcast(np.sort(often.toPandas()["k"].to_numpy(np.int64)))  # at most MOST_COMMON numbers

        def row(i, text):
            found = distinct_shingles(text, width)
            return i, len(found), first_shingles(found, share, late.value), parities(found.view(np.uint64), PARITIES)

        self.marks = written(map_rows(own, row, "id long, n int, first array<long>, parities array<long>"), "shingle-marks")
        members = self.marks.select("id", "n", F.posexplode("first").alias("i", "k"))
        live = written(members.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "live-shingles")
        self.met = written(members.join(if_small(live), "k"), "met-shingles")
        self.links = self.labels = None

    def verified(self, candidates: DataFrame) -> DataFrame:
        """The pairs a, b of candidates that have the similarity. Only sets of pairs with fitting parities are joined."""
        share, width, size = self.share, self.width, F.col("m") + F.col("n")
        side = lambda name, n, p: self.marks.select(F.col("id").alias(name), F.col("n").alias(n), F.col("parities").alias(p))
        fitting = candidates.where("a != b").distinct().join(side("a", "m", "p"), "a").join(side("b", "n", "q"), "b").where(_even(F.col("p"), F.col("q"), size, share))
        left = written(fitting.select("a", "b", "m", "n"), "fitting")
        ends = written(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "ends")
        sets = map_rows(self.texts.join(if_small(ends), "id", "left_semi"), lambda i, t: (i, f := distinct_shingles(t, width), parities(f.view(np.uint64), WIDE)), "id long, found array<long>, wide array<long>")
        sets = written(sets, "sets")
        p, q = sets.select(F.col("id").alias("a"), F.col("wide").alias("p")), sets.select(F.col("id").alias("b"), F.col("wide").alias("q"))
        left = written(left.join(p, "a").join(q, "b").where(_even(F.col("p"), F.col("q"), size, share)).select("a", "b", "m", "n"), "fitting")
        x, y = sets.select(F.col("id").alias("a"), F.col("found").alias("x")), sets.select(F.col("id").alias("b"), F.col("found").alias("y"))
        enough = F.size(F.array_intersect("x", "y")) * (share[0] + share[1]) >= size * share[0]
        return left.join(x, "a").join(y, "b").where(enough).select("a", "b")

    def add(self, candidates: Callable[[], DataFrame]) -> bool:
        """Verifies candidates, and deletes the tables that they came from; whether there are new links."""
        spark = self.unique.sparkSession
        found = settled(spark, lambda: self.verified(candidates()), "similar")
        if found.isEmpty():
            return False
        self.links = found if self.links is None else written(self.links.union(found).distinct(), "similar")
        self.labels = settled(spark, lambda: components(self.links).withColumnRenamed("node", "id"), "similar-labels")
        return True

    def placed(self) -> DataFrame:
        """Sets under shingles whose sets are not all connected yet, with their components."""
        named = self.met.withColumn("component", F.col("id")) if self.labels is None else self.met.join(self.labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = named.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("k")
        return written(named.join(if_small(written(split, "split")), "k"), "placed")

    def fingerprint_links(self, distance: int) -> DataFrame:
        """Candidates from fingerprints within a few bits, and from equal ones."""
        first = self.unique.groupBy("fp").agg(F.min("id").alias("first"))
        near = settled(self.unique.sparkSession, lambda: simhash.links(first.select("fp"), distance), "fingerprint-links")
        a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
        equal = self.unique.select("fp", "id").join(first, "fp").where("id != first").select(*_pair("first", "id"))
        return near.join(a, "a").join(b, "b").select(*_pair("x", "y")).union(equal)

    def with_one(self, placed: DataFrame, turn: int) -> DataFrame:
        """Candidates: under each shingle, one set (another in each turn) with all those of other components."""
        hub = placed.groupBy("k").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "k", "id").alias("h"), "id", "n", "i", "component")).alias("hub"))
        met = placed.join(hub, "k").where(F.col("component") != F.col("hub.component"))
        return met.where(_sized(F.struct("n", "i"), F.col("hub"), self.share)).select(*_pair("hub.id", "id"))

    def in_blocks(self, placed: DataFrame) -> DataFrame:
        """Candidates: all pairs of different components under each shingle that fit by size, place and parities; no row is made of the others."""
        counted = placed.drop("c").join(placed.groupBy("k").agg(F.count("*").alias("c")), "k")
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        dealt = counted.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).join(self.marks.select("id", "parities"), "id")
        lists = dealt.groupBy("k", "x", "y").agg(F.collect_list(F.struct("id", "own", "n", "i", "component", "parities")).alias("them"))

        def near(p, q):
            once = (q["id"] > p["id"]) & ((p["own"] != q["own"]) | (F.col("x") == F.col("y")))
            return once & (p["component"] != q["component"]) & _sized(p, q, self.share) & _even(p["parities"], q["parities"], p["n"] + q["n"], self.share)

        tried = F.flatten(F.transform("them", lambda p: F.transform(F.filter("them", lambda q: near(p, q)), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b")))))
        return lists.select(F.inline(tried))


def similar_labels(texts: DataFrame, unique: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, common: int = COMMON, rounds: int = ROUNDS, distance: int = 2) -> DataFrame | None:
    """id and component of the distinct sets that have a similar one; None if there are none.

    Every similar pair meets under a shingle, and what the rounds leave unconnected there is compared in full,
    so components are exact. texts has id and text, unique id and fp of one text of each set.
    """
    join = Similar(texts, unique, width, share, common)
    join.add(lambda: join.fingerprint_links(distance))
    for turn in range(rounds):
        if not join.add(lambda: join.with_one(join.placed(), turn)):  # noqa: B023
            break
    join.add(lambda: join.in_blocks(join.placed()))
    return join.labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE, common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """key and component_id (the smallest key reachable over similar texts, its own included) of every row of docs.

    A text of fewer words has one shingle; texts without words are copies of each other. Texts of equal sets are
    one in the search. Rows with a null key count as members, but give no component its number.
    """
    return settled(docs.sparkSession, lambda: _classes(docs, key, text, width, share, common, rounds), "near-duplicates")


def _classes(docs: DataFrame, key: str, text: str, width: int, share: tuple[int, int], common: int, rounds: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text")).withColumn("id", F.monotonically_increasing_id())
    texts = written(texts, "texts", "zstd")
    sets = map_rows(texts, lambda k, t, i: (k, i, *shingle_set(t, width)), f"key {kind}, id long, h1 long, h2 long, fp long")
    sets = written(sets, "shingle-sets")
    unique = written(sets.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("key").alias("least"), F.min("fp").alias("fp")), "unique-sets")
    labels = similar_labels(texts, unique, width, share, common, rounds)
    classes = unique.withColumn("component", F.col("id")) if labels is None else unique.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    numbers = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(numbers, "component").select("h1", "h2", "component_id")
    return sets.select("key", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("key").alias(key), "component_id")
