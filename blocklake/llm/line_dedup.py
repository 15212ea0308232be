"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is cut into threshold + 1 segments. Edits within the threshold leave one
segment whole, and where it can lie in the other line follows from both lengths,
so lines meet under (length, segment number, text) of the segments of one and a
few substrings of the other. Lines that crowd under a segment meet again under
parts of their signatures, of which one is equal. Every meeting is verified by an
edit distance whose band of 2 * threshold + 1 diagonals is a few machine words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import if_small, let, settled, unused, written
from blocklake.llm.components import components

#: The threshold: an edit for every PER characters of the shorter line, DISTANCE at most.
DISTANCE, PER = 2, 16
#: Lines under one key are compared in lists of about this length at most; what crowds beyond the signatures is dealt into pairs of blocks.
BLOCK = 256


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, version (64 bits of the text), line_no and line of all lines that are not blank. Null keys stand as the largest."""
    lines = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("key"), F.xxhash64(text).alias("version"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"\S"))


def hashed(df: DataFrame) -> DataFrame:
    """With 128 bits of the line as h1 and h2."""
    return df.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def probes(distance: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment from 1, shift) of every substring to look up; no shift and no less length: the index itself."""
    k = distance + 1
    out = [(0, i, 0) for i in range(1, k + 1)]
    for less in range(distance + 1):
        for i in range(1, k + 1):
            low, high = max(-(i - 1), less - (k - i)), min(i - 1, less + (k - i))
            out += [(less, i, s) for s in range(low, high + 1) if (less, s) != (0, 0)]
    return out


def segment(length: Column, seg: Column, k: Column | int) -> tuple[Column, Column]:
    """Start (from 1) and size of a segment of a line of a length in k; the last ones are longer by one."""
    short, longer = F.floor(length / k).cast("int"), length % k
    size = short + F.when(seg > k - longer, 1).otherwise(0)
    return (seg - 1) * short + F.greatest(F.lit(0), seg - 1 - (k - longer)) + 1, size


def combos(distances: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("less"), F.lit(i).alias("seg"), F.lit(s).alias("shift")) for t in distances for a, i, s in probes(t)])


def threshold(length: Column, distance: int, per: int) -> Column:
    return F.least(F.lit(distance), F.floor(length / per).cast("int"))


def members(lines: DataFrame, distance: int, per: int) -> DataFrame:
    """k, id: the keys of every line."""
    n = F.char_length("line")
    chosen = F.when(n >= distance * (per + 1), combos([distance])).otherwise(combos(list(range(1, distance + 1))))  # a long line meets no shorter threshold
    cut = lines.select("id", "line", n.alias("n"), F.inline(chosen)).withColumn("length", F.col("n") - F.col("less"))
    start, size = segment(F.col("length"), F.col("seg"), F.col("t") + 1)
    placed = cut.where(F.col("t") == threshold(F.col("length"), distance, per)).withColumns({"start": start + F.col("shift"), "size": size})
    key = F.xxhash64("length", "seg", F.substring(F.col("line"), F.col("start"), F.col("size")))
    return placed.where("start >= 1 AND start + size - 1 <= n").select(key.alias("k"), "id")


def within(line: Column, other: Column, distance: int) -> Column:
    """Whether two lines are within the edit distance.

    Word e holds a bit for every diagonal of the band: that the prefixes that meet there are within e edits.
    A character of the other line moves all words on: matches stay, and from one edit less come substitutions
    (same bit), insertions (the bit above) and deletions (the new bit below). Without a bit left nothing moves.
    """
    width = 2 * distance + 1
    full = (1 << width) - 1
    names = [f"r{e}" for e in range(distance + 1)]
    start = F.struct(*[F.lit(sum(1 << b for b in range(distance, distance + e + 1))).cast("int").alias(n) for e, n in enumerate(names)], F.lit(0).alias("j"))

    def run(p, t):
        def step(acc, c):
            match = F.lit(0)
            for b in range(width):
                match = match.bitwiseOR(F.when(F.get(p, acc["j"] - distance + b).eqNullSafe(c), F.lit(1 << b)).otherwise(F.lit(0)))

            def moved(m):
                out = []
                for e, name in enumerate(names):
                    new = acc[name].bitwiseAND(m)
                    if e:
                        less = acc[names[e - 1]]
                        new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full))
                    out.append(new)
                return F.struct(*[o.alias(n) for o, n in zip(out, names, strict=True)], (acc["j"] + 1).alias("j"))

            return F.when(acc[names[-1]] == 0, acc).otherwise(let(match, moved))

        diagonal = F.size(p) - F.size(t) + distance
        reached = lambda end: F.call_function("shiftright", end, diagonal).bitwiseAND(F.lit(1)) == 1
        return (diagonal >= 0) & (diagonal < width) & let(F.aggregate(t, start, step, lambda acc: acc[names[-1]]), reached)

    return let(F.split(line, ""), lambda p: let(F.split(other, ""), lambda t: run(p, t)))


def signature(line: Column) -> Column:
    """Parities of how often characters (64 bits) and pairs of neighbours (128 bits) occur. An edit turns 2 and 4 bits at most."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    start = F.struct(F.lit(0).alias("last"), *[F.lit(0).cast("long").alias(n) for n in ("u", "b1", "b2")])

    def step(acc, c):
        code, pair = F.ascii(c), F.pmod(acc["last"] * 31 + F.ascii(c), F.lit(128))
        low = acc["b1"].bitwiseXOR(F.when(pair < 64, bit(pair)).otherwise(F.lit(0).cast("long")))
        high = acc["b2"].bitwiseXOR(F.when(pair >= 64, bit(pair - 64)).otherwise(F.lit(0).cast("long")))
        return F.struct(code.alias("last"), acc["u"].bitwiseXOR(bit(code % 64)).alias("u"), low.alias("b1"), high.alias("b2"))

    return F.aggregate(F.split(line, ""), start, step)


def apart(crowd: DataFrame, marks: DataFrame, words: tuple[str, ...], most: int) -> DataFrame:
    """k, id: finer keys within each key of a crowd (k, id). Signatures that differ in `most` bits of these words at most are equal in one of most + 1 groups of their bits."""
    mask = lambda g, w: sum(1 << b for b in range(64) if (64 * w + b) % (most + 1) == g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = [F.xxhash64("k", F.lit(g), *[F.col(name).bitwiseAND(F.lit(signed(mask(g, w))).cast("long")) for w, name in enumerate(words)]) for g in range(most + 1)]
    return crowd.join(marks, "id").select(F.explode(F.array(*groups)).alias("k"), "id")


def compared(met: DataFrame, marks: DataFrame, distance: int) -> DataFrame:
    """a < b: the pairs under one key (met has k, id and the key's count c) whose lengths and signatures may be within the distance. No row is made of the others."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).select("k", "id", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("k", "id", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    lists = dealt.join(marks, "id").groupBy("k", "x", "y").agg(F.collect_list(F.struct("id", "own", "n", "u", "b1", "b2")).alias("them"))
    turned = lambda p, q, name: F.bit_count(p[name].bitwiseXOR(q[name]))

    def near(p, q):
        once = (q["id"] > p["id"]) & ((p["own"] != q["own"]) | (F.col("x") == F.col("y")))
        return once & (F.abs(p["n"] - q["n"]) <= distance) & (turned(p, q, "u") <= 2 * distance) & (turned(p, q, "b1") + turned(p, q, "b2") <= 4 * distance)

    pairs = F.flatten(F.transform("them", lambda p: F.transform(F.filter("them", lambda q: near(p, q)), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b")))))
    return lists.select(F.inline(pairs))


def shared_keys(keys: DataFrame, name: str) -> DataFrame:
    """k and c, the count of rows, of the keys that two ids or more have."""
    return written(keys.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("c")).where("low < high").select("k", "c"), name)


def line_links(lines: DataFrame, distance: int = DISTANCE, per: int = PER) -> DataFrame:
    """a < b: ids of all different lines within an edit for every `per` characters of the shorter one, `distance` at most; lines has id and line, each once.

    Under a key only ids, lengths and signatures are compared. Pairs that these leave are verified.
    """
    long = lines.where(F.char_length("line") >= per)  # shorter ones allow no edit
    keys = members(long, distance, per)
    met = written(keys.join(if_small(shared_keys(keys, "live-keys")), "k").distinct(), "met")
    ids = written(met.select("id").distinct(), "met-ids")
    marks = long.join(if_small(ids), "id").select("id", F.char_length("line").alias("n"), signature(F.col("line")).alias("s")).select("id", "n", "s.u", "s.b1", "s.b2")
    marks = written(marks, "marks")
    found = [compared(met.where(F.col("c") <= BLOCK), marks, distance)]
    many = met.where(F.col("c") > BLOCK)
    for words, most in ((("b1", "b2"), 4 * distance), (("u",), 2 * distance)):
        if many.isEmpty():
            break
        finer = written(apart(many, marks, words, most), "finer-keys")
        again = written(finer.join(if_small(shared_keys(finer, "crowded-keys")), "k"), "met-again")
        found.append(compared(again.where(F.col("c") <= BLOCK), marks, distance))
        many = again.where(F.col("c") > BLOCK)
    else:
        found.append(compared(many, marks, distance))
    candidates = written(functools.reduce(DataFrame.union, found).distinct(), "candidates")
    ends = written(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    texts = written(long.join(if_small(ends), "id").select("id", "line"), "texts")
    left = candidates.join(texts.select(F.col("id").alias("a"), F.col("line").alias("p")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("line").alias("q")), "b")
    allowed = threshold(F.least(F.char_length("p"), F.char_length("q")), distance, per)
    near = F.when(allowed == distance, within(F.col("p"), F.col("q"), distance))
    for t in range(1, distance):
        near = near.when(allowed == t, within(F.col("p"), F.col("q"), t))
    return both.where(near).select("a", "b")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, per: int = PER) -> DataFrame:
    """key, version, line_no, h1, h2, class_key, class_line, n_links, n_copies and kept of every line that has a copy or a link."""
    counted = occurrences(docs, key, text).groupBy("line").agg(F.min("key").alias("first"), F.count("*").alias("n_copies"))
    lines = written(counted.withColumn("id", F.monotonically_increasing_id()), "lines", "zstd")
    links = settled(docs.sparkSession, lambda: line_links(lines, distance, per), "links")
    linked = settled(docs.sparkSession, lambda: components(links), "linked")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    near = written(linked.join(degree, linked["node"] == degree["id"]).select("id", "component", "n_links"), "near")
    marked = hashed(lines.join(if_small(near), "id", "left").where("n_copies > 1 OR component IS NOT NULL")).select("h1", "h2", "first", "n_copies", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    marked = written(marked, "marked")
    least_key = marked.groupBy("component").agg(F.min("first").alias("class_key"))
    classes = written(marked.join(least_key, "component").drop("first"), "line-classes")
    found = hashed(occurrences(docs, key, text)).drop("line").join(classes, ["h1", "h2"])
    found = written(found, "repeated")
    first = found.where("key = class_key").groupBy("component").agg(F.min("line_no").alias("class_line"))
    placed = found.join(written(first, "first-lines"), "component")
    return placed.select("key", "version", "line_no", "h1", "h2", "class_key", "class_line", "n_links", "n_copies", F.expr("key = class_key AND line_no = class_line").alias("kept"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, per: int = PER) -> DataFrame:
    """A row per line that is not blank: key, line_no, its class (class_key, class_line: where its first line stands),
    n_links (different lines within the edit distance), n_copies (of itself) and kept (it is the first of its class).

    A class is what copies and links connect. Lines under `per` characters allow no edit. Null texts are
    empty; null keys come last; rows of an equal key are versions of one document.
    """
    every = occurrences(docs, key, text).select("key", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    found = settled(docs.sparkSession, lambda: repeated_lines(docs, key, text, distance, per).drop("version").distinct(), "repeated-lines")
    joined = every.join(found, ["key", "line_no", "h1", "h2"], "left")
    bare = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    return joined.select(
        bare("key").alias(key), "line_no", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("class_line", "line_no").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("kept", F.lit(True)).alias("kept"),
    ).withColumn("class_key", bare("class_key"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, per: int = PER) -> DataFrame:
    """docs without the lines that repeat an earlier one (by key, then line) exactly or within the edit distance.

    Blank lines stay. All columns of docs stay, whatever their names; a text of which nothing is left is empty.
    What goes is gathered for a key and a text together, so null and repeated keys gather no more than a text has.
    """
    dropped = settled(docs.sparkSession, lambda: repeated_lines(docs, key, text, distance, per).where("NOT kept"), "dropped-lines")
    k, v, gone = unused(docs, "k", "v", "gone")
    lists = dropped.groupBy(F.col("key").alias(k), F.col("version").alias(v)).agg(F.collect_set("line_no").alias(gone))
    keyed = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), v: F.xxhash64(text)})
    lines = F.split(F.col(text), "\n", -1)
    left = let(lines, lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone)), lambda i: F.get(all_, i)), "\n"))
    return keyed.join(lists, [k, v], "left").withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
