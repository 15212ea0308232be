"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates; only hashes of their values are aggregated over the
corpus. A value that many owners have is a widely copied example; one of few
owners that looks random is live-looking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklake.llm.common import if_small, let, unused, written


@dataclass(frozen=True)
class Kind:
    """A pattern; its value is a group of it that ends with the match. Matches with a shorter value are dropped."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: In the order of ties. The base kinds come first; the others are the method's own.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # runs of any length match as those of 16 or more: a run has no second start
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Kind("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{12,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 16),
    Kind("url", r"://[^\s:/@]{1,64}:([^\s:/@]{8,128})(?=@)", 1, 8),
)
#: Values that say themselves that they are none.
PLACEHOLDERS = r"(?i)example|change_?me|your|dummy|placeholder|xxxx|\*{4}|^(.)\1*$|12345678|abcdefgh"
MIN_DISTINCT = 6
#: A value of more owners, or in more repositories, than this is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 10


def _pieces(text: Column, rank: int, kind: Kind) -> Column:
    """The kind's matches in a text in order: how long what lies before each is, and what the match is, in code points and in bytes."""
    cut = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    value = lambda m: m if not kind.group else F.regexp_extract(m, ":([^:]*)$", 1) if kind.name == "url" else F.regexp_extract(m, kind.pattern, kind.group)

    def piece(x):
        return let(
            value(x["m"]),
            lambda v: F.struct(
                F.lit(rank).alias("rank"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size"), F.octet_length(x["p"]).alias("gap_bytes"), F.octet_length(x["m"]).alias("bytes"), F.octet_length(v).alias("value_bytes"),
                (F.char_length(v) >= kind.least).alias("counts"), F.unhex(F.sha2(v, 256)).alias("hash"), ((F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT) & ~v.rlike(PLACEHOLDERS)).alias("random"),
            ),
        )

    return F.when(text.rlike(kind.pattern), F.transform(F.filter(cut, lambda x: x["m"].isNotNull()), piece))


def joined(spans: str | Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: str | Column) -> list[Column]:
    """128 bits of a text; a null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit(1), whole).alias("d2")]


def find_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """row (a number of its own), key, owner, d1, d2 and matches of every row of docs, as a table in the shared folder; texts stay behind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(F.array(*[F.coalesce(x, F.expr("array()")) for x in (_pieces(whole, i, k) for i, k in enumerate(kinds))]))
    columns = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), *digest(text), found.alias("matches"))
    return written(columns, "secrets")


def placed(found: DataFrame) -> DataFrame:
    """A row per span: row, key, owner, d1, d2, rank, start, end, value_start and value_end (bytes), hash, random.

    A match begins after all gaps and matches of its kind before it: running sums over a text's own matches.
    """
    each = found.select("row", "key", "owner", "d1", "d2", F.posexplode("matches").alias("no", "m")).select("row", "key", "owner", "d1", "d2", "no", "m.*")
    before = Window.partitionBy("row", "rank").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.withColumns({"end": F.sum(F.col("gap") + F.col("size")).over(before), "value_end": F.sum(F.col("gap_bytes") + F.col("bytes")).over(before)})
    return summed.where("counts").select("row", "key", "owner", "d1", "d2", "rank", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("value_end") - F.col("value_bytes")).alias("value_start"), "value_end", "hash", "random")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos and n_owners of every candidate value; a row's key is its repository.

    Distinct (hash, owner, key) first, then counts by (hash, owner) and by hash: each step is aggregated before
    its shuffle, so a value that a third of all rows hold is few rows in each.
    """
    spread = found.select("key", "owner", F.inline("matches")).where("counts").select("hash", "owner", "key").distinct()
    by_owner = spread.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(found: DataFrame) -> DataFrame:
    """The spans with live: few owners and repositories have the value, and it looks random."""
    few = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= MAX_REPOS)
    return placed(found).join(ownership(found).select("hash", few.alias("few")), "hash").withColumn("live", F.col("few") & F.col("random")).drop("few")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """A row per row of docs: key, spans (start, rank, end, live; by start and kind) and, over distinct values, n_live and n_copied.

    A null or empty text has no spans and zeros. Null owners are one owner. Equal rows are copies of one
    repository. Other columns are left out.
    """
    found = find_matches(docs, key, text, owner, kinds)
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live")))
    counts = {name: F.countDistinct(F.when(F.col("live") == live, F.col("hash"))).alias(name) for name, live in (("n_live", True), ("n_copied", False))}
    by_row = judged(found).groupBy("row").agg(spans.alias("spans"), *counts.values())
    out = found.select("row", "key").join(by_row, "row", "left")
    none = F.expr("cast(array() AS array<struct<start:bigint,rank:int,end:bigint,live:boolean>>)")
    return out.select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"), *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def redact_live(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """docs with the values of live-looking credentials masked; widely copied examples and all else stay as they are.

    Values that overlap are masked as one. All columns of docs stay, whatever their names; null texts stay null.
    Where values stand follows from the text alone, so places and rows meet by the text's digest: neither null
    keys nor repeated ones meet as a group, and only texts with live values are looked up.
    """
    live = judged(find_matches(docs, key, text, owner)).where("live").select("d1", "d2", "value_start", "value_end").distinct()
    order = Window.partitionBy("d1", "d2").orderBy("value_start", "value_end")
    reached = F.max("value_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = live.withColumn("fresh", F.when(F.coalesce(F.col("value_start") >= reached, F.lit(True)), 1).otherwise(0)).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = parted.groupBy("d1", "d2", "part").agg(F.min("value_start").alias("a"), F.max("value_end").alias("b"))
    a, b, at = unused(docs, "d1", "d2", "places")
    places = written(merged.groupBy(F.col("d1").alias(a), F.col("d2").alias(b)).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias(at)), "places")
    columns = docs.columns
    marked = docs.withColumns(dict(zip((a, b), digest(text), strict=True))).join(if_small(places), [a, b], "left")

    def between(i):
        begin = F.coalesce(F.get(at, i - 1)["b"], F.lit(0))
        stop = F.coalesce(F.get(at, i)["a"], F.octet_length(F.col(text)).cast("long"))
        return F.substring(F.col(text).cast("binary"), (begin + 1).cast("int"), (stop - begin).cast("int")).cast("string")

    masked = F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), between), mask)
    return marked.withColumn(text, F.when(F.col(at).isNotNull(), masked).otherwise(F.col(text))).select(*columns)
