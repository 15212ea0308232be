"""Compressing by blocks, decoding only the blocks that are needed, and what lies between.

Values are cut into blocks in the JVM, blocks are dealt over all tasks to be encoded
or decoded, and a value's stream is put together from its sorted blocks. Sizes of
blocks follow from the data and the options alone, so the bytes never depend on how
many partitions or executors there were.
"""

from __future__ import annotations

import lzma
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklake.errors import XzError, XzLimitError
from blocklake.functions import sizes
from blocklake.functions.arm64 import arm64
from blocklake.functions.checks import check_of
from blocklake.sources import container
from blocklake.sources.tables import parts, range_reader

RAW_IDS = {"x86": 4, "powerpc": 5, "ia64": 6, "arm": 7, "armthumb": 8, "sparc": 9}


@dataclass(frozen=True)
class Options:
    """How to compress. dict_size and block_size None: from the preset and each value's length."""

    preset: int = 6
    extreme: bool = False
    check: str = "crc64"
    dict_size: int | None = None
    block_size: int | None = None
    filter: str | None = None
    delta_distance: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.preset <= 9:
            raise ValueError("preset is 0 to 9")
        if self.check not in container.CHECKS:
            raise ValueError(f"check is one of {', '.join(container.CHECKS)}")
        if self.dict_size is not None and not 4096 <= self.dict_size <= 1536 << 20:
            raise ValueError("dict_size is 4 KiB to 1.5 GiB")
        if self.block_size is not None and self.block_size < 1:
            raise ValueError("block_size is positive")
        if self.filter not in (None, "delta", "arm64", *RAW_IDS):
            raise ValueError(f"filter is delta, arm64 or one of {', '.join(RAW_IDS)}")
        if not 1 <= self.delta_distance <= 256:
            raise ValueError("delta_distance is 1 to 256")

    def chain(self, length: int) -> list[dict]:
        """The filters for a block of a length; the dictionary is never larger than it needs to be."""
        most = self.dict_size or sizes.PRESETS[self.preset][1] * 1024
        last = {"id": lzma.FILTER_LZMA2, "preset": self.preset | (lzma.PRESET_EXTREME if self.extreme else 0), "dict_size": min(max(length, 4096), most)}
        if self.filter == "delta":
            return [{"id": lzma.FILTER_DELTA, "dist": self.delta_distance}, last]
        return [{"id": RAW_IDS[self.filter]}, last] if self.filter in RAW_IDS else [last]

    def encode(self, data: bytes) -> tuple[bytes, int, int]:
        """A block of data and its sizes. The library has no ARM64 filter to write with: that block is put together here."""
        number = container.CHECKS[self.check]
        if self.filter != "arm64":
            return container.encode_block(data, number, self.chain(len(data)))
        chain = self.chain(len(data))
        packed = lzma.compress(arm64(data, 0, True), lzma.FORMAT_RAW, filters=chain)
        props = bytes((container.dict_code(chain[-1]["dict_size"]),))
        return container.build_block(packed, [(container.FILTERS["arm64"], b""), (container.FILTERS["lzma2"], props)], check_of(data, number), len(data))

    def block_bytes(self, length: Column) -> Column:
        if self.block_size:
            return F.lit(self.block_size)
        return sizes.default_block(F.least(F.greatest(length, F.lit(4096)), F.lit(self.dict_size or sizes.PRESETS[self.preset][1] * 1024)))


def by_value(one: Callable[[object], object], kind: str = "binary") -> Callable[[Column | str], Column]:
    """A column function that applies one to each value, a few values of a batch at a time."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(batch):
                yield pa.array([one(v) for v in part.to_pylist()], pa.binary() if kind == "binary" else pa.string())

    return run


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all shuffle partitions by columns. The number is given, or adaptive execution would join small partitions whose rows take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def plan_blocks(df: DataFrame, key: str, data: str | None, block: Column, length: Column | None = None) -> DataFrame:
    """key, block_no, block_offset, block_length: where each value is cut. An empty value has no block."""
    n = length if length is not None else F.octet_length(data)
    cut = df.select(F.col(key), n.cast("long").alias("n"), block.cast("long").alias("b"), *([F.col(data).alias("data")] if data else []))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("b"))).otherwise(F.expr("cast(array() AS array<bigint>)"))
    placed = cut.select("*", F.posexplode(starts).alias("block_no", "block_offset"))
    return placed.select(key, "block_no", "block_offset", F.least("b", F.col("n") - F.col("block_offset")).alias("block_length"), *(["data"] if data else []))


def encode_blocks(df: DataFrame, key: str, data: str, options: Options) -> DataFrame:
    """key, block_no, unpadded_size, uncompressed_size and raw of every block; the blocks of one value are dealt over all tasks."""
    planned = plan_blocks(df, key, data, options.block_bytes(F.octet_length(data)))
    blocks = planned.select(F.col(key), "block_no", F.expr("substring(data, cast(block_offset + 1 AS int), cast(block_length AS int))").alias("piece"))

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            encoded = [options.encode(piece) for piece in batch.column(2).to_pylist()]
            raw, unpadded, size = zip(*encoded, strict=True) if encoded else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unpadded, pa.int64()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], ["k", "block_no", "unpadded_size", "uncompressed_size", "raw"])

    kind = df.schema[key].dataType.simpleString()
    return spread(blocks, key, "block_no").mapInArrow(run, f"k {kind}, block_no int, unpadded_size long, uncompressed_size long, raw binary").withColumnRenamed("k", key)


def assemble_streams(keys: DataFrame, blocks: DataFrame, key: str, check: str) -> DataFrame:
    """key and content: a stream per key from its blocks in order; a key without blocks gets an empty stream."""
    lists = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", "unpadded_size", "uncompressed_size", "raw"))).alias("blocks"))
    number = container.CHECKS[check]

    def joined(bs):
        return container.assemble([b["raw"] for b in bs or ()], [(b["unpadded_size"], b["uncompressed_size"]) for b in bs or ()], number)

    return keys.select(key).join(lists, key, "left").select(key, by_value(joined)("blocks").alias("content"))


def compress(df: DataFrame, key: str, data: str, options: Options | None = None) -> DataFrame:
    """key and content (.xz) of every value, block by block over all tasks. Keys are unique; a null value counts as empty."""
    options = options or Options()
    filled = df.select(key, F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    return assemble_streams(filled, encode_blocks(filled, key, "data", options), key, options.check)


def xz_compress(column: Column, options: Options | None = None) -> Column:
    """A value as one .xz stream of its own, for many values of moderate size. Null stays null."""
    chosen = options or Options()

    def one(v):
        if v is None:
            return None
        step = chosen.block_size or max(2 * min(max(len(v), 4096), chosen.dict_size or sizes.PRESETS[chosen.preset][1] * 1024), 1 << 20)
        blocks = [chosen.encode(v[i : i + step]) for i in range(0, len(v), step)]
        return container.assemble([b[0] for b in blocks], [(b[1], b[2]) for b in blocks], container.CHECKS[chosen.check])

    return by_value(one)(column.cast("binary"))


def xz_decompress(column: Column, limit: int | None = None, strict: bool = True) -> Column:
    """The data of a value of one or more .xz streams. Damaged values raise, or are null if not strict."""

    def one(v):
        try:
            return None if v is None else container.decode_all(v, limit)
        except XzError:
            if strict:
                raise
            return None

    return by_value(one)(column)


def validation(df: DataFrame, content: str = "content", limit: int | None = None) -> DataFrame:
    """df with error: the kind of failure (format, data, limit, base) of reading a value, null if it reads well."""

    def one(v):
        try:
            container.decode_all(v or b"", limit)
        except XzError as e:
            return {"XzFormatError": "format", "XzDataError": "data", "XzLimitError": "limit"}.get(type(e).__name__, "base")
        return None

    return df.withColumn("error", by_value(one, "string")(content))


def located(blocks: DataFrame) -> DataFrame:
    """Blocks with uncompressed_offset, the running sum of the sizes before them in their file."""
    before = Window.partitionBy("path").orderBy("stream_no", "block_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("uncompressed_offset", F.coalesce(F.sum("uncompressed_size").over(before), F.lit(0)))


def running_sum(df: DataFrame, group: str, order: str, value: str, stride: int = 4096) -> DataFrame:
    """df with running, the sum of value over the rows of a group up to each by an integer order (ties together).

    A group is summed by strides of the order first; only these sums, far fewer than rows, meet in one task.
    """
    placed = df.withColumn("stride", F.floor(F.col(order) / stride))
    sums = placed.groupBy(group, "stride").agg(F.sum(value).alias("total"))
    before = Window.partitionBy(group).orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col(group).alias("group_"), F.col("stride").alias("stride_"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    joined = placed.join(begins, F.col(group).eqNullSafe(F.col("group_")) & (F.col("stride") == F.col("stride_")))
    own = F.sum(value).over(Window.partitionBy(group, "stride").orderBy(order))
    return joined.withColumn("running", F.col("begin") + own).drop("stride", "group_", "stride_", "begin")


def check_limit(blocks: DataFrame, limit: int) -> None:
    """Raises XzLimitError if a file's blocks hold more than a limit; reads sizes only and decodes nothing."""
    over = blocks.groupBy("path").agg(F.sum("uncompressed_size").alias("total")).where(F.col("total") > limit).orderBy("path").take(1)
    if over:
        raise XzLimitError(f"{over[0]['path']}: {over[0]['total']} bytes, {limit} allowed")


def decode(blocks: DataFrame, limit: int | None = None, contents: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, stream_no, block_no, uncompressed_offset, carry and data of the blocks that are left of a located block table.

    The blocks of one file are dealt over all tasks, and each reads the byte ranges of its own only. With contents
    (path, content) they are cut out there first, so no task holds a value beside its blocks.
    """
    names = ("path", "stream_no", "block_no", "uncompressed_offset", *carry)
    rows = blocks.select(*names, "compressed_offset", "padded_size", "unpadded_size", "uncompressed_size", "check_type")
    if contents is not None:
        piece = F.expr("substring(content, cast(compressed_offset + 1 AS int), cast(padded_size AS int))")
        rows = rows.join(contents.select("path", "content"), "path").select(*rows.columns, piece.alias("raw"))

    rows = spread(rows, "path", "stream_no", "block_no")

    def run(batches):
        reader, last = None, None
        for batch in (part for whole in batches for part in parts(whole)):
            data = []
            for row in batch.select(batch.schema.names[len(names) :] + ["path"]).to_pylist():
                if "raw" in row:
                    raw = row["raw"]
                else:
                    if row["path"] != last:
                        reader, last = range_reader(row["path"])[0], row["path"]
                    raw = reader(row["compressed_offset"], row["padded_size"])
                data.append(container.decode_block(raw, row["check_type"], row["unpadded_size"], row["uncompressed_size"], limit))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(data, pa.binary())], [*names, "data"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, data binary")


def seek(blocks: DataFrame, requests: DataFrame, stride: int = 1 << 20) -> DataFrame:
    """The blocks that requests (path, request_id, position, length) touch, with request_id and the part of each.

    Requests and blocks meet by path and by the strides of the data that they reach into, so a file with many of
    both is no product of them; a pair counts in the first stride that both have. Positions past the end touch nothing.
    """
    end = F.col("uncompressed_offset") + F.col("uncompressed_size")
    stop = F.col("position") + F.col("length")
    strides = lambda a, b: F.explode(F.sequence(F.floor(a / stride), F.floor((b - 1) / stride)))
    placed = blocks.where("uncompressed_size > 0").withColumn("stride", strides(F.col("uncompressed_offset"), end))
    asked = requests.where("length > 0").withColumn("stride", strides(F.col("position"), stop))
    met = placed.join(asked, ["path", "stride"]).where((F.col("position") < end) & (stop > F.col("uncompressed_offset")))
    met = met.where(F.col("stride") == F.floor(F.greatest("position", "uncompressed_offset") / stride)).drop("stride")
    first = F.greatest(F.col("position") - F.col("uncompressed_offset"), F.lit(0))
    return met.withColumns({"piece_start": first, "piece_length": F.least(stop, end) - F.col("uncompressed_offset") - first})


def read_slices(blocks: DataFrame, requests: DataFrame, limit: int | None = None, contents: DataFrame | None = None) -> DataFrame:
    """request_id and data of every request; each touched block is decoded once, however many requests it serves."""
    touched = seek(blocks, requests)
    needed = blocks.join(touched.select("path", "stream_no", "block_no").distinct(), ["path", "stream_no", "block_no"], "left_semi")
    pieces = touched.select("request_id", "path", "stream_no", "block_no", "piece_start", "piece_length").join(decode(needed, limit, contents), ["path", "stream_no", "block_no"])
    cut = pieces.select("request_id", "uncompressed_offset", F.expr("substring(data, cast(piece_start + 1 AS int), cast(piece_length AS int))").alias("piece"))
    parts = cut.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("uncompressed_offset", "piece"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["piece"]))
    return requests.select("request_id").join(parts, "request_id", "left").select("request_id", F.coalesce(whole, F.lit(b"")).alias("data"))


def index_mismatches(indexed: DataFrame, decoded: DataFrame) -> DataFrame:
    """Blocks where the index and the decoded data differ, or that only one of them has; none if a file is sound."""
    keys = ["path", "stream_no", "block_no"]
    seen = decoded.select(*keys, F.octet_length("data").cast("long").alias("decoded_size"))
    both = indexed.select(*keys, F.col("uncompressed_size").alias("indexed_size")).join(seen, keys, "full")
    return both.where(~F.col("indexed_size").eqNullSafe(F.col("decoded_size")))
