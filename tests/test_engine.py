"""The engine on Spark: tables, slices, sinks, filters, checks, streams."""

import hashlib
import lzma
import os
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blocklake.errors import XzLimitError
from blocklake.functions import checks
from blocklake.functions.arm64 import arm64
from blocklake.operators import alone, blocks, filters
from blocklake.operators.blocks import Options
from blocklake.sources import container, datasource, tables
from blocklake.streaming import files

DATA = b"".join(f"{i % 37} line {i} of text\n".encode() for i in range(20_000))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("xz")
    for name, data, step in (("a", DATA, 1 << 16), ("b", DATA[::-1], 1 << 17)):
        made = [container.encode_block(data[i : i + step], 4, Options(preset=1).chain(step)) for i in range(0, len(data), step)]
        stream = container.assemble([m[0] for m in made], [(m[1], m[2]) for m in made], 4)
        (root / f"{name}.xz").write_bytes(stream + bytes(8) + lzma.compress(b"tail") if name == "b" else stream)
    return str(root)


def test_tables_and_slices(spark, folder):
    listed = tables.files(spark, folder)
    streams = tables.xz_streams(listed).orderBy("path", "stream_no").collect()
    assert [s["stream_no"] for s in streams] == [0, 0, 1] and streams[1]["padding_after"] == 8
    located = blocks.located(tables.xz_blocks(listed)).cache()
    assert located.groupBy("path").agg(F.sum("uncompressed_size").alias("n")).orderBy("path").first()["n"] == len(DATA)
    path = streams[0]["path"]
    r = random.Random(1)
    asked = [(path, str(i), r.randrange(len(DATA) + 50), 200_000 if i == 0 else r.randrange(1, 9000)) for i in range(40)]
    got = {x["request_id"]: bytes(x["data"]) for x in blocks.read_slices(located, spark.createDataFrame(asked, "path string, request_id string, position long, length long")).collect()}
    assert got == {i: DATA[p : p + n] for _, i, p, n in asked}
    assert blocks.index_mismatches(located, blocks.decode(located)).count() == 0
    with pytest.raises(XzLimitError):
        blocks.check_limit(located, 1000)
    blocks.check_limit(located, len(DATA) + 4)


def test_pruning_is_in_the_plan(spark, folder):
    located = blocks.located(tables.xz_blocks(tables.files(spark, folder)))
    kept = blocks.decode(located.where("block_no = 1"))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("block_no") and "Filter" in plan


def test_bytes_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, DATA[: 1000 * i]) for i in range(8)], "id long, data binary")
    options = Options(preset=1, block_size=700)
    one = blocks.compress(df.coalesce(1), "id", "data", options).orderBy("id").collect()
    many = blocks.compress(df.repartition(7), "id", "data", options).orderBy("id").collect()
    assert one == many and [lzma.decompress(x["content"]) for x in one] == [DATA[: 1000 * i] for i in range(8)]


def test_blocks_are_dealt_over_tasks(spark):
    """Of one value many tasks encode and decode blocks, and put it together again."""
    df = spark.createDataFrame([(1, DATA)], "id long, data binary")
    options = Options(preset=1, block_size=5000)
    made = blocks.encode_blocks(df, "id", "data", options)
    assert made.select(F.spark_partition_id()).distinct().count() == 4
    packed = blocks.compress(df, "id", "data", options).select(F.col("id").cast("string").alias("path"), "content")
    data = blocks.decode(blocks.located(tables.xz_blocks(packed)), contents=packed)
    assert data.select(F.spark_partition_id()).distinct().count() == 4
    assert b"".join(bytes(x["data"]) for x in data.orderBy("block_no").collect()) == DATA


def test_slices_over_many_strides(spark):
    located = spark.createDataFrame([("p", 0, i, 70 * i, 70) for i in range(40)], "path string, stream_no int, block_no int, uncompressed_offset long, uncompressed_size long")
    r = random.Random(2)
    asked = [("p", str(i), r.randrange(3000), r.choice((0, 1, 5, 400))) for i in range(60)]
    want = sorted((i, b, max(p - 70 * b, 0), min(p + n, 70 * b + 70) - max(p, 70 * b)) for _, i, p, n in asked for b in range(40) if n and p < 70 * b + 70 and p + n > 70 * b)
    for stride in (16, 100, 1 << 20):
        got = blocks.seek(located, spark.createDataFrame(asked, "path string, request_id string, position long, length long"), stride)
        assert sorted(tuple(x) for x in got.select("request_id", "block_no", "piece_start", "piece_length").collect()) == want


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(("a", "b", None)), r.randrange(-50, 50), r.randrange(9)) for _ in range(200)]
    got = blocks.running_sum(spark.createDataFrame(rows, "g string, o long, v long"), "g", "o", "v", 8).collect()
    assert sorted(map(str, ((x["g"], x["o"], x["v"], x["running"]) for x in got))) == sorted(map(str, ((g, o, v, sum(c for a, b, c in rows if a == g and b <= o)) for g, o, v in rows)))


def test_lost_index(spark):
    whole = container.assemble(*(lambda made: ([m[0] for m in made], [(m[1], m[2]) for m in made], 4))([Options(preset=1).encode(DATA[i : i + 9000]) for i in range(0, 90_000, 9000)]))
    df = spark.createDataFrame([("cut", whole[: len(whole) * 2 // 3])], "path string, content binary")
    found = tables.lost_blocks(df).withColumn("uncompressed_offset", F.lit(0).cast("long"))
    data = b"".join(bytes(x["data"]) for x in blocks.decode(found, contents=df).orderBy("block_no").collect())
    assert data == DATA[: len(data)] and len(data) >= 45_000 and len(data) % 9000 == 0


def test_strict_and_permissive(spark):
    good = lzma.compress(b"x" * 100)
    df = spark.createDataFrame([("good", good), ("cut", good[:-1]), ("magic", b"\x00" + good[1:]), ("empty", b"")], "path string, content binary")
    found = {r["path"]: r["error"] for r in blocks.validation(df).collect()}
    assert found["good"] is None and found["magic"] == "format" and found["cut"] in ("format", "data") and found["empty"] == "data"
    assert {r["path"]: r["error"] is None for r in tables.xz_blocks(df, strict=False).collect()} == {"good": True, "cut": False, "magic": False, "empty": False}
    assert blocks.validation(df.where("path = 'good'"), limit=50).first()["error"] == "limit"
    assert df.select(blocks.xz_decompress(F.col("content"), strict=False).alias("d")).where("d IS NULL").count() == 3
    with pytest.raises(Exception, match="XzDataError|XzFormatError"):
        df.select(blocks.xz_decompress(F.col("content"))).collect()


def test_format(spark, folder, tmp_path):
    datasource.register(spark)
    df = spark.read.format("xz").load(folder)
    assert df.where("block_no >= 2").union(df.where("block_no < 2")).count() == df.count()  # used twice, filtered differently
    assert df.count() > 10
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, bytes([65 + i]) * 5000) for i in range(6)], "i int, data binary").repartitionByRange(3, "i").sortWithinPartitions("i")
    rows.select("data").write.format("xz").mode("append").option("preset", "1").save(out)
    parts = sorted(os.listdir(out))
    assert "_temporary" not in parts and b"".join(lzma.open(f"{out}/{p}").read() for p in parts) == b"".join(bytes([65 + i]) * 5000 for i in range(6))
    assert spark.read.format("xz").load(out).count() == 6
    with pytest.raises(Exception, match="allowed"):
        spark.read.format("xz").option("maxOutputSize", "10").load(out).count()
    parts = spark.read.format("xz").option("splitSize", "3000").load(folder)  # a file's blocks over many tasks
    rows_of = lambda d: sorted((x["path"], x["stream_no"], x["block_no"], x["uncompressed_offset"], bytes(x["data"])) for x in d.collect())
    assert parts.rdd.getNumPartitions() > 10 and rows_of(parts) == rows_of(df)
    nested = f"{out}/deeper/part"
    os.makedirs(nested)
    rows.select("data").coalesce(1).write.format("xz").mode("append").option("preset", "1").option("blockSize", "7000").option("dictSize", "8192").option("extreme", "true").save(nested)
    (made,) = [f for f in os.listdir(nested) if f.endswith(".xz")]
    cut = tables.xz_blocks(tables.files(spark, f"{nested}/{made}")).orderBy("block_no").collect()
    assert [b["uncompressed_size"] for b in cut] == [7000] * 4 + [2000] and {b["dict_size"] for b in cut} <= {4096, 8192} and lzma.open(f"{nested}/{made}").read() == b"".join(bytes([65 + i]) * 5000 for i in range(6))
    assert spark.read.format("xz").load(out).count() == 6 + 5 and spark.read.format("xz").load(f"{out}/part-*.xz").count() == 6 and spark.read.format("xz").load(f"{out}/*/*/*.xz").count() == 5


def test_checks(spark):
    def slow(data, crc=0):
        crc ^= 2**64 - 1
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (checks.POLYNOMIAL if crc & 1 else 0)
        return crc ^ (2**64 - 1)

    assert checks.crc64_of(b"123456789") == 0x995DC9BBDF1939FA and checks.crc64_of(b"") == 0
    r = random.Random(4)
    values = [r.randbytes(n) for n in [*range(0, 40), 255, 256, 257, 511, 512, 513, 1031, 2048, 5000]]
    assert checks.crc64_many(values).tolist() == [slow(v) for v in values] and checks.crc64_many([]).tolist() == []
    for data in values:
        n = len(data)
        assert checks.crc64_of(data[n // 3 :], checks.crc64_of(data[: n // 3])) == slow(data) == checks.combine(slow(data[: n // 2]), slow(data[n // 2 :]), n - n // 2)
    row = spark.createDataFrame([(b"123456789",), (b"\x00",), (None,)], "d binary").select(checks.crc32(F.col("d")).alias("a"), checks.crc64(F.col("d")).alias("b")).collect()
    assert row[0]["a"] == 0xCBF43926 and row[1]["a"] == 0xD202EF8D and row[0]["b"] == "995dc9bbdf1939fa" and row[2]["b"] is None


@pytest.mark.parametrize("name", ["delta", "arm64", "x86", "powerpc", "ia64", "arm", "armthumb", "sparc"])
def test_filters_undo_themselves(spark, name):
    r = random.Random(8)
    values = [r.randbytes(n) for n in (0, 1, 3, 4, 7, 4096, 10_001)] + [b"".join(r.choice((b"\x94", b"\x97", b"\x90", b"\xb0")).rjust(4, bytes([r.randrange(256)])) for _ in range(500))]
    df = spark.createDataFrame([(v,) for v in values], "d binary")
    out = df.select("d", filters.byte_filter(F.col("d"), name, True, 4, 4096).alias("e")).select("d", "e", filters.byte_filter(F.col("e"), name, False, 4, 4096).alias("back")).collect()
    assert all(x["d"] == x["back"] and len(x["d"]) == len(x["e"]) for x in out)
    if name == "delta":
        assert all(bytes(x["e"]) == bytes((x["d"][i] - (x["d"][i - 4] if i >= 4 else 0)) % 256 for i in range(len(x["d"]))) for x in out)


def test_arm64_addresses():
    call = (0x94000001).to_bytes(4, "little")
    assert arm64(bytes(4) + call, 0, True)[4:] == (0x94000002).to_bytes(4, "little")
    page = lambda n: (0x90000003 | (n & 3) << 29 | (n >> 2 & 0x7FFFF) << 5).to_bytes(4, "little")  # ADRP x3, n pages on
    assert arm64(page(7), 0x5000, True) == page(12) and arm64(page(12), 0x5000, False) == page(7)
    far = page(1 << 18)  # beyond 512 MiB: left alone
    assert arm64(far, 0x5000, True) == far and arm64(b"abc", 0, True) == b"abc"


def test_lzma_alone(spark):
    values = [b"", b"a", DATA[:10_000], DATA]
    out = spark.createDataFrame([(v,) for v in values], "d binary").select("d", alone.lzma_compress(F.col("d")).alias("c"))
    rows = alone.lzma_headers(out, "c").select("*", alone.lzma_decompress(F.col("c")).alias("back")).collect()
    assert all(x["d"] == x["back"] for x in rows) and rows[2]["dict_size"] == 16_384 and int(rows[3]["declared_size"]) == len(DATA)
    unknown = lzma.compress(DATA, lzma.FORMAT_ALONE)
    assert alone._decode(unknown, None) == DATA and alone._decode(unknown, len(DATA)) == DATA
    for bad, limit in ((unknown, 100), (unknown[:-20], None), (unknown[:5], None), (b"\xe1" + unknown[1:], None), (bytes(rows[3]["c"]), 10)):
        with pytest.raises(Exception):
            alone._decode(bad, limit)


def test_stream(spark, folder, tmp_path):
    q = files.with_progress(files.stream_files(spark, folder)).select("path", F.sha2("data", 256).alias("sha")).writeStream.format("memory").queryName("xz_files").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    got = {os.path.basename(r["path"]): r["sha"] for r in spark.sql("SELECT * FROM xz_files").collect()}
    assert got == {"a.xz": hashlib.sha256(DATA).hexdigest(), "b.xz": hashlib.sha256(DATA[::-1] + b"tail").hexdigest()}


def test_batches_are_read_in_parts():
    """Of a large batch, Python holds the objects and results of a few rows at a time."""

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    content = container.assemble([], [], 4)
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(1000)], "content": [content] * 1000})
    found = list(tables.xz_streams(Frame())(iter([batch])))
    assert max(b.num_rows for b in found) <= tables.PART and [x for b in found for x in b["path"].to_pylist()] == batch["path"].to_pylist()

    seen = []
    run = blocks.by_value(lambda v: seen.append(v) or v).func
    values = pa.array([b"a", None, b""] * 400, pa.binary())
    made = run(iter([values, values[:0], values[:5]]))
    assert len(next(made)) == len(seen) == tables.PART
    assert sum(map(len, made)) + tables.PART == len(seen) == 1205


def test_delta_expressions_find_each_byte_once(spark):
    """As a loop over bytes, and in less than half the time of cutting every byte out of the value twice."""
    values = [None, b"", b"\0", b"\xff", b"\0\0\0", bytes(range(256)), b"\x80" * 5, bytes(range(255, -1, -1)) * 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, data binary")
    for d in (1, 2, 7, 256):
        got = {r["i"]: r["c"] for r in df.select("i", filters.delta_column(F.col("data"), d).alias("c")).collect()}
        assert [got[i] if got[i] is None else bytes(got[i]) for i in range(len(values))] == [v if v is None else bytes((x - (v[j - d] if j >= d else 0)) % 256 for j, x in enumerate(v)) for v in values]

    long = spark.createDataFrame([(bytes(range(256)) * 800,)], "data binary").coalesce(1)
    data = F.col("data")
    byte = lambda i: F.when(i > 0, F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")).otherwise(0)
    twice = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.lpad(F.hex(F.pmod(byte(i) - byte(i - 2), F.lit(256))), 2, "0")), ""))

    def seconds(column):
        df, out = long.select(F.sha2(column, 256).alias("h")), []
        for _ in range(2):
            began = time.perf_counter()
            h = df.first()["h"]
            out.append(time.perf_counter() - began)
        return min(out), h

    (new, a), (old, b) = seconds(filters.delta_column(data, 2)), seconds(twice)
    assert a == b and 2 * new < old


def test_parts_are_light():
    """128 large values are not held at once; rows and their order stay."""
    values = [bytes([i]) * (300_000 if i % 2 else 10) for i in range(200)] + [bytes(3 << 20)]
    for batch in (pa.array(values), pa.RecordBatch.from_arrays([pa.array([[{"raw": v}] for v in values])], ["blocks"])):
        found = list(tables.parts(batch))
        assert sum([len(p) for p in found]) == len(values) and all(len(p) == 1 or p.nbytes <= tables.PART_BYTES for p in found)
        assert [x for p in found for x in p.to_pylist()] == batch.to_pylist()
    assert [len(p) for p in tables.parts(pa.array(range(300)))] == [128, 128, 44]


def test_filters_hold_little_of_a_batch(spark, monkeypatch):
    """What the ARM filter's worker holds as Python's objects does not grow with the rows of a batch (here one, of 8 or 32 MB)."""
    plain = filters._branch

    def traced(v, *how):
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        coded = plain(v, *how)
        peak = tracemalloc.get_traced_memory()[1]
        if v[0] == 2:  # the last row: workers live on
            tracemalloc.stop()
        return coded + peak.to_bytes(8, "big")

    def most(rows: int) -> int:
        first = F.when(F.col("id") == rows - 1, F.lit(b"\2")).otherwise(F.lit(b"\1"))
        values = spark.range(0, rows, 1, 1).select(F.concat(first, F.encode(F.repeat(F.lit("\x01\x02\x03k"), 4096), "ISO-8859-1")).alias("d"))
        peaks = [int(r["p"], 16) for r in values.select(F.hex(F.substring(filters.byte_filter(F.col("d"), "arm"), -8, 8)).alias("p")).collect()]
        assert len(peaks) == rows
        return max(peaks)

    monkeypatch.setattr(filters, "_branch", traced)  # pickled with the filter
    few, many = most(500), most(2000)
    assert many < 8 << 20 and many < 1.5 * few
