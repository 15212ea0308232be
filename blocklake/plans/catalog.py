"""Named queries over the engine's own operators, with the SQL of the same results on the raw tables.

Compression loses nothing, so a query over data that went through the codec must
give what plain SQL gives over the tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklake.functions import checks, sizes
from blocklake.operators import alone, blocks, filters
from blocklake.operators.blocks import Options
from blocklake.sources import container, tables

BLOCK = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


def _archives(spark: SparkSession, sf_dir: str, options: Options = Options(preset=0, block_size=BLOCK)) -> DataFrame:
    """path and content: every document's text as .xz in memory, under its id as path."""
    return blocks.compress(_texts(spark, sf_dir), "doc_id", "data", options).select(F.col("doc_id").cast("string").alias("path"), "content", "doc_id")


def _through(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    packed = _table(spark, sf_dir, "documents").withColumn("packed", blocks.xz_compress(F.col("text"), options))
    return packed.withColumn("data", blocks.xz_decompress(F.col("packed")))


FAST = Options(preset=0)


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def roundtrip_hash(spark, sf_dir):
    return _through(spark, sf_dir, FAST).select("doc_id", F.sha2("data", 256).alias("sha"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def roundtrip_agg(spark, sf_dir):
    return _through(spark, sf_dir, FAST).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length(F.col("data").cast("string"))).alias("n_chars"))


@query("SELECT conv_id, turn, sha256(text) AS sha FROM conversations")
def roundtrip_blocks(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text").select(F.to_json("k").alias("k"), "text", "k.conv_id", "k.turn")
    packed = blocks.compress(turns, "k", "text", Options(preset=1, block_size=256, check="sha256"))
    return packed.join(turns.select("k", "conv_id", "turn"), "k").select("conv_id", "turn", F.sha2(blocks.xz_decompress(F.col("content")), 256).alias("sha"))


PLAN_SQL = f"""SELECT doc_id, CAST(i AS INTEGER) AS block_no, i * {BLOCK} AS block_offset, least({BLOCK}, strlen(text) - i * {BLOCK}) AS block_length
FROM documents, generate_series(0, greatest((SELECT max(strlen(text)) FROM documents) // {BLOCK}, 0)) AS g(i) WHERE i * {BLOCK} < strlen(text)"""


@query(PLAN_SQL)
def block_plan(spark, sf_dir):
    return blocks.plan_blocks(_texts(spark, sf_dir), "doc_id", "data", F.lit(BLOCK)).drop("data")


@query(f"SELECT doc_id, block_no, block_length, coalesce(sum(block_length) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS uncompressed_offset FROM ({PLAN_SQL})")
def block_offsets(spark, sf_dir):
    """From the indexes of the written streams, not from the plan."""
    found = blocks.located(tables.xz_blocks(_archives(spark, sf_dir)))
    return found.select(F.col("path").cast("long").alias("doc_id"), "block_no", F.col("uncompressed_size").alias("block_length"), "uncompressed_offset")


@query(f"SELECT doc_id, CAST(ceil(strlen(text) / {BLOCK}.0) AS INTEGER) AS block_count, strlen(text) AS uncompressed_size, 'crc64' AS check_name FROM documents")
def stream_table(spark, sf_dir):
    return tables.xz_streams(_archives(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "block_count", "uncompressed_size", "check_name")


@query("SELECT count(*) AS headers, count(*) AS sound, 4 AS check_type FROM documents")
def header_scan(spark, sf_dir):
    return tables.stream_headers(_archives(spark, sf_dir)).agg(F.count("*").alias("headers"), F.count_if("header_ok").alias("sound"), F.max("check_type").alias("check_type"))


def _requests(spark, sf_dir):
    """Three places in every document: its start, its middle and near its end."""
    n = F.octet_length("text").cast("long")
    at = F.explode(F.array(F.lit(0).cast("long"), F.floor(n / 2), F.greatest(n - 100, F.lit(0)))).alias("position")
    found = _table(spark, sf_dir, "documents").select("doc_id", at).distinct()
    return found.select(F.col("doc_id").cast("string").alias("path"), F.concat_ws("-", "doc_id", "position").alias("request_id"), "position", F.lit(700).cast("long").alias("length"))


REQUESTS_SQL = "(SELECT DISTINCT doc_id, unnest([0, strlen(text) // 2, greatest(strlen(text) - 100, 0)]) AS position FROM documents)"


@query(f"SELECT r.doc_id || '-' || r.position AS request_id, p.block_no FROM {REQUESTS_SQL} r JOIN ({PLAN_SQL}) p ON r.doc_id = p.doc_id AND r.position >= p.block_offset AND r.position < p.block_offset + p.block_length")
def seek_lookup(spark, sf_dir):
    """The block that holds each position: a range join on the block table."""
    found = blocks.seek(blocks.located(tables.xz_blocks(_archives(spark, sf_dir))), _requests(spark, sf_dir).withColumn("length", F.lit(1).cast("long")))
    return found.select("request_id", "block_no")


@query(f"SELECT r.doc_id || '-' || r.position AS request_id, sha256(encode(d.text)[r.position + 1 : r.position + 700]) AS sha FROM {REQUESTS_SQL} r JOIN documents d ON r.doc_id = d.doc_id")
def slice_read(spark, sf_dir):
    packed = _archives(spark, sf_dir)
    return blocks.read_slices(blocks.located(tables.xz_blocks(packed)), _requests(spark, sf_dir), contents=packed).select("request_id", F.sha2("data", 256).alias("sha"))


@query("SELECT a.doc_id, sha256(a.text || '/' || b.text) AS sha, 2 AS streams FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def concat_streams(spark, sf_dir):
    """Two streams with four bytes of padding between them read as one value."""
    packed = _table(spark, sf_dir, "documents").select("doc_id", blocks.xz_compress(F.col("text"), FAST).alias("content"), blocks.xz_compress(F.concat(F.lit("/"), "text"), FAST).alias("second"))
    after = packed.select((F.col("doc_id") - 1).alias("doc_id"), F.col("second"))
    both = packed.drop("second").join(after, "doc_id").select("doc_id", F.concat("content", F.lit(bytes(4)), "second").alias("content"))
    data = both.select("doc_id", F.sha2(blocks.xz_decompress(F.col("content")), 256).alias("sha"))
    count = tables.xz_streams(both.select(F.col("doc_id").cast("string").alias("path"), "content")).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("streams"))
    return data.join(count, "doc_id")


@query("SELECT doc_id, running, running <= 100000 AS allowed FROM (SELECT doc_id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents)")
def limit_screen(spark, sf_dir):
    """Which values fit a limit, from the indexes alone."""
    total = tables.xz_streams(_archives(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "uncompressed_size")
    found = total.join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    summed = blocks.running_sum(found, "source", "doc_id", "uncompressed_size")
    return summed.select("doc_id", "running", (F.col("running") <= 100_000).alias("allowed"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS n_values FROM documents")
def index_check(spark, sf_dir):
    """The index against the decoded blocks: no difference, and every value read without an error."""
    packed = _archives(spark, sf_dir)
    located = blocks.located(tables.xz_blocks(packed))
    bad = blocks.index_mismatches(located, blocks.decode(located, contents=packed)).select(F.lit(1).alias("bad"))
    good = blocks.validation(packed).where("error IS NULL").select(F.lit(0).alias("bad"))
    return bad.union(good).agg(F.count_if(F.col("bad") == 1).alias("mismatches"), F.count_if(F.col("bad") == 0).alias("n_values"))


@query("SELECT kind, error, count(*) AS n FROM documents, (VALUES ('magic', 'format'), ('footer', 'format'), ('index', 'data'), ('cut', 'format'), ('none', NULL), ('bomb', 'limit')) AS k(kind, error) GROUP BY ALL")
def damage_check(spark, sf_dir):
    """Each kind of damage gives its kind of error: magic bytes gone, a checksum of the index changed, a value cut off, a size above a limit."""
    content, n = F.col("content"), F.octet_length("content")
    part = lambda start, size: F.substring(content, start, size)
    index = n - 12  # the last byte of the index's checksum
    turned = F.unhex(F.lpad(F.hex(F.pmod(F.conv(F.hex(part(index, F.lit(1))), 16, 10).cast("int") + 1, F.lit(256))), 2, "0"))
    damaged = {
        "magic": F.concat(F.lit(b"\x00"), part(F.lit(2), n)), "footer": F.concat(part(F.lit(1), n - 1), F.lit(b"\x00")),
        "index": F.concat(part(F.lit(1), index - 1), turned, part(index + 1, F.lit(12))), "cut": part(F.lit(1), n - 4), "none": content,
    }
    packed = _archives(spark, sf_dir)
    made = packed.select(F.explode(F.create_map(*[x for k, v in damaged.items() for x in (F.lit(k), v)])).alias("kind", "content"))
    found = blocks.validation(made).select("kind", "error")
    bombs = blocks.validation(packed.withColumn("content", blocks.xz_compress(F.lit(bytes(5000)), FAST)), limit=4999).select(F.lit("bomb").alias("kind"), "error")
    return found.union(bombs).groupBy("kind", "error").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, block_no, sha256(encode(text)[block_offset + 1 : block_offset + block_length]) AS sha FROM ({PLAN_SQL}) JOIN documents USING (doc_id)")
def block_sha256(spark, sf_dir):
    packed = _archives(spark, sf_dir, Options(preset=0, block_size=BLOCK, check="sha256"))
    data = blocks.decode(blocks.located(tables.xz_blocks(packed)), contents=packed)
    return data.select(F.col("path").cast("long").alias("doc_id"), "block_no", checks.sha256(F.col("data")).alias("sha"))


@query("SELECT doc_id, strlen(text) AS total, CAST(1 AS BIGINT) AS blocks FROM documents WHERE strlen(text) > 0")
def chunk_sizes(spark, sf_dir):
    """The sum of the chunks' sizes is the size of the data."""
    found = tables.lzma2_chunks(_archives(spark, sf_dir, FAST))
    return found.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.sum("uncompressed_size").alias("total"), F.countDistinct("stream_no", "block_no").alias("blocks"))


def _crc_sql(table: str, ones: int) -> str:
    """A checksum in SQL: bytes folded over a table."""
    return f"xor({ones}::UBIGINT, list_reduce(b, lambda c, x: xor(c >> 8, {table}.t[CAST(1 + (xor(c, x) & 255) AS BIGINT)]), {ones}::UBIGINT))"


def _crc_table_sql(polynomial: int) -> str:
    return f"SELECT list_transform(range(256), lambda i: list_reduce(list_transform(range(8), lambda k: k::UBIGINT), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}::UBIGINT) ELSE c >> 1 END, i::UBIGINT)) AS t"


@query(f"""WITH t64 AS MATERIALIZED ({_crc_table_sql(0xC96C5795D7870F42)}), t32 AS MATERIALIZED ({_crc_table_sql(0xEDB88320)}),
d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM documents)
SELECT doc_id, CAST({_crc_sql('t32', 2**32 - 1)} AS BIGINT) AS crc32, lpad(lower(hex({_crc_sql('t64', 2**64 - 1)})), 16, '0') AS crc64 FROM d, t64, t32""")
def text_checks(spark, sf_dir):
    """CRC32 and CRC64 of every text."""
    return _texts(spark, sf_dir).select("doc_id", checks.crc32(F.col("data")).alias("crc32"), checks.crc64(F.col("data")).alias("crc64"))


_SIZES = {
    "max_compressed_size": ("n + n // 64 + 128", lambda n: sizes.max_compressed_size(n)),
    "padding": ("(4 - n % 4) % 4", lambda n: sizes.padding4(n)),
    "vli_length": ("CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END", lambda n: sizes.vli_length(n)),
    "effective_dict": ("least(greatest(n, 4096), 8388608)", lambda n: sizes.effective_dict(n, F.lit(6))),
    "default_block": ("greatest(2 * least(greatest(n, 4096), 8388608), 1048576)", lambda n: sizes.default_block(sizes.effective_dict(n, F.lit(6)))),
    "chunk_limit": ("greatest(least(65536, 2 * least(greatest(n, 4096), 8388608)), 4096)", lambda n: sizes.chunk_limit(sizes.effective_dict(n, F.lit(6)))),
    "alone_dict": ("CAST(pow(2, ceil(log2(least(greatest(n, 4096), 8388608)))) AS BIGINT)", lambda n: sizes.alone_dict(n, F.lit(6))),
}


@query("SELECT doc_id, " + ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, (sql, _) in _SIZES.items()) + " FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def size_functions(spark, sf_dir):
    n = F.col("n")
    return _texts(spark, sf_dir).select("doc_id", F.octet_length("data").cast("long").alias("n")).select("doc_id", *[f(n).cast("long").alias(name) for name, (_, f) in _SIZES.items()])


@query("SELECT i AS check_id, CAST(CASE WHEN i = 0 THEN 0 WHEN i <= 3 THEN 4 WHEN i <= 6 THEN 8 WHEN i <= 9 THEN 16 WHEN i <= 12 THEN 32 ELSE 64 END AS INTEGER) AS size FROM generate_series(0, 15) AS g(i)")
def check_sizes(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("check_id"), sizes.check_bytes(F.col("id")).cast("int").alias("size"))


@query("SELECT i AS code, CAST((2 + i % 2) * pow(2, i // 2 + 11) AS BIGINT) AS size, i AS back FROM generate_series(0, 39) AS g(i)")
def dict_codes(spark, sf_dir):
    found = spark.range(40).select(F.col("id").alias("code"), sizes.dict_bytes(F.col("id")).alias("size"))
    return found.withColumn("back", sizes.dict_code(F.col("size")).cast("long"))


@query("SELECT i AS byte, CAST(i % 9 AS BIGINT) AS lc, CAST((i // 9) % 5 AS BIGINT) AS lp, CAST(i // 45 AS BIGINT) AS pb, i AS back FROM generate_series(0, 224) AS g(i)")
def props_bytes(spark, sf_dir):
    fields = spark.range(225).select(F.col("id").alias("byte"), sizes.props_fields(F.col("id")).alias("f")).select("byte", *[F.col("f")[x].cast("long").alias(x) for x in ("lc", "lp", "pb")])
    return fields.withColumn("back", sizes.props_byte(F.col("lc"), F.col("lp"), F.col("pb")))


@query("""SELECT * FROM (VALUES (0, 65536, 8, 32, 128, 2, 'hc4', 'greedy'), (1, 1048576, 8, 32, 128, 2, 'hc4', 'greedy'), (2, 2097152, 16, 64, 273, 2, 'hc4', 'greedy'), (3, 4194304, 16, 64, 273, 32, 'hc4', 'lazy'),
(4, 4194304, 32, 128, 273, 32, 'hc4', 'lazy'), (5, 8388608, 32, 128, 273, 32, 'hc4', 'lazy'), (6, 8388608, 64, 256, 273, 64, 'hc4', 'lazy'), (7, 16777216, 64, 256, 273, 64, 'bt4', 'optimal'),
(8, 33554432, 128, 512, 273, 64, 'bt4', 'optimal'), (9, 67108864, 128, 512, 273, 64, 'bt4', 'optimal')) AS t(preset, dict_size, depth, extreme_depth, match_max, nice_length, finder, parser)""")
def preset_table(spark, sf_dir):
    schema = "preset int, kib int, depth int, extreme_depth int, match_max int, nice_length int, finder string, parser string"
    found = spark.createDataFrame(list(sizes.PRESETS), schema)
    return found.select("preset", sizes.preset_dict(F.col("preset")).cast("int").alias("dict_size"), "depth", "extreme_depth", "match_max", "nice_length", "finder", "parser")


@query("""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda x: ('0x' || x)::INTEGER) AS b FROM pages),
v AS (SELECT page_id, unnest(b) AS v, generate_subscripts(b, 1) AS pos FROM h),
d AS (SELECT page_id, pos, (v - coalesce(lag(v, 2) OVER (PARTITION BY page_id ORDER BY pos), 0) + 256) % 256 AS value FROM v)
SELECT page_id, sha256(string_agg(lpad(hex(value), 2, '0'), '' ORDER BY pos)) AS sha FROM d GROUP BY page_id""")
def delta_window(spark, sf_dir):
    """The delta filter over the bytes of whole pages, by expressions alone; SQL has it as a window."""
    coded = filters.delta_column(F.col("html").cast("binary"), 2)
    return _table(spark, sf_dir, "pages").where("octet_length(html) > 0").select("page_id", F.sha2(F.hex(coded), 256).alias("sha"))


def _filter_query(name: str, distance: int):
    def run(spark, sf_dir):
        data = _texts(spark, sf_dir)
        there = filters.byte_filter(F.col("data"), name, True, distance)
        back = data.withColumn("coded", there).withColumn("plain", filters.byte_filter(F.col("coded"), name, False, distance))
        return back.select("doc_id", F.sha2("plain", 256).alias("sha"), (F.octet_length("coded") == F.octet_length("data")).alias("same_size"))

    query("SELECT doc_id, sha256(text) AS sha, true AS same_size FROM documents", f"filter_{name}")(run)


for _name in ("delta", "x86", "powerpc", "ia64", "arm", "armthumb", "sparc", "arm64"):
    _filter_query(_name, 3)


#: What each filter makes of filters.machine_code(): digests that `xz --format=raw` and a loop over bytes (delta) confirm.
FILTER_VECTORS = (
    ("x86", "99243ea56ab98f63e1b7a99e10997e89a70f2cae17dc7781bb1c6e422a143754"),
    ("powerpc", "c8a72818d2f40af2b0134ef66a173741d629048cfc4fbc8f9c434331a38a9014"),
    ("ia64", "3d7c3fb31ac3e348d2c5ea88d54847680d5169b20078e875941465601019ed5a"),
    ("arm", "65c7ce86006f8d768c6a1ad2072ad4ce196c50659d354c287ecfa9f4c7f1c307"),
    ("armthumb", "a705a7007e6f707616b21b4abf11697eb28019416f51497e1c8dc8919436b24e"),
    ("sparc", "b00ff481ba88729773443f742a70761216348ef845c1a214572e1deb28569863"),
    ("arm64", "3b8684f2b9a850c24dc9859292c7b458abbe60e761754fc0737f63040a42da6b"),
    ("delta", "df450f89b07b02aeeb38c2e2143a93cb1a780038a0b8b5352d44c7dea14fb41d"),
)


@query("SELECT name, sha, true AS undone FROM (VALUES " + ", ".join(f"('{n}', '{h}')" for n, h in FILTER_VECTORS) + ") AS t(name, sha)")
def filter_vectors(spark, sf_dir):
    """Every filter over code with branches, there and back."""
    code = spark.createDataFrame([(filters.machine_code(),)], "data binary")
    found = []
    for name, _ in FILTER_VECTORS:
        there = code.withColumn("coded", filters.byte_filter(F.col("data"), name, True, 3))
        back = filters.byte_filter(F.col("coded"), name, False, 3)
        found.append(there.select(F.lit(name).alias("name"), F.sha2("coded", 256).alias("sha"), (back == F.col("data")).alias("undone")))
    return functools.reduce(DataFrame.union, found)


@query("SELECT vec_id, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM (SELECT vec_id, i, CAST(embedding[i] AS DECIMAL(18, 4)) AS x FROM embeddings, generate_series(1, 512) AS g(i) WHERE i <= len(embedding)) GROUP BY vec_id")
def vectors_delta(spark, sf_dir):
    """Vectors packed as bytes, compressed with a delta of four bytes, and read back."""
    text = _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("decimal(18,4)").cast("string")), ",").alias("data"))
    packed = text.withColumn("packed", blocks.xz_compress(F.col("data"), Options(preset=0, filter="delta", delta_distance=4)))
    return packed.select("vec_id", F.sha2(blocks.xz_decompress(F.col("packed")), 256).alias("sha"))


@query("SELECT doc_id, sha256(text) AS sha, 3 AS lc, 0 AS lp, 2 AS pb, CAST(pow(2, ceil(log2(greatest(strlen(text), 4096)))) AS BIGINT) AS dict_size, strlen(text) AS declared_size FROM documents")
def lzma_alone(spark, sf_dir):
    packed = _table(spark, sf_dir, "documents").select("doc_id", alone.lzma_compress(F.col("text")).alias("content"))
    found = alone.lzma_headers(packed)
    return found.select("doc_id", F.sha2(alone.lzma_decompress(F.col("content")), 256).alias("sha"), "lc", "lp", "pb", "dict_size", F.col("declared_size").cast("long").alias("declared_size"))


@query("SELECT lower(n) AS name, id FROM (VALUES ('delta', 3), ('x86', 4), ('powerpc', 5), ('ia64', 6), ('arm', 7), ('armthumb', 8), ('sparc', 9), ('arm64', 10), ('riscv', 11), ('lzma2', 33)) AS t(n, id)")
def filter_ids(spark, sf_dir):
    return spark.createDataFrame(list(container.FILTERS.items()), "name string, id int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
