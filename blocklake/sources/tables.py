"""Files of compressed data as tables of their streams and blocks, without their payload.

Spark lists the files; executors read only footers, indexes and headers by byte
ranges. Data is decoded in a second step (operators/blocks.py) from whatever rows
of the block table a query has kept, so filters and joins on it prune the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklake.errors import XzError
from blocklake.sources import container

STREAMS = "path string, stream_no int, stream_offset long, check_type int, check_name string, block_count int, index_size long, padding_after long, compressed_size long, uncompressed_size long, error string"
BLOCKS = "path string, stream_no int, block_no int, compressed_offset long, unpadded_size long, padded_size long, uncompressed_size long, check_type int, filters array<struct<id:long,props:binary>>, dict_size long, has_sizes boolean, error string"
CHUNKS = "path string, stream_no int, block_no int, chunk_no int, control int, kind string, reset string, uncompressed_size int, compressed_size int, props int"


def open_file(path: str):
    """A random-access file of any store that Arrow reads; path as Spark names it (file:/..., s3a://...)."""
    path = path.replace("s3a://", "s3://").replace("file:///", "/").replace("file:/", "/")
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def range_reader(path: str) -> tuple[Callable[[int, int], bytes], int]:
    file = open_file(path)
    return (lambda at, n: file.read_at(n, at)), file.size()


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of the files that a path, folder or glob names. Content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


#: Rows and bytes of a batch that Python's objects are made of at once: a whole batch has 10,000 rows and more memory than its data.
PART, PART_BYTES = 128, 1 << 20


def parts(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch a few rows at a time, and a single one where rows are large."""
    for i in range(0, len(batch), PART):
        yield from _light(batch.slice(i, PART))


def _light(part: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    if len(part) < 2 or part.nbytes <= PART_BYTES:
        yield part
    else:
        half = len(part) // 2
        yield from _light(part.slice(0, half))
        yield from _light(part.slice(half))


def _rows(schema: str, df: DataFrame, make: Callable[[str, Callable[[int, int], bytes], int], Iterator[dict]], strict: bool) -> DataFrame:
    """make's rows for each file (columns path and, if the bytes are at hand, content). Not strict: an error is a row."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            out = []
            for row in batch.to_pylist():
                try:
                    content = row.get("content")
                    reader, n = ((lambda at, k, c=content: c[at : at + k]), len(content)) if "content" in row and content is not None else range_reader(row["path"])
                    out += make(row["path"], reader, n)
                except XzError as e:
                    if strict:
                        raise
                    out.append({"path": row["path"], "error": f"{type(e).__name__}: {e}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def xz_streams(df: DataFrame, strict: bool = True) -> DataFrame:
    """A row per stream of each file; df has path and, for values instead of files, content."""

    def make(path, read, n):
        for i, s in enumerate(container.walk(read, n)):
            yield {
                "path": path, "stream_no": i, "stream_offset": s.offset, "check_type": s.check, "check_name": container.CHECK_NAMES.get(s.check), "block_count": len(s.blocks), "index_size": s.index_size,
                "padding_after": s.padding_after, "compressed_size": s.end - s.offset, "uncompressed_size": sum(b.uncompressed_size for b in s.blocks),
            }

    return _rows(STREAMS, df, make, strict)


def xz_blocks(df: DataFrame, strict: bool = True) -> DataFrame:
    """A row per block of each file with its place, sizes and filters."""

    def make(path, read, n):
        for i, s in enumerate(container.walk(read, n)):
            for j, b in enumerate(s.blocks):
                head = read(b.compressed_offset, min(1024, b.padded_size))
                chain, packed, size, _ = container.parse_block_header(head)
                yield {
                    "path": path, "stream_no": i, "block_no": j, "compressed_offset": b.compressed_offset, "unpadded_size": b.unpadded_size, "padded_size": b.padded_size, "uncompressed_size": b.uncompressed_size, "check_type": s.check,
                    "filters": [{"id": name, "props": props} for name, props in chain], "dict_size": container.dict_size(chain[-1][1][0]), "has_sizes": packed is not None and size is not None,
                }

    return _rows(BLOCKS, df, make, strict)


def lost_blocks(df: DataFrame) -> DataFrame:
    """path, block_no, compressed_offset, unpadded_size, padded_size, uncompressed_size and check_type of the blocks that a forward reading finds in each value (path, content), whether or not it still has an index."""

    def make(path, read, n):
        for i, (check, b) in enumerate(container.forward(read(0, n))):
            yield {"path": path, "stream_no": 0, "block_no": i, "compressed_offset": b.compressed_offset, "unpadded_size": b.unpadded_size, "padded_size": b.padded_size, "uncompressed_size": b.uncompressed_size, "check_type": check}

    return _rows("path string, stream_no int, block_no int, compressed_offset long, unpadded_size long, padded_size long, uncompressed_size long, check_type int", df, make, True)


def lzma2_chunks(df: DataFrame) -> DataFrame:
    """A row per LZMA2 chunk of each file's blocks, found by their headers alone."""

    def make(path, read, n):
        for i, s in enumerate(container.walk(read, n)):
            for j, b in enumerate(s.blocks):
                raw = read(b.compressed_offset, b.padded_size)
                for c in container.chunks(raw[container.parse_block_header(raw)[3] : b.unpadded_size - container.check_size(s.check)]):
                    yield {"path": path, "stream_no": i, "block_no": j} | c

    return _rows(CHUNKS, df, make, True)


def stream_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """df with header_ok and check_type of each value's first 12 bytes, by expressions alone."""
    head = F.substring(F.col(content), 1, 12)
    flags = F.substring(F.col(content), 7, 2)
    stored = _le32(F.substring(F.col(content), 9, 4))
    return df.withColumns({"header_ok": (F.substring(head, 1, 6) == F.lit(container.HEADER_MAGIC)) & (stored == F.crc32(flags)), "check_type": F.conv(F.hex(F.substring(flags, 2, 1)), 16, 10).cast("int")})


def _le32(four):
    """Four bytes, the least first, as a number."""
    digits = F.hex(four)
    return F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
