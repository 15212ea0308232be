"""format("xz"): a reader of files by parts and a writer of folders of .xz files.

The reader has no pushFilters: it would change what a DataFrame means that is
used twice. To prune, filter the block table and decode what is left.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blocklake.operators.blocks import Options
from blocklake.sources import container
from blocklake.sources.tables import open_file


def _place(path: str) -> tuple[fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://").removeprefix("file://") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class FilePart(InputPartition):
    """The blocks of a file that begin within a range of its bytes."""

    path: str
    start: int
    stop: int


class XzReader(DataSourceReader):
    """A row per block: path, stream_no, block_no, uncompressed_offset, data.

    path is a file, a folder (with the folders in it) or a glob. Files are read in parts of about splitSize bytes:
    a task reads the file's indexes and the blocks that begin in its part.
    """

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options["maxoutputsize"]) if "maxoutputsize" in options else None
        self.split = int(options.get("splitsize", 64 << 20))

    def partitions(self):
        store, path = _place(self.path)
        if re.search(r"[*?\[]", path):
            root = re.split(r"/[^/]*[*?\[]", path)[0]  # the folders before the first pattern
            found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if fnmatch.fnmatchcase(f.path, path)]
        else:
            root, info = path, store.get_file_info(path)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path.removeprefix(root).split("/"))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".xz") and not hidden(f))
        return [FilePart(p, at, min(n, at + self.split)) for p, n in files for at in range(0, max(n, 1), self.split)]

    def read(self, part):
        file = open_file(part.path)
        at = 0
        streams = container.walk(lambda a, n: file.read_at(n, a), file.size())
        total = sum(b.uncompressed_size for s in streams for b in s.blocks)
        if self.limit is not None and total > self.limit:
            raise container.XzLimitError(f"{part.path}: {total} bytes, {self.limit} allowed")
        for i, s in enumerate(streams):
            for j, b in enumerate(s.blocks):
                if part.start <= b.compressed_offset < part.stop:
                    yield part.path, i, j, at, container.decode_block(file.read_at(b.padded_size, b.compressed_offset), s.check, b.unpadded_size, b.uncompressed_size)
                at += b.uncompressed_size


@dataclass
class Written(WriterCommitMessage):
    name: str


class XzWriter(DataSourceWriter):
    """A file per task, seen only after the commit. With blockSize the data of its rows is one stream, cut into blocks of that size; without it a row is a block."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite, self.column = options["path"], overwrite, schema.fieldNames().index("data")
        number = lambda name: int(options[name]) if name in options else None
        self.options = Options(
            preset=int(options.get("preset", 6)), extreme=options.get("extreme", "false").lower() == "true", check=options.get("check", "crc64"), dict_size=number("dictsize"),
            block_size=number("blocksize"), filter=options.get("filter"), delta_distance=int(options.get("deltadistance", 1)),
        )

    def pieces(self, rows):
        """The data of the blocks."""
        size, held = self.options.block_size, bytearray()
        for row in rows:
            data = bytes(row[self.column] or b"")
            if not size:
                yield data
                continue
            held += data
            while len(held) >= size:
                yield bytes(held[:size])
                del held[:size]
        yield bytes(held)

    def write(self, rows):
        from pyspark import TaskContext

        store, path = _place(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.xz"
        check, records = container.CHECKS[self.options.check], []
        store.create_dir(f"{path}/_temporary", recursive=True)
        with store.open_output_stream(f"{path}/_temporary/{name}") as out:
            out.write(container.stream_header(check))
            for data in self.pieces(rows):
                if data:
                    raw, unpadded, size = self.options.encode(data)
                    out.write(raw)
                    records.append((unpadded, size))
            index = container.index_bytes(records)
            out.write(index + container.stream_footer(check, len(index)))
        return Written(name)

    def commit(self, messages):
        store, path = _place(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")
        store.delete_dir(f"{path}/_temporary")

    def abort(self, messages):
        store, path = _place(self.path)
        if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary")


class XzDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xz"

    def schema(self):
        return "path string, stream_no int, block_no int, uncompressed_offset long, data binary"

    def reader(self, schema):
        return XzReader(self.options)

    def writer(self, schema, overwrite):
        return XzWriter(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(XzDataSource)
