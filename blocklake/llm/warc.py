"""WARC archives: a writer with payload revisits, and a salvage reader.

Each record is a gzip member of its own. The reader checks every member (its
checksum) and record (version line, lengths, digest). After a failed check it
searches for the next valid member or version line, goes on there, and reports
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blocklake.llm.common import if_small, written
from blocklake.sources.tables import open_file

VERSION, MEMBER, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
LINE = re.compile(rb"WARC/1\.[0-9]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads with more copies than this are looked up apart from the rest.
HOT = 10_000
#: Bytes read at a time, and of a member's content that are held in memory before a temporary file of the task takes them.
STEP, SPOOL = 1 << 20, 64 << 20
#: Stores that workers read by ranges. Files of other ones come as values, which end at 2 GiB.
STORES = ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")
#: A file is closed when it has reached this size; a worker reads one file at a time.
ROLL = 32 << 20
RECORDS = "file string, offset long, length long, inner_offset long, inner_length long, gap string, record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has refers_to, and no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Target-URI: {quote(uri or '', safe='%/:=&?~#+!$,;@()*[]')}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return b"WARC/1.1\r\n" + "\r\n".join(fields).encode() + END + block + END


def gzip_member(record: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Broken(Exception):
    """A check failed."""


class Source:
    """Bytes at hand by range: of a file, or of what a member holds. The next place of a mark is remembered."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size = read, size
        self._at, self._part = 0, b""
        self._next: dict[bytes, tuple[int, int]] = {}

    def read(self, at: int, n: int) -> bytes:
        """n bytes, or fewer at the end. Small reads are served from a part read ahead."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self._at <= at <= at + n <= self._at + len(self._part):
            if n > STEP:
                return self._read(at, n)
            self._fill(at)
        return self._part[at - self._at : at - self._at + n]

    def _fill(self, at: int) -> None:
        self._at, self._part = at, self._read(at, min(2 * STEP, self.size - at))

    def find(self, mark: bytes, at: int) -> int:
        """The next place of a mark, or the size."""
        low, found = self._next.get(mark, (1, 0))
        if not low <= at <= found:
            found, pos = self.size, at
            while pos < self.size:
                if not self._at <= pos < self._at + len(self._part) - len(mark):
                    self._fill(pos)
                hit = self._part.find(mark, pos - self._at)
                if hit >= 0:
                    found = self._at + hit
                    break
                pos = max(pos + 1, self._at + len(self._part) - len(mark) + 1)
            self._next[mark] = (at, found)
        return found

    def parts(self, at: int, n: int) -> Iterator[bytes]:
        for pos in range(at, at + n, STEP):
            yield self.read(pos, min(STEP, at + n - pos))


def of_bytes(data: bytes) -> Source:
    return Source(lambda at, n: data[at : at + n], len(data))


def header_fields(data: Source, at: int) -> tuple[dict[str, str], int]:
    """The fields of the header at a place, folded lines joined, and where it ends. Raises Broken at the first line that is none."""
    fields: dict[str, str] = {}
    last, first = "", True
    while True:
        end = data.find(b"\r\n", at)
        if end >= data.size:
            raise Broken("no end of header")
        line = data.read(at, end - at)
        at = end + 2
        if first:
            if not LINE.fullmatch(line):
                raise Broken("no version line")
            first = False
        elif not line:
            return fields, at
        elif line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, colon, value = line.partition(b":")
            if not colon or not name.strip():
                raise Broken("bad header line")
            last = name.strip().lower().decode("latin-1")
            fields[last] = value.strip().decode("utf-8", "replace")


def parse_record(data: Source, at: int, proven: bool = False) -> tuple[dict, int]:
    """The record at a place and where it ends; its block is read in steps. proven: a digest must vouch for it. Raises Broken."""
    fields, start = header_fields(data, at)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("bad length")
    end = start + int(length)
    if data.read(end, 4) != END:
        raise Broken("length does not meet the end of the record")
    whole, body, http, split = hashlib.sha1(), hashlib.sha1(), b"", "http" not in fields.get("content-type", "http")
    size = 0
    for part in data.parts(start, end - start):
        whole.update(part)
        if not split:
            http += part
            head, mark, part = http.partition(END)
            if not mark:
                continue
            http, split = head, True
        body.update(part)
        size += len(part)
    digests = [base64.b32encode(x.digest()).decode() for x in (whole, body)]
    block = fields.get("warc-block-digest")
    if block is not None and block != f"sha1:{digests[0]}":
        raise Broken("block digest")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields.get("warc-type") == "revisit"
    if digest and not revisit and digest != digests[1]:
        raise Broken("payload digest")
    if proven and block is None and (revisit or not digest):
        raise Broken("no digest vouches for it")
    if revisit:  # the kept HTTP header tells the size of the payload that it leaves out
        size = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), 0)
    bare = lambda name: fields[name].removeprefix("<urn:record:").removesuffix(">") if name in fields else None
    found = {"record_id": bare("warc-record-id"), "uri": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": bare("warc-refers-to"), "payload_digest": digest or digests[1], "payload_bytes": size}
    return found, end + 4


def unpack_member(data: Source, at: int, out: BinaryIO) -> tuple[int, str]:
    """Writes what the gzip member at a place holds; where it ends, and why not all of it could be had (empty: it could).

    Steps begin small, as most false members fail at once. An error takes the output of its whole step with it,
    so steps that fail are halved until a byte is left.
    """
    unpacker, pos, step, why = zlib.decompressobj(31), at, 64, ""
    while step and not unpacker.eof and pos < data.size:
        part, before, mark = data.read(pos, step), unpacker.copy(), out.tell()
        try:
            rest = part
            while rest and not unpacker.eof:
                out.write(unpacker.decompress(rest, STEP))
                rest = unpacker.unconsumed_tail
        except zlib.error as e:
            unpacker, step, why = before, min(step, len(part)) // 2, f"member: {e}"
            out.seek(mark)
            out.truncate()
            continue
        pos += len(part)
        if not why:
            step = min(2 * step, STEP)
    if unpacker.eof:
        return pos - len(unpacker.unused_data), ""
    return at, why or "member cut off"


def member_records(content: Source, reason: str) -> Iterator[tuple[int, int, str | None, dict]]:
    """(offset in the member, length, gap reason or None, record) of a member's content; in one that failed a check only what a digest vouches for."""
    pos = bad_from = 0
    why = ""
    while pos < content.size:
        try:
            record, end = parse_record(content, pos, bool(reason))
        except Broken as e:
            why = why or str(e)
            pos = content.find(VERSION, pos + 1)
            continue
        if bad_from < pos:
            yield bad_from, pos - bad_from, reason or why, {}
        yield pos, end - pos, None, record
        pos = bad_from = end
        why = ""
    if bad_from < content.size:
        yield bad_from, content.size - bad_from, reason or why, {}


def salvage(data: Source) -> Iterator[tuple[int, int, int | None, str | None, dict]]:
    """(offset, length, offset in the member, gap reason or None, record) of an archive, plain or of gzip members, in order.

    Gaps without an inner offset and what lies between them cover every byte. A member that fails its check
    gives the records that a digest vouches for, with no length of their own, before the gap that it is; in a
    sound one only the broken parts are gaps, by their offsets in its content.
    """
    at, bad_from, reason = 0, None, ""
    while at < data.size:
        found: list = []
        end, why = at, ""
        if data.read(at, len(MEMBER)) == MEMBER:
            with tempfile.SpooledTemporaryFile(max_size=SPOOL) as store:
                end, why = unpack_member(data, at, store)
                size = store.tell()

                def read(pos: int, n: int) -> bytes:
                    store.seek(pos)  # noqa: B023
                    return store.read(n)  # noqa: B023

                inner = member_records(Source(read, size), why)
                if why:
                    for pos, _, gap, record in inner:
                        if gap is None:
                            yield at, 0, pos, None, record
                elif not size:
                    why = "empty member"
                else:
                    if bad_from is not None:
                        yield bad_from, at - bad_from, None, reason, {}
                        bad_from = None
                    for pos, n, gap, record in inner:
                        yield at, end - at, pos, gap, record if gap is None else {"inner_length": n}
        else:
            try:
                record, end = parse_record(data, at)
                found = [record]
            except Broken as e:
                why = str(e)
        if why:
            if bad_from is None:
                bad_from, reason = at, why
            at = min(data.find(MEMBER, at + 1), data.find(VERSION, at + 1))
            continue
        if bad_from is not None:
            yield bad_from, at - bad_from, None, reason, {}
            bad_from = None
        for record in found:
            yield at, end - at, None, None, record
        at = end
    if bad_from is not None:
        yield bad_from, data.size - bad_from, None, reason, {}


def with_revisits(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """pages with refers_to: of equal payloads of at least `least` bytes all but the largest key refer to it.

    Payloads are compared by SHA-1 and length. Only keys and digests are grouped and joined, so a payload with
    very many copies is a pre-aggregated row; the payloads themselves meet a join by key at most.
    Rows with a null key refer to none and are referred to by none.
    """
    named = pages.withColumn("digest", F.concat(F.sha1(payload), F.lit(":"), F.octet_length(payload)))
    ids = named.where(F.octet_length(payload) >= least).select(key, "digest")
    shared = written(ids.groupBy("digest").agg(F.max(key).alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL"), "shared-digests")
    hot = shared.where(F.col("n") > HOT).select("digest", F.col("refers_to").alias("hot"))  # at most a row for every HOT rows of pages
    marked = ids.join(if_small(hot), "digest", "left")
    cold = marked.where("hot IS NULL").select(key, "digest").join(shared.where(F.col("n") <= HOT).select("digest", "refers_to"), "digest")
    revisits = marked.where("hot IS NOT NULL").select(key, "digest", F.col("hot").alias("refers_to")).union(cold.select(key, "digest", "refers_to")).where(F.col(key) < F.col("refers_to")).distinct()
    return named.join(revisits, [key, "digest"], "left").drop("digest")


def write_warc(records: DataFrame, directory: str) -> DataFrame:
    """Writes record_id, uri, payload and refers_to of every row as gzip members; returns the list of finished files.

    Every task writes files of its own, named anew in every attempt; only those of attempts that ended well are
    in the list (file, records, bytes), so a lost executor leaves no half file and no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(directory)
        store.create_dir(path, recursive=True)
        out, name, count, size = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip_member(record_bytes(record_id, uri, payload, digest_of(payload), refers_to))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    columns = records.select(F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("uri").cast("string"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), F.col("refers_to").cast("string"))
    return written(columns.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def read_warc(spark: SparkSession, directory: str, files: DataFrame | None = None) -> DataFrame:
    """A row for every record and every quarantined gap (then gap says why, and the record's columns are null).

    files: the list that the writer returned; files beside it, of attempts that failed, are passed over.
    An empty list or folder gives no rows.
    """
    if files is not None and files.isEmpty():
        return spark.createDataFrame([], RECORDS)
    whole = urlsplit(directory).scheme not in ("", *STORES)
    archives = spark.read.format("binaryFile").load(directory).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file"), *(["content"] if whole else []))
    if files is not None:
        archives = archives.join(files.select("file"), "file", "left_semi")
    target = to_arrow_schema(StructType.fromDDL(RECORDS))

    def rows(path: str, file: str, content: bytes | None) -> Iterator[dict]:
        store = None if content is not None else open_file(unquote(path))
        data = of_bytes(content) if store is None else Source(lambda at, n: store.read_at(n, at), store.size())
        for offset, length, inner, gap, record in salvage(data):
            yield {"file": file, "offset": offset, "length": length, "inner_offset": inner, "gap": gap} | record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for path, file, content in zip(*columns, *([] if whole else [[None] * len(batch)]), strict=True):
                found = rows(path, file, content)
                while part := list(itertools.islice(found, 4096)):
                    yield pa.RecordBatch.from_pylist(part, schema=target)

    return archives.select("path", "file", *(["content"] if whole else [])).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, directory: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row of pages to a folder and returns what the salvage reader finds there, gaps included.

    A null payload is empty. Other columns of pages are left out.
    """
    columns = pages.select(F.col(key).alias("record_id"), F.col(uri).alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    files = write_warc(with_revisits(columns, "record_id", "payload", least), directory)
    return read_warc(pages.sparkSession, directory, files)
