"""The .xz container: header, blocks, index and footer as plain values.

Fixed values of the file format: magic bytes, check ids with their sizes, filter ids.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from blocklake.errors import XzDataError, XzError, XzFormatError, XzLimitError

HEADER_MAGIC, FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
CHECKS = {"none": 0, "crc32": 1, "crc64": 4, "sha256": 10}
CHECK_NAMES = {v: k for k, v in CHECKS.items()}
FILTERS = {"delta": 3, "x86": 4, "powerpc": 5, "ia64": 6, "arm": 7, "armthumb": 8, "sparc": 9, "arm64": 10, "riscv": 11, "lzma2": 0x21}
MAX_INT = 2**31 - 1


def check_size(check: int) -> int:
    """Bytes of a check by its id: 0, then 4, 8, 16, 32, 64 for each three ids."""
    return 0 if check == 0 else 4 << (check - 1) // 3


def le32(data: bytes, at: int = 0) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def crc(data: bytes) -> bytes:
    return zlib.crc32(data).to_bytes(4, "little")


def vli_bytes(n: int) -> bytes:
    """A variable-length integer: 7 bits a byte, the least first."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_vli(data: bytes, at: int) -> tuple[int, int]:
    """Its value and where it ends. Over 9 bytes, cut off or padded with a zero byte: XzDataError."""
    value = 0
    for i in range(9):
        if at + i >= len(data):
            raise XzDataError("integer cut off")
        b = data[at + i]
        value |= (b & 0x7F) << 7 * i
        if b < 0x80:
            if i and b == 0:
                raise XzDataError("integer not in its shortest form")
            return value, at + i + 1
    raise XzDataError("integer too long")


def dict_size(byte: int) -> int:
    """Dictionary bytes that a property byte says: 2 or 3 times a power of two."""
    if byte > 40:
        raise XzDataError("dictionary size")
    return (2 | byte & 1) << byte // 2 + 11 if byte < 40 else 2**32 - 1


@dataclass(frozen=True)
class Block:
    compressed_offset: int
    unpadded_size: int
    uncompressed_size: int

    @property
    def padded_size(self) -> int:
        return (self.unpadded_size + 3) // 4 * 4


@dataclass(frozen=True)
class Stream:
    offset: int
    check: int
    blocks: tuple[Block, ...]
    index_size: int
    padding_after: int
    end: int


def stream_header(check: int) -> bytes:
    flags = bytes((0, check))
    return HEADER_MAGIC + flags + crc(flags)


def index_bytes(records: list[tuple[int, int]]) -> bytes:
    body = b"\x00" + vli_bytes(len(records)) + b"".join(vli_bytes(a) + vli_bytes(b) for a, b in records)
    body += bytes(-len(body) % 4)
    return body + crc(body)


def stream_footer(check: int, index_size: int) -> bytes:
    body = (index_size // 4 - 1).to_bytes(4, "little") + bytes((0, check))
    return crc(body) + body + FOOTER_MAGIC


def assemble(blocks: list[bytes], records: list[tuple[int, int]], check: int) -> bytes:
    """One stream of encoded blocks and their (unpadded, uncompressed) sizes; without blocks an empty stream."""
    index = index_bytes(records)
    return b"".join((stream_header(check), *blocks, index, stream_footer(check, len(index))))


def parse_header(data: bytes) -> int:
    """The check id of a 12-byte stream header."""
    if len(data) < 12:
        raise XzDataError("stream header cut off")
    if data[:6] != HEADER_MAGIC or data[6] or data[7] & 0xF0:
        raise XzFormatError("not a stream header")
    if crc(data[6:8]) != data[8:12]:
        raise XzDataError("stream header checksum")
    return data[7]


def parse_index(data: bytes) -> list[tuple[int, int]]:
    """(unpadded, uncompressed) of every block."""
    if len(data) < 8 or data[0] or crc(data[:-4]) != data[-4:]:
        raise XzDataError("index")
    count, at = read_vli(data, 1)
    out = []
    for _ in range(count):
        unpadded, at = read_vli(data, at)
        size, at = read_vli(data, at)
        if not 5 <= unpadded <= MAX_INT or size > MAX_INT:
            raise XzDataError("index record")
        out.append((unpadded, size))
    if len(data) - 4 - at > 3 or any(data[at:-4]):
        raise XzDataError("index padding")
    return out


def walk(read: Callable[[int, int], bytes], length: int) -> list[Stream]:
    """The streams of a file in order, found from its end by footers and indexes; block data is never read.

    read(offset, n) returns n bytes. Padding between streams is zeros in multiples of 4; anything else between
    or after streams is an error, and so is a file without a stream. What is left and shorter than a header and a
    footer, or does not end with a footer, is not of the format, be its stream empty or not.
    """
    found, end = [], length
    while end > 0 or not found:
        padding = 0
        while end >= 4 and read(end - 4, 4) == bytes(4):
            end, padding = end - 4, padding + 4
        if end == 0:
            raise XzDataError("no stream" if not found else "bytes before the first stream")
        if end < 24:
            raise XzFormatError("shorter than a stream")
        footer = read(end - 12, 12)
        if footer[10:] != FOOTER_MAGIC or footer[8] or footer[9] & 0xF0:
            raise XzFormatError("not a stream footer")
        if crc(footer[4:10]) != footer[:4]:
            raise XzDataError("stream footer checksum")
        index_size = (le32(footer, 4) + 1) * 4
        index_at = end - 12 - index_size
        if index_at < 12:
            raise XzDataError("index size")
        records = parse_index(read(index_at, index_size))
        start = index_at - sum((a + 3) // 4 * 4 for a, _ in records) - 12
        if start < 0:
            raise XzDataError("blocks beyond the file")
        if parse_header(read(start, 12)) != footer[9]:
            raise XzDataError("header and footer differ")
        blocks, at = [], start + 12
        for unpadded, size in records:
            blocks.append(Block(at, unpadded, size))
            at += (unpadded + 3) // 4 * 4
        found.append(Stream(start, footer[9], tuple(blocks), index_size, padding, end))
        end = start
    return found[::-1]


def parse_block_header(data: bytes) -> tuple[list[tuple[int, bytes]], int | None, int | None, int]:
    """(filter id, properties) of the chain, compressed and uncompressed size if declared, and the header's length."""
    size = (data[0] + 1) * 4 if data else 0
    if not data or data[0] == 0 or len(data) < size:
        raise XzDataError("block header cut off")
    if crc(data[: size - 4]) != data[size - 4 : size]:
        raise XzDataError("block header checksum")
    flags, at, sizes = data[1], 2, [None, None]
    if flags & 0x3C:
        raise XzDataError("reserved block flags")
    for i, bit in enumerate((0x40, 0x80)):
        if flags & bit:
            sizes[i], at = read_vli(data, at)
            if sizes[i] > MAX_INT:
                raise XzDataError("block size")
    chain = []
    for _ in range((flags & 3) + 1):
        name, at = read_vli(data, at)
        n, at = read_vli(data, at)
        chain.append((name, data[at : at + n]))
        at += n
    if at > size - 4 or any(data[at : size - 4]):
        raise XzDataError("block header padding")
    for name, properties in chain:
        if name not in FILTERS.values():
            raise XzError(f"filter {name:#x} is not supported")
        if len(properties) not in ((1,) if name in (0x21, 3) else (0, 4)):
            raise XzDataError("filter properties")
    if chain[-1][0] != 0x21 or any(name == 0x21 for name, _ in chain[:-1]):
        raise XzError("the last filter, and only it, is LZMA2")
    dict_size(chain[-1][1][0])
    return chain, sizes[0], sizes[1], size


def decode_block(raw: bytes, check: int, unpadded: int, uncompressed: int, limit: int | None = None) -> bytes:
    """The data of one block, as a stream of its own. The limit is tested before anything is decoded."""
    if limit is not None and uncompressed > limit:
        raise XzLimitError(f"{uncompressed} bytes, {limit} allowed")
    _, _, declared, _ = parse_block_header(raw)
    if declared is not None and declared != uncompressed:
        raise XzDataError("block header and index differ")
    try:
        data = lzma.decompress(assemble([raw], [(unpadded, uncompressed)], check), lzma.FORMAT_XZ)
    except lzma.LZMAError as e:
        raise (XzError if "nsupported" in str(e) else XzDataError)(str(e)) from None
    if len(data) != uncompressed:
        raise XzDataError("block and index differ")
    return data


def encode_block(data: bytes, check: int, filters: list[dict]) -> tuple[bytes, int, int]:
    """An encoded block, padded, and its (unpadded, uncompressed) sizes."""
    whole = lzma.compress(data, lzma.FORMAT_XZ, check, filters=filters)
    (stream,) = walk(lambda at, n: whole[at : at + n], len(whole))
    if not stream.blocks:
        return b"", 0, 0
    (block,) = stream.blocks
    return whole[12 : 12 + block.padded_size], block.unpadded_size, block.uncompressed_size


def dict_code(size: int) -> int:
    """The least property byte whose dictionary holds a size."""
    return next((c for c in range(40) if dict_size(c) >= size), 40)


def build_block(packed: bytes, chain: list[tuple[int, bytes]], check: bytes, uncompressed: int) -> tuple[bytes, int, int]:
    """A block from LZMA2 data that is made already, with both sizes in its header; and its (unpadded, uncompressed) sizes."""
    fields = vli_bytes(len(packed)) + vli_bytes(uncompressed) + b"".join(vli_bytes(name) + vli_bytes(len(props)) + props for name, props in chain)
    size = (2 + len(fields) + 3) // 4 * 4 + 4
    head = (bytes((size // 4 - 1, 0xC0 | len(chain) - 1)) + fields).ljust(size - 4, b"\0")
    return head + crc(head) + packed + bytes(-len(packed) % 4) + check, size + len(packed) + len(check), uncompressed


def decode_all(data: bytes, limit: int | None = None) -> bytes:
    """All streams of a value, one after the other. The limit holds for their sum and is tested against the indexes first."""
    streams = walk(lambda at, n: data[at : at + n], len(data))
    total = sum(b.uncompressed_size for s in streams for b in s.blocks)
    if limit is not None and total > limit:
        raise XzLimitError(f"{total} bytes, {limit} allowed")
    return b"".join(decode_block(data[b.compressed_offset : b.compressed_offset + b.padded_size], s.check, b.unpadded_size, b.uncompressed_size) for s in streams for b in s.blocks)


def chunks(lzma2: bytes) -> Iterator[dict]:
    """The LZMA2 chunks of a block's data, without decoding them, up to the end marker."""
    at = no = 0
    while True:
        if at >= len(lzma2):
            raise XzDataError("LZMA2 data without an end")
        control = lzma2[at]
        if control == 0:
            return
        if at + (3 if control in (1, 2) else 6 if control >= 0xC0 else 5) > len(lzma2):
            raise XzDataError("LZMA2 chunk header cut off")
        if control >= 0x80:
            size = ((control & 0x1F) << 16 | lzma2[at + 1] << 8 | lzma2[at + 2]) + 1
            packed = (lzma2[at + 3] << 8 | lzma2[at + 4]) + 1
            reset = ("none", "state", "state+props", "all")[control >> 5 & 3]
            head = 6 if control >= 0xC0 else 5
            yield {"chunk_no": no, "control": control, "kind": "lzma", "reset": reset, "uncompressed_size": size, "compressed_size": packed, "props": lzma2[at + 5] if head == 6 else None}
            at += head + packed
        elif control in (1, 2):
            size = (lzma2[at + 1] << 8 | lzma2[at + 2]) + 1
            yield {"chunk_no": no, "control": control, "kind": "stored", "reset": "dict" if control == 1 else "none", "uncompressed_size": size, "compressed_size": size, "props": None}
            at += 3 + size
        else:
            raise XzDataError("LZMA2 control byte")
        no += 1


def forward(data: bytes) -> Iterator[tuple[int, Block]]:
    """Check id and place of every block from the start of a value on, without its indexes.

    A block's sizes come from its header or else from its chunks, so what was written before an index got lost is
    found. It ends at the first byte that is no stream, block, index or padding.
    """
    at = 0
    while at < len(data):
        try:
            check = parse_header(data[at : at + 12])
            at += 12
            while data[at : at + 1] not in (b"", b"\0"):
                _, packed, size, head = parse_block_header(data[at : at + 1024])
                found = list(chunks(memoryview(data)[at + head : None if packed is None else at + head + packed]))
                size = sum(c["uncompressed_size"] for c in found) if size is None else size
                packed = 1 + sum(c["compressed_size"] + (3 if c["kind"] == "stored" else 5 + (c["props"] is not None)) for c in found) if packed is None else packed
                block = Block(at, head + packed + check_size(check), size)
                if at + block.unpadded_size > len(data):
                    return
                yield check, block
                at += block.padded_size
            count, end = read_vli(data, at + 1)
            for _ in range(2 * count):
                _, end = read_vli(data, end)
            at += (end - at + 3) // 4 * 4 + 4 + 12  # the index with its padding and checksum, and the footer
            while data[at : at + 4] == bytes(4):
                at += 4
        except XzError:
            return
