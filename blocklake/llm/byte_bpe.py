"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised on its
own, in parallel. A chunk that starts inside a pre-token may cut wrongly at
first, but from the first boundary that it shares with the chunk before it both
cut alike, so the texts are stitched there and the pieces between two such
places are encoded apart. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import array
import base64
import functools

import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows, written

CHUNK, OVERLAP = 32_768, 1_024


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes], regex.Pattern]:
    """The encoder, the bytes of each id and the pre-token pattern; read once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), raw, regex.compile(pattern)


def ids_bytes(text: str, encoder: tiktoken.Encoding) -> bytes:
    ids = array.array("I", encoder.encode_ordinary(text))
    return ids.tobytes()  # little-endian on every platform that Spark supports


def decoded(ids: bytes, raw: list[bytes]) -> bytes:
    return b"".join(map(raw.__getitem__, array.array("I", ids)))


def boundaries(chunk: str, pattern: regex.Pattern, start: int, stop: int, last: bool) -> list[int]:
    """Ends of pre-tokens in chunk[start:stop] after a visible character. One that touches the chunk's end may go on beyond it."""
    ends = (m.end() for m in pattern.finditer(chunk))
    return [e for e in ends if start <= e < stop and (last or e < len(chunk)) and not chunk[e - 1].isspace()]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, ids (little-endian unsigned 32-bit integers, binary) and decoded bytes (binary), a row per row of docs.

    vocabulary is a file of base64 tokens and ranks that every worker can read. A null text is empty and has no
    ids. A text of at most one chunk has nothing to stitch and is encoded where it is read; longer ones are dealt
    by chunk, so one long text spreads over tasks; only boundaries meet to be stitched. If two chunks share no boundary in their overlap
    (a run longer than it), they are stitched without one: the pieces join and are encoded as one.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    schema = f"key {kind}, ids binary, decoded binary"

    def whole(helper, k, t):
        ids = ids_bytes(t, helper[0])
        return k, ids, decoded(ids, helper[1])

    init = lambda: encoding(vocabulary, pattern)
    short = map_rows(rows.where(F.char_length("text") <= chunk), whole, schema, init)

    # a row's identity: equal keys and texts are equal results, counted and repeated at the end
    long = rows.where(F.char_length("text") > chunk).groupBy("key", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    long = written(long.select(F.monotonically_increasing_id().alias("id"), "key", "copies", "text"), "long-texts")
    starts = F.expr(f"sequence(0, char_length(text) - 1, {chunk})")
    cut = long.select("id", F.char_length("text").alias("n"), F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i + 1, F.lit(chunk + overlap)))).alias("no", "part"))

    def pre_tokens(helper, i, n, no, part):
        last = no * chunk + len(part) >= n
        head = boundaries(part, helper[2], 0, min(overlap, len(part)), last) if no else []
        tail = [e - chunk for e in boundaries(part, helper[2], chunk, chunk + overlap, last)]
        return i, no, part, head, tail

    marked = written(map_rows(cut.repartition("id", "no"), pre_tokens, "id long, no int, part string, head array<int>, tail array<int>", init), "chunks")
    order = Window.partitionBy("id").orderBy("no")  # boundaries only; the chunks' texts stay where they are
    # where this chunk ends and the next begins: the first boundary that both have; null if there is none
    met = marked.select("id", "no", "tail", F.lead("head").over(order).alias("next"), F.lead("no").over(order).isNull().alias("last"))
    met = met.select("id", "no", "last", F.array_min(F.array_intersect("tail", "next")).alias("stop"))
    met = met.withColumn("start", F.lag("stop").over(order)).withColumn("joins", F.col("start").isNull() & (F.col("no") > 0))
    # chunks without a shared boundary fall into one piece
    met = met.withColumn("piece", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    body = F.when(F.col("joins"), 0).otherwise(F.coalesce("start", F.lit(0)))
    end = F.when(F.col("last"), F.lit(chunk + overlap)).when(F.col("stop").isNull(), F.lit(chunk)).otherwise(F.col("stop") + chunk)
    own = marked.select("id", "no", "part").join(met, ["id", "no"]).select("id", "piece", "no", F.substring(F.col("part"), body + 1, end - body).alias("own"))
    pieces = own.groupBy("id", "piece").agg(F.expr("listagg(own) WITHIN GROUP (ORDER BY no)").alias("own"))

    def encode_piece(helper, i, piece, own):
        ids = ids_bytes(own, helper[0])
        return i, piece, ids, decoded(ids, helper[1])

    encoded = map_rows(pieces, encode_piece, "id long, piece long, ids binary, decoded binary", init)
    stitched = encoded.groupBy("id").agg(*[F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY piece)").alias(c) for c in ("ids", "decoded")])
    joined = long.select("id", "key", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).join(stitched, "id")
    return short.unionByName(joined.select("key", "ids", "decoded")).withColumnRenamed("key", key)


def digest_tokens(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and digests of ids and decoded bytes, a row per row of docs."""
    out = encode_texts(docs, vocabulary, pattern, key, text)
    return out.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
