"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from blocklake.llm import byte_bpe, document_fingerprint, html_extraction, license_scan, line_dedup, packing, quality_rules, secret_scan, simhash, warc
from blocklake.llm.common import shared_dir, table


def op1_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op2_warc(spark, sf_dir):
    found = warc.archive_pages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    broken = F.raise_error(F.concat(F.lit("a gap in an archive that was just written: "), F.col("gap")))
    number = lambda name: F.when(F.col("gap").isNotNull(), broken.cast("string")).when(F.col(name) != "", F.col(name)).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op3_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] <= 2)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"), "n_live", "n_copied", secret_scan.joined(F.filter("spans", lambda s: s["live"])).alias("live_spans"),
    )


def op4_html_extraction(spark, sf_dir):
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.digest_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_count("text"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_document_fingerprint(spark, sf_dir):
    return document_fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)} | {"pipeline": corpus_pipeline.run}


#: Base32 of a SHA-1 in hex, from four groups of 40 bits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(s, {1 + 10 * g}, 10)) AS BIGINT) >> {35 - 5 * i}) & 31 AS INTEGER), 1)" for g in range(4) for i in range(8))
OP2_SQL = f"""WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM m"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: (kind, pattern, group of the value, least length of it, characters after the match that the pattern takes along). RE2 has no look-ahead, folds more than ASCII, and its white space lacks a character.
_SECRETS = (
    ("assign", f"""({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 12, 0),
    ("access", "AKIA[A-Z0-9]+", 0, 18, 0),
    ("hex", "[0-9a-f]+", 0, 16, 0),
    ("provider", secret_scan.KINDS[3].pattern, 0, 16, 0),
    ("url", r"://[^\x09-\x0D\x20:/@]{1,64}:([^\x09-\x0D\x20:/@]{8,128})@", 1, 8, 1),
)


def _secrets_sql(rank: int, pattern: str, group: int, least: int, extra: int) -> str:
    """Matches and what lies between them alternate, so running sums of lengths give places."""
    pattern = "'" + pattern.replace("'", "''") + "'"
    before = "list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
    found = f"SELECT r, ms, string_split_regex(t, {pattern}) AS parts FROM (SELECT r, t, regexp_extract_all(t, {pattern}) AS ms FROM d) WHERE len(ms) > 0"
    each = f"SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: {before})) AS start FROM ({found})"
    return f"SELECT r, {rank} AS rank, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) + length(m) - {extra} AS stop, regexp_extract(m, {pattern}, {group}) AS value FROM ({each}) WHERE length(regexp_extract(m, {pattern}, {group})) >= {least}"


_SPAN = f"[{', '.join(repr(k[0]) for k in _SECRETS)}][rank + 1] || ':' || start || ':' || stop"
OP3_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({' UNION ALL '.join(_secrets_sql(i, *k[1:]) for i, k in enumerate(_SECRETS))}),
owners AS (SELECT value, count(DISTINCT owner) AS n, count(DISTINCT (owner, doc_id)) AS repos FROM found JOIN d USING (r) GROUP BY value),
values_ AS (SELECT value, n <= {secret_scan.MAX_OWNERS} AND repos <= {secret_scan.MAX_REPOS} AND len(list_distinct(string_split(value, ''))) >= {secret_scan.MIN_DISTINCT} AND NOT regexp_matches(value, '(?i)example|change_?me|your|dummy|placeholder|xxxx|\\*{{4}}|12345678|abcdefgh') AS live FROM owners),
judged AS (SELECT DISTINCT r, value, live FROM found JOIN values_ USING (value)),
counts AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg({_SPAN}, ',' ORDER BY start, rank) FILTER (rank <= 2) AS base, string_agg({_SPAN}, ',' ORDER BY start, rank) AS spans, string_agg({_SPAN}, ',' ORDER BY start, rank) FILTER (live) AS live_spans FROM found JOIN values_ USING (value) GROUP BY r),
lives AS (SELECT r, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN counts USING (r) LEFT JOIN lives USING (r)"""


def oracle_sql() -> dict:
    """The others' methods (fuzzy search, learned rules, edit joins on whole tables, XXH64, BPE, dynamic programming) are held against brute force in tests/llm."""
    return {"op2_warc": OP2_SQL, "op3_secret_scan": OP3_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
