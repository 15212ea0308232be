"""A corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
reads it back from Parquet as its docs. All but the last keep the columns of
documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklake.llm import line_dedup, packing, quality_rules, secret_scan, shingle_join
from blocklake.llm.common import settled, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject."""
    return quality_rules.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one; a document of which nothing is left goes."""
    left = _documents(line_dedup.drop_repeated_lines(docs.select(*COLUMNS)))
    return left.where(F.col("text").rlike(r"\S"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by a five-word Jaccard similarity of 0.8 or more, that with the smallest id.

    Documents without an id stay. The operator's fingerprints (five words, 2 bits) give the first links, each
    verified on the whole sets; texts whose fingerprints lie further apart are found by their shingles.
    """
    found = shingle_join.near_duplicates(docs)
    extra = written(found.where("doc_id != component_id").select("doc_id"), "extra")
    return docs.select(*COLUMNS).join(extra, "doc_id", "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials masked."""
    return _documents(secret_scan.redact_live(docs.select(*COLUMNS)))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot."""
    return packing.pack(docs, packing.word_count("text"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("secret scans", secrets), ("packing", batches)]

#: SQL can't express the learned rules, the fingerprints or the packing; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written to the shared folder and read again, and what its stage wrote beside it is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, functools.partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
