"""A stream of .xz files: each new file is decoded once. Stateless; an extension of the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklake.operators.blocks import xz_decompress


def stream_files(spark: SparkSession, path: str, limit: int | None = None, per_trigger: int = 100) -> DataFrame:
    """path, modificationTime and data of the files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.xz").load(path)
    return found.select("path", "modificationTime", xz_decompress(F.col("content"), limit).alias("data"))


def with_progress(df: DataFrame, name: str = "xz") -> DataFrame:
    """df with a metric of the bytes and values that have passed, as the query's listeners see it."""
    return df.observe(name, F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("values"))
