"""Compressed block data as Spark DataFrames."""
