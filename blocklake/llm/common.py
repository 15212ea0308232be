"""What several operators share: tables, the shared folder, Arrow mapping."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset and all run in one process (as in tests), a fresh local one is set. On a cluster this
    raises instead: a local folder would lose what other machines write.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="blocklake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Paths that written() has made inside each settled() that is under way, the innermost last.
_made: list[list[str]] = []


#: Spark's setting to delete the shuffle files of an action as soon as it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: it cuts lineage, outlives executors, and its rows no longer change. The shuffles that made it are deleted."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    if _made:
        _made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a table in the shared folder. The tables that make() wrote on its way there are deleted: nothing needs them any more."""
    _made.append([])
    try:
        out = written(make(), name)
    finally:
        paths = _made.pop()
    kept = paths.pop()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if _made:
        _made[-1].append(kept)
    return out


#: A table of up to so many narrow rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
SMALL = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _cells(column: pa.Array) -> list:
    """A column's values; arrays of numbers as NumPy arrays, which make no object of each number."""
    if not (pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type)):
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def map_rows(df: DataFrame, row: Callable[..., tuple], schema: str, init: Callable[[], object] | None = None) -> DataFrame:
    """df's columns through row(*values) -> tuple, batch by batch; init() makes a helper once per task, passed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        helper = (init(),) if init else ()
        for batch in batches:
            columns = [_cells(c) for c in batch.columns]
            rows = [row(*helper, *values) for values in zip(*columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def utf8(column: Column) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(column.cast("binary"), F.lit(b""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value found once."""
    return F.get(F.transform(F.array(value), use), 0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
