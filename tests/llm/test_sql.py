"""The SQL of the operators' queries in DuckDB against Spark, over whole tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blocklake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    number = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(number, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want) and len(got)


def test_secrets_sql_on_a_fixture(spark):
    """All kinds, copied and live values, nulls, repeated rows and characters beyond the first plane."""
    from blocklake.llm import secret_scan
    from tests.llm.test_corpus_operators import secret_documents

    df = secret_documents(spark)
    con = duckdb.connect()
    frame = df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    con.register("documents", frame)
    want = con.execute(registry.OP3_SQL).fetchall()
    names = [c[0] for c in con.description]
    found = secret_scan.scan_secrets(df).select("doc_id", secret_scan.joined("spans").alias("spans"), "n_live", "n_copied", secret_scan.joined(F.filter("spans", lambda s: s["live"])).alias("live")).collect()
    at = [names.index(c) for c in ("doc_id", "spans", "n_live", "n_copied", "live_spans")]
    assert sorted(map(str, map(tuple, found))) == sorted(str(tuple(row[i] for i in at)) for row in want)
