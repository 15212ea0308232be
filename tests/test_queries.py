"""Every query of the engine against DuckDB over the raw tables."""

import duckdb
import pytest

from blocklake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_damage_of_empty_texts(spark, tmp_path):
    """Empty and null texts, whose streams have no blocks, and null ids count like all others."""
    rows = [(0, ""), (1, None), (2, "a"), (3, "word " * 1000), (None, "word"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["damage_check"](spark, str(tmp_path)).select("kind", "error", "n").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT kind, error, n FROM ({catalog.oracle_sql()['damage_check']})").fetchall()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want) == 6
