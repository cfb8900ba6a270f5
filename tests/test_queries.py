"""Every query with SQL against DuckDB, over whole small tables."""

import os

import duckdb
import pytest

from ductus import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        assert rows(found) == rows(duck.sql(queries.ORACLES[name]).df())
    else:
        assert len(found) > 0


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_perplexity_of_every_line(spark):
    lines = queries.script_lines(spark, SF)
    got = queries.QUERIES["perplexity"](spark, SF)
    assert got.count() == lines.count() == got.filter("log10_perplexity IS NOT NULL").count()
