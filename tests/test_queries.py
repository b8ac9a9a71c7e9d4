"""Every registered query that has SQL gives the same rows as DuckDB."""

import importlib.util
import math

import duckdb
import pytest

import __spark_entry__ as entry
from skylark.plans import catalog, streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {**catalog.SQL, **streams.SQL}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(SQL):
        assert entry.queries()[name](spark, sf_dir).count() > 0


def test_imports_without_the_training_data_package():
    names = set(entry.queries())
    assert ("pipeline" in names) == (importlib.util.find_spec("corpus_pipeline") is not None and importlib.util.find_spec(
        "skylark.llm") is not None)
    assert set(entry.oracle_sql()) <= names
