"""Every named query against its SQL form in DuckDB."""

import collections

import duckdb
import pytest

from careerlens.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _bag(df.columns, got) == _bag(rel.columns, rel.fetchall())


def test_every_query_reads_given_tables():
    for name, sql in ORACLES.items():
        assert any(f" {t}" in sql or f"\n{t}" in sql for t in TABLES), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["company", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
