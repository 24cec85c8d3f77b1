"""Every query that has an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from attestra.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if x != x else round(x, 9) + 0.0
        return x if x is None or isinstance(x, (bool, int)) else float(x) if hasattr(x, "as_tuple") else str(x)

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    expected = want.select(*[f'"{c}"' for c in order]).fetchall()
    assert plain(got.select(*[f"`{c}`" for c in order]).collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
