"""Queries of this package that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from attestra.llm import registry


def plain(rows):
    return sorted((tuple(x if x is None or isinstance(x, (bool, int, float)) else str(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert plain(got.select(*order).collect()) == plain(want.select(*order).fetchall())
