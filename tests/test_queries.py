"""Every registered query against its oracle, at the smallest scale."""

import math

import duckdb
import pytest

from gaugewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    try:
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.6g}" if not isinstance(value, int) else str(value)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in ORACLES
    oracle = duck.sql(ORACLES[name])
    assert sorted(oracle.columns) == columns
    at = [oracle.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in oracle.fetchall())
