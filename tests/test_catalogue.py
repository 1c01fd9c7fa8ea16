"""Every catalogue query against its DuckDB SQL at the smallest size."""

import decimal
import math

import duckdb
import pytest

from granary.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_like_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(str([plain(dict(zip(columns, r))[c]) for c in order]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
