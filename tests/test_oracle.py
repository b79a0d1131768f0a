"""Every query with SQL against another engine, on the same tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, Decimal):
        return float(f"{v:.12g}")
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    rows = sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in got.collect()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
