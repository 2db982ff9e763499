"""Every registered query of the label side ends, and gives the rows of its SQL oracle, over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from proofmark.plans import queries, runs  # noqa: F401  they register themselves
from proofmark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows(names, found):
    order = sorted(names)
    return Counter(tuple(plain(dict(zip(names, r, strict=True))[n]) for n in order) for r in found)


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as c:
        c.sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_are_those_of_the_oracle(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df.columns, df.collect())
    if name in ORACLES:
        told = tables.sql(ORACLES[name])
        assert sorted(told.columns) == sorted(df.columns)
        assert found == rows(told.columns, told.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
