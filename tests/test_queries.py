"""Every registered query that has SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from hearthline.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, got = bag(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        rel = con.sql(SQL[name])
        names, want = bag(rel.columns, rel.fetchall())
        assert columns == names
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).columns == ["property", "n_periods", "total_s"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150
