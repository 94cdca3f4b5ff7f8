"""Every query with an oracle gives the rows that DuckDB gives for its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and isinstance(a, type(b))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
