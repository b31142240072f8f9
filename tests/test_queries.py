"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

import __spark_entry__

DATA = os.environ.get("DAYSIEVE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op") and k != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql_or_is_an_operator_that_sql_cannot_express():
    without = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in without)
