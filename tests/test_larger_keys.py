"""Queries on tables whose keys are larger than those of the given ones."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__


def test_users_beyond_nine_digits_are_those_of_sql(spark, tmp_path):
    start = datetime(2024, 1, 9)
    rows = [(i, start + timedelta(hours=5 * i), 7 + i % 3 * 1_000_000_000, ("purchase", "click", "view", "error")[i % 4], 1.5, '{"k": %d}' % (i % 5)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["q_work_sessions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["q_work_sessions"])
    columns = sorted(got.columns)
    plain = lambda names, data: sorted(tuple(str(r[list(names).index(c)]) for c in columns) for r in data)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())
