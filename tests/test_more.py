from datetime import datetime, timedelta

from pyspark.sql import functions as F

from daysieve.config import Config
from daysieve.operators import evidence, state


def test_settings_stay_within_bounds():
    c = Config().merged({"cutoff_hour": 40, "gap_minutes": 1, "max_tokens": 10**9, "shell": "yes", "browser": True, "exclude_projects": [" a ", ""], "zone": " Asia/Shanghai ", "unknown": 1, "replies": None})
    assert (c.cutoff_hour, c.gap_minutes, c.max_tokens, c.shell, c.browser, c.exclude_projects, c.zone, c.replies) == (23, 5, 32_000, False, True, ("a",), "Asia/Shanghai", True)
    shown, hidden = c.disclosure()
    assert any("浏览过的网页" in x for x in shown) and not any("终端" in x for x in shown) and "文件正文" in hidden


def test_collected_days_are_taken_again_while_fresh(spark, tmp_path):
    path, at = str(tmp_path / "day"), datetime(2024, 1, 9, 10)
    now = lambda minutes: F.lit(at + timedelta(minutes=minutes)).cast("timestamp")
    first = state.cached(spark.range(3), path, now(0))
    assert first.count() == 3
    assert state.cached(spark.range(5), path, now(1)).count() == 3
    assert state.cached(spark.range(5), path, now(3)).count() == 5


def test_documents_are_written_once(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "day string, markdown string")
    new = spark.createDataFrame([("a", "x"), ("b", "new"), ("c", "z"), (None, "z")], "day string, markdown string")
    assert sorted((r.day, r.previous) for r in state.changed_documents(new, old, "day").collect()) == [("b", "y"), ("c", None)]


def test_coverage_in_a_sentence(spark):
    rows = spark.createDataFrame([("B", "ok", 2, None), ("A", "ok", 3, None), ("C", "absent", 0, None), ("D", "failed", 0, None), ("E", "denied", 0, "没有读取权限")], "name string, status string, count int, error string")
    assert state.coverage_words(rows).first().sentence == "看过 A 3 个会话、B 2 个会话；没有读到 D（解析失败）、E（没有读取权限）。"
    assert state.coverage_words(rows.limit(0)).first().sentence == ""


def test_null_keys_are_keys(spark):
    stored = spark.createDataFrame([(None, "a", 1), ("k", "b", 2)], "key string, v string, n int")
    new = spark.createDataFrame([(None, "c", 5), ("x", "d", 1)], "key string, v string, n int")
    assert sorted(map(str, (tuple(r) for r in evidence.insert_new(stored, new, ["key"]).collect()))) == sorted(map(str, [(None, "a", 1), ("k", "b", 2), ("x", "d", 1)]))
    got = sorted(map(str, (tuple(r) for r in evidence.upsert(stored, new, ["key"], {"v": "new", "n": "max"}).collect())))
    assert got == sorted(map(str, [(None, "c", 5), ("k", "b", 2), ("x", "d", 1)]))
