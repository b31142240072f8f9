import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daysieve.operators import state
from daysieve.sinks import tables

ROW = "id string, v string, n long"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_only_buckets_that_differ_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    t = tables.Table(spark, path, ("id",), 16)
    assert t.read() is None
    first = spark.createDataFrame([(f"k{i}", "a", i) for i in range(200)] + [(None, "a", 1)], ROW)
    assert len(t.merge(first, {"v": "new", "n": "max"})) == 16
    before = files(path)
    # the same again writes nothing
    assert t.merge(first, {"v": "new", "n": "max"}) == [] and t.merge(first.limit(5)) == [] and files(path) == before
    changed = t.merge(spark.createDataFrame([("k1", "b", 0), ("k2", "a", 2), (None, "c", 9)], ROW), {"v": "new", "n": "max"})
    assert 1 <= len(changed) <= 2 and t.versions() == [1, 2]
    want = [(f"k{i}", "b" if i == 1 else "a", i) for i in range(200)] + [(None, "c", 9)]
    assert rows(t.read()) == sorted(map(str, want))
    assert rows(t.read(1)) == rows(first)
    # first write wins without rules
    assert len(t.merge(spark.createDataFrame([("k1", "z", 0), ("new", "z", 0), ("new", "z", 0)], ROW))) == 1
    assert rows(t.read()) == sorted([*map(str, want), str(("new", "z", 0))]) and t.versions() == [2, 3]
    # what moves between columns is a change, though a hash passes nulls over
    t.merge(spark.createDataFrame([("m", "1", None)], ROW), {"v": "new", "n": "new"})
    assert len(t.merge(spark.createDataFrame([("m", None, 1)], ROW), {"v": "new", "n": "new"})) == 1


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = tables.Table(spark, str(tmp_path / "t"), ("id",), 4)
    t.merge(spark.createDataFrame([("a", "x", 1)], ROW))
    with monkeypatch.context() as m:
        m.setattr(tables.Folder, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.merge(spark.createDataFrame([("a", "y", 1), ("b", "y", 1)], ROW), {"v": "new", "n": "new"})
    assert rows(t.read()) == [str(("a", "x", 1))] and t.versions() == [1]
    t.merge(spark.createDataFrame([("b", "z", 1)], ROW))
    assert rows(t.read()) == [str(("a", "x", 1)), str(("b", "z", 1))]


def test_two_writers_of_one_version(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), ("id",), 4)
    t.merge(spark.createDataFrame([("a", "x", 1)], ROW))
    m = t.manifest()
    t.merge(spark.createDataFrame([("b", "x", 1)], ROW))
    with pytest.raises(FileExistsError):
        t._write(spark.createDataFrame([("c", "x", 1)], ROW), m, [0, 1, 2, 3], None)
    assert rows(t.read()) == [str(("a", "x", 1)), str(("b", "x", 1))]


def test_readers_of_a_snapshot_end_with_it(spark, tmp_path):
    path, at = str(tmp_path / "day"), datetime(2024, 1, 9)
    now = lambda m: F.lit(at + timedelta(minutes=m)).cast("timestamp")
    first = state.cached(spark.range(1000), path, now(0))
    some = first.toLocalIterator()
    next(some)
    assert state.cached(spark.range(5), path, now(3)).count() == 5
    assert 1 + sum(1 for _ in some) == 1000 and first.count() == 1000
    assert state.cached(spark.range(0), path, now(9)).count() == 0


def test_documents_with_backups(spark, tmp_path):
    path, docs = str(tmp_path / "out"), lambda *r: spark.createDataFrame(r, "day string, markdown string")
    stamp = lambda m: F.lit(datetime(2024, 1, 9, 0, m)).cast("timestamp")
    assert tables.publish(docs(("d1", "one"), ("d2", "two")), path, stamp(0))
    before = files(path)
    assert tables.publish(docs(("d1", "one"), ("d2", "two")), path, stamp(1)) == [] and files(path) == before
    assert len(tables.publish(docs(("d1", "other"), ("d3", "three")), path, stamp(2))) in (1, 2)
    assert rows(tables.Table(spark, f"{path}/documents", ("day",)).read()) == sorted(map(str, [("d1", "other"), ("d2", "two"), ("d3", "three")]))
    assert [(r.day, r.markdown) for r in tables.Table(spark, f"{path}/backups", ("day", "replaced_at")).read().collect()] == [("d1", "one")]
