import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daysieve.operators import sessions, turns
from daysieve.streaming import live

START = datetime(2024, 1, 9)
ITEM = "project string, ts timestamp, ordinal long, kind string"
MESSAGE = "session_id string, ts timestamp, seq long, role string, text string, is_final boolean"


def feed(spark, path, parts, schema):
    """Each part is a file; they are read in this order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, rows, out, checkpoint):
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and not q.isActive


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_a_stream_are_those_of_a_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, at = [], {p: START for p in "abc"}
    for i in range(240):
        p = rng.choice("abc")
        at[p] += timedelta(minutes=rng.choice([0, 1, 10, 29, 31, 45, 90]), microseconds=rng.randrange(5) * 1000)
        rows.append((p, at[p], i, rng.choice(["commit", "prompt", "reply", "file"])))
    rows.sort(key=lambda r: r[1])
    # any order within two hours, in parts; some rows again
    mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.random() * 115))
    cut = [0, 50, 120, 180, len(mixed)]
    parts = [mixed[a:b] + rng.sample(mixed[a:b], 5) for a, b in zip(cut, cut[1:])]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    stream = lambda: live.live_blocks(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(source), late="2 hours", hold_minutes=600)
    feed(spark, source, parts[:2], ITEM)
    run(spark, stream(), out, checkpoint)
    # from the checkpoint on
    feed(spark, source, parts[2:] + [[("z", START + timedelta(days=30), 0, "end")], [("z", START + timedelta(days=60), 1, "end")]], ITEM)
    run(spark, stream(), out, checkpoint)
    got = spark.read.parquet(out).where("project <> 'z'")
    whole = sessions.split_by_gap(spark.createDataFrame(rows, ITEM))
    want = whole.groupBy("project", "block").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("items"), F.count_if(F.col("kind") == "commit").alias("commits"), F.count_if(F.col("kind") == "prompt").alias("prompts")).drop("block")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_turns_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for s in "ab":
        for i in range(80):
            rows.append((s, START + timedelta(minutes=i * 3, seconds=rng.randrange(9)), i, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["t", "  ", None]) and f"text {i}", rng.random() < 0.2))
    mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.random() * 50))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    parts = [mixed[:60], mixed[60:], [("z", START + timedelta(days=30), 0, "user", "end", False)], [("z", START + timedelta(days=60), 1, "user", "end", False)], [("a", START + timedelta(days=70), 99, "user", "later", False)], [("z", START + timedelta(days=90), 2, "user", "end", False)], [("z", START + timedelta(days=120), 3, "user", "end", False)]]
    feed(spark, source, parts, MESSAGE)
    run(spark, live.live_turns(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(source), late="1 hour"), out, checkpoint)
    got = spark.read.parquet(out).where("session_id <> 'z'").select("session_id", "turn", "prompt", "reply")
    every = spark.createDataFrame(rows + parts[4], MESSAGE)
    want = turns.fold_turns(every, most=None).select("session_id", "turn", "prompt", "reply")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_evidence_is_new_once(spark, tmp_path):
    schema = "source_type string, source_ref string, occurred_at timestamp"
    parts = [[("commit", "a", START), ("commit", "b", START), ("commit", "a", START)], [("commit", "a", START + timedelta(minutes=5)), ("file", "a", START)]]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    stream = lambda: live.new_evidence(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for part in parts:
        feed(spark, source, [part], schema)
        run(spark, stream(), out, checkpoint)
    assert sorted((r.source_type, r.source_ref) for r in spark.read.parquet(out).collect()) == [("commit", "a"), ("commit", "b"), ("file", "a")]


def test_rows_of_a_batch_are_kept_by_few_calls():
    import pandas as pd

    calls, chunks = [], []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or ([] if name == "listTimers" else Handle())

        def appendValue(self, value):
            calls.append("appendValue")
            chunks.append(value)

    class Timer:
        def getCurrentWatermarkInMs(self):
            return 0

    keeper = live.InOrder(live.Blocks(1, "reply"), 1)
    keeper.init(Handle())
    list(keeper.handleInputRows(("a",), iter([pd.DataFrame({"us": range(500), "ordinal": range(500), "kind": ["file", None] * 250})]), Timer()))
    assert len(calls) < 20 and len(chunks) == 1
