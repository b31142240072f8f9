"""What keeps the work of a task bounded."""

from datetime import datetime

from pyspark.sql import functions as F

from daysieve.operators import attribution
from daysieve.sources import assistants


def test_files_of_any_shape_are_read_once(spark):
    df = spark.range(3).select(F.lit("f").alias("file"), F.lit('[{"role": "user", "text": "q"}, {"a": [{"sender": "bot", "text": "r"}, null, [], 1]}]').alias("text"), F.lit(datetime(2024, 1, 1)).alias("mtime"))
    rows = assistants.any_messages(df)
    assert rows.count() == 6
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3") == 1


def test_rows_of_one_path_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(attribution, "CROWD", 50, raising=False)
    roots = spark.createDataFrame([("/m", "m"), ("/m/a", "a")], "root string, project string")
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "/m/a/x").when(F.col("id") < 800, None).when(F.col("id") < 900, "/other").otherwise(F.concat(F.lit("/m/"), "id")).alias("path"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = attribution.longest_prefix(rows, roots).withColumn("task", F.spark_partition_id()).collect()
        marked = attribution.marked_root(rows, spark.createDataFrame([("/m/a",)], "dir string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = lambda i: ("a", "/m/a") if i < 700 else (None, None) if i < 900 else ("m", "/m")
    assert sorted((r.id, r.project, r.matched_root) for r in got) == [(i, *want(i)) for i in range(1000)]
    assert sorted((r.id, r.marked_root) for r in marked) == [(i, "/m/a" if i < 700 else None) for i in range(1000)]
    for out in (got, marked):
        tasks = [r.task for r in out]
        assert max(tasks.count(t) for t in set(tasks)) < 500
