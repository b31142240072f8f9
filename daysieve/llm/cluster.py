"""Helpers that run on Spark: cutting lineage in the shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only up to so many rows of a few numbers each.
BROADCAST_ROWS = 200_000
#: Counters by which crowded keys are found; fewer than an eighth of them can be crowded, which bounds what is broadcast.
COUNTERS = 1 << 20
#: A key with no more rows is never crowded.
CROWD = 4096


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir, which all executors share; a lost executor costs nothing that is in it.

    Only a local master, as in tests, gets a folder of its own. With spark.cleaner.referenceTracking.cleanCheckpoints
    Spark deletes what is no longer referred to.
    """
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="daysieve-checkpoints-"))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast df if its counted rows are few; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """docs but the rows whose id is in gone (doc_id); the ids are broadcast if few."""
    gone = cut(gone.where("doc_id IS NOT NULL").distinct().withColumnRenamed("doc_id", "__gone"))
    return docs.join(small_side(gone, gone.count()), F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")


def least_of_each(rows: DataFrame, key: str, order: list, n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each key by order, which must be total. They are ranked in salted parts first, so no task takes in what all tasks have of one key."""
    part = F.pmod(F.xxhash64(*order), F.lit(salts)).alias("__part")
    rows = rows.select("*", part)
    for by in ([key, "__part"], [key]):
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__place") <= n).drop("__place")
    return rows.drop("__part")


def dealt(rows: DataFrame, key: str, by: str) -> DataFrame:
    """rows with crowd (null, or about how many rows of its key there are, if these are too many for a task) and part, which deals those rows by another column; 0 for all others.

    Keys, which are hashes, are counted by their remainders, so the counts are of bounded size whatever the rows. Those
    that have more than CROWD rows and eight times the mean are crowded; a key that shares a crowded one's remainder
    goes with it.
    """
    counter = F.pmod(F.col(key), F.lit(COUNTERS))
    counts = cut(rows.groupBy(counter.alias("__counter")).agg(F.count("*").alias("crowd")))
    total = counts.agg(F.sum("crowd")).first()[0] or 0
    crowded = F.broadcast(counts.where(F.col("crowd") > max(CROWD, 8 * total // COUNTERS)))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.ceil(F.col("crowd") / CROWD)), F.lit(0).cast("long"))
    return rows.join(crowded, counter == F.col("__counter"), "left").withColumn("part", part).drop("__counter")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node long, component long): the smallest node reachable over edges, for each node that has one.

    Alternating large-star and small-star steps: each node sends its smallest neighbour to the others, so the
    edges never outgrow their first number, and rounds grow with the logarithm of a component's length. Nulls
    and loops are dropped. The lineage is cut in each round.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    before = None
    # a second key makes each join shuffle both sides anew, so the edges of a hub can be split over tasks
    code = F.xxhash64("u").alias("code")
    for _ in range(most_rounds):
        # large star: each u's larger neighbours go to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").select(code, "u", "v").join(least.select(code, "u", "m"), ["code", "u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each u's smaller neighbours, and u, go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.select(code, "u", "v").join(least.select(code, "u", "m"), ["code", "u"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        e = e.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
