"""Smaller operators around a day: usage, templates, pictures for modules, places to look in, hours of a board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attribution import clean_path


def usage(runs: DataFrame, by: str = "local_date") -> DataFrame:
    """(by, calls, input, output) of runs (by, input_tokens, output_tokens, ok) that worked."""
    return runs.where("ok").groupBy(by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output"))


def override(builtin: DataFrame, custom: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key, the custom one where both have it."""
    return custom.unionByName(builtin.join(custom.select(key), key, "left_anti"), allowMissingColumns=True)


def attach_images(modules: DataFrame, images: DataFrame) -> DataFrame:
    """modules with the pictures (id, for_key) that were given to them among source_ids and images; others are left out."""
    own = images.where("for_key IS NOT NULL").groupBy(F.col("for_key").alias("key")).agg(F.sort_array(F.collect_set(F.concat(F.lit("image:"), "id"))).alias("__ids"))
    rows = modules.join(own, "key", "left").withColumn("__ids", F.coalesce("__ids", F.expr("cast(array() as array<string>)")))
    return rows.withColumns({"source_ids": F.array_distinct(F.concat("source_ids", "__ids")), "images": F.col("images") + F.size("__ids")}).drop("__ids")


def candidate_roots(cwds: DataFrame, fixed: DataFrame, home: str, most: int = 6) -> DataFrame:
    """(path, weight): the parents of the directories most sessions work in, and fixed ones (path, weight), the heaviest first; never the home itself."""
    path = clean_path(F.col("cwd"))
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    at = F.when((parent == home) | (parent == ""), path).otherwise(parent)
    top = cwds.where(F.col("cwd").startswith("/")).groupBy(at.alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most)
    rows = top.select("path", (F.col("n") + 100).cast("long").alias("weight")).unionByName(fixed.select(clean_path(F.col("path")).alias("path"), F.col("weight").cast("long").alias("weight")))
    return rows.where(F.col("path") != home).groupBy("path").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "path")


def board_hours(modules: DataFrame, by: str = "project", margin_minutes: int = 30) -> DataFrame:
    """(by, hour, modules): the hours that modules (start_ts, end_ts), each with a margin, touch; the others of a board are idle."""
    m = F.expr(f"INTERVAL {margin_minutes} MINUTES")
    last = F.col("end_ts") + m - F.expr("INTERVAL 1 MICROSECOND")
    hours = F.sequence(F.date_trunc("HOUR", F.col("start_ts") - m), F.date_trunc("HOUR", last), F.expr("INTERVAL 1 HOUR"))
    return modules.select(by, F.explode(hours).alias("hour")).groupBy(by, "hour").agg(F.count("*").alias("modules"))


def idle_spans(hours: DataFrame, by: str = "project") -> DataFrame:
    """(by, from_hour, to_hour): stretches between a board's touched hours, each as one."""
    from pyspark.sql import Window

    after = F.lead("hour").over(Window.partitionBy(by).orderBy("hour"))
    hour = F.expr("INTERVAL 1 HOUR")
    return hours.withColumn("__next", after).where(F.col("__next") > F.col("hour") + hour).select(by, (F.col("hour") + hour).alias("from_hour"), F.col("__next").alias("to_hour"))


def mask_key(c: Column, shown: int = 4) -> Column:
    """A key of which only the last signs are shown; short ones not at all."""
    n = F.length(c)
    return F.when(n > 2 * shown, F.concat(F.repeat(F.lit("*"), n - shown), F.substring(c, -shown, shown))).otherwise(F.repeat(F.lit("*"), n))


def model_json(c: Column, required: tuple[str, ...] = ()) -> Column:
    """The JSON between the first and the last brace of a model's answer, as a variant; null if it is none, or lacks one of the required keys."""
    found = F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    for key in required:
        found = F.when(F.try_variant_get(found, f"$.{key}", "variant").isNotNull(), found)
    return found


#: Modules of a board that are laid out in one group, about; a longer stretch is a group of its own.
LAID_TOGETHER = 4096


def tracks(modules: DataFrame, by: str = "board") -> DataFrame:
    """modules (by, start_ts, end_ts, ...) with track, from 0: none overlaps another of its track, and each board has as few as can be. A module takes the lowest track that is free where it starts; ties go by end and by key, if there is such a column.

    Where nothing of a board lies across an instant, all tracks are free, so stretches between such instants are laid out by themselves.
    """
    import heapq

    import pyarrow as pa
    from pyspark.sql import Window

    order = ["start_ts", "__end", *(["key"] if "key" in modules.columns else [])]
    rows = modules.withColumn("__end", F.greatest("start_ts", F.coalesce("end_ts", "start_ts")))
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__new", (F.col("start_ts") >= F.max("__end").over(before)).cast("int"))
    # short stretches of a board are laid out together: each goes with the place at which it begins
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.max(F.when(F.col("__new") == 1, F.row_number().over(Window.partitionBy(by).orderBy(*order)))).over(so_far)
    rows = rows.withColumn("__stretch", F.floor(F.coalesce(begins, F.lit(0)) / LAID_TOGETHER))
    out = modules.schema.names

    def laid(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        free: list[int] = []
        busy: list[tuple] = []
        track = []
        for start, end in zip(group.column("start_ts").cast(pa.int64()).to_pylist(), group.column("__end").cast(pa.int64()).to_pylist()):
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            track.append(heapq.heappop(free) if free else len(busy))
            heapq.heappush(busy, (end, track[-1]))
        return group.select(out).append_column("track", pa.array(track, pa.int32()))

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in modules.schema.fields)
    return rows.where("start_ts IS NOT NULL").groupBy(by, "__stretch").applyInArrow(laid, f"{given}, track int")
