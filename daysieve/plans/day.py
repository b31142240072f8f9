"""A day from its sources to ranked modules, one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import to_title
from ..operators import sessions as s
from ..operators import web
from ..operators.evidence import select_modules

MODULE = ["key", "title", "category", "project", "start_ts", "end_ts", "duration_min", "items", *s.STATS, "source_ids", "tools", "score", "selected", "burst", "ordinal"]


def blocks(items: DataFrame, gap_minutes: float = s.GAP_MINUTES) -> DataFrame:
    """Items in blocks, deduplicated within them."""
    return s.dedupe(s.split_by_gap(s.complete(items), gap_minutes))


def work_modules(items: DataFrame, gap_minutes: float = s.GAP_MINUTES, burst_seconds: float = s.BURST_SECONDS, burst_files: int = s.BURST_FILES, run: Column | None = None) -> DataFrame:
    """Modules of a timeline: a row for each block that isn't low signal, and one for all those of a run. run tells it by start_ts; by default it is a day."""
    kept = blocks(items, gap_minutes)
    rows = s.describe(kept).join(s.bursts(kept, burst_seconds, burst_files), ["project", "block"], "left")
    no_talk = (F.col("prompts") == 0) & (F.col("commits") == 0) & (F.col("commands") == 0) & (F.col("shell") == 0)
    low = s.low_signal(F.col("document_work"))
    burst = F.coalesce("burst", F.lit(False)) & no_talk & ~low
    n = F.col("files").cast("string")
    rows = rows.withColumns({"low": low, "burst": burst, "ordinal": F.col("block")})
    whole = rows.where("NOT low").withColumns({
        "title": F.when(F.col("burst"), F.concat(F.lit("新增项目 "), F.col("project").cast("string"), F.lit("（"), n, F.lit(" 个文件）"))).otherwise(F.col("title")),
        "category": F.when(F.col("burst"), "杂项").otherwise(F.col("category")),
        "score": F.when(F.col("burst"), 1.0).otherwise(F.col("score")),
        "selected": F.lit(True),
        "key": s.module_key(F.col("project"), F.col("start_ts")),
    })
    run = (F.date_format("start_ts", "yyyy-MM-dd") if run is None else run.cast("string")).alias("day")
    left = kept.join(rows.where("low").select("project", "block", run), ["project", "block"])
    order = F.struct("project", "ts", "ordinal")
    misc = left.groupBy("day").agg(F.count("*").alias("items"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), *[c.alias(k) for k, c in s.stats().items()], F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("source_id")))), lambda x: x["source_id"])).alias("source_ids"))
    misc = misc.withColumns({"project": F.lit(None).cast("string"), "duration_min": F.lit(0).cast("long"), "key": F.concat(F.lit("misc@"), "day"), "title": F.concat(F.lit("零散文件改动 "), F.col("files").cast("string"), F.lit(" 个")), "category": F.lit("杂项"), "score": F.lit(0.0), "selected": F.lit(False), "burst": F.lit(False), "ordinal": F.lit(0).cast("long"), "tools": F.expr("cast(array() as array<string>)")})
    return whole.withColumn("project", F.col("project").cast("string")).select(*MODULE).unionByName(misc.select(*MODULE))


def note_modules(notes: DataFrame, images: DataFrame) -> DataFrame:
    """A module for each note (local_date, entry_id, text, ts) that has text or images (id, entry_id, name, ts)."""
    pictures = images.where("entry_id IS NOT NULL").groupBy("entry_id").agg(F.count("*").alias("n_images"), F.sort_array(F.collect_list(F.concat(F.lit("image:"), "id"))).alias("image_ids"), F.max("ts").alias("last_image"))
    rows = notes.join(pictures, "entry_id", "left").withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("n_images", F.coalesce("n_images", F.lit(0))).where("text <> '' OR n_images > 0")
    at = F.coalesce("ts", F.col("local_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    own = F.array(F.concat_ws("", F.lit("note:"), F.col("local_date").cast("string"), F.lit("#"), "entry_id"))
    empty = F.expr("cast(array() as array<string>)")
    zero = {k: F.lit(0).cast("long") for k in s.STATS}
    return rows.select(F.concat(F.lit("note@"), "entry_id").alias("key"), F.when(F.col("text") != "", to_title(F.col("text"), 40)).otherwise(F.concat(F.col("n_images").cast("string"), F.lit(" 张图片"))).alias("title"), F.lit("手记").alias("category"), F.lit("notes").alias("project"), at.alias("start_ts"), F.greatest(at, "last_image").alias("end_ts"), F.lit(0).cast("long").alias("duration_min"), ((F.col("text") != "").cast("long") + F.col("n_images")).alias("items"), *[(zero | {"notes": (F.col("text") != "").cast("long"), "images": F.col("n_images").cast("long")})[k].alias(k) for k in s.STATS], F.concat(F.when(F.col("text") != "", own).otherwise(empty), F.coalesce("image_ids", empty)).alias("source_ids"), empty.alias("tools"), F.lit(100.0).alias("score"), F.lit(True).alias("selected"), F.lit(False).alias("burst"), F.lit(0).cast("long").alias("ordinal"))


def build_modules(items: DataFrame, visits: DataFrame | None = None, notes: DataFrame | None = None, images: DataFrame | None = None, gap_minutes: float = s.GAP_MINUTES, web_gap_minutes: float = web.GAP_MINUTES, **burst) -> DataFrame:
    """All modules of a timeline, visits and notes with unique keys. rank orders them by score; the rest of small things stands last."""
    rows = work_modules(items, gap_minutes, **burst)
    if visits is not None:
        found = web.web_modules(visits, web_gap_minutes).withColumns({"tools": F.expr("cast(array() as array<string>)"), "burst": F.lit(False)})
        rows = rows.unionByName(found.select(*MODULE))
    if notes is not None:
        rows = rows.unionByName(note_modules(notes, images))
    return s.dedupe_keys(rows)


def headline(modules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, first_ts, last_ts, modules, items) of modules, the rest of small things left out: when work began and ended, and how much it was."""
    rows = modules.where(~F.col("key").startswith("misc@"))
    return rows.groupBy(*by).agg(F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"), F.count("*").alias("modules"), F.sum("items").alias("items"))


def ranked(modules: DataFrame) -> DataFrame:
    """Modules in order: by score, the rest of small things last."""
    return modules.orderBy(F.col("key").startswith("misc@"), F.desc("score"), "start_ts", "key")


def day(items: DataFrame, overrides: DataFrame | None = None, excluded: tuple[str, ...] = (), **how) -> DataFrame:
    """Modules of a day after selection."""
    rows = build_modules(items, **how)
    return rows if overrides is None else select_modules(rows, overrides, excluded)
