"""Visited pages: grouped over a day, and as sessions of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import to_title
from ..functions.times import duration_minutes
from .sessions import _tops, score, split_by_gap, stats

GAP_MINUTES = 30
LEAST_PAGES = 3
#: Visits of all people stand in one timeline, so they are dealt by shorter slices than projects are.
SLICE_MINUTES = 5


def _pages(visits: DataFrame, by: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    order = F.struct("ts", "ordinal")
    longest = F.struct((-F.length(F.coalesce("title", F.lit("")))).alias("n"), F.col("ts"), F.col("ordinal"))
    return visits.groupBy(*by, "url").agg(
        F.min_by("host", order).alias("host"),
        F.min_by("title", longest).alias("title"),
        F.min(F.struct("ts", "ordinal", "term"))["term"].alias("term"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("visits"),
        F.sum(F.coalesce("secs", F.lit(0.0))).alias("secs"),
        F.min("ordinal").alias("ordinal"),
        *[F.min(F.struct("ts", "ordinal", c))[c].alias(c) for c in more],
    )


def group_pages(visits: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each url: first and last visit, number, seconds, longest title; of most, those visited most."""
    pages = _pages(visits, [], tuple(c for c in ("browser", "profile") if c in visits.columns))
    if most is not None:
        pages = pages.orderBy(F.desc("visits"), F.desc("secs"), "first_ts", "url").limit(most)
    return pages


def profile_report(profiles: DataFrame, visits: DataFrame) -> DataFrame:
    """(browser, profile, status, count, error) of profiles (browser, profile, readable, error): denied where one can't be opened, failed where reading it gave an error, else ok with the number of its visits that stay."""
    counts = visits.groupBy("browser", "profile").agg(F.count("*").alias("count"))
    rows = profiles.join(counts, ["browser", "profile"], "left")
    status = F.when(~F.coalesce("readable", F.lit(True)), "denied").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.select("browser", "profile", "status", F.when(F.col("status") == "ok", F.coalesce("count", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("count"), F.when(F.col("status") != "ok", F.col("error")).alias("error"))


def visits_of(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """The visits to pages that were kept."""
    return visits.join(pages.select("url"), "url", "left_semi")


def web_blocks(visits: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """(block, url, ...): sessions of visits, each page once in its session."""
    rows = visits.where("ts IS NOT NULL AND url IS NOT NULL").withColumns({"project": F.lit("web"), "kind": F.lit("visit")})
    return _pages(split_by_gap(rows, gap_minutes, slice_minutes=SLICE_MINUTES), ["block"])


def web_modules(visits: DataFrame, gap_minutes: float = GAP_MINUTES, least: int = LEAST_PAGES) -> DataFrame:
    """Sessions of at least `least` pages, the others of a day together as one that is not selected; its block is the day's number, negative."""
    pages = web_blocks(visits, gap_minutes)
    items = pages.select("block", F.col("first_ts").alias("ts"), "last_ts", "ordinal", F.lit("web").alias("kind"), F.col("title").alias("label"), F.concat(F.lit("web:"), "url").alias("source_id"), "url", "host", "term", "secs", F.lit(None).cast("boolean").alias("created"))
    size = items.groupBy("block").agg((F.count("*") >= least).alias("whole"), F.unix_date(F.to_date(F.min("ts"))).alias("day"))
    items = items.join(size, "block").withColumn("block", F.when(F.col("whole"), F.col("block")).otherwise(-F.col("day").cast("long"))).drop("day")
    order = F.struct("ts", "ordinal")
    rows = items.groupBy("block").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("__last_start"), F.max("last_ts").alias("__last"), F.min("ordinal").alias("ordinal"), F.count("*").alias("items"), *[c.alias(n) for n, c in stats().items()], F.count("term").alias("terms"), F.min_by(F.when(F.col("term").isNotNull(), F.col("term")), F.when(F.col("term").isNotNull(), order)).alias("term"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ts", "ordinal", "source_id"))), lambda x: x["source_id"])).alias("source_ids"))
    rows = rows.join(_tops(items, ["block"], {"hosts": (F.col("host"), 3, F.lit(1))}), "block", "left")
    whole = F.col("block") > 0
    rows = rows.withColumn("end_ts", F.when(whole, F.col("__last")).otherwise(F.col("__last_start")))
    rows = rows.withColumn("duration_min", F.when(whole, duration_minutes(F.col("start_ts"), F.col("end_ts"))).otherwise(F.lit(0).cast("long")))
    n = F.col("pages").cast("string")
    searched = F.concat(F.lit("搜索「"), to_title(F.col("term"), 18), F.lit("」"), F.when(F.col("terms") > 1, F.concat(F.lit("等 "), F.col("terms").cast("string"), F.lit(" 次"))).otherwise(""), F.lit("，浏览 "), n, F.lit(" 个页面"))
    title = F.when(~whole, F.concat(F.lit("零散浏览 "), n, F.lit(" 个页面"))).when(F.col("terms") > 0, searched).otherwise(F.concat(F.lit("浏览 "), n, F.lit(" 个页面："), F.array_join("hosts", "、")))
    key = F.when(whole, F.concat(F.lit("web@"), F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm"))).otherwise(F.concat(F.lit("web-misc@"), F.date_format("start_ts", "yyyy-MM-dd")))
    return rows.withColumns({"title": title, "key": key, "category": F.lit("网页"), "project": F.lit("web"), "score": F.when(whole, score(F.col("duration_min"))).otherwise(F.lit(0.0)), "selected": whole}).drop("__last", "__last_start", "terms", "term", "hosts", "hosts_all")


def last_term(terms: DataFrame, key: str = "url_id", order: str = "rowid") -> DataFrame:
    """(key, term): the last search term of each address."""
    return terms.groupBy(key).agg(F.max_by("term", order).alias("term"))


__all__ = ["group_pages", "last_term", "profile_report", "visits_of", "web_blocks", "web_modules"]
