"""Shell logs, browser histories and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import is_credential_command
from ..functions.texts import base_name, collapse, cut
from .inventory import classified, counters, hits, skips

MOST_COMMAND = 300
CHROMIUM_MS, SAFARI_S = 11_644_473_600_000, 978_307_200


def read_shell_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_shell_log(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_shell_log(lines: DataFrame) -> DataFrame:
    """(ts, cwd, cmd, id) of lines time, directory and command, parted by the first two tabs; others are skipped."""
    part = lambda i: F.regexp_extract(F.trim(F.regexp_replace("line", r"\r$", "")), r"^([^\t]*)\t([^\t]*)\t(.*)$", i)
    rows = lines.select(F.try_to_timestamp(F.trim(part(1))).alias("ts"), F.trim(part(2)).alias("cwd"), cut(collapse(part(3)), MOST_COMMAND).alias("cmd")).where("ts IS NOT NULL AND cmd <> ''")
    rows = rows.withColumn("ts", F.date_trunc("MILLISECOND", "ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.withColumn("id", F.substring(F.sha1(F.concat_ws("\t", iso, "cwd", "cmd").cast("binary")), 1, 16))


def collect_shell(commands: DataFrame, holds: Column | None = None) -> DataFrame:
    """Commands of a range, each once, without those that carry credentials."""
    rows = commands if holds is None else commands.where(holds)
    return rows.where(~is_credential_command(F.col("cmd"))).dropDuplicates(["id"])


def shell_counts(commands: DataFrame, holds: Column) -> DataFrame:
    """One row on the commands of a range: total and skipped_credential, those that carry credentials."""
    return commands.where(holds).agg(F.count("*").alias("total"), F.count_if(is_credential_command(F.col("cmd"))).alias("skipped_credential"))


def chromium_visits(visits: DataFrame, urls: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(ts, url, title, secs, term) of visits (url, visit_time, transition, visit_duration) and urls (id, url, title, hidden)."""
    core = F.col("transition").bitwiseAND(F.lit(255))
    v = visits.where(~core.isin(3, 4, 8)).select(F.col("url").alias("url_id"), "visit_time", "visit_duration")
    rows = v.join(urls.where("coalesce(hidden, 0) = 0").select(F.col("id").alias("url_id"), "url", "title"), "url_id")
    if terms is not None:
        from ..operators.web import last_term

        rows = rows.join(last_term(terms), "url_id", "left")
    else:
        rows = rows.withColumn("term", F.lit(None).cast("string"))
    ms = F.expr(f"visit_time div 1000 - {CHROMIUM_MS}")  # beyond 2**53, so no floating point
    return rows.select(F.timestamp_millis(ms).alias("ts"), "url", "title", F.expr("visit_duration div 1000000").cast("double").alias("secs"), "term")


def firefox_visits(visits: DataFrame, places: DataFrame) -> DataFrame:
    """The same of visits (place_id, visit_date, visit_type) and places (id, url, title)."""
    v = visits.where(~F.col("visit_type").isin(4, 5, 6, 8, 9)).select(F.col("place_id").alias("id"), "visit_date")
    return v.join(places.select("id", "url", "title"), "id").select(F.timestamp_millis(F.expr("visit_date div 1000")).alias("ts"), "url", "title", F.lit(0.0).alias("secs"), F.lit(None).cast("string").alias("term"))


def safari_visits(visits: DataFrame, items: DataFrame) -> DataFrame:
    """The same of visits (history_item, visit_time, title) and items (id, url)."""
    v = visits.select(F.col("history_item").alias("id"), "visit_time", "title")
    ms = F.floor((F.col("visit_time") + SAFARI_S) * 1000 + 0.5).cast("long")
    return v.join(items.select("id", "url"), "id").select(F.timestamp_millis(ms).alias("ts"), "url", "title", F.lit(0.0).alias("secs"), F.lit(None).cast("string").alias("term"))


def scan_files(inventory: DataFrame, in_range, repos: DataFrame | None = None, everything: bool = False, extra: tuple[str, ...] = (), roots: tuple[str, ...] | None = None, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(path, mtime, size, created) of an inventory (path, mtime, birthtime, ctime, size): work files changed or new in a range, outside repositories and directories that hold no work. With most, no more than so many."""
    return hits(classified(inventory, in_range, roots, repos, depth, everything=everything, extra=extra), most)


def scan_counts(inventory: DataFrame, in_range, repos: DataFrame | None = None, everything: bool = False, roots: tuple[str, ...] | None = None, depth: int | None = None, most: int | None = None) -> DataFrame:
    """One row about such a scan: scanned, dirs, skipped_in_repo, skipped_sensitive, skipped_noise, truncated."""
    return counters(classified(inventory, in_range, roots, repos, depth, everything=everything), most)


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory of the path is hidden or one that the search for repositories leaves out."""
    return F.exists(F.filter(F.split(F.regexp_extract(path, r"^(.*)[/\\\\][^/\\\\]*$", 1), r"[/\\\\]"), lambda d: d != ""), skips)


def with_outlines(files: DataFrame, contents: DataFrame) -> DataFrame:
    """files with outline (array) and outline_kind from contents (path, text), by extension; notebooks, tables, SQL and Markdown are read by expressions."""
    from ..functions.texts import csv_columns, extension, markdown_outline, notebook_outline, sql_outline

    ext, text = extension(base_name(F.col("path"))), F.col("text")
    outline = F.when(ext.isin("md", "markdown", "txt", "rst"), markdown_outline(text)).when(ext == "csv", csv_columns(text)).when(ext == "tsv", csv_columns(text, separator="\t")).when(ext == "sql", sql_outline(text)).when(ext == "ipynb", notebook_outline(text))
    kind = F.when(ext.isin("csv", "tsv"), "columns").when(ext == "sql", "statements").when(outline.isNotNull(), "headings")
    return files.join(contents.select("path", F.when(F.size(outline) > 0, outline).alias("outline"), F.when(F.size(outline) > 0, kind).alias("outline_kind")), "path", "left")
