"""Exports of version control: git logs and status, Subversion XML. Texts come as a column, a file to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of logs whose records start with 0x1e and whose fields hash, author, email, time, subject are parted by 0x1f, numstat lines below. A record is a row from the scan on, so a long log is many tasks."""
    return parse_git_log(spark.read.text(path, lineSep=RECORD).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file")))


def parse_git_log(records: DataFrame) -> DataFrame:
    """(hash, author, email, committed_at, message, additions, deletions, files) of records."""
    lines = F.split(F.col("record"), r"\r?\n")
    head = F.split(F.element_at(lines, 1), FIELD)
    stat = F.filter(F.transform(lines, lambda x: F.split(x, "\t", 3)), lambda x: F.size(x) == 3)
    total = lambda i: F.aggregate("stat", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[i].try_cast("long"), F.lit(0)))
    rows = records.withColumns({"head": head, "stat": stat}).where(F.size("head") >= 5)
    return rows.select(F.trim(F.col("head")[0]).alias("hash"), F.col("head")[1].alias("author"), F.col("head")[2].alias("email"), F.try_to_timestamp(F.col("head")[3]).alias("committed_at"), F.col("head")[4].alias("message"), total(0).alias("additions"), total(1).alias("deletions"), F.transform("stat", lambda x: x[2]).alias("files"), *[c for c in records.columns if c not in ("record",)])


def parse_git_status(lines: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(repo, status, path, mtime) of porcelain lines (repo, line); a rename is its new path, mtime comes from stats (repo, path, mtime)."""
    path = F.regexp_replace(F.element_at(F.split(F.substring("line", 4, 100_000), " -> "), -1), '^"|"$', "")
    rows = lines.where(F.length("line") > 3).select("repo", F.trim(F.substring("line", 1, 2)).alias("status"), path.alias("path"))
    return rows.withColumn("mtime", F.lit(None).cast("timestamp")) if stats is None else rows.join(stats.select("repo", "path", "mtime"), ["repo", "path"], "left").select("repo", "status", "path", "mtime")


def without_nested_untracked(status: DataFrame, repos: DataFrame) -> DataFrame:
    """status rows but untracked ones in a repository below their own."""
    from ..operators.attribution import longest_prefix

    full = status.withColumn("__full", F.concat_ws("/", "repo", "path"))
    found = longest_prefix(full, repos.select(F.col("repo").alias("root"), F.col("repo").alias("__owner")), "__full", "root", ("__owner",))
    return found.where(~((F.col("status") == "??") & (F.col("__owner") != F.col("repo")))).drop("__full", "__owner", "matched_root")


def by_author(commits: DataFrame, needle: str | None) -> DataFrame:
    """Commits whose author or address holds needle, whatever the case."""
    if not needle:
        return commits
    n = F.lit(needle.lower())
    return commits.where(F.contains(F.lower("author"), n) | F.contains(F.lower(F.coalesce("email", F.lit(""))), n))


def arrivals(repos: DataFrame, holds: Column) -> DataFrame:
    """(repo, at, remote): repositories (repo, description_mtime, birthtime, remote) that came within a range."""
    from ..functions.texts import clean_remote

    at = F.coalesce("description_mtime", F.when(F.unix_seconds("birthtime") > 0, F.col("birthtime")))
    return repos.withColumn("at", at).where(holds).select("repo", "at", clean_remote(F.col("remote")).alias("remote"))


LOG_SCHEMA = "_revision long, author string, date string, msg string, paths struct<path: array<struct<_VALUE: string, _action: string, _kind: string>>>"
STATUS_SCHEMA = "_path string, `wc-status` struct<_item: string, _props: string>"
INFO_SCHEMA = "_revision string, url string, `relative-url` string, repository struct<root: string>"
# Subversion's words for a state and their letters.
STATES = {"modified": "M", "added": "A", "deleted": "D", "missing": "!", "replaced": "R", "conflicted": "C", "unversioned": "?", "obstructed": "~"}


def read_svn_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "logentry").schema(LOG_SCHEMA).load(path)


def svn_commits(entries: DataFrame, copy_path: str, copy_id: str, author: str | None = None) -> DataFrame:
    """Commits of log entries, their files below the working copy; directories and what lies outside are left out. Lines aren't counted there."""
    prefix = copy_path.rstrip("/")
    files = F.filter("paths.path", lambda p: (F.coalesce(p["_kind"], F.lit("file")) != "dir") & (p["_VALUE"] == F.lit(prefix)) | (F.coalesce(p["_kind"], F.lit("file")) != "dir") & p["_VALUE"].startswith(prefix + "/"))
    files = F.transform(files, lambda p: F.regexp_replace(F.substring(p["_VALUE"], F.lit(len(prefix) + 1), F.length(p["_VALUE"])), "^/+", ""))
    rows = entries.select(F.concat(F.lit("svn:r"), F.col("_revision").cast("string"), F.lit("@"), F.lit(copy_id)).alias("hash"), F.col("_revision").alias("revision"), "author", F.lit(None).cast("string").alias("email"), F.date_trunc("MILLISECOND", F.try_to_timestamp("date")).alias("committed_at"), F.col("msg").alias("message"), F.lit(0).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"), files.alias("files"), F.lit("svn-commit").alias("source_type"))
    return by_author(rows, author)


def svn_worktree(entries: DataFrame) -> DataFrame:
    """(status, path) of status entries; a change of properties only is M, unchanged ones are left out."""
    item, props = F.col("wc-status._item"), F.col("wc-status._props")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), item)
    return entries.select(F.coalesce(state, F.when(props.isin("modified", "conflicted"), "M")).alias("status"), F.col("_path").alias("path")).where("status IS NOT NULL")


def read_svn_status(spark: SparkSession, path: str) -> DataFrame:
    """Status entries with file, the export that they stand in."""
    return spark.read.format("xml").option("rowTag", "entry").schema(STATUS_SCHEMA).load(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_svn_info(spark: SparkSession, path: str) -> DataFrame:
    """(url, relative_url, repo_root, revision, file) of info exports; relative_url is where the working copy lies in its repository, null for the root."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(INFO_SCHEMA).load(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    relative = F.nullif(F.regexp_replace(F.trim("relative-url"), r"^\^/*", ""), F.lit(""))
    return rows.select(blank(F.col("url")).alias("url"), relative.alias("relative_url"), blank(F.col("repository.root")).alias("repo_root"), F.col("_revision").alias("revision"), F.col("_metadata.file_path").alias("file"))


def relative_path(repo_path: Column, base: Column) -> Column:
    """A path of a log entry below the working copy that lies at base in its repository; null for what lies elsewhere and for the working copy itself."""
    p = F.regexp_replace(repo_path, "/+$", "")
    own = F.regexp_replace(F.coalesce(base, F.lit("")), "^/+|/+$", "")
    below = F.when(F.startswith(p, F.concat(F.lit("/"), own, F.lit("/"))), F.substring(p, F.length(own) + 3, F.length(p)))
    return F.when(own == "", F.nullif(F.regexp_replace(p, "^/+", ""), F.lit(""))).otherwise(below)


def relative_status(status: DataFrame, stats: DataFrame) -> DataFrame:
    """(status, path, mtime) of svn_worktree() rows (status, path, root): paths below root, with what stats (path, mtime, is_dir) knows of them; directories that aren't versioned are left out."""
    from ..operators.attribution import clean_path

    path, root = clean_path(F.col("path")), clean_path(F.col("root"))
    rows = status.withColumn("__full", F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, F.regexp_replace(path, r"^\./", ""))))
    known = stats.select(clean_path(F.col("path")).alias("__full"), "mtime", "is_dir")
    rows = rows.drop("mtime").join(known, "__full", "left").where(~((F.col("status") == "?") & F.coalesce("is_dir", F.lit(False))))
    inside = F.startswith("__full", F.concat(root, F.lit("/")))
    return rows.select("status", F.when(inside, F.substring("__full", F.length(root) + 2, F.length("__full"))).otherwise(F.col("path")).alias("path"), "mtime")


def working_copy_id(root: Column) -> Column:
    return F.substring(F.sha1(root.cast("binary")), 1, 8)
