"""Directory trees as a table: walked by Spark's tasks, or exported; repositories, working copies and work files in it.

An inventory has a row for each entry of a directory: path, kind (file, dir or other; denied for a directory that can't
be listed), mtime, birthtime, ctime, size. `walk()` makes one from folders that all executors reach, by a Python data
source whose partitions are directories: the driver lists the uppermost levels only, until there are enough directories
to deal out, and no task enters a directory that holds no work. The other functions take any inventory, so they check
names and depth again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import names
from ..functions.texts import base_name
from ..operators.attribution import clean_path, longest_prefix

# Directories that hold no work. Those that begin with a dot are left out anyhow.
SKIP = (
    "node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", "out", "target", ".next", ".nuxt", ".cache", "vendor", "Pods", ".gradle",
    ".idea", "DerivedData", ".terraform", "coverage", ".pnpm-store", ".turbo", "$Recycle.Bin", "$RECYCLE.BIN", "System Volume Information", "Recovery",
    "Config.Msi", "$WINDOWS.~BT", "$WINDOWS.~WS", "$WinREAgent", "MSOCache", "found.000", "Trash", "lost+found", ".Spotlight-V100", ".fseventsd",
    ".DocumentRevisions-V100",
)
# Further directories that a scan of files leaves out.
SCAN_SKIP = (
    "Library", "AppData", "Applications", "System", "Windows", "Program Files", "Program Files (x86)", "ProgramData", "$RECYCLE.BIN",
    "System Volume Information", "Trash", ".Trash", "Downloads.localized", "Music", "Movies", "Pictures", "Photos", "site-packages", "Cellar", "pkg",
    "obj", "tmp", "temp", "logs", "WXWork", "Tencent Files", "nt_qq", "nt_db", "nt_temp", "nt_msg", "postgreSQL", "pgdata", "pg_wal", "pg_stat",
    "pg_notify", "Avator", "BrowserCache", "Code Cache", "GPUCache", "blob_storage", "CrashDumps", "Crashpad", "IndexedDB", "Local Storage",
    "Service Worker",
)
#: Levels below a root in which repositories are looked for, and files; how many repositories are kept.
REPOSITORY_DEPTH, SCAN_DEPTH, MOST_REPOSITORIES = 4, 6, 200
# Fixed value: said where there are more.
TOO_MANY = "扫描到的 git 仓库超过 {0} 个，只保留前 {0} 个 —— 扫描目录（--root）多半开得太大了，指向真正写代码的目录会准得多"

#: Directories that the driver lists at most before the rest is dealt to tasks.
DEALT = 256
SCHEMA = "root string, path string, depth int, kind string, mtime timestamp, birthtime timestamp, ctime timestamp, size bigint, error string"


class Pruning:
    """Which directories are entered."""

    def __init__(self, skip: list[str], fold: bool, dots: bool, depth: int):
        self.names = {x.lower() for x in skip} if fold else set(skip)
        self.fold, self.dots, self.depth = fold, dots, depth

    def enters(self, name: str, depth: int) -> bool:
        return depth <= self.depth and not (self.dots and name.startswith(".")) and (name.lower() if self.fold else name) not in self.names


class Directories(InputPartition):
    """Some directories (root, path, depth), and whether what lies below them is walked too."""

    def __init__(self, found: list[tuple[str, str, int]], deep: bool):
        self.found, self.deep = found, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.pruning = Pruning(json.loads(options["skip"]), options["fold"] == "true", options["dots"] == "true", int(options["depth"]))
        self.dealt = int(options["dealt"])

    def partitions(self) -> list[Directories]:
        """Levels are listed here while they are few; a directory whose children alone are too many is left whole to a task."""
        level, done = [(r, r, 0) for r in self.roots], []
        while level and len(level) < self.dealt:
            below, whole = [], []
            for root, path, depth in level:
                inner: list[tuple[str, str, int]] = []
                try:
                    with os.scandir(path) as entries:
                        for e in entries:
                            if e.is_dir(follow_symlinks=False) and self.pruning.enters(e.name, depth + 1):
                                inner.append((root, e.path, depth + 1))
                                if len(inner) > self.dealt:
                                    break
                except OSError:
                    pass  # the task that lists it says so
                if len(inner) > self.dealt:
                    whole.append((root, path, depth))
                else:
                    done.append((root, path, depth))
                    below += inner
            if whole:
                return self._parts(done, [*whole, *below])
            level = below
        return self._parts(done, level)

    def _parts(self, listed: list, walked: list) -> list[Directories]:
        some = max(1, -(-len(walked) // (4 * self.dealt)))
        parts = [Directories(walked[i : i + some], True) for i in range(0, len(walked), some)]
        return parts + ([Directories(listed, False)] if listed else []) or [Directories([], False)]

    def read(self, partition: Directories) -> Iterator[tuple]:
        from datetime import datetime, timezone

        at = lambda s: datetime.fromtimestamp(s, timezone.utc) if s else None
        left = list(reversed(partition.found))
        while left:
            root, path, depth = left.pop()
            try:
                with os.scandir(path) as entries:
                    for e in entries:
                        try:
                            is_dir = e.is_dir(follow_symlinks=False)
                            kind = "dir" if is_dir else "file" if e.is_file(follow_symlinks=False) else "other"
                            st = e.stat(follow_symlinks=False)
                            yield root, e.path, depth, kind, at(st.st_mtime), at(getattr(st, "st_birthtime", None)), at(st.st_ctime), st.st_size, None
                        except OSError as x:  # it went meanwhile
                            yield root, e.path, depth, "denied", None, None, None, None, x.strerror
                            continue
                        if is_dir and partition.deep and self.pruning.enters(e.name, depth + 1):
                            left.append((root, e.path, depth + 1))
            except OSError as x:
                yield root, path, depth, "denied", None, None, None, None, x.strerror


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk(spark: SparkSession, roots: list[str], depth: int = SCAN_DEPTH, skip: tuple[str, ...] = SKIP, fold: bool = True, dots: bool = True, dealt: int = DEALT) -> DataFrame:
    """The inventory of roots; directories in skip (whatever the case, if fold), and with a dot in front if dots, are listed but not entered. Links are not followed."""
    spark.dataSource.register(Tree)
    plain = [r.removeprefix("file://") if r.startswith("file:///") else r.removeprefix("file:") for r in roots]
    given = {"roots": json.dumps([os.path.abspath(r) for r in plain]), "skip": json.dumps(list(skip)), "depth": depth, "dealt": dealt, "fold": str(fold).lower(), "dots": str(dots).lower()}
    return spark.read.format("directory_tree").options(**given).load()


def skips(name: Column) -> Column:
    """Whether the search for repositories leaves out a directory of this name."""
    return name.startswith(".") | F.lower(name).isin(*sorted({x.lower() for x in SKIP}))


def skips_in_scan(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a scan of files does."""
    return name.startswith(".") | name.isin(*dict.fromkeys((*SKIP, *SCAN_SKIP, *extra)))


def reached(path: Column, roots: tuple[str, ...] | Column | None, depth: int | None, leaves_out) -> Column:
    """Whether a walk from one of a few roots, or from a row's own, comes to this clean path: at most depth directories lie between, none of which leaves_out says to skip. Without roots all of the path's directories count."""
    if roots is None:
        roots = ("",)
    if isinstance(roots, tuple):
        roots = F.array(*(F.lit(r.rstrip("/")) for r in roots))

    def from_root(root: Column) -> Column:
        rest = F.split(F.substring(path, F.length(root) + 1, F.length(path)), "/")
        dirs = F.filter(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), lambda x: x != "")
        fine = (F.startswith(path, F.concat(root, F.lit("/"))) | (root == "")) & ~F.exists(dirs, leaves_out)
        return fine if depth is None else fine & (F.size(dirs) <= depth)

    return F.exists(roots, from_root)


def _roots(inventory: DataFrame, roots: tuple[str, ...] | None) -> tuple[str, ...] | Column | None:
    """Those given, else the root that a row was found below."""
    return F.array(F.regexp_replace("root", "/+$", "")) if roots is None and "root" in inventory.columns else roots


def repositories(inventory: DataFrame, roots: tuple[str, ...] | None = None, marker: str = ".git", depth: int = REPOSITORY_DEPTH, most: int | None = None) -> DataFrame:
    """(path) of the directories that hold marker (.svn for working copies), also within one another. With most, the first that a walk in the order of names meets."""
    path = clean_path(F.col("path"))
    rows = inventory.withColumn("__path", path).where(base_name(F.col("__path")) == marker).where(reached(F.col("__path"), _roots(inventory, roots), depth, skips))
    found = rows.select(F.regexp_replace("__path", r"/[^/]*$", "").alias("path")).distinct()
    return found if most is None else found.orderBy(F.split("path", "/")).limit(most)


def too_many(found: DataFrame, most: int = MOST_REPOSITORIES) -> DataFrame:
    """(warning): a row if more than most were found."""
    return found.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(TOO_MANY.format(most)).alias("warning"))


def classified(inventory: DataFrame, in_range, roots: tuple[str, ...] | None = None, repos: DataFrame | None = None, depth: int | None = None, skip: tuple[str, ...] = (), exclude: tuple[str, ...] = (), everything: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The files of an inventory that a scan comes to, with outcome: other_time, in_repo, sensitive, noise or hit; at, the time that lies in the range, and created, if the file only came then.

    in_range maps an instant column to a condition; exclude are directories left out by their whole paths, skip by their names.
    """
    path = clean_path(F.col("path"))
    rows = inventory.withColumn("path", path)
    if "kind" in rows.columns:
        rows = rows.where("kind = 'file'")
    name = base_name(F.col("path"))
    rows = rows.where(~name.startswith(".")).where(reached(F.col("path"), _roots(inventory, roots), depth, lambda x: skips_in_scan(x, skip)))
    for x in exclude:
        rows = rows.where(~F.col("path").startswith(x.rstrip("/") + "/"))
    born, moved = F.col("birthtime"), F.col("ctime")
    changed = F.coalesce(in_range(F.col("mtime")), F.lit(False))
    at = F.when(changed, F.col("mtime")).when(in_range(born), born).when(in_range(moved), moved)
    rows = rows.withColumns({"created": ~changed, "at": at})
    inside = F.lit(False)
    if repos is not None:
        rows = longest_prefix(rows, repos.select(F.col("root"), F.lit(True).alias("__in")), "path", "root", ("__in",)).drop("matched_root")
        inside = F.coalesce("__in", F.lit(False))
    outcome = F.when(F.col("at").isNull(), "other_time").when(inside, "in_repo").when(names.is_sensitive(name), "sensitive").when(~names.is_work(name, everything, extra), "noise").otherwise("hit")
    return rows.withColumn("outcome", outcome).drop("__in")


def hits(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, mtime, size, created) of classified files; with most, the first in the order of a walk."""
    rows = files.where("outcome = 'hit'").select("path", F.col("at").alias("mtime"), "size", "created")
    return rows if most is None else rows.orderBy(F.split("path", "/")).limit(most)


def counters(files: DataFrame, most: int | None = None) -> DataFrame:
    """One row on classified files: scanned, dirs (that hold a file), skipped_in_repo, skipped_sensitive, skipped_noise, truncated (whether there are as many hits as are kept)."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    by_dir = files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("__dir")).agg(F.count("*").alias("s"), n("in_repo").alias("r"), n("sensitive").alias("v"), n("noise").alias("x"), n("hit").alias("h"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_dir.agg(none("s").alias("scanned"), F.count("*").alias("dirs"), none("r").alias("skipped_in_repo"), none("v").alias("skipped_sensitive"), none("x").alias("skipped_noise"), (none("h") >= most if most is not None else F.lit(False)).alias("truncated"))


def touched_since(inventory: DataFrame, since: Column) -> DataFrame:
    """Files that may hold something of a range: none changed before it does."""
    return inventory.where("kind = 'file'").where(F.col("mtime") >= since)


def newest(inventory: DataFrame, n: int, suffix: str = "") -> DataFrame:
    """The n files of this ending that changed last, ties by path."""
    return inventory.where("kind = 'file'").where(F.col("path").endswith(suffix)).orderBy(F.desc("mtime"), "path").limit(n)
