"""Paths to projects: longest-prefix joins and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import base_name, dir_name, display_name, slug

#: From more rows on, a path's rows are dealt to PARTS.
CROWD, PARTS = 100_000, 1 << 16


def clean_path(path: Column) -> Column:
    """Forward slashes, no slash at the end."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/{2,}", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/+$", ""))


def ancestors(path: Column) -> Column:
    """A clean path and all directories above it, the longest first."""
    parts = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def longest_prefix(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", take: tuple[str, ...] = ("project",)) -> DataFrame:
    """rows with the columns take of the longest root that holds path, null where none does.

    Each distinct path is joined by its ancestors, an equi-join that shuffles like any other and needs no nested loop;
    the distinct paths keep a path of many rows from being joined more than once.
    """
    clash = [c for c in (*take, "matched_root") if c in rows.columns]
    rows = rows.drop(*clash).withColumn("__path", clean_path(F.col(path)))
    steps = _counted(rows).select("__path", "__n", F.posexplode(ancestors(F.col("__path"))).alias("__depth", "__root"))
    known = roots.select(clean_path(F.col(root)).alias("__root"), F.lit(True).alias("__holds"), *take).dropDuplicates(["__root"])
    depth = F.when(F.col("__holds"), F.col("__depth"))
    hits = steps.join(known, "__root", "left").groupBy("__path").agg(F.min_by(F.struct("__root", *take), depth).alias("__hit"), F.max("__n").alias("__n"))
    found = _of_paths(rows, hits)
    return found.select(*[F.col(c) for c in rows.columns if c != "__path"], F.col("__hit.__root").alias("matched_root"), *[F.col(f"__hit.{c}").alias(c) for c in take])


def _counted(rows: DataFrame) -> DataFrame:
    """(__path, __n): the distinct paths with their numbers of rows."""
    return rows.where("__path IS NOT NULL").groupBy("__path").agg(F.count("*").alias("__n"))


def _of_paths(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows with the __hit of their __path in hits (__path, __hit, __n rows).

    Paths of more than CROWD rows, of which there are few, are broadcast; their rows, and those without a path, are dealt
    by their other columns and meet nothing in the join of the rest, so no path's rows are all one task's.
    """
    known = hits.select("__path", F.col("__hit").alias("__own"), "__n")
    many = known.where(F.col("__n") > CROWD).select("__path", F.struct("__own").alias("__many"))  # at most rows / CROWD
    rest = known.select("__path", F.col("__own").alias("__one"), F.when(F.col("__n") > CROWD, -1).otherwise(0).cast("long").alias("__part"))
    plain = [f.name for f in rows.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    dealt = rows.join(F.broadcast(many), "__path", "left")
    part = F.when(F.col("__path").isNull() | F.col("__many").isNotNull(), 1 + F.pmod(F.xxhash64(*plain), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    both = dealt.withColumn("__part", part).join(rest, ["__path", "__part"], "left")
    return both.withColumn("__hit", F.coalesce("__many.__own", "__one")).select(*rows.columns, "__hit")


def without_nested(roots: DataFrame, root: str = "root") -> DataFrame:
    """Distinct roots that no other root holds."""
    clean = roots.select(clean_path(F.col(root)).alias(root)).distinct()
    steps = clean.select(root, F.explode(ancestors(F.col(root))).alias("__above")).where(F.col("__above") != F.col(root))
    nested = steps.join(clean.select(F.col(root).alias("__above")), "__above").select(root).distinct()
    return clean.join(nested, root, "left_anti")


def outside(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The rows whose path no root holds."""
    found = longest_prefix(rows.withColumn("__keep", F.lit(1)), roots.select(F.col(root)).withColumn("__in", F.lit(True)), path, root, ("__in",))
    return found.where("__in IS NULL").drop("__in", "__keep", "matched_root")


def project_dir(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """rows with project_dir: the first directory below the longest root that holds the file, else the file's own."""
    found = longest_prefix(rows, roots.withColumn("__r", F.col(root)), path, root, ("__r",)).drop("__r")
    p = clean_path(F.col(path))
    rest = F.split(F.substring(p, F.length("matched_root") + 2, F.length(p)), "/")
    own = F.regexp_replace(p, r"/[^/]*$", "")
    below = F.when(F.size(rest) > 1, F.concat_ws("/", F.col("matched_root"), F.element_at(rest, 1))).otherwise(F.col("matched_root"))
    return found.withColumn("project_dir", F.when(F.col("matched_root").isNull(), own).otherwise(below)).drop("matched_root")


def marked_root(rows: DataFrame, marked: DataFrame, path: str = "path", most: int = 8) -> DataFrame:
    """rows with marked_root: the nearest of up to `most` directories above that is in marked (dir)."""
    rows = rows.withColumn("__path", clean_path(F.col(path)))
    steps = _counted(rows).select("__path", "__n", F.posexplode_outer(F.slice(ancestors(F.col("__path")), 2, most)).alias("__d", "__dir"))
    known = marked.select(clean_path(F.col("dir")).alias("__dir")).distinct().withColumn("__holds", F.lit(True))
    hits = steps.join(known, "__dir", "left").groupBy("__path").agg(F.min_by("__dir", F.when(F.col("__holds"), F.col("__d"))).alias("__hit"), F.max("__n").alias("__n"))
    return _of_paths(rows, hits).withColumnRenamed("__hit", "marked_root").drop("__path")


def attribute_sessions(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """sessions (session_id, cwd, action_paths array) with project: by cwd, else the first action's file, else a name of cwd."""
    by_cwd = longest_prefix(sessions, projects, "cwd").withColumnRenamed("project", "__by_cwd").drop("matched_root")
    acts = sessions.select("session_id", F.posexplode("action_paths").alias("__i", "path"))
    first = longest_prefix(acts, projects).where("project IS NOT NULL").groupBy("session_id").agg(F.min_by("project", "__i").alias("__by_file"))
    named = F.when(F.col("cwd").isNotNull() & (F.col("cwd") != ""), slug(display_name(F.col("cwd"))))
    return by_cwd.join(first, "session_id", "left").withColumn("project", F.coalesce("__by_cwd", "__by_file", named)).drop("__by_cwd", "__by_file")


def route_commits(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """(hash, project): the one sub-project that all files of a commit (hash, repo, files array of paths below repo) with any agree on, else the repository's."""
    files = commits.select("hash", "repo", F.explode_outer("files").alias("__f")).withColumn("path", F.concat_ws("/", "repo", "__f"))
    owner = longest_prefix(commits.select("hash", "repo"), projects, "repo").select("hash", F.col("project").alias("__parent"))
    sub = longest_prefix(files, projects).groupBy("hash").agg(F.collect_set("project").alias("__ids"))
    return owner.join(sub, "hash").withColumn("__subs", F.filter("__ids", lambda x: x != F.col("__parent"))).select("hash", F.when(F.size("__subs") == 1, F.element_at("__subs", 1)).otherwise(F.col("__parent")).alias("project"))


def build_projects(repos: DataFrame, cwds: DataFrame, extra: DataFrame) -> DataFrame:
    """(project, name, root): repositories, then working directories and others (root) that none of those before holds."""
    known = repos.select(clean_path(F.col("root")).alias("root"))
    for more in (cwds, extra):
        more = more.select(clean_path(F.col("root")).alias("root")).distinct()
        new = without_nested(outside(more, known, "root"))
        known = known.unionByName(new)
    rows = known.distinct().withColumn("name", display_name(F.col("root"))).withColumn("project", slug(F.col("name")))
    return dedupe_ids(rows)


def dedupe_ids(projects: DataFrame) -> DataFrame:
    """Projects (project, name, root) of one id are named by their parents, and numbered where that doesn't tell them apart."""
    many = F.count("*").over(Window.partitionBy("project")) > 1
    named = F.concat_ws("/", F.nullif(dir_name(F.col("root")), F.lit("")), base_name(F.col("root")))
    named = F.when(F.length(named) > 40, F.concat(F.substring(named, 1, 40), F.lit("…"))).otherwise(named)
    rows = projects.withColumn("__many", many).withColumn("name", F.when(F.col("__many"), named).otherwise(F.col("name"))).withColumn("project", F.when(F.col("__many"), slug(F.col("name"))).otherwise(F.col("project"))).drop("__many")
    n = F.row_number().over(Window.partitionBy("project").orderBy("root"))
    return rows.withColumn("__n", n).withColumn("project", F.when(F.col("__n") > 1, F.concat("project", F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col("project"))).drop("__n")


def reconcile(projects: DataFrame, stored: DataFrame) -> DataFrame:
    """projects with the ids under which their roots are stored already."""
    kept = stored.select(clean_path(F.col("root")).alias("root"), F.col("project").alias("__stored"))
    return projects.withColumn("root", clean_path(F.col("root"))).join(kept, "root", "left").withColumn("project", F.coalesce("__stored", "project")).drop("__stored")
