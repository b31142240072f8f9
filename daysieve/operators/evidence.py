"""Evidence: builders of the one schema, first-write-wins and other upserts, selection, and the check of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import cut, stay_words
from ..functions.times import local_date

COLUMNS = ["source_type", "source_ref", "project", "path", "occurred_at", "local_date", "level", "excerpt"]


def source_id(kind: str | Column, ref: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), ref.cast("string"))


def parse_source_id(c: Column) -> dict[str, Column]:
    """Type and reference, parted at the first colon."""
    return {"source_type": F.substring_index(c, ":", 1), "source_ref": F.substring(c, F.instr(c, ":") + 1, F.length(c))}


def evidence(rows: DataFrame, source_type: Column | str, ref: Column, at: Column, excerpt: Column, level: Column | str = "L0", path: Column | None = None, project: str = "project", cutoff: int = 4, zone: str = "UTC", n: int = 200) -> DataFrame:
    """Evidence rows of any source."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(lit(source_type).alias("source_type"), ref.cast("string").alias("source_ref"), F.col(project).cast("string").alias("project"), (F.lit(None).cast("string") if path is None else path).alias("path"), at.alias("occurred_at"), local_date(at, cutoff, zone).alias("local_date"), lit(level).alias("level"), cut(excerpt, n).alias("excerpt"))


def from_commits(commits: DataFrame, **when) -> DataFrame:
    """commits (project, repo, hash, committed_at, message, source_type)."""
    return evidence(commits, F.coalesce("source_type", F.lit("commit")), F.col("hash"), F.col("committed_at"), F.col("message"), path=F.col("repo"), **when)


def from_arrivals(rows: DataFrame, **when) -> DataFrame:
    """rows (project, repo, at, remote): repositories that came, by clone or new."""
    return evidence(rows, "clone", F.col("repo"), F.col("at"), F.coalesce("remote", F.lit("")), path=F.col("repo"), **when)


def from_images(images: DataFrame, **when) -> DataFrame:
    """images (local_date, id, name, path, ts) of notes; one without a time stands at noon."""
    at = F.coalesce("ts", F.col("local_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    rows = evidence(images.withColumn("project", F.lit("notes")), "image", F.col("id"), at, F.col("name"), "L1", F.col("path"), **when)
    return rows


def from_worktree(rows: DataFrame, now: Column, **when) -> DataFrame:
    """rows (project, path, status, mtime, source_type, outline array); a deleted file is dated now."""
    level = F.when(F.size("outline") > 0, "L1").otherwise("L0")
    return evidence(rows, F.coalesce("source_type", F.lit("worktree")), F.concat_ws(":", "project", "path"), F.coalesce("mtime", now), F.concat_ws(" ", "status", "path"), level, F.col("path"), **when)


def from_files(files: DataFrame, **when) -> DataFrame:
    level = F.when(F.size("outline") > 0, "L1").otherwise("L0")
    return evidence(files, "file", F.col("path"), F.col("mtime"), F.coalesce(F.nullif(F.array_join(F.slice("outline", 1, 5), "、"), F.lit("")), F.col("path")), level, F.col("path"), **when)


def from_web(pages: DataFrame, **when) -> DataFrame:
    """pages of group_pages(): title, number of visits, stay and browser."""
    visits = F.when(F.col("visits") > 1, F.concat(F.col("visits").cast("string"), F.lit(" 次")))
    parts = F.concat_ws("｜", F.col("title"), visits, F.nullif(stay_words(F.col("secs")), F.lit("")), F.col("browser") if "browser" in pages.columns else F.lit(None).cast("string"))
    return evidence(pages.withColumn("project", F.lit("web")), "web", F.col("url"), F.col("first_ts"), parts, path=F.col("url"), **when)


def from_notes(notes: DataFrame, **when) -> DataFrame:
    """notes (local_date, entry_id, text, ts); one without a time stands at noon."""
    at = F.coalesce("ts", F.col("local_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    return evidence(notes.withColumn("project", F.lit("notes")), "note", F.concat_ws("#", F.col("local_date").cast("string"), "entry_id"), at, F.col("text"), "L1", **when)


def from_shell(rows: DataFrame, **when) -> DataFrame:
    return evidence(rows, "shell", F.col("id"), F.col("ts"), F.col("cmd"), "L1", F.col("cwd"), **when)


def from_sessions(prompts: DataFrame, replies: DataFrame, actions: DataFrame, **when) -> DataFrame:
    """prompts, replies (provider, project, session_id, index, text, ts) and actions (…, kind, value, ts). References hold the provider, so two tools' sessions of one id stay apart."""
    ref = F.concat(F.col("provider"), F.lit("/"), F.col("session_id").cast("string"), F.lit("#"), F.col("index").cast("string"))
    out = evidence(prompts, "session", ref, F.col("ts"), F.col("text"), "L1", **when)
    out = out.unionByName(evidence(replies, "session-reply", ref, F.col("ts"), F.col("text"), "L2", **when))
    return out.unionByName(evidence(actions, "session-action", F.concat_ws(":", ref, "kind", "value"), F.col("ts"), F.col("value"), "L1", **when))


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """stored and those rows of new whose keys it lacks; the first of new of a key. What is written once stays. A null key is a key."""
    if order:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates(keys)
    there = stored.select(*[F.col(k).alias(f"__{k}") for k in keys])
    fresh = new.join(there, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """stored with new merged in by keys. how, by column: new (overwrites), keep (the stored one if there is one), fill (new unless null), max."""
    a, b = stored.withColumn("__there", F.lit(True)).alias("a"), new.withColumn("__there", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    there, was = F.col("b.__there").isNotNull(), F.col("a.__there").isNotNull()
    pick = {
        "new": lambda c: F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")),
        "keep": lambda c: F.coalesce(f"a.{c}", f"b.{c}"),
        "fill": lambda c: F.coalesce(f"b.{c}", f"a.{c}"),
        "max": lambda c: F.greatest(f"a.{c}", f"b.{c}"),
    }
    return joined.select(*[F.when(was, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys], *[pick[h](c).alias(c) for c, h in how.items()])


def select_modules(modules: DataFrame, overrides: DataFrame, excluded: tuple[str, ...] = (), project: str = "project", barred_by: str | None = None) -> DataFrame:
    """modules (key, selected) after permanent exclusions and then overrides (key, chosen), which win over both. Many rules are a table: operators.rules.excluded() marks modules by a column, named by barred_by."""
    barred = F.coalesce(F.col(barred_by), F.lit(False)) if barred_by else F.lit(False)
    for rule in excluded:
        barred = barred | (F.contains(F.coalesce(F.col(project).cast("string"), F.lit("")), F.lit(rule)) if rule else F.lit(False))
    joined = modules.join(overrides.select("key", "chosen").dropDuplicates(["key"]), "key", "left")
    return joined.withColumn("selected", F.coalesce("chosen", F.when(barred, F.lit(False)).otherwise(F.col("selected")))).drop("chosen")


def validate(facts: DataFrame, stored: DataFrame, dates: tuple | None = None) -> DataFrame:
    """facts (fact_id, source_ids array, confidence) with missing (array) and confidence 'unverified' where any is. Without ids a fact stays as it is."""
    known = stored if dates is None else stored.where(F.col("local_date").isin(list(dates)))
    known = known.select(source_id(F.col("source_type"), F.col("source_ref")).alias("cited")).distinct().withColumn("__found", F.lit(True))
    cited = facts.select("fact_id", F.explode("source_ids").alias("cited"))
    missing = cited.join(known, "cited", "left").where("__found IS NULL").groupBy("fact_id").agg(F.sort_array(F.collect_set("cited")).alias("missing"))
    rows = facts.join(missing, "fact_id", "left")
    return rows.withColumn("confidence", F.when(F.col("missing").isNotNull(), "unverified").otherwise(F.col("confidence"))).withColumn("missing", F.coalesce("missing", F.expr("cast(array() as array<string>)")))
