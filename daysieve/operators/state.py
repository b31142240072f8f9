"""What a user changes or looks up: stored choices, notes, evidence by id, coverage of sources, unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_SIGNS = 50, 20_000


def show(evidence: DataFrame, wanted: str) -> DataFrame:
    """Evidence whose reference starts with wanted, of one type if it is `type:reference`; by time."""
    kind, colon, ref = wanted.partition(":")
    rows = evidence.where(F.col("source_type") == kind) if colon else evidence
    return rows.where(F.col("source_ref").startswith(ref if colon else wanted)).orderBy("occurred_at", "source_type", "source_ref")


def evidence_for(modules: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence that modules (source_ids) refer to, each once."""
    cited = modules.select(F.explode("source_ids").alias("source_id")).distinct()
    return evidence.withColumn("source_id", F.concat_ws(":", "source_type", "source_ref")).join(cited, "source_id", "left_semi")


def dirty_in_range(worktree: DataFrame, holds: Column, last_is_today: bool, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Changes without a time or in a range, the first `most` of each repository, and (repo, more): how many that hides. None of past ranges, whose state is gone."""
    rows = worktree.where((F.col("mtime").isNull() | holds) & F.lit(last_is_today))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("repo").orderBy("path")))
    more = rows.where(F.col("__n") > most).groupBy("repo").agg(F.count("*").alias("more"))
    return rows.where(F.col("__n") <= most).drop("__n"), more


def overrides(states: DataFrame, column: str = "excluded_json") -> DataFrame:
    """(local_date, key, chosen) of a stored JSON object {key: true or false}, or of the older list of keys, which all were left out; anything else is none."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    chosen = F.from_json(F.when(text.startswith("{"), text), "map<string, boolean>")
    old = states.select("local_date", F.explode(listed).alias("key"), F.lit(False).alias("chosen"))
    return old.unionByName(states.select("local_date", F.explode(chosen).alias("key", "chosen"))).where("key IS NOT NULL AND chosen IS NOT NULL")


def normal_notes(entries: DataFrame, images: DataFrame, day: str = "local_date") -> tuple[DataFrame, DataFrame]:
    """Entries (day, place, id, text, ts) with an id, the first MOST_ENTRIES of a day, cut; images (day, id, entry_id) without an entry that isn't there."""
    n = F.row_number().over(Window.partitionBy(day).orderBy("place"))
    kept = entries.where("id IS NOT NULL AND id <> ''").withColumn("__n", n).where(F.col("__n") <= MOST_ENTRIES)
    kept = kept.withColumns({"id": F.substring("id", 1, 40), "text": F.substring(F.coalesce("text", F.lit("")), 1, MOST_SIGNS)}).drop("__n")
    known = kept.select(F.col(day).alias("__day"), F.col("id").alias("__id")).distinct()
    there = images.join(known, F.col(day).eqNullSafe(F.col("__day")) & (F.col("entry_id") == F.col("__id")), "left")
    return kept, there.withColumn("entry_id", F.col("__id")).drop("__day", "__id")


def coverage(reports: DataFrame) -> DataFrame:
    """(status, sources, found) of reports (name, status, count): how many sources are there, absent or failed, and what they gave."""
    return reports.groupBy("status").agg(F.count("*").alias("sources"), F.coalesce(F.sum("count"), F.lit(0)).alias("found"))


def coverage_words(reports: DataFrame) -> DataFrame:
    """One sentence: the sources that gave something, and those that couldn't be read. A report is a row for each source."""
    seen = F.when((F.col("status") == "ok") & (F.col("count") > 0), F.concat("name", F.lit(" "), F.col("count").cast("string"), F.lit(" 个会话")))
    failed = F.when(~F.col("status").isin("ok", "absent"), F.concat("name", F.lit("（"), F.coalesce("error", F.lit("解析失败")), F.lit("）")))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("name", c.alias("w"))))), lambda x: x["w"])
    rows = reports.agg(listed(seen).alias("seen"), listed(failed).alias("missing"))
    a = F.when(F.size("seen") > 0, F.concat(F.lit("看过 "), F.array_join("seen", "、")))
    b = F.when(F.size("missing") > 0, F.concat(F.lit("没有读到 "), F.array_join("missing", "、")))
    words = F.concat_ws("；", a, b)
    return rows.select(F.when(words != "", F.concat(words, F.lit("。"))).otherwise("").alias("sentence"))


def unique_ids(rows: DataFrame, column: str = "project", order: str = "root") -> DataFrame:
    """rows whose ids that come again are numbered from 2 on; an empty id is unknown."""
    base = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    rows = rows.withColumn(column, base).withColumn("__n", F.row_number().over(Window.partitionBy(column).orderBy(order)))
    return rows.withColumn(column, F.when(F.col("__n") > 1, F.concat(column, F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col(column))).drop("__n")


def files_from_patch(patch: Column) -> Column:
    """The files that a patch adds, updates or deletes, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r'\*\*\* (?:Add|Update|Delete) File: (.+?)(?=\\n|\\r|\r?\n|"|$)'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda x: x != ""))


def command_text(parts: Column) -> Column:
    """The command of an argument list on one line; of `shell -c command` only the command."""
    from ..functions.texts import collapse

    wrapped = (F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).rlike("^-l?c$")
    return collapse(F.when(F.coalesce(wrapped, F.lit(False)), F.try_element_at(parts, F.lit(-1))).otherwise(F.array_join(parts, " ")))


def thread_id(file: Column) -> Column:
    """The thread that a log named rollout-time-id[_id...].jsonl belongs to, the last id; null for other names."""
    from ..functions.texts import base_name

    ids = F.regexp_extract(base_name(file), r"(?i)^rollout-\d{4}-\d{2}-\d{2}T[\d-]+-((?:[0-9a-f-]{36}_)*[0-9a-f-]{36})\.jsonl$", 1)
    return F.nullif(F.element_at(F.split(ids, "_"), -1), F.lit(""))


def cached(rows: DataFrame, path: str, taken_at: Column | None = None, seconds: int = 120) -> DataFrame:
    """rows as written at path if that is younger than `seconds`, else written there anew, as a version of its own: who reads an older one ends with it."""
    from ..sinks.tables import snapshot

    now = F.current_timestamp() if taken_at is None else taken_at
    return snapshot(rows, path, rows.sparkSession.range(1).select(F.unix_micros(now)).first()[0], seconds)


def changed_documents(new: DataFrame, stored: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """The documents to be written: those that aren't stored or whose text differs, with previous, the text to be kept as a backup."""
    old = stored.select(F.col(key).alias("__key"), F.col(text).alias("previous"))
    joined = new.join(old, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.where(F.col("previous").isNull() | (F.col("previous") != F.col(text))).drop("__key")
