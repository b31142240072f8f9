"""Journals and prompts: highlights, sections with caps, references and facts, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import has_secret, redact_personal
from ..functions.texts import cut, defuse_markdown, estimate_tokens
from ..operators.timeline import item_text

#: How many items of a kind a section or a prompt shows.
SECTION_CAPS = {"prompt": 12, "file": 8, "action-command": 6, "web": 10}
HIGHLIGHTS = 5


def highlights(modules: DataFrame, n: int = HIGHLIGHTS) -> DataFrame:
    return modules.where("selected").orderBy(F.desc("score"), "start_ts", "key").limit(n)


def capped(items: DataFrame, caps: dict[str, int] = SECTION_CAPS, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """The first items of each kind in a block; kinds without a cap stay whole."""
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(2**31 - 1))
    n = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("ts", "ordinal"))
    return items.withColumn("place", n).where(F.col("place") <= limit)


def skipped(items: DataFrame, caps: dict[str, int] = SECTION_CAPS, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """(by, kind, more): how many a cap hides."""
    limit = F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return items.groupBy(*by, "kind").agg(F.count("*").alias("n")).withColumn("more", F.col("n") - limit).where("more > 0").select(*by, "kind", "more")


def facts(modules: DataFrame) -> DataFrame:
    """(fact_id, text, source_ids, confidence) of selected modules; one without sources is unverified."""
    return modules.where("selected").select(F.col("key").alias("fact_id"), defuse_markdown(F.col("title")).alias("text"), "source_ids", F.when(F.size("source_ids") > 0, "confirmed").otherwise("unverified").alias("confidence"))


def confidence_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("confidence").agg(F.count("*").alias("n"))


def footnotes(rows: DataFrame, most: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fact_id, i, source_id, number): the first ids of each fact, numbered by where they first appear among the facts of a journal; by names the columns that tell journals apart, so that each is numbered in a task of its own."""
    cited = rows.select(*by, "fact_id", F.posexplode(F.slice("source_ids", 1, most)).alias("i", "source_id"))
    first = cited.groupBy(*by, "source_id").agg(F.min(F.struct("fact_id", "i")).alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("first")))
    return cited.join(numbered.drop("first"), [*by, "source_id"]).select(*by, "fact_id", "i", "source_id", "number")


#: How many items of a kind a model is shown; OTHERS of any other.
PROMPT_CAPS = {"note": 5, "image": 10, "prompt": 50, "reply": 30, "commit": 30, "clone": 5, "file": 40, "action-file": 40, "worktree": 40, "action-command": 25, "action-search": 10, "shell": 30, "web": 25}
OTHERS = 30


def prompt_lines(items: DataFrame, home: str | None = None, caps: dict[str, int] = PROMPT_CAPS, run: tuple[str, ...] = ()) -> DataFrame:
    """(run, ref, source_id, line, secret, tokens): what a model would be shown, numbered e1, e2 and so on over a run; secret lines must not leave. Of pages, those searched for and those looked at longest come first."""
    from ..functions.redact import redact_home

    repeats = F.coalesce("repeats", F.lit(1)) if "repeats" in items.columns else F.lit(1)
    web = F.col("kind") == "web"
    column = lambda c, t: F.col(c) if c in items.columns else F.lit(None).cast(t)
    weight = [F.when(web & column("term", "string").isNotNull(), 0).otherwise(1), F.when(web, -F.coalesce(column("secs", "double"), F.lit(0.0))), F.when(web, -repeats)]
    within = Window.partitionBy(*run, "project", "block", "kind").orderBy(*weight, "ts", "ordinal")
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(OTHERS))
    rows = items.withColumn("__place", F.row_number().over(within)).where(F.col("__place") <= limit)
    line = cut(redact_personal(redact_home(item_text(rows), home)), 4000)
    ref = F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(*run).orderBy("project", "block", "ts", "ordinal")).cast("string"))
    return rows.withColumn("line", line).select(*run, ref.alias("ref"), "project", "block", "kind", "source_id", "line", has_secret(F.col("label")).alias("secret"), estimate_tokens(F.col("line")).alias("tokens"))


def prompt_skipped(items: DataFrame, caps: dict[str, int] = PROMPT_CAPS) -> DataFrame:
    """(project, block, kind, more): how many items of a kind a model isn't shown."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(OTHERS))
    return items.groupBy("project", "block", "kind").agg(F.count("*").alias("n")).withColumn("more", F.col("n") - limit).where("more > 0").select("project", "block", "kind", "more")


def entries_to_facts(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Facts of a model's entries (fact_id, text, refs array): references become source ids, unknown ones are dropped, an entry without any is unverified."""
    known = entries.select("fact_id", F.posexplode("refs").alias("i", "ref")).join(refs.select("ref", "source_id").dropDuplicates(["ref"]), "ref")
    ids = known.groupBy("fact_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("i", "source_id"))), lambda x: x["source_id"])).alias("source_ids"))
    rows = entries.drop("refs").join(ids, "fact_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.expr("cast(array() as array<string>)")))
    return rows.withColumn("confidence", F.when(F.size("source_ids") > 0, "confirmed").otherwise("unverified"))


def plain_text(markdown):
    """A journal's text without footnotes and notes on confidence, for reading."""
    lines = F.filter(F.split(markdown, r"\r?\n"), lambda x: ~x.rlike(r"^\[\^[^\]]+\]:") & ~x.rlike(r"^>\s*(?:置信度|统计)"))
    return F.array_join(F.transform(lines, lambda x: F.rtrim(F.regexp_replace(x, r"\[\^[^\]]+\]", ""))), "\n")
