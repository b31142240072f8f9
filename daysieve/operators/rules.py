"""Rules of users as tables: many substrings looked for in many texts at once, the last rule or any rule counting.

Rules meet texts by grams. A text that holds a rule's substring holds all its grams, so of each rule the gram that the
fewest texts hold is looked up in an equi-join, and what it finds is checked. No rule is tried on a text that lacks
its rarest gram, and nothing loops over rules, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import display_name, slug
from .attribution import clean_path, dedupe_ids, outside, without_nested

#: Length of grams; shorter substrings are grams themselves.
GRAM = 3


def grams(text: Column, lengths: tuple[int, ...]) -> Column:
    """The distinct grams of a text, of each of a few lengths."""
    of = lambda q: F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(q) for q in lengths)))


def holding(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """(text, needle): the distinct pairs of which the text holds the needle, as it stands; nulls and empty needles hold nothing and are held by nothing."""
    wanted = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    lengths = tuple(sorted(r.q for r in wanted.select(F.least(F.length("needle"), F.lit(GRAM)).alias("q")).distinct().collect()))
    known = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    if not lengths:
        return known.select("text", F.lit(None).cast("string").alias("needle")).limit(0)
    posted = known.select("text", F.explode(grams(F.col("text"), lengths)).alias("gram"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    own = grams(F.col("needle"), (GRAM,))
    asked = wanted.select("needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(own)).alias("gram"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = rarest.where("least.n > 0").select("needle", F.col("least.gram").alias("gram"))
    return posted.join(rarest, "gram").where(F.contains("text", F.col("needle"))).select("text", "needle")


def last_rule(texts: DataFrame, rules: DataFrame, text: str = "text", take: str = "project") -> DataFrame:
    """(text, take) of each distinct text that a rule (match, take, ordinal) holds for: the last of these by ordinal. An empty match holds for every text."""
    last = Window.partitionBy("match").orderBy(F.desc("ordinal"), take)
    rules = rules.where(F.col("match").isNotNull()).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    found = holding(texts, rules, text, "match").join(rules.select(F.col("match").alias("needle"), "ordinal", take), "needle").select("text", "ordinal", take)
    every = rules.where("match = ''").first()
    if every is not None:
        found = found.unionByName(texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumns({"ordinal": F.lit(every["ordinal"]), take: F.lit(every[take])}))
    return found.groupBy("text").agg(F.max_by(take, "ordinal").alias(take))


def excluded(modules: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """modules (project, name, ...) with excluded: whether a rule (rule) stands in its project's name, id or root (projects: project, root). Blank rules are none."""
    rules = rules.select(F.trim("rule").alias("needle"))
    named = modules.select("project", F.explode(F.array("project", "name")).alias("text")).distinct()
    texts = named.unionByName(projects.join(modules.select("project").distinct(), "project").select("project", F.col("root").alias("text")))
    hit = texts.join(holding(texts, rules).select("text").distinct(), "text").select("project").distinct().withColumn("__hit", F.lit(True))
    return modules.join(hit, "project", "left").withColumn("excluded", F.coalesce("__hit", F.lit(False))).drop("__hit")


def projects(repos: DataFrame, sessions: DataFrame, extra: DataFrame, sub_projects: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(project, name, root, renamed): repositories (root); sub-projects (repo, path, project) of those that are known; working directories of sessions (cwd, action_roots) and others (root) that none of those before holds.

    A session whose actions are all in other projects than its working directory's doesn't make that a project. Ids
    that clash are told apart, then the rules of users (match, project, ordinal) rename what they hold for, the last first.
    """
    known = repos.select(clean_path(F.col("root")).alias("root")).distinct()
    named = None
    if sub_projects is not None:
        below = F.regexp_replace("path", r"^(\./)+|^/+", "")
        sub = sub_projects.where("repo IS NOT NULL AND path IS NOT NULL AND project IS NOT NULL").select(clean_path(F.col("repo")).alias("repo"), below.alias("path"), F.trim("project").alias("given"))
        sub = sub.join(known.select(F.col("root").alias("repo")), "repo").withColumn("root", clean_path(F.concat_ws("/", "repo", F.nullif("path", F.lit("")))))
        named = sub.groupBy("root").agg(F.max("given").alias("given"), F.min("repo").alias("repo"))
        known = known.unionByName(named.select("root")).distinct()
    cwd = clean_path(F.col("cwd"))
    elsewhere = (F.size("action_roots") > 0) & ~F.array_contains(F.transform("action_roots", clean_path), cwd)
    own = sessions.where("cwd IS NOT NULL AND cwd NOT IN ('', '.')").where(~F.coalesce(elsewhere, F.lit(False))).select(cwd.alias("root"))
    for more in (own, extra.select(clean_path(F.col("root")).alias("root"))):
        known = known.unionByName(without_nested(outside(more.distinct(), known, "root")))
    rows = known.distinct().withColumn("name", display_name(F.col("root"))).withColumn("renamed", F.lit(False))
    rows = rows.withColumn("project", slug(F.col("name")))
    if named is not None:
        rows = rows.join(named.select("root", "given", F.lit(True).alias("__sub")), "root", "left")
        rows = rows.withColumn("name", F.coalesce(F.nullif("given", F.lit("")), "name")).withColumn("renamed", F.coalesce("__sub", F.lit(False))).drop("given", "__sub")
    rows = dedupe_ids(rows.select("project", "name", "root", "renamed"))
    if rules is not None:
        given = last_rule(rows, rules.withColumnRenamed("project", "given"), "root", "given").withColumnRenamed("text", "root")
        rows = rows.join(given, "root", "left")
        rows = rows.withColumn("project", F.when(F.col("given").isNotNull(), slug(display_name(F.col("given")))).otherwise(F.col("project"))).withColumn("renamed", F.col("renamed") | F.col("given").isNotNull()).withColumn("name", F.coalesce("given", "name")).drop("given")
    return rows.select("project", "name", "root", "renamed")
