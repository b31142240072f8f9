"""Work sessions: timelines split by gaps, deduplicated, with statistics, kinds, titles and scores.

A timeline row is an item: project, ts, ordinal (unique in its project, breaks ties), kind, label, source_id, and where
known prompt_source_id, session_title, provider, outline array<string>, outline_kind, created, url, host, term, secs.
Missing columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.texts import base_name, collapse, cut, dir_name, extension, to_title
from ..functions.times import duration_minutes

# Kinds of items, and below the labels shown to users (categories and titles).
FILE_KINDS = ["file", "action-file", "worktree"]
TALK_KINDS = ["prompt", "action-command", "action-search"]
DEDUPED_KINDS = ["prompt", "action-command", "action-search", "reply", "shell"]
GAP_MINUTES = 90
#: Slices of time that a timeline is dealt by.
SLICE_MINUTES = 60
BURST_SECONDS, BURST_FILES, BURST_SHARE = 5, 8, 0.8
OPTIONAL = {"prompt_source_id": "string", "session_title": "string", "provider": "string", "outline": "array<string>", "outline_kind": "string", "created": "boolean", "url": "string", "host": "string", "term": "string", "secs": "double"}


def complete(items: DataFrame) -> DataFrame:
    """items with all optional columns, without rows that have no time."""
    return items.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in items.columns}).where("ts IS NOT NULL")


def split_by_gap(items: DataFrame, gap_minutes: float = GAP_MINUTES, by: tuple[str, ...] = ("project",), sticky: str = "reply", slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """items with block: numbered from 1, anew after more than gap_minutes since the item before, unless it is sticky.

    A project's timeline is worked on by slices of time, so a busy project, and a busy day of it, are many tasks: gaps
    within a slice are counted there, and one row a slice that has items (its first and last one, its blocks) tells where
    its numbers start. The slices' length changes no result.
    """
    day = [*by, "__day"]
    in_day = Window.partitionBy(*day).orderBy("ts", "ordinal")
    over_days = Window.partitionBy(*by).orderBy("__day")

    def opens(kind: Column, ts: Column, before: Column, first: bool) -> Column:
        late = (kind != sticky) & (F.unix_micros(ts) - F.unix_micros(before) > int(gap_minutes * 60_000_000))
        return F.when(before.isNull(), F.lit(first)).otherwise(F.coalesce(late, F.lit(False))).cast("long")

    rows = items.withColumn("__day", F.expr(f"floor(unix_micros(ts) / {slice_minutes * 60_000_000}L)"))
    rows = rows.withColumn("__opens", opens(F.col("kind"), F.col("ts"), F.lag("ts").over(in_day), False))
    days = rows.groupBy(*day).agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"), F.min_by("kind", F.struct("ts", "ordinal")).alias("__kind"), F.sum("__opens").alias("__more"))
    days = days.withColumn("__new", opens(F.col("__kind"), F.col("__first"), F.lag("__last").over(over_days), True))
    start = (F.sum(F.col("__new") + F.col("__more")).over(over_days.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__more")).alias("__start")
    rows = rows.withColumn("__so_far", F.sum("__opens").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _join(rows, days.select(*day, start), day)
    return rows.withColumn("block", F.col("__so_far") + F.col("__start")).drop("__day", "__opens", "__so_far", "__start")


def _join(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    side = side.withColumnsRenamed({c: f"__s_{c}" for c in on})
    joined = rows.join(side, [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in on])
    return joined.drop(*[f"__s_{c}" for c in on])


def dedupe(items: DataFrame, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """The first of equal prompts, commands, searches, replies and commands typed within a block, with repeats and alt_source_ids; replies point to the prompt that stayed."""
    norm = F.when(F.col("kind").isin(DEDUPED_KINDS), collapse(F.col("label"))).otherwise(F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    rows = items.withColumn("__same", norm)
    same = Window.partitionBy(*by, "kind", "__same")
    ordered = same.orderBy("ts", "ordinal")
    rows = rows.withColumns({"__place": F.row_number().over(ordered), "repeats": F.count("*").over(same), "__stays": F.first("source_id").over(ordered)})
    again = rows.where("__place > 1")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("__place", "source_id"))), lambda x: x["source_id"])
    alts = again.groupBy(*by, "kind", "__same").agg(ids.alias("alt_source_ids"))
    moved = again.where("kind = 'prompt'").select(*by, F.col("source_id").alias("prompt_source_id"), F.col("__stays").alias("__prompt")).dropDuplicates([*by, "prompt_source_id"])
    rows = rows.where("__place = 1").join(alts, [*by, "kind", "__same"], "left")
    rows = rows.join(moved, [*by, "prompt_source_id"], "left")
    return rows.withColumn("prompt_source_id", F.when(F.col("kind") == "reply", F.coalesce("__prompt", "prompt_source_id")).otherwise(F.col("prompt_source_id"))).drop("__same", "__place", "__stays", "__prompt").select(*[c for c in items.columns], "repeats", "alt_source_ids")


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def stats() -> dict[str, Column]:
    """The counters of a block as aggregates."""
    is_file = F.col("kind").isin(FILE_KINDS)
    web = F.col("kind") == "web"
    name = base_name(F.col("label"))
    # a block's names are few: as sets they combine before the shuffle, where distinct counts would expand each row
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    return {
        "commits": _count("commit"),
        "clones": _count("clone"),
        "prompts": _count("prompt"),
        "replies": _count("reply"),
        "files": distinct(F.when(is_file, name)),
        "created_files": distinct(F.when(is_file & F.coalesce("created", F.lit(False)), name)),
        "commands": _count("action-command"),
        "shell": _count("shell"),
        "searches": _count("action-search"),
        "pages": distinct(F.when(web, F.coalesce("url", "source_id"))),
        "sites": distinct(F.when(web, F.col("host"))),
        # sums of the same seconds in another order differ by less than a microsecond
        "secs": F.floor(F.round(F.coalesce(F.sum(F.when(web, F.col("secs"))), F.lit(0.0)), 6) + 0.5).cast("long"),
        "notes": _count("note"),
        "images": _count("image"),
    }


STATS = ["commits", "clones", "prompts", "replies", "files", "created_files", "commands", "shell", "searches", "pages", "sites", "secs", "notes", "images"]


def score(duration: Column) -> Column:
    """The weight of a block from its counters; files and pages count by their roots, long blocks up to twice."""
    base = 6 * F.col("commits") + 4 * F.col("clones") + 3 * F.col("prompts") + 1.5 * (F.col("commands") + F.col("searches")) + F.col("shell") + 3 * F.sqrt("files") + 2 * F.sqrt("pages")
    return F.floor(base * F.least(1 + duration / 120, F.lit(2.0)) * 10 + 0.5) / 10


def low_signal(document_work: Column) -> Column:
    """No work but a few files, none of them a document."""
    idle = F.lit(True)
    for c in ("commits", "clones", "prompts", "commands", "shell", "searches", "pages"):
        idle = idle & (F.col(c) == 0)
    return idle & (F.col("files") <= 2) & ~document_work


def bursts(items: DataFrame, seconds: float = BURST_SECONDS, least: int = BURST_FILES, share: float = BURST_SHARE, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """(by, burst_files, burst_best, burst): blocks of files most of which appear within seconds, an unpacked archive rather than work."""
    files = items.where(F.col("kind").isin("file", "worktree")).withColumn("__us", F.unix_micros("ts"))
    reach = Window.partitionBy(*by).orderBy("__us").rangeBetween(-int(seconds * 1_000_000), 0)
    best = files.withColumn("__near", F.count("*").over(reach)).groupBy(*by).agg(F.count("*").alias("burst_files"), F.max("__near").alias("burst_best"))
    return best.withColumn("burst", (F.col("burst_files") >= least) & (F.col("burst_best") >= F.ceil(F.col("burst_files") * share)))


def _tops(items: DataFrame, by: list[str], sides: dict[str, tuple[Column, int | None, Column]]) -> DataFrame:
    """(by, name array, name_all long, ...) for each of sides (value, n, weight): the n most frequent values, the first seen before others as frequent; all of them in one pass. Null where a block has none."""
    every = F.array(*(F.struct(F.lit(name).alias("side"), value.alias("v"), weight.cast("long").alias("w")) for name, (value, _, weight) in sides.items()))
    items = items.select(*by, "ts", "ordinal", F.explode(F.filter(every, lambda x: x["v"] != "")).alias("__x")).select(*by, "ts", "ordinal", "__x.*")
    counted = items.groupBy(*by, "side", "v").agg(F.sum("w").alias("__n"), F.min(F.struct("ts", "ordinal")).alias("__first"))
    own = {name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("first"), "v")))) for name in sides}
    out = []
    for name, (_, n, _) in sides.items():
        values = F.transform(own[name] if n is None else F.slice(own[name], 1, n), lambda x: x["v"])
        out += [F.when(F.size(own[name]) > 0, values).alias(name), F.nullif(F.size(own[name]), F.lit(0)).cast("long").alias(f"{name}_all")]
    return counted.groupBy(*by).agg(*out)


def describe(blocks: DataFrame, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """One row for each block of deduplicated items: bounds, counters, duration, score, category, title, tools, source_ids."""
    keys = list(by)
    order = F.struct("ts", "ordinal")
    first = lambda when, value: F.min_by(F.when(when, value), F.when(when, order))
    kind, ext = F.col("kind"), extension(base_name(F.col("label")))
    is_file = kind.isin(FILE_KINDS)
    has_outline = F.coalesce(F.size("outline") > 0, F.lit(False))
    titled = (kind == "prompt") & F.col("session_title").isNotNull() & (F.col("session_title") != "")
    outlined = is_file & has_outline
    rows = blocks.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("items"),
        *[c.alias(n) for n, c in stats().items()],
        F.bool_or(is_file & (ext.isin(names.DOCUMENT_WORK) | has_outline)).alias("document_work"),
        (2 * F.count_if(kind.isin("commit", "clone")) + F.count_if(is_file & ext.isin(names.CODE))).alias("code_votes"),
        F.count_if(is_file & ext.isin(names.DOCUMENT)).alias("document_votes"),
        F.count_if(is_file & ext.isin(names.DATA)).alias("data_votes"),
        F.count_if(kind.isin(TALK_KINDS)).alias("talk"),
        F.count_if(is_file | (kind == "commit")).alias("fileish"),
        F.count_if(is_file).alias("file_items"),
        first(kind == "commit", F.col("label")).alias("t_commit"),
        first(kind == "clone", F.col("label")).alias("t_clone"),
        first(titled, F.col("session_title")).alias("t_session"),
        first(kind == "prompt", F.col("label")).alias("t_prompt"),
        first(kind == "action-search", F.col("label")).alias("t_search"),
        first(kind == "shell", F.col("label")).alias("t_shell"),
        first(outlined, F.struct("label", "outline", "outline_kind")).alias("t_outline"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ts", "ordinal", "source_id"))), lambda x: x["source_id"])).alias("source_ids"),
    )
    rows = rows.withColumn("duration_min", duration_minutes(F.col("start_ts"), F.col("end_ts"))).withColumn("score", score(F.col("duration_min"))).withColumn("category", category())
    word = F.regexp_replace(F.element_at(F.split(F.trim(F.col("label")), r"\s+"), 1), r"^.*[\\/]", "")
    parent = F.when(dir_name(F.col("label")) != ".", dir_name(F.col("label")))
    sides = {"dirs": (F.when(is_file, parent), 2, F.lit(1)), "exts": (F.when(is_file, ext), 3, F.lit(1)), "words": (F.when(kind == "shell", word), 3, F.col("repeats")), "tools": (F.col("provider"), None, F.lit(1))}
    rows = rows.join(_tops(blocks, keys, sides), keys, "left")
    return rows.withColumn("title", title()).drop("t_commit", "t_clone", "t_session", "t_prompt", "t_search", "t_shell", "t_outline", "dirs", "dirs_all", "exts", "exts_all", "words", "words_all", "tools_all")


def category() -> Column:
    """By votes of extensions; talk or typing without files is a kind of its own."""
    code, doc, data = F.col("code_votes"), F.col("document_votes"), F.col("data_votes")
    return (
        F.when((F.col("talk") >= 3) & (F.col("fileish") <= 2), "AI会话")
        .when((F.col("shell") >= 3) & (F.col("talk") == 0) & (F.col("fileish") <= 2), "终端")
        .when(code + doc + data == 0, F.when(F.col("talk") > 0, "AI会话").otherwise("其他"))
        .when((code >= doc) & (code >= data), "代码")
        .when(doc >= data, "文档")
        .otherwise("数据")
    )


def title() -> Column:
    """What a block was about: a commit, a clone, a session's title, a prompt, files, a search, commands, in this order."""
    n = lambda c: F.col(c).cast("string")
    commit = F.concat(to_title(F.col("t_commit")), F.when(F.col("commits") > 1, F.concat(F.lit("（等 "), n("commits"), F.lit(" 个提交）"))).otherwise(""))
    name = F.regexp_replace(base_name(F.col("t_outline.label")), r"\.[^.]+$", "")
    head = F.when(F.col("t_outline.outline_kind") == "sheets", name).otherwise(F.element_at("t_outline.outline", 1))
    outlined = F.when(F.col("file_items") == 1, to_title(head, 30)).otherwise(F.concat(to_title(head, 22), F.lit(" 等 "), n("files"), F.lit(" 个文件")))
    dirs = F.array_join(F.transform("dirs", lambda d: F.concat(d, F.lit("/"))), "、")
    exts = F.array_join(F.transform("exts", lambda e: F.concat(F.lit("."), e)), "、")
    exts_part = F.when(exts != "", F.concat(F.lit("（"), exts, F.lit("）"))).otherwise("")
    files = F.concat(F.lit("改动 "), n("files"), F.lit(" 个文件"), F.coalesce(F.when(dirs != "", F.concat(F.lit("："), dirs)), F.lit("")), F.coalesce(exts_part, F.lit("")))
    files = F.when((F.col("file_items") <= 3) & F.col("t_outline").isNotNull(), outlined).otherwise(files)
    search = F.concat(F.lit("搜索「"), to_title(F.col("t_search"), 24), F.lit("」"))
    more = F.when(F.col("words_all") > 3, " 等").otherwise("")
    shell = F.when(F.col("shell") == 1, F.concat(F.lit("终端："), to_title(F.col("t_shell"), 36))).otherwise(F.concat(F.lit("终端："), F.array_join("words", "、"), more, F.lit(" "), n("shell"), F.lit(" 条命令")))
    return (
        F.when(F.col("commits") > 0, commit)
        .when(F.col("clones") > 0, to_title(F.col("t_clone"), 64))
        .when(F.col("t_session").isNotNull(), to_title(F.col("t_session")))
        .when(F.col("prompts") > 0, to_title(F.col("t_prompt")))
        .when(F.col("file_items") > 0, files)
        .when(F.col("searches") > 0, search)
        .when(F.col("shell") > 0, shell)
        .otherwise("零散活动")
    )


def module_key(project: Column, start: Column) -> Column:
    """Stable over runs: the project and the hour in which a block starts."""
    return F.concat(F.coalesce(project.cast("string"), F.lit("misc")), F.lit("@"), F.date_format(start, "yyyy-MM-dd'T'HH"))


def dedupe_keys(modules: DataFrame) -> DataFrame:
    """A key that comes again gets #2, #3 and so on by start."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("start_ts", "ordinal"))
    return modules.withColumn("__n", place).withColumn("key", F.when(F.col("__n") > 1, F.concat("key", F.lit("#"), F.col("__n").cast("string"))).otherwise(F.col("key"))).drop("__n")


__all__ = ["BURST_FILES", "STATS", "bursts", "complete", "cut", "dedupe", "dedupe_keys", "describe", "low_signal", "module_key", "score", "split_by_gap", "stats"]
