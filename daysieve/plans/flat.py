"""The flat view of a day: each project's commits, changes, sessions and files, and visited pages, as facts with their sources; and a list of modules for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import base_name, collapse, cut
from ..functions.times import hhmm
from ..operators.evidence import source_id

#: How many files, pages and prompts are told one by one; changed paths, files, commands and searches in a line.
FILES, PROMPTS, PATHS, NAMES, CALLS = 15, 12, 5, 8, 5
#: Ids that stand for what is hidden, for a session's files, and for an overview.
HIDDEN_IDS, FILE_IDS, OVERVIEW_IDS = 20, 20, 6
WEB = "web"


def _fact(project: Column, part: int, order: list[Column], text: Column, ids: Column, at: Column, depth: int = 0, confidence: Column | None = None) -> list[Column]:
    place = F.struct(F.lit(part).alias("part"), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    return [project.cast("string").alias("project"), place.alias("place"), text.alias("text"), ids.alias("source_ids"), (F.lit("confirmed") if confidence is None else confidence).alias("confidence"), at.cast("timestamp").alias("occurred_at"), F.lit(depth).alias("depth")]


def _first(n: int, rank: str, value: Column, after: int = 0, when: Column | None = None) -> Column:
    """An aggregate: the values of rows by rank, n of them after the first ones."""
    fit = (F.col(rank) > after) & (F.col(rank) <= after + n)
    fit = fit if when is None else fit & when
    return F.transform(F.sort_array(F.collect_list(F.when(fit, F.struct(F.col(rank).alias("r"), value.alias("v"))))), lambda x: x["v"])


def _said(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _more(n: Column, shown: int, unit: str) -> Column:
    return F.when(n > shown, F.concat(F.lit(" 等 "), _said(n), F.lit(f" {unit}"))).otherwise("")


def commit_facts(commits: DataFrame) -> DataFrame:
    """Of commits (project, source_type, hash, revision, message, additions, deletions, files, committed_at)."""
    svn = F.col("source_type") == "svn-commit"
    lines = F.when((F.col("additions") > 0) | (F.col("deletions") > 0), F.concat(F.lit("，+"), _said("additions"), F.lit(" −"), _said("deletions"))).otherwise("")
    stat = F.when(F.size("files") > 0, F.concat(F.lit("（"), _said(F.size("files")), F.lit(" 个文件"), lines, F.lit("）"))).otherwise("")
    text = F.concat(F.when(svn, F.concat(F.lit("SVN r"), _said("revision"))).otherwise(""), F.lit("提交「"), F.coalesce("message", F.lit("")), F.lit("」"), stat)
    order = [F.col("committed_at").cast("string"), F.col("hash"), F.lit(0).cast("long")]
    return commits.select(*_fact(F.col("project"), 0, order, text, F.array(source_id(F.col("source_type"), F.col("hash"))), F.col("committed_at")))


def change_facts(worktree: DataFrame) -> DataFrame:
    """Of uncommitted changes (project, source_type, path): one for each project and kind of version control."""
    rank = F.row_number().over(Window.partitionBy("project", "source_type").orderBy("path"))
    ids = source_id(F.col("source_type"), F.concat_ws(":", _said("project"), "path"))
    rows = worktree.withColumn("n", rank).groupBy("project", "source_type").agg(_first(PATHS, "n", F.col("path")).alias("shown"), F.count("*").alias("all"), F.sort_array(F.collect_list(ids)).alias("ids"))
    where = F.when(F.col("source_type") == "svn-worktree", "工作副本").otherwise("工作树")
    text = F.concat(where, F.lit("有未提交改动："), F.array_join("shown", "、"), _more(F.col("all"), PATHS, "个"))
    return rows.select(*_fact(F.col("project"), 1, [F.col("source_type"), F.lit(""), F.lit(0).cast("long")], text, F.col("ids"), F.lit(None)))


def session_facts(sessions: DataFrame, prompts: DataFrame, replies: DataFrame, actions: DataFrame) -> DataFrame:
    """Of sessions (project, session_id, provider, title, first_ts) with prompts (session_id, index, text, ts), replies (session_id, index, prompt_index, text, ts) and actions (session_id, index, kind, value).

    An overview, each prompt with its reply up to PROMPTS, and a line for files, commands and searches. All of a session
    meets in its own group, its lists cut to what is told before it does.
    """
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("index"))
    last = replies.groupBy("session_id", F.col("prompt_index").alias("index")).agg(F.max_by(F.struct(F.col("index").alias("i"), "text", "ts"), "index").alias("reply"))
    asked = prompts.withColumn("n", nth).join(last, ["session_id", "index"], "left")
    ref = lambda i: F.concat_ws("#", _said("session_id"), _said(i))
    own = asked.groupBy("session_id").agg(F.count("*").alias("prompts"), F.count("reply").alias("replies"), _first(1, "n", F.col("index")).alias("first"), F.sort_array(F.collect_list(F.when(F.col("n") > PROMPTS, F.struct("n", source_id("session", ref("index")).alias("id"), "ts")))).alias("rest"))
    kinds = Window.partitionBy("session_id", "kind")
    done = actions.withColumns({"k": F.row_number().over(kinds.orderBy("index")), "new": F.row_number().over(Window.partitionBy("session_id", "kind", "value").orderBy("index")) == 1})
    done = done.withColumn("nth", F.sum(F.col("new").cast("int")).over(kinds.orderBy("index").rowsBetween(Window.unboundedPreceding, 0)))
    action = source_id("session-action", F.concat_ws(":", ref("index"), "kind", "value"))
    of = lambda kind: F.col("kind") == kind
    made = done.groupBy("session_id").agg(
        F.count_if(of("file") & F.col("new")).alias("files"), _first(NAMES, "nth", base_name(F.col("value")), when=of("file") & F.col("new")).alias("file_names"), _first(FILE_IDS, "k", action, when=of("file")).alias("file_ids"),
        *(c for kind in ("command", "search") for c in (F.count_if(of(kind)).alias(f"{kind}s"), _first(CALLS, "k", F.col("value"), when=of(kind)).alias(f"{kind}_shown"), _first(CALLS, "k", action, when=of(kind)).alias(f"{kind}_ids"))),
    )
    rows = sessions.join(own, "session_id", "left").join(made, "session_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("prompts", "replies", "files", "commands", "searchs")})
    counted = F.concat_ws("、", *(F.when(F.col(c) > 0, F.concat(F.lit(a), _said(c), F.lit(b))) for c, a, b in (("prompts", "提问 ", " 条"), ("replies", "回复 ", " 条"), ("files", "改动 ", " 个文件"), ("commands", "执行 ", " 条命令"), ("searchs", "联网搜索 ", " 次"))))
    name = F.when(F.col("provider") == "codex", "Codex").otherwise("Claude Code")
    label = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("「"), cut(collapse(F.col("title")), 50), F.lit("」"))).otherwise(F.concat(F.lit(" `"), F.substring(_said("session_id"), 1, 8), F.lit("`")))
    begun = F.transform(F.coalesce("first", F.array().cast("array<bigint>")), lambda i: source_id("session", ref(i)))
    order = lambda n: [F.col("first_ts").cast("string"), _said("session_id"), n.cast("long")]
    project, none = F.col("project"), F.lit(None)
    out = rows.select(*_fact(project, 2, order(F.lit(0)), F.concat(name, F.lit(" 会话"), label, F.lit("："), F.coalesce(F.nullif(counted, F.lit("")), F.lit("无可提取内容"))), begun, F.col("first_ts"), 0, F.when(F.size(begun) > 0, "confirmed").otherwise("unverified")))
    told = asked.where(F.col("n") <= PROMPTS).join(sessions.select("session_id", "project", "first_ts"), "session_id")
    parts = [told.select(*_fact(project, 2, order(F.col("n") * 2), cut(collapse(F.col("text")), 90), F.array(source_id("session", ref("index"))), F.col("ts"), 1))]
    parts.append(told.where("reply IS NOT NULL").select(*_fact(project, 2, order(F.col("n") * 2 + 1), F.concat(F.lit("回复："), cut(collapse(F.col("reply.text")), 120)), F.array(source_id("session-reply", ref("reply.i"))), F.col("reply.ts"), 2)))
    hidden = F.concat(F.lit("另有 "), _said(F.size("rest")), F.lit(" 条提问"))
    parts.append(rows.where(F.size("rest") > 0).select(*_fact(project, 2, order(F.lit(10_000)), hidden, F.transform("rest", lambda x: x["id"]), F.element_at("rest", 1)["ts"], 1)))
    parts.append(rows.where("files > 0").select(*_fact(project, 2, order(F.lit(10_001)), F.concat(F.lit("改动文件："), F.array_join("file_names", "、"), _more(F.col("files"), NAMES, "个")), F.col("file_ids"), none, 1)))
    for i, (kind, head, a, z, unit) in enumerate((("command", "执行命令：", "`", "`", "条"), ("search", "联网搜索：", "「", "」", "次"))):
        words = F.array_join(F.transform(f"{kind}_shown", lambda x: F.concat(F.lit(a), x, F.lit(z))), "、")  # noqa: B023
        parts.append(rows.where(F.col(f"{kind}s") > 0).select(*_fact(project, 2, order(F.lit(10_002 + i)), F.concat(F.lit(head), words, _more(F.col(f"{kind}s"), CALLS, unit)), F.col(f"{kind}_ids"), none, 1)))
    for p in parts:
        out = out.unionByName(p)
    return out


def _listed(rows: DataFrame, part: int, kind: str, ref: Column, head: Column, each: Column, rest: str) -> DataFrame:
    """An overview of ranked rows (project, n, at), each of the first FILES, and how many are hidden: a row's own line and its project's from one pass."""
    ids = source_id(kind, ref)
    whole = rows.groupBy("project").agg(F.count("*").alias("all"), F.count_distinct("host").alias("hosts"), _first(OVERVIEW_IDS, "n", ids).alias("ids"), F.min_by("at", "n").alias("at"), _first(HIDDEN_IDS, "n", ids, FILES).alias("rest"), F.min_by(F.when(F.col("n") > FILES, F.col("at")), F.when(F.col("n") > FILES, F.col("n"))).alias("rest_at"))
    order = lambda n: [F.lit(""), F.lit(""), n.cast("long")]
    hidden = F.concat(F.lit("另有 "), _said(F.col("all") - FILES), F.lit(rest))
    lines = F.array_compact(F.array(F.struct(*_fact(F.col("project"), part, order(F.lit(0)), head, F.col("ids"), F.col("at"))), F.when(F.col("all") > FILES, F.struct(*_fact(F.col("project"), part, order(F.lit(10_000)), hidden, F.col("rest"), F.col("rest_at"), 1)))))
    one = rows.where(F.col("n") <= FILES).select(*_fact(F.col("project"), part, order(F.col("n")), each, F.array(ids), F.col("at"), 1))
    return whole.select(F.inline(lines)).unionByName(one)


def file_facts(files: DataFrame) -> DataFrame:
    """Of files (project, root, path, mtime) outside of version control."""
    rows = files.withColumns({"n": F.row_number().over(Window.partitionBy("project").orderBy("mtime", "path")), "at": F.col("mtime"), "host": F.lit("")})
    root = F.regexp_replace(F.coalesce("root", F.lit("")), r"[/\\]+$", "")
    below = (root != "") & F.startswith("path", root) & F.substring("path", F.length(root) + 1, F.lit(1)).isin("/", "\\")
    name = F.when(below, F.substring("path", F.length(root) + 2, F.length("path"))).otherwise(base_name(F.col("path")))
    return _listed(rows, 3, "file", F.col("path"), F.concat(F.lit("改动 "), _said("all"), F.lit(" 个文件（不在版本库内，按文件修改时间）")), name, " 个文件（用 --json 看完整列表）")


def page_facts(pages: DataFrame) -> DataFrame:
    """Of pages (url, host, title, term, first_ts): those that were searched for first."""
    first = F.row_number().over(Window.partitionBy("project").orderBy(F.col("term").isNull(), "first_ts", "url"))
    rows = pages.withColumns({"project": F.lit(WEB), "at": F.col("first_ts")}).withColumn("n", first)
    each = F.when(F.col("term").isNotNull(), F.concat(F.lit("搜索「"), "term", F.lit("」"))).otherwise(F.concat(cut(collapse(F.col("title")), 60), F.lit("（"), "host", F.lit("）")))
    return _listed(rows, 4, "web", F.col("url"), F.concat(F.lit("浏览 "), _said("all"), F.lit(" 个页面（"), _said("hosts"), F.lit(" 个站点）")), each, " 个页面")


def module_lines(modules: DataFrame, zone: str = "UTC") -> DataFrame:
    """modules with line: two lines for a reader, whether it is in the journal, category, title, marks; project, time, counters and weight."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in modules.columns else F.lit(False)
    tags = F.concat_ws("，", F.when(has("excluded"), "永久排除"), F.when(has("overridden"), "手动"), F.when(has("burst"), "解压/复制"))
    start, end = hhmm(F.col("start_ts"), zone), hhmm(F.col("end_ts"), zone)
    time = F.when(F.col("duration_min") > 0, F.concat_ws("-", start, end)).otherwise(start)
    bits = F.concat_ws("、", *(F.when(F.col(c) > 0, F.concat_ws(" ", _said(c), F.lit(unit))) for c, unit in (("commits", "提交"), ("prompts", "提问"), ("commands", "命令"), ("files", "文件"), ("pages", "页面"))))
    score = F.when(F.col("score") == F.floor("score"), F.floor("score").cast("string")).otherwise(_said("score"))
    first = F.concat(F.when(F.col("selected"), "●").otherwise("○"), F.lit(" ["), "category", F.lit("] "), "title", F.when(tags != "", F.concat(F.lit("  〔"), tags, F.lit("〕"))).otherwise(""))
    second = F.concat(F.lit("    "), F.coalesce(_said("project"), F.lit("")), F.lit("｜"), time, F.lit("｜"), F.coalesce(F.nullif(bits, F.lit("")), F.lit("无")), F.lit("｜权重 "), score)
    return modules.withColumn("line", F.concat_ws("\n", first, second))


def markdown(facts: DataFrame, projects: DataFrame, evidence: DataFrame, run: str, checked: Column, zone: Column) -> DataFrame:
    """(run, markdown): a document for each run (run): its facts (run, project, place, ...) under their projects (run, project, name, nth; all that were looked at) in the order of nth, then footnotes, and what was checked.

    checked and zone are expressions on run: what was looked into, and the words on time zone and day's end.
    """
    from .report import cited_lines

    named = projects.select(F.col(run).alias("__run"), F.col("project").cast("string").alias("__project"), "name", "nth")
    rows = facts.join(named, F.col(run).eqNullSafe(F.col("__run")) & (F.col("project") == F.col("__project")))
    at = F.struct("nth", F.lit(1).alias("part"), "place", "text")
    lines = rows.select(run, at.alias("at"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- ")).alias("lead"), "text", "confidence", F.slice("source_ids", 1, 6).alias("ids"))
    heads = named.select("__run", F.col("nth").alias("__nth"), F.concat(F.lit("## [["), "name", F.lit("]]")).alias("heading"))
    entries, line = cited_lines(lines, evidence, run)
    by_project = entries.withColumn("line", line).groupBy(run, F.col("at.nth").alias("nth")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"), F.flatten(F.collect_list("notes")).alias("notes"), F.count("*").alias("n"), *(F.count_if(F.col("confidence") == c).alias(c) for c in ("confirmed", "inferred", "unverified"))
    )
    headed = by_project.join(heads, F.col(run).eqNullSafe(F.col("__run")) & (F.col("nth") == F.col("__nth")))
    section = F.struct("nth", F.concat("heading", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    docs = headed.groupBy(run).agg(F.array_join(F.transform(F.sort_array(F.collect_list(section)), lambda x: x["text"]), "\n").alias("sections"), F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("notes"))), lambda x: x["note"]), "\n").alias("notes"), *(F.sum(c).alias(c) for c in ("n", "confirmed", "inferred", "unverified")))
    runs = projects.select(run).distinct().join(docs.withColumnRenamed(run, "__of"), F.col(run).eqNullSafe(F.col("__of")), "left")
    title = F.concat(F.lit("# "), _said(run), F.lit("\n\n"))
    full = F.concat("sections", F.lit("\n---\n\n"), "notes", F.lit("\n\n> 扫描范围："), checked, F.lit("。"), _said("n"), F.lit(" 条事实：confirmed "), _said("confirmed"), F.lit("，inferred "), _said("inferred"), F.lit("，unverified "), _said("unverified"), F.lit("。"), zone, F.lit("，全部时间戳按 UTC 存储。\n"))
    none = F.concat(F.lit("无可记录活动。\n\n已检查的来源：\n- "), F.replace(checked, F.lit("｜"), F.lit("\n- ")), F.lit("\n\n> "), zone, F.lit("，跨零点的工作会归到前一天。\n"))
    return runs.select(run, F.concat(title, F.when(F.col("n").isNull(), none).otherwise(full)).alias("markdown"))
