"""Sources to one timeline of items, and how items are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import base_name, collapse, cut, stay_words
from ..functions.times import hhmm
from .evidence import source_id
from .sessions import FILE_KINDS, OPTIONAL

#: What a kind of outline is called.
OUTLINES = {"headings": "标题", "sheets": "工作表", "slides": "幻灯片", "columns": "列", "statements": "语句", "title": "标题"}
#: How counters are worded, in this order.
COUNTERS = [("commits", "%s 提交"), ("clones", "clone %s 个仓库"), ("prompts", "%s 提问"), ("commands", "%s 命令"), ("shell", "%s 终端命令"), ("searches", "%s 搜索"), ("files", "%s 文件"), ("pages", "%s 页面"), ("notes", "手记"), ("images", "%s 张图")]


def _items(rows: DataFrame, rank: int, at: Column, kind: Column | str, label: Column, sid: Column, order: Column, **more: Column) -> DataFrame:
    """Items of one source; ordinal keeps the order of sources among equal times."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    columns = {c: (more[c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()}
    return rows.select(F.col("project").cast("string").alias("project"), at.alias("ts"), F.concat_ws(":", F.lit(str(rank)), order.cast("string")).alias("ordinal"), kind.alias("kind"), label.cast("string").alias("label"), sid.alias("source_id"), *columns.values()).where("ts IS NOT NULL")


def _turn(rows: DataFrame) -> Column:
    return F.concat_ws("#", F.col("session_id").cast("string"), F.lpad(F.col("index").cast("string"), 6, "0"))


def timeline_of(arrivals: DataFrame | None = None, commits: DataFrame | None = None, worktree: DataFrame | None = None, prompts: DataFrame | None = None, replies: DataFrame | None = None, actions: DataFrame | None = None, files: DataFrame | None = None, shell: DataFrame | None = None, now: Column | None = None) -> DataFrame | None:
    """The items of all given sources, each with its project.

    arrivals (repo, at, remote, name), commits (hash, committed_at, message), worktree (path, mtime, source_type; without
    a time: now), prompts (session_id, index, text, ts, title, provider), replies (session_id, index, prompt_index, text,
    ts, provider), actions (session_id, index, kind, value, ts, provider), files (path, mtime, created, outline,
    outline_kind), shell (id, ts, cmd). Sources without a time are left out; times tie in this order of sources.
    """
    parts = []
    column = lambda rows, c, t="string": F.col(c) if c in rows.columns else F.lit(None).cast(t)
    if arrivals is not None:
        came = F.coalesce(F.concat(F.lit("clone 了 "), "name", F.lit("（"), "remote", F.lit("）")), F.concat(F.lit("新建仓库 "), "name"))
        parts.append(_items(arrivals, 0, F.col("at"), "clone", came, source_id("clone", F.col("repo")), F.col("repo")))
    if commits is not None:
        parts.append(_items(commits, 1, F.col("committed_at"), "commit", F.col("message"), source_id(F.coalesce(column(commits, "source_type"), F.lit("commit")), F.col("hash")), F.col("hash")))
    if worktree is not None:
        sid = source_id(F.coalesce(column(worktree, "source_type"), F.lit("worktree")), F.concat_ws(":", "project", "path"))
        parts.append(_items(worktree, 2, F.coalesce("mtime", F.current_timestamp() if now is None else now), "worktree", F.col("path"), sid, F.col("path"), outline=column(worktree, "outline", "array<string>"), outline_kind=column(worktree, "outline_kind")))
    ref = F.concat_ws("#", F.col("session_id").cast("string"), F.col("index").cast("string"))
    if prompts is not None:
        parts.append(_items(prompts, 3, F.col("ts"), "prompt", F.col("text"), source_id("session", ref), _turn(prompts), session_title=column(prompts, "title"), provider=column(prompts, "provider")))
    if replies is not None:
        asked = source_id("session", F.concat_ws("#", F.col("session_id").cast("string"), F.col("prompt_index").cast("string")))
        parts.append(_items(replies, 4, F.col("ts"), "reply", F.col("text"), source_id("session-reply", ref), _turn(replies), prompt_source_id=asked, provider=column(replies, "provider")))
    if actions is not None:
        kind = F.when(F.col("kind") == "file", "action-file").when(F.col("kind") == "search", "action-search").otherwise("action-command")
        parts.append(_items(actions, 5, F.col("ts"), kind, F.col("value"), source_id("session-action", F.concat_ws(":", ref, "kind", "value")), _turn(actions), provider=column(actions, "provider")))
    if files is not None:
        parts.append(_items(files, 6, F.col("mtime"), "file", F.col("path"), source_id("file", F.col("path")), F.col("path"), outline=column(files, "outline", "array<string>"), outline_kind=column(files, "outline_kind"), created=column(files, "created", "boolean")))
    if shell is not None:
        parts.append(_items(shell, 7, F.col("ts"), "shell", F.col("cmd"), source_id("shell", F.col("id")), F.col("id")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def reply_pairs(items: DataFrame, by: tuple[str, ...] = ("project", "block")) -> DataFrame:
    """(by, source_id, reply_id, reply): prompts with the last reply that answers each; null where none does."""
    order = F.struct("ts", "ordinal")
    told = items.where("kind = 'reply'").groupBy(*by, F.col("prompt_source_id").alias("source_id")).agg(F.max_by("source_id", order).alias("reply_id"), F.max_by("label", order).alias("reply"))
    return items.where("kind = 'prompt'").select(*by, "source_id").join(told, [*by, "source_id"], "left")


def public_items(items: DataFrame) -> DataFrame:
    """Items as they may be shown: a file by its name, and of each kind only the columns that belong to it."""
    is_file, web = F.col("kind").isin(FILE_KINDS), F.col("kind") == "web"
    outlined = is_file & (F.coalesce(F.size("outline"), F.lit(0)) > 0)
    only = {"path": (is_file, F.col("label")), "outline": (outlined, F.col("outline")), "outline_kind": (outlined, F.col("outline_kind")), "created": (is_file & F.col("created"), F.col("created")), "prompt_source_id": (F.col("kind") == "reply", F.col("prompt_source_id")), "url": (web, F.col("url")), "host": (web, F.col("host")), "term": (web, F.col("term")), "secs": (web, F.col("secs"))}
    kept = [c for c in ("repeats", "alt_source_ids") if c in items.columns]
    keys = [c for c in ("project", "block") if c in items.columns]
    return items.select(*keys, "kind", "ts", "source_id", *kept, F.when(is_file, base_name(F.col("label"))).otherwise(F.col("label")).alias("label"), "provider", *[F.when(cond, value).alias(c) for c, (cond, value) in only.items()])


def outline_words(n: int, more: bool = False) -> Column:
    """An item's label, with what its outline holds."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTLINES.items() for x in kv]), F.col("outline_kind")), F.lit("大纲"))
    rest = F.when(F.size("outline") > n, " …").otherwise("") if more else F.lit("")
    return F.concat("label", F.lit("（"), kind, F.lit("："), F.array_join(F.slice("outline", 1, n), " ／ "), rest, F.lit("）"))


def _repeats(items: DataFrame, form: str) -> Column:
    n = F.coalesce("repeats", F.lit(1)) if "repeats" in items.columns else F.lit(1)
    return F.when(n > 1, F.format_string(form, n.cast("int"))).otherwise("")


def page_words(items: DataFrame, n: int | None = None) -> Column:
    """A page as searched for or looked at, with host, visits and stay."""
    times, stay = _repeats(items, "，%d 次"), stay_words(F.col("secs"))
    label = F.col("label") if n is None else cut(collapse(F.col("label")), n)
    seen = F.concat(label, F.lit("（"), F.coalesce("host", F.lit("")), times, F.when(stay != "", F.concat(F.lit("，"), stay)).otherwise(""), F.lit("）"))
    return F.when(F.col("term").isNotNull(), F.concat(F.lit("搜索「"), "term", F.lit("」"), times)).otherwise(seen)


def item_text(items: DataFrame) -> Column:
    """An item in a line, before anything is redacted."""
    missing = {c: t for c, t in OPTIONAL.items() if c not in items.columns}
    if missing:
        return F.col("label")
    is_file = F.col("kind").isin(FILE_KINDS)
    return (
        F.when(F.col("kind") == "web", page_words(items))
        .when((F.col("kind") == "file") & F.coalesce("created", F.lit(False)), F.concat("label", F.lit("（新出现）")))
        .when(F.col("kind") == "note", F.substring(F.trim(F.col("label")), 1, 4000))
        .when(is_file & (F.coalesce(F.size("outline"), F.lit(0)) > 0), outline_words(5))
        .otherwise(F.coalesce("label", F.lit("")))
    )


def stats_line() -> Column:
    """A module's counters in words, those that are 0 left out."""
    bits = [F.when(F.col(c) > 0, F.format_string(form, F.col(c).cast("string")) if "%s" in form else F.lit(form)) for c, form in COUNTERS]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *bits), F.lit("")), F.lit("无"))


def meta(zone: str = "UTC") -> Column:
    """Project, tools, time, category and counters of a module."""
    start, end = hhmm(F.col("start_ts"), zone), hhmm(F.col("end_ts"), zone)
    time = F.when(F.col("duration_min") > 0, F.concat(start, F.lit("–"), end)).otherwise(start)
    tools = F.nullif(F.array_join("tools", "、"), F.lit(""))
    return F.concat_ws(" ｜ ", F.col("project"), tools, time, F.col("category"), stats_line())
