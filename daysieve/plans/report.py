"""Journals: the facts of each module, their lines, footnotes and the Markdown of a run (a day or a week)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import base_name, collapse, cut, defuse_markdown, dir_name
from ..operators.sessions import FILE_KINDS
from ..operators.timeline import meta, outline_words, page_words, stats_line

CAPS = {"prompt": 12, "file": 8, "command": 6, "page": 10}
IDS, OUTLINED, HIGHLIGHTS = 6, 5, 5
#: The order of facts in a section.
ORDER = ["note", "image", "clone", "commit", "prompt", "files", "command", "shell", "search", "page"]


PLACE = "struct<part:int,o0:timestamp,o1:string,o2:int>"


def _line(kind: str, text: Column, ids: Column, o2: Column, depth: int = 0, o0: Column | None = None, o1: Column | None = None) -> Column:
    """A fact with its place in a section: by part, then by (o0, o1, o2)."""
    at = F.lit(None).cast("timestamp") if o0 is None else o0
    place = F.struct(F.lit(ORDER.index(kind)).alias("part"), at.alias("o0"), (F.lit("") if o1 is None else o1).alias("o1"), o2.cast("int").alias("o2"))
    return F.struct(place.alias("place"), text.alias("text"), F.array_compact(F.array_distinct(ids)).alias("source_ids"), F.lit(depth).alias("depth"))


def _first(of: Column, rank: Column, most: int, value: str, after: int = 0) -> Column:
    """An aggregate: the values of the rows of a class by rank, after the first ones and up to most."""
    few = F.sort_array(F.collect_list(F.when(of & (rank > after) & (rank <= most), F.struct(rank.alias("r"), F.col(value).alias("v")))))
    return F.transform(few, lambda x: x["v"])


def section_facts(items: DataFrame, bursts: DataFrame | None = None) -> DataFrame:
    """(project, block, place, text, source_ids, depth, confidence): the facts of each block of deduplicated items, place gives their order; bursts (project, block, files) are blocks whose files came together.

    Items are dealt by block once; ranks within a block, its lists and its lines all come from that.
    """
    kind, cls = F.col("kind"), F.col("__cls")
    rows = items.repartition("project", "block").withColumn("__cls", F.when(kind.isin(FILE_KINDS), "file").otherwise(kind))
    block = ["project", "block"]
    by_time = Window.partitionBy(*block, "__cls").orderBy(F.when(cls == "web", F.col("term").isNull()), "ts", "ordinal")
    of_label = Window.partitionBy(*block, "__cls", "label").orderBy("ts", "ordinal")
    outlined = (cls == "file") & (F.coalesce(F.size("outline"), F.lit(0)) > 0)
    of_outline = Window.partitionBy(*block, "__cls", "label", "__outlined").orderBy("ts", "ordinal")
    rows = rows.withColumn("__outlined", outlined).withColumns({"__rank": F.row_number().over(by_time), "__new": (F.row_number().over(of_label) == 1).cast("int"), "__shown": F.col("__outlined") & (F.row_number().over(of_outline) == 1)})
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__nth": F.sum("__new").over(so_far), "__outline": F.sum(F.col("__shown").cast("int")).over(so_far)})
    # a prompt sees the last reply that names it
    asked = Window.partitionBy(*block, F.when(kind == "reply", F.col("prompt_source_id")).when(kind == "prompt", F.col("source_id")))
    told = F.when(kind == "reply", F.struct("ts", "ordinal", "label", "source_id"))
    rows = rows.withColumn("__reply", F.when(kind == "prompt", F.max(told).over(asked)))

    rank = F.col("__rank")
    again = F.when(F.col("repeats") > 1, F.format_string("（重复 %d 次）", F.col("repeats").cast("int"))).otherwise("")
    others = F.slice(F.coalesce("alt_source_ids", F.expr("cast(array() as array<string>)")), 1, 4)
    page = F.when(F.col("term").isNull(), F.concat(F.lit("浏览："), page_words(items, 60))).otherwise(page_words(items))
    ids = F.array("source_id")
    alone = lambda k, text: F.when(cls == k, _line(k, text, ids, F.lit(0), o0=F.col("ts"), o1=F.col("ordinal").cast("string")))
    few = (cls == "prompt") & (rank <= CAPS["prompt"])
    came = F.col("__came").isNotNull() if bursts is not None else F.lit(False)
    own = F.array_compact(F.array(
        alone("note", F.col("label")), alone("image", F.concat(F.lit("图片："), "label")), alone("clone", F.col("label")), alone("commit", F.concat(F.lit("提交「"), "label", F.lit("」"))),
        F.when(few, _line("prompt", F.concat(F.lit("提问："), "label", again), F.concat(ids, others), rank * 10 - 1000)),
        F.when(few & F.col("__reply").isNotNull(), _line("prompt", F.concat(F.lit("回复："), cut(collapse(F.col("__reply.label")), 160)), F.array("__reply.source_id"), rank * 10 - 999, 1)),
        F.when(F.col("__shown") & (F.col("__outline") <= OUTLINED) & ~came, _line("files", outline_words(4, more=True), ids, F.col("__outline"), 1)),
        F.when((cls == "web") & (rank <= CAPS["page"]), _line("page", page, ids, rank - 1000)),
    ))
    if bursts is not None:
        rows = rows.join(bursts.select(*block, F.col("files").alias("__came")), block, "left")
    lists = {"command": "action-command", "shell": "shell", "search": "action-search"}
    wanted = [F.flatten(F.collect_list(own)).alias("own")]
    for k, of in lists.items():
        wanted += [_first(cls == of, rank, CAPS["command"], "label").alias(f"{k}_shown"), _first(cls == of, rank, IDS, "source_id").alias(f"{k}_ids"), F.count_if(cls == of).alias(f"{k}_n"), F.min(F.when(cls == of, F.col("ts"))).alias(f"{k}_ts")]
    for k, of in (("prompt", "prompt"), ("page", "web")):
        wanted += [F.count_if(cls == of).alias(f"{k}_n"), _first(cls == of, rank, CAPS[k] + IDS, "source_id", CAPS[k]).alias(f"{k}_ids")]
    is_file = cls == "file"
    wanted += [_first(is_file & (F.col("__new") == 1), F.col("__nth"), CAPS["file"], "label").alias("file_shown"), F.sum(F.when(is_file, F.col("__new"))).alias("file_n"), _first(is_file, rank, IDS, "source_id").alias("file_ids"), F.count_if(is_file & F.coalesce("created", F.lit(False))).alias("fresh")]
    wanted += [F.max("__came").alias("came")] if bursts is not None else []
    whole = rows.groupBy(*block).agg(*wanted)

    said = lambda c: F.col(c).cast("string")
    more = lambda k, cap, unit: F.when(F.col(f"{k}_n") > cap, F.concat(F.lit(" 等 "), said(f"{k}_n"), F.lit(f" {unit}"))).otherwise("")

    def listed(k: str, head: str, unit: str, a: str, z: str) -> Column:
        words = F.array_join(F.transform(f"{k}_shown", lambda x: F.concat(F.lit(a), x, F.lit(z))), "、")
        return F.when(F.col(f"{k}_n") > 0, _line(k, F.concat(F.lit(head), words, more(k, CAPS["command"], unit)), F.col(f"{k}_ids"), F.lit(0), o0=F.col(f"{k}_ts")))

    def rest(k: str, words: str) -> Column:
        return F.when(F.col(f"{k}_n") > CAPS[k], _line(k, F.concat(F.lit("另有 "), (F.col(f"{k}_n") - CAPS[k]).cast("string"), F.lit(f" {words}")), F.col(f"{k}_ids"), F.lit(9)))

    fresh = F.when(F.col("fresh") > 0, F.concat(F.lit("（其中 "), said("fresh"), F.lit(" 个是新出现的）"))).otherwise("")
    words = F.concat(F.lit("改动文件："), F.array_join("file_shown", "、"), more("file", CAPS["file"], "个"), fresh)
    if bursts is not None:
        words = F.when(F.col("came").isNotNull(), F.concat(F.lit("新增项目 "), "project", F.lit("："), said("came"), F.lit(" 个文件同时出现（下载 / 解压 / 复制）"))).otherwise(words)
    lines = F.concat("own", F.array_compact(F.array(
        listed("command", "执行命令：", "条", "`", "`"), listed("shell", "终端里敲了：", "条", "`", "`"), listed("search", "联网搜索：", "次", "「", "」"),
        rest("prompt", "条提问"), rest("page", "个页面"), F.when(F.col("file_n") > 0, _line("files", words, F.col("file_ids"), F.lit(0))),
    )))
    return whole.select(*block, F.inline(lines)).withColumn("confidence", F.when(F.size("source_ids") > 0, "confirmed").otherwise("unverified"))


def highlight_facts(modules: DataFrame, run: str, n: int = HIGHLIGHTS) -> DataFrame:
    """(run, place, text, source_ids): the first modules of each run, by score."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("score"), "start_ts", "key"))
    text = F.concat(F.lit("**"), "title", F.lit("**（"), F.coalesce("project", F.lit("")), F.lit("，"), stats_line(), F.lit("）"))
    return modules.where("selected").withColumn("place", rank).where(F.col("place") <= n).select(run, "place", text.alias("text"), F.slice("source_ids", 1, 2).alias("source_ids"))


def footnote_label(zone_words: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """What a footnote says of an evidence row (source_type, source_ref, excerpt, path, path_alias, occurred_at); by kind."""
    ref, excerpt, alias = F.col("source_ref"), F.coalesce("excerpt", F.lit("")), F.coalesce("path_alias", F.lit(""))
    at = F.date_format("occurred_at", zone_words)
    when = F.coalesce(F.concat(F.lit("（"), at, F.lit("）")), F.lit(""))
    said, named = defuse_markdown(excerpt), defuse_markdown(F.when(alias != "", alias).otherwise(ref))
    parts = F.split(excerpt, "｜")
    outline = F.coalesce(F.concat(F.lit("，"), defuse_markdown(F.nullif(F.get(parts, F.lit(1)), F.lit("")))), F.lit(""))
    state = F.when(excerpt == "", "?").otherwise(F.get(parts, F.lit(0)))
    sid, index = F.substring(F.get(F.split(ref, "#"), F.lit(0)), 1, 8), F.get(F.split(ref, "#"), F.lit(1))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    rest = F.when(F.size(parts) > 1, F.concat(F.lit("，"), F.array_join(F.slice(parts, 2, 100), "，"))).otherwise("")
    fresh = F.get(parts, F.lit(1)) == "新出现"
    fresh = F.coalesce(fresh, F.lit(False))
    size = F.get(parts, F.lit(0))
    told = F.when((size != "") & ~size.rlike(r"^\d+ bytes$"), F.concat(F.lit("，"), defuse_markdown(size))).otherwise("")
    folder = F.when(F.coalesce(dir_name(F.col("path")), F.lit("")) != "", text("（", defuse_markdown(dir_name(F.col("path"))), "/）")).otherwise("")
    changed = F.coalesce(F.concat(F.when(fresh, "，出现于 ").otherwise("，改于 "), at), F.lit(""))
    by_kind = {
        "commit": text("commit `", F.substring(ref, 1, 7), "` — ", said, when),
        "svn-commit": text("SVN `", F.regexp_replace(ref, r"^(?:svn:)?(r\d+)@.*$", "$1"), "` — ", said, when),
        "worktree": text("工作树 `", state, "` ", named, outline),
        "svn-worktree": text("工作副本 `", state, "` ", named, outline),
        "session": text("会话 `", sid, "` 第 ", F.coalesce(index, F.lit("")), " 条消息", when, "：", defuse_markdown(F.substring(excerpt, 1, 120))),
        "session-reply": text("会话 `", sid, "` 第 ", F.coalesce(index, F.lit("")), " 条消息的回复", when, "：", defuse_markdown(F.substring(excerpt, 1, 160))),
        "session-action": text("会话 `", sid, "` 的操作 — ", said),
        "web": text("网页「", defuse_markdown(F.get(parts, F.lit(0))), "」（", defuse_markdown(alias), "）", rest, F.coalesce(F.concat(F.lit("，首次打开 "), at), F.lit("")), "：<", F.coalesce("path", ref), ">"),
        "note": text("手记（", F.get(F.split(ref, "#"), F.lit(0)), F.coalesce(F.concat(F.lit("，写于 "), at), F.lit("")), "）：", defuse_markdown(F.substring(excerpt, 1, 200))),
        "image": text("图片 `", defuse_markdown(F.when(alias != "", alias).when(excerpt != "", excerpt).otherwise(ref)), "`", when),
        "shell": text("终端 `", said, "`", F.when(alias != "", text("（在 ", defuse_markdown(alias), "/）")).otherwise(""), when),
        "clone": F.when(excerpt != "", text("仓库 `", named, "` clone 自 ", said, when)).otherwise(text("仓库 `", named, "` 在本机新建", when)),
        "file": text("文件 `", defuse_markdown(F.when(alias != "", alias).otherwise(base_name(ref))), "`", folder, changed, told, F.when(fresh, "，新出现（创建于当天）").otherwise("")),
    }
    label = None
    for k, c in by_kind.items():
        cond = F.col("source_type") == k
        label = F.when(cond, c) if label is None else label.when(cond, c)
    return label.otherwise(text(F.col("source_type"), " `", ref, "`"))


def cited_lines(rows: DataFrame, evidence: DataFrame, run: str) -> tuple[DataFrame, Column]:
    """Entries (run, at, lead, text, confidence, notes) of rows that cite ids, and an expression for an entry's line. Sources are numbered within a run by where they come first in the order of at; notes has (number, note) of those that do so in this entry. An entry without text is its lead."""
    rows = rows.select(run, "at", "lead", "text", "confidence", F.posexplode_outer("ids").alias("i", "source_id"))
    labels = evidence.select(F.concat_ws(":", "source_type", "source_ref").alias("source_id"), footnote_label().alias("label")).dropDuplicates(["source_id"])
    rows = rows.join(labels, "source_id", "left").repartition(run)
    cited = F.col("source_id").isNotNull()
    rows = rows.withColumn("first", F.min(F.when(cited, F.struct("at", "i"))).over(Window.partitionBy(run, "source_id")))
    rows = rows.withColumn("number", F.when(cited, F.dense_rank().over(Window.partitionBy(run, cited).orderBy("first"))))
    number = F.col("number").cast("string")
    mark = F.when(cited, F.struct("i", F.concat(F.lit("[^ev"), number, F.lit("]")).alias("mark")))
    note = F.when(cited & (F.col("first") == F.struct("at", "i")), F.struct("number", F.concat(F.lit("[^ev"), number, F.lit("]: "), F.coalesce("label", F.lit("（证据缺失）"))).alias("note")))
    entries = rows.groupBy(run, "at").agg(*(F.first(c).alias(c) for c in ("lead", "text", "confidence")), F.array_join(F.transform(F.sort_array(F.collect_list(mark)), lambda x: x["mark"]), "").alias("marks"), F.collect_list(note).alias("notes"))
    doubt = F.when(F.col("confidence") == "confirmed", "").otherwise(F.concat(F.lit(" `"), "confidence", F.lit("`"), F.when(F.col("confidence") == "unverified", "（无法关联来源，请确认或删除）").otherwise("")))
    return entries, F.when(F.col("text").isNull(), F.col("lead")).otherwise(F.concat("lead", defuse_markdown(F.col("text")), "marks", doubt))


def markdown(modules: DataFrame, facts: DataFrame, evidence: DataFrame, run: str) -> DataFrame:
    """(run, markdown): a document for each run, with highlights, a section for each selected module, footnotes and counts.

    modules (run, project, block, key, title, meta columns), facts of section_facts(), evidence with footnote columns. A
    document is a run's own group: it is as large as what is read of a day or week, however many runs there are. Its
    sources are numbered where they first appear, and only those that are cited meet the evidence.
    """
    own = facts.groupBy("project", "block").agg(F.sort_array(F.collect_list(F.struct("place", "text", "source_ids", "depth", "confidence"))).alias("__facts"))
    nth = F.row_number().over(Window.partitionBy(run, "selected").orderBy(F.desc("score"), "start_ts", "key"))
    rows = modules.join(own, ["project", "block"], "left").withColumn("nth", nth)
    none = F.array().cast("array<string>")

    def entry(part: int, lead: Column, text: Column, ids: Column, confidence: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), lead.alias("lead"), text.alias("text"), ids.alias("ids"), confidence.alias("confidence"))

    # what a module gives: itself as a highlight (part 0), its head and its facts (part 1); or that it is left out (part 9)
    top = entry(0, F.concat(F.col("nth").cast("string"), F.lit(". ")), F.concat(F.lit("**"), "title", F.lit("**（"), F.coalesce("project", F.lit("")), F.lit("，"), stats_line(), F.lit("）")), F.slice("source_ids", 1, 2), F.lit("confirmed"))
    head = F.concat(F.lit("\n### "), defuse_markdown(F.col("title")), F.lit("\n\n_"), defuse_markdown(meta()), F.lit("_\n"))
    each = F.transform("__facts", lambda f: entry(1, F.concat(F.repeat(F.lit("  "), f["depth"]), F.lit("- ")), f["text"], F.slice(f["source_ids"], 1, 6), f["confidence"]))
    given = F.concat(F.array(F.when(F.col("nth") <= HIGHLIGHTS, top), entry(1, head, F.lit(None).cast("string"), none, F.lit(None).cast("string"))), F.coalesce(each, F.array().cast(f"array<struct<part:int,lead:string,text:string,ids:array<string>,confidence:string>>")))  # noqa: F541
    left = F.array(entry(9, F.lit(""), F.lit(None).cast("string"), none, F.lit(None).cast("string")))
    rows = rows.select(run, "nth", F.posexplode(F.array_compact(F.when(F.col("selected"), given).otherwise(left))).alias("seq", "e"))
    rows = rows.select(run, F.struct("e.part", "nth", "seq").alias("at"), "e.lead", "e.text", "e.confidence", "e.ids")
    entries, line = cited_lines(rows, evidence, run)
    told = F.col("confidence").isNotNull()
    of = lambda part: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at.part") == part, F.struct("at", line.alias("line"))))), lambda x: x["line"]), "\n")
    notes = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("notes"))), lambda x: x["note"]), "\n")
    docs = entries.groupBy(run).agg(of(0).alias("top"), of(1).alias("body"), notes.alias("notes"), F.count_if(F.col("at.part") == 9).alias("excluded"), F.count_if(told).alias("n"), *(F.count_if(F.col("confidence") == c).alias(c) for c in ("confirmed", "inferred", "unverified")))
    some = F.col("body") != ""
    out = F.concat(
        F.lit("# "), F.col(run).cast("string"), F.lit("\n\n"),
        F.when(~some, "今天没有可写进日记的内容。\n").otherwise(F.concat(F.lit("## 今日重点\n\n"), "top", F.lit("\n\n## 明细\n"), "body", F.lit("\n"))),
        F.when(F.col("excluded") > 0, F.concat(F.lit("\n> 另有 "), F.col("excluded").cast("string"), F.lit(" 个模块被排除，未写入本篇。\n"))).otherwise(""),
        F.when(some, F.concat(F.lit("\n---\n\n"), "notes", F.format_string("\n\n> 由 规则生成：%d 条，confirmed %d，inferred %d，unverified %d。\n", "n", "confirmed", "inferred", "unverified"))).otherwise(""),
    )
    return docs.select(run, out.alias("markdown"))
