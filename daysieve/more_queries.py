"""Further operators over the star-schema tables, with SQL that gives the same rows: timelines, evidence by source, journals, lookups, parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import redact, texts, times, urls
from .operators import attribution as a
from .operators import evidence as e
from .operators import extras, state, timeline, turns, web
from .operators import sessions as s
from .plans import day, journal, report
from .queries import BLOCKS, ITEMS, KEPT, STATS, _us, _with, items, table, visits
from .sources import assistants, logs, vcs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# One text of every form that a reader may meet, at the end of each document.
def said(spark, d, *forms: str):
    """documents with text, the form of its id's remainder after the id."""
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", form.alias("text"))


def _cases(values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[doc_id % {len(values)} + 1]"


# --- timelines

SOURCES = """src AS (
    SELECT (o_custkey % 10)::VARCHAR AS project, epoch_us(o_orderdate) AS ts_us, 'commit' AS kind, 'order ' || o_orderkey AS label, 'commit:' || o_orderkey AS source_id FROM orders
    UNION ALL SELECT n_regionkey::VARCHAR, epoch_us(TIMESTAMP '1995-03-01'), 'clone', CASE WHEN n_nationkey % 2 = 0 THEN 'clone 了 ' || n_name || '（host/' || n_nationkey || '）' ELSE '新建仓库 ' || n_name END, 'clone:/r/' || n_nationkey FROM nation
    UNION ALL SELECT (p_partkey % 10)::VARCHAR, epoch_us(CASE WHEN p_partkey % 7 = 0 THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1995-01-01' + to_days((p_partkey % 300)::INT) END), 'worktree', 'p' || p_partkey || '.md', 'worktree:' || (p_partkey % 10) || ':p' || p_partkey || '.md' FROM part
    UNION ALL SELECT (conv_id % 10)::VARCHAR, epoch_us(TIMESTAMP '1995-06-01' + to_minutes(turn::INT)), CASE role WHEN 'user' THEN 'prompt' ELSE 'reply' END, text, CASE role WHEN 'user' THEN 'session:' ELSE 'session-reply:' END || conv_id || '#' || turn FROM conversations WHERE role IN ('user', 'assistant')
    UNION ALL SELECT (event_id % 10)::VARCHAR, epoch_us(ts), CASE event_type WHEN 'error' THEN 'shell' WHEN 'click' THEN 'file' WHEN 'signup' THEN 'action-search' ELSE 'action-command' END, event_type || event_id,
        CASE event_type WHEN 'error' THEN 'shell:' || event_id WHEN 'click' THEN 'file:click' || event_id ELSE 'session-action:' || user_id || '#' || event_id || ':' || CASE event_type WHEN 'signup' THEN 'search' ELSE 'command' END || ':' || event_type || event_id END FROM events)"""


def sources(spark, d) -> DataFrame:
    """Every table as a source of one timeline."""
    at = lambda t: F.lit(t).cast("timestamp")
    commits = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("project"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("committed_at"), F.concat(F.lit("order "), "o_orderkey").alias("message"))
    came = table(spark, d, "nation").select(F.col("n_regionkey").alias("project"), F.concat(F.lit("/r/"), "n_nationkey").alias("repo"), F.col("n_name").alias("name"), at("1995-03-01").alias("at"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("host/"), "n_nationkey")).alias("remote"))
    changed = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("project"), F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), F.when(F.col("p_partkey") % 7 != 0, F.timestamp_add("DAY", (F.col("p_partkey") % 300).cast("int"), at("1995-01-01"))).alias("mtime"))
    talk = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("project"), F.col("conv_id").alias("session_id"), F.col("turn").alias("index"), (F.col("turn") - 1).alias("prompt_index"), "text", "role", F.timestamp_add("MINUTE", F.col("turn").cast("int"), at("1995-06-01")).alias("ts"))
    ev = table(spark, d, "events").withColumns({"project": F.col("event_id") % 10, "name": F.concat("event_type", "event_id")})
    acts = ev.where("event_type NOT IN ('error', 'click')").select("project", F.col("user_id").alias("session_id"), F.col("event_id").alias("index"), F.when(F.col("event_type") == "signup", "search").otherwise("command").alias("kind"), F.col("name").alias("value"), "ts")
    files = ev.where("event_type = 'click'").select("project", F.col("name").alias("path"), F.col("ts").alias("mtime"))
    shell = ev.where("event_type = 'error'").select("project", F.col("event_id").alias("id"), "ts", F.col("name").alias("cmd"))
    return timeline.timeline_of(came, commits, changed, talk.where("role = 'user'"), talk.where("role = 'assistant'"), acts, files, shell, at("1996-01-01"))


@query(f"WITH {SOURCES} SELECT project, ts_us, kind, md5(label) AS label, source_id FROM src WHERE ts_us IS NOT NULL AND label IS NOT NULL")
def ses01_timeline(spark, d):
    """Seven kinds of sources as one timeline."""
    rows = sources(spark, d).where("label IS NOT NULL")
    return rows.select("project", F.unix_micros("ts").alias("ts_us"), "kind", F.md5(F.col("label").cast("binary")).alias("label"), "source_id")


@query(f"WITH {SOURCES}, o AS (SELECT project, ts_us, CASE WHEN lag(ts_us) OVER w IS NULL OR (kind <> 'reply' AND ts_us - lag(ts_us) OVER w > 90 * 60000000::BIGINT) THEN 1 ELSE 0 END AS opens FROM src WINDOW w AS (PARTITION BY project ORDER BY ts_us, kind <> 'clone', kind <> 'commit', kind <> 'worktree', kind <> 'prompt', kind <> 'reply', source_id)) SELECT project, sum(opens)::BIGINT AS blocks FROM o GROUP BY project")
def q_sources_to_sessions(spark, d):
    """From all sources to work sessions: how many blocks each project has."""
    rows = s.split_by_gap(s.complete(sources(spark, d)))
    return rows.groupBy("project").agg(F.max("block").alias("blocks"))


@query("WITH r AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who FROM conversations) SELECT p.conv_id, p.turn AS prompt, r.turn AS reply FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') p LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1")
def join12_reply_with_prompt(spark, d):
    talk = table(spark, d, "conversations").select(F.lit("p").alias("project"), F.col("conv_id").alias("block"), F.concat(F.when(F.col("role") == "user", "q").otherwise("r"), "turn").alias("source_id"), F.concat(F.lit("q"), F.col("turn") - 1).alias("prompt_source_id"), F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "reply").alias("kind"), F.lit(None).cast("timestamp").alias("ts"), F.col("turn").alias("ordinal"), F.col("text").alias("label"))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    return timeline.reply_pairs(talk).select(F.col("block").alias("conv_id"), number("source_id").alias("prompt"), number("reply_id").alias("reply"))


@query(_with(ITEMS) + " SELECT ordinal, kind, CASE WHEN kind = 'file' THEN regexp_extract(label, '[^/]+$') ELSE label END AS label, CASE WHEN kind = 'file' THEN label END AS path, CASE WHEN kind = 'web' THEN host END AS host FROM items")
def flt13_public_items(spark, d):
    rows = s.complete(items(spark, d))
    shown = timeline.public_items(rows)
    return shown.select(F.substring("source_id", 3, 20).cast("long").alias("ordinal"), "kind", "label", "path", "host")


# --- journals

_SHOWN = "string_agg('`' || label || '`', '、' ORDER BY n) FILTER (n <= 6)"
_IDS = "coalesce(string_agg(source_id, ',' ORDER BY n) FILTER (n <= 6), '')"
SECTIONS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY project, block, kind ORDER BY ts, ordinal) AS n FROM kept),
    alts AS (SELECT project, block, kind, same, string_agg(source_id, ',' ORDER BY ts, ordinal) FILTER (place BETWEEN 2 AND 5) AS alts FROM placed GROUP BY ALL),
    files AS (SELECT project, block, string_agg(label, '、' ORDER BY k) FILTER (k <= 8) || CASE WHEN count(*) > 8 THEN ' 等 ' || count(*) || ' 个' ELSE '' END AS shown
        FROM (SELECT project, block, label, row_number() OVER (PARTITION BY project, block ORDER BY min((ts, ordinal))) AS k FROM kept WHERE kind = 'file' GROUP BY project, block, label) GROUP BY ALL),
    lines AS (SELECT project, block, '提交「' || label || '」' AS text, source_id AS ids, 3 AS part, ts AS o0, ordinal::VARCHAR AS o1, 0 AS o2 FROM ranked WHERE kind = 'commit'
        UNION ALL SELECT project, block, '提问：' || label || CASE WHEN repeats > 1 THEN '（重复 ' || repeats || ' 次）' ELSE '' END, concat_ws(',', source_id, alts), 4, NULL, '', n - 100 FROM ranked LEFT JOIN alts USING (project, block, kind, same) WHERE kind = 'prompt' AND n <= 12
        UNION ALL SELECT project, block, '另有 ' || count(*) || ' 条提问', string_agg(source_id, ',' ORDER BY n) FILTER (n <= 18), 4, NULL, '', 9 FROM ranked WHERE kind = 'prompt' AND n > 12 GROUP BY ALL
        UNION ALL SELECT project, block, '终端里敲了：' || {_SHOWN} || CASE WHEN count(*) > 6 THEN ' 等 ' || count(*) || ' 条' ELSE '' END, {_IDS}, 7, min(ts), '', 0 FROM ranked WHERE kind = 'shell' GROUP BY ALL
        UNION ALL SELECT project, block, '联网搜索：' || {_SHOWN.replace("'`' || label || '`'", "'「' || label || '」'")} || CASE WHEN count(*) > 6 THEN ' 等 ' || count(*) || ' 次' ELSE '' END, {_IDS}, 8, min(ts), '', 0 FROM ranked WHERE kind = 'action-search' GROUP BY ALL
        UNION ALL SELECT project, block, '改动文件：' || any_value(shown), {_IDS}, 5, NULL, '', 0 FROM ranked JOIN files USING (project, block) WHERE kind = 'file' GROUP BY ALL)"""

#: The text of each document, from its modules' and facts' lines on.
DOCUMENTS = r"""st AS (SELECT project, block, min(ts) AS start_ts, max(ts) AS end_ts, list(source_id ORDER BY ts, ordinal) AS ids, count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (kind = 'prompt') AS prompts,
        count(*) FILTER (kind = 'shell') AS shell, count(*) FILTER (kind = 'action-search') AS searches, count(DISTINCT regexp_extract(label, '[^/]+$')) FILTER (kind = 'file') AS files FROM kept GROUP BY project, block),
    m AS (SELECT *, strftime(start_ts, '%Y-%m-%d %H') AS day, project || '@' || block AS key, block % 7 = 0 AS barred,
        coalesce(nullif(concat_ws(' · ', CASE WHEN commits > 0 THEN commits || ' 提交' END, CASE WHEN prompts > 0 THEN prompts || ' 提问' END, CASE WHEN shell > 0 THEN shell || ' 终端命令' END, CASE WHEN searches > 0 THEN searches || ' 搜索' END, CASE WHEN files > 0 THEN files || ' 文件' END), ''), '无') AS line,
        strftime(start_ts, '%H:%M') || CASE WHEN floor((epoch_ms(end_ts) - epoch_ms(start_ts)) / 60000.0 + 0.5) > 0 THEN '–' || strftime(end_ts, '%H:%M') ELSE '' END AS hours FROM st),
    n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY prompts DESC, start_ts, key) AS nth FROM m WHERE NOT barred),
    e AS (SELECT day, 0 AS sec, nth, 0 AS seq, nth || '. **' || key || '**（' || project || '，' || line || '）' AS text, ids[1:2] AS ids FROM n WHERE nth <= 5
        UNION ALL SELECT day, 1, nth, 0, chr(10) || '### ' || key || chr(10) || chr(10) || '_' || concat_ws(' ｜ ', project, hours, '类', line) || '_' || chr(10), [] FROM n
        UNION ALL SELECT day, 1, nth, row_number() OVER (PARTITION BY project, block ORDER BY part, o0 NULLS FIRST, o1, o2), '- ' || text, string_split(l.ids, ',')[1:6] FROM lines l JOIN n USING (project, block)),
    c AS (SELECT day, sec, nth, seq, unnest(ids) AS sid, generate_subscripts(ids, 1) AS i FROM e),
    num AS (SELECT day, sid, row_number() OVER (PARTITION BY day ORDER BY min((sec, nth, seq, i))) AS number FROM c GROUP BY day, sid),
    marks AS (SELECT day, sec, nth, seq, string_agg('[^ev' || number || ']', '' ORDER BY i) AS marks FROM c JOIN num USING (day, sid) GROUP BY ALL),
    notes AS (SELECT day, string_agg('[^ev' || number || ']: e `' || substr(sid, 3) || '`', chr(10) ORDER BY number) AS notes FROM num GROUP BY day),
    docs AS (SELECT day, string_agg(text || coalesce(marks, ''), chr(10) ORDER BY nth) FILTER (sec = 0) AS top, string_agg(text || coalesce(marks, ''), chr(10) ORDER BY nth, seq) FILTER (sec = 1) AS body, count(*) FILTER (sec = 0 OR seq > 0) AS facts FROM e LEFT JOIN marks USING (day, sec, nth, seq) GROUP BY day),
    lefts AS (SELECT day, count(*) FILTER (barred) AS barred FROM m GROUP BY day),
    written AS (SELECT day, '# ' || day || chr(10) || chr(10) || CASE WHEN body IS NULL THEN '今天没有可写进日记的内容。' || chr(10) ELSE '## 今日重点' || chr(10) || chr(10) || top || chr(10) || chr(10) || '## 明细' || chr(10) || body || chr(10) END
        || CASE WHEN barred > 0 THEN chr(10) || '> 另有 ' || barred || ' 个模块被排除，未写入本篇。' || chr(10) ELSE '' END
        || CASE WHEN body IS NULL THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) || notes || chr(10) || chr(10) || '> 由 规则生成：' || facts || ' 条，confirmed ' || facts || '，inferred 0，unverified 0。' || chr(10) END AS markdown
        FROM lefts LEFT JOIN docs USING (day) LEFT JOIN notes USING (day))"""


@query(_with(ITEMS, BLOCKS, KEPT, view="action-search", gap=720) + f", {SECTIONS} SELECT project, block, text, ids FROM lines")
def out01_sections(spark, d):
    """The facts of each block's section, with caps and what they hide."""
    facts = report.section_facts(day.blocks(items(spark, d, "action-search"), 720))
    return facts.select("project", "block", "text", F.array_join("source_ids", ",").alias("ids"))


@query(_with(ITEMS, BLOCKS, KEPT, view="action-search", gap=45) + f", {SECTIONS}, {DOCUMENTS} SELECT day, length(markdown) AS signs, md5(markdown) AS digest FROM written")
def out02_markdown(spark, d):
    """A document for each hour in which modules begin, compared as a whole: highlights, sections, marks, footnotes, counts and what was left out."""
    every = items(spark, d, "action-search")
    kept = day.blocks(every, 45).persist()  # modules and facts both come from it
    named = {"key": F.concat_ws("@", "project", "block"), "title": F.concat_ws("@", "project", "block"), "day": F.date_format("start_ts", "yyyy-MM-dd HH"), "selected": F.col("block") % 7 != 0, "score": F.col("prompts").cast("double"), "category": F.lit("类")}
    modules = s.describe(kept).withColumns(named)
    ev = every.select(F.substring_index("source_id", ":", 1).alias("source_type"), F.substring("source_id", 3, 20).alias("source_ref"), F.col("ts").alias("occurred_at"), F.col("label").alias("excerpt"), F.lit("").alias("path"), F.lit("").alias("path_alias"))
    written = report.markdown(modules, report.section_facts(kept), ev, "day")
    return written.select("day", F.length("markdown").cast("long").alias("signs"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


_KINDS = ["commit", "svn-commit", "worktree", "svn-worktree", "session", "session-reply", "session-action", "web", "note", "image", "shell", "clone", "file", "other"]


@query(f"""WITH x AS (SELECT event_id, {_cases(_KINDS).replace('doc_id', 'event_id')} AS k, 'r' || event_id || '@abc#' || user_id AS ref, props || '｜新出现' AS excerpt, '/w/dir/' || event_type AS path, event_type AS alias, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS tm FROM events)
    SELECT event_id, CASE k WHEN 'commit' THEN 'commit `' || substr(ref, 1, 7) || '` — ' || excerpt || '（' || tm || '）' WHEN 'svn-commit' THEN 'SVN `r' || event_id || '` — ' || excerpt || '（' || tm || '）'
        WHEN 'worktree' THEN '工作树 `' || split_part(excerpt, '｜', 1) || '` ' || alias || '，新出现' WHEN 'svn-worktree' THEN '工作副本 `' || split_part(excerpt, '｜', 1) || '` ' || alias || '，新出现'
        WHEN 'session' THEN '会话 `' || substr(split_part(ref, '#', 1), 1, 8) || '` 第 ' || split_part(ref, '#', 2) || ' 条消息（' || tm || '）：' || excerpt WHEN 'session-reply' THEN '会话 `' || substr(split_part(ref, '#', 1), 1, 8) || '` 第 ' || split_part(ref, '#', 2) || ' 条消息的回复（' || tm || '）：' || excerpt
        WHEN 'session-action' THEN '会话 `' || substr(split_part(ref, '#', 1), 1, 8) || '` 的操作 — ' || excerpt WHEN 'web' THEN '网页「' || split_part(excerpt, '｜', 1) || '」（' || alias || '），新出现，首次打开 ' || tm || '：<' || path || '>'
        WHEN 'note' THEN '手记（' || split_part(ref, '#', 1) || '，写于 ' || tm || '）：' || excerpt WHEN 'image' THEN '图片 `' || alias || '`（' || tm || '）' WHEN 'shell' THEN '终端 `' || excerpt || '`（在 ' || alias || '/）（' || tm || '）'
        WHEN 'clone' THEN '仓库 `' || alias || '` clone 自 ' || excerpt || '（' || tm || '）' WHEN 'file' THEN '文件 `' || alias || '`（dir/），出现于 ' || tm || '，' || split_part(excerpt, '｜', 1) || '，新出现（创建于当天）' ELSE 'other `' || ref || '`' END AS label FROM x""")
def scal19_footnote_labels(spark, d):
    ev = table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    rows = ev.select("event_id", kind.alias("source_type"), F.concat(F.lit("r"), "event_id", F.lit("@abc#"), "user_id").alias("source_ref"), F.concat("props", F.lit("｜新出现")).alias("excerpt"), F.concat(F.lit("/w/dir/"), "event_type").alias("path"), F.col("event_type").alias("path_alias"), F.col("ts").alias("occurred_at"))
    return rows.select("event_id", report.footnote_label().alias("label"))


@query("WITH c AS (SELECT o_custkey % 20 AS run, o_orderkey AS fact_id, unnest(['c' || (o_custkey % 50), 'd' || (o_orderkey % 30)]) AS source_id, unnest([0, 1]) AS i FROM orders), f AS (SELECT run, source_id, min((fact_id, i)) AS first FROM c GROUP BY ALL), n AS (SELECT run, source_id, row_number() OVER (PARTITION BY run ORDER BY first) AS number FROM f) SELECT run, fact_id, i, source_id, number FROM c JOIN n USING (run, source_id)")
def topk06_footnotes(spark, d):
    facts = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderkey").alias("fact_id"), F.array(F.concat(F.lit("c"), F.col("o_custkey") % 50), F.concat(F.lit("d"), F.col("o_orderkey") % 30)).alias("source_ids"))
    return journal.footnotes(facts, by=("run",)).withColumn("number", F.col("number").cast("long"))


@query(_with(ITEMS, BLOCKS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY project, block, kind ORDER BY CASE WHEN kind = 'web' THEN -secs END, ts, ordinal) AS n FROM blocks), c AS (SELECT * FROM r WHERE n <= CASE kind WHEN 'web' THEN 2 WHEN 'file' THEN 3 ELSE 30 END) SELECT 'e' || row_number() OVER (PARTITION BY project ORDER BY block, ts, ordinal) AS ref, project, source_id FROM c")
def topk03_prompt_lines(spark, d):
    """TOPK-03, TOPK-04, OUT-04: what a model would be shown, pages looked at longest first, numbered in each run."""
    rows = s.split_by_gap(s.complete(items(spark, d))).withColumn("run", F.col("project"))
    return journal.prompt_lines(rows, caps={"web": 2, "file": 3}, run=("run",)).select("ref", "project", "source_id")


@query(_with(ITEMS, BLOCKS) + " SELECT * FROM (SELECT project, block, kind, count(*) - CASE kind WHEN 'web' THEN 2 WHEN 'file' THEN 3 ELSE 30 END AS more FROM blocks GROUP BY project, block, kind) WHERE more > 0")
def topk03_prompt_skipped(spark, d):
    return journal.prompt_skipped(s.split_by_gap(s.complete(items(spark, d))), {"web": 2, "file": 3})


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + " SELECT project, block, coalesce(nullif(concat_ws(' · ', CASE WHEN commits > 0 THEN commits || ' 提交' END, CASE WHEN prompts > 0 THEN prompts || ' 提问' END, CASE WHEN shell > 0 THEN shell || ' 终端命令' END, CASE WHEN files > 0 THEN files || ' 文件' END, CASE WHEN pages > 0 THEN pages || ' 页面' END), ''), '无') AS line FROM modules")
def aux02_stats_line(spark, d):
    return s.describe(day.blocks(items(spark, d))).select("project", "block", timeline.stats_line().alias("line"))


@query(_with(ITEMS) + " SELECT ordinal, CASE WHEN kind = 'web' THEN label || '（' || host || CASE WHEN secs >= 60 THEN '，停留约 ' || floor(secs / 60 + 0.5)::INT || ' 分钟' ELSE '' END || '）' ELSE label END AS text FROM items")
def aux03_item_text(spark, d):
    rows = s.complete(items(spark, d))
    return rows.select("ordinal", timeline.item_text(rows).alias("text"))


# --- evidence by source

_EV = "source_type, source_ref, project, epoch_us(occurred_at) AS at_us, (occurred_at - INTERVAL 4 HOUR)::DATE AS local_date, level, excerpt"


def _ev(rows: DataFrame) -> DataFrame:
    return rows.select("source_type", "source_ref", "project", F.unix_micros("occurred_at").alias("at_us"), "local_date", "level", "excerpt")


@query(f"""WITH x AS (SELECT 'commit' AS source_type, o_orderkey::VARCHAR AS source_ref, o_custkey::VARCHAR AS project, o_orderdate::TIMESTAMP AS occurred_at, 'L0' AS level, 'm' || o_orderkey AS excerpt FROM orders
    UNION ALL SELECT 'clone', '/r/' || n_nationkey, n_name, TIMESTAMP '1995-03-01', 'L0', CASE WHEN n_nationkey % 2 = 0 THEN 'h' ELSE '' END FROM nation
    UNION ALL SELECT 'svn-worktree', p_brand || ':' || p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1995-01-01' END, CASE WHEN p_partkey % 2 = 0 THEN 'L1' ELSE 'L0' END, 'M ' || p_name FROM part) SELECT {_EV} FROM x""")
def evd01_from_git(spark, d):
    """Clones, commits and changes as evidence."""
    at = lambda x: F.lit(x).cast("timestamp")
    commits = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.lit("/r").alias("repo"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("committed_at"), F.concat(F.lit("m"), "o_orderkey").alias("message"), F.lit(None).cast("string").alias("source_type"))
    came = table(spark, d, "nation").select(F.col("n_name").alias("project"), F.concat(F.lit("/r/"), "n_nationkey").alias("repo"), at("1995-03-01").alias("at"), F.when(F.col("n_nationkey") % 2 == 0, "h").alias("remote"))
    dirty = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("path"), F.lit("M").alias("status"), F.when(F.col("p_partkey") % 3 != 0, at("1995-01-01")).alias("mtime"), F.lit("svn-worktree").alias("source_type"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("h"))).otherwise(F.expr("cast(array() as array<string>)")).alias("outline"))
    return _ev(e.from_commits(commits).unionByName(e.from_arrivals(came)).unionByName(e.from_worktree(dirty, at("1996-01-01"))))


@query(f"WITH x AS (SELECT 'file' AS source_type, '/f/' || event_id AS source_ref, user_id::VARCHAR AS project, ts AS occurred_at, CASE WHEN event_id % 2 = 0 THEN 'L1' ELSE 'L0' END AS level, CASE WHEN event_id % 2 = 0 THEN event_type || '、b' ELSE '/f/' || event_id END AS excerpt FROM events UNION ALL SELECT 'shell', event_id::VARCHAR, user_id::VARCHAR, ts, 'L1', event_type FROM events) SELECT {_EV} FROM x")
def evd02_from_files_and_shell(spark, d):
    ev = table(spark, d, "events").withColumn("project", F.col("user_id"))
    outline = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("b"))).otherwise(F.expr("cast(array() as array<string>)"))
    files = ev.select("project", F.concat(F.lit("/f/"), "event_id").alias("path"), F.col("ts").alias("mtime"), outline.alias("outline"))
    shell = ev.select("project", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("cmd"), F.lit("/w").alias("cwd"))
    return _ev(e.from_files(files).unionByName(e.from_shell(shell)))


@query(_with(ITEMS) + f", p AS (SELECT url, min(ts) AS occurred_at, count(*) AS n, sum(secs) AS secs, arg_min(label, (-length(label), ts, ordinal)) AS title FROM items WHERE kind = 'web' GROUP BY url), x AS (SELECT 'web' AS source_type, url AS source_ref, 'web' AS project, occurred_at, 'L0' AS level, concat_ws('｜', title, CASE WHEN n > 1 THEN n || ' 次' END, CASE WHEN secs >= 60 THEN '停留约 ' || floor(secs / 60 + 0.5)::INT || ' 分钟' END) AS excerpt FROM p) SELECT {_EV} FROM x")
def evd03_from_web(spark, d):
    return _ev(e.from_web(web.group_pages(visits(spark, d))))


@query(f"""WITH x AS (SELECT 'note' AS source_type, '1995-01-02#' || doc_id AS source_ref, 'notes' AS project, TIMESTAMP '1995-01-02 12:00:00' AS occurred_at, 'L1' AS level, lang AS excerpt FROM documents WHERE lang IS NOT NULL
    UNION ALL SELECT 'image', doc_id::VARCHAR, 'notes', TIMESTAMP '1995-01-02 10:00:00', 'L1', 'i' || doc_id FROM documents) SELECT {_EV} FROM x""")
def evd04_from_notes(spark, d):
    docs = table(spark, d, "documents")
    notes = docs.where("lang IS NOT NULL").select(F.lit("1995-01-02").cast("date").alias("local_date"), F.col("doc_id").alias("entry_id"), F.col("lang").alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    images = docs.select(F.lit("1995-01-02").cast("date").alias("local_date"), F.col("doc_id").alias("id"), F.concat(F.lit("i"), "doc_id").alias("name"), F.lit("/p").alias("path"), F.lit("1995-01-02 10:00:00").cast("timestamp").alias("ts"))
    return _ev(e.from_notes(notes).unionByName(e.from_images(images)))


@query(f"""WITH c AS (SELECT *, 'p' || (conv_id % 3) || '/' || conv_id || '#' || turn AS ref, TIMESTAMP '1995-06-01' + to_minutes(turn::INT) AS occurred_at FROM conversations), x AS (
    SELECT CASE role WHEN 'user' THEN 'session' ELSE 'session-reply' END AS source_type, ref AS source_ref, 'a' AS project, occurred_at, CASE role WHEN 'user' THEN 'L1' ELSE 'L2' END AS level, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS excerpt FROM c WHERE role IN ('user', 'assistant')
    UNION ALL SELECT 'session-action', ref || ':command:run', 'a', occurred_at, 'L1', 'run' FROM c WHERE role = 'user') SELECT {_EV.replace('excerpt', 'md5(excerpt) AS excerpt')} FROM x""")
def evd06_from_sessions(spark, d):
    talk = table(spark, d, "conversations").select(F.lit("a").alias("project"), F.concat(F.lit("p"), F.col("conv_id") % 3).alias("provider"), F.col("conv_id").alias("session_id"), F.col("turn").alias("index"), "text", "role", F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("1995-06-01").cast("timestamp")).alias("ts"), F.lit("command").alias("kind"), F.lit("run").alias("value"))
    rows = e.from_sessions(talk.where("role = 'user'"), talk.where("role = 'assistant'"), talk.where("role = 'user'"))
    return _ev(rows).withColumn("excerpt", F.md5(F.col("excerpt").cast("binary")))


@query("SELECT source_ref FROM (SELECT 'click' AS t, event_id::VARCHAR AS source_ref FROM events WHERE event_type = 'click') WHERE starts_with(source_ref, '1')")
def flt12_show(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("source_type"), F.col("event_id").cast("string").alias("source_ref"), F.col("ts").alias("occurred_at"))
    return state.show(rows, "click:1").select("source_ref")


@query("SELECT event_id FROM events WHERE event_id IN (SELECT o_custkey FROM orders UNION SELECT o_custkey * 2 FROM orders)")
def flt14_evidence_for(spark, d):
    rows = table(spark, d, "events").select(F.lit("e").alias("source_type"), F.col("event_id").cast("string").alias("source_ref"), "event_id")
    modules = table(spark, d, "orders").select(F.array(F.concat(F.lit("e:"), "o_custkey"), F.concat(F.lit("e:"), F.col("o_custkey") * 2)).alias("source_ids"))
    return state.evidence_for(modules, rows).select("event_id")


@query("WITH x AS (SELECT l_suppkey AS repo, l_orderkey * 10 + l_linenumber AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_partkey % 5 = 0 OR l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01') SELECT repo, path FROM x WHERE n <= 30")
def flt03_dirty(spark, d):
    """Changes without a time or of the range, the first of each repository."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate").cast("timestamp")).alias("mtime"))
    at = lambda x: F.lit(x).cast("timestamp")
    return state.dirty_in_range(rows, (F.col("mtime") >= at("1995-01-01")) & (F.col("mtime") < at("1996-01-01")), True, 30)[0].select("repo", "path")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'absent' WHEN event_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS sources, sum(user_id)::BIGINT AS found FROM events GROUP BY ALL")
def agg13_coverage(spark, d):
    status = F.when(F.col("event_id") % 7 == 0, "absent").when(F.col("event_id") % 5 == 0, "error").otherwise("ok")
    return state.coverage(table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), status.alias("status"), F.col("user_id").alias("count")))


@query("SELECT event_id AS local_date, CASE WHEN event_id % 3 = 1 THEN 'b' || user_id ELSE 'a' || user_id END AS key, event_id % 3 = 0 AS chosen FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'c', false FROM events WHERE event_id % 3 = 1")
def sel02_overrides(spark, d):
    """Stored choices as an object, as the older list, and as junk."""
    ev = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.format_string('{"a%d": true}', "user_id")).when(F.col("event_id") % 3 == 1, F.format_string('["b%d", "c"]', "user_id")).otherwise("junk")
    return state.overrides(ev.select(F.col("event_id").alias("local_date"), text.alias("excluded_json")))


@query("WITH x AS (SELECT user_id AS local_date, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'view') SELECT local_date, event_id, n <= 50 AS kept FROM x WHERE n <= 50 UNION ALL SELECT user_id, -event_id, event_id IN (SELECT event_id FROM x WHERE n <= 50) FROM events")
def sel03_notes(spark, d):
    """A day's first entries, and images whose entry is still there."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("local_date"), F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("id"), "event_type", F.lit("t").alias("text"), "ts")
    entries, images = state.normal_notes(ev.where("event_type <> 'view'"), ev.select("local_date", "id", F.col("id").alias("entry_id")))
    return entries.select("local_date", F.col("place").alias("event_id"), F.lit(True).alias("kept")).unionByName(images.select("local_date", (-F.col("id").cast("long")).alias("event_id"), F.col("entry_id").isNotNull().alias("kept")))


@query("SELECT event_id, CASE WHEN n > 1 THEN 'u' || user_id || '-' || n ELSE 'u' || user_id END AS id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def aux09_unique_ids(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("id"))
    return state.unique_ids(rows, "id", "event_id").select("event_id", "id")


@query("SELECT p_partkey, 'a' || p_partkey || '.py,b/c.md' AS files, CASE WHEN p_partkey % 2 = 0 THEN 'ls -l x' ELSE 'git log ' || p_partkey END AS command FROM part")
def aux04_patches_and_commands(spark, d):
    patch = F.format_string("*** Begin\n*** Update File: a%d.py\n@@\n*** Add File: b/c.md\n*** Update File: a%d.py\n", "p_partkey", "p_partkey")
    command = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("bash"), F.lit("-lc"), F.lit("ls  -l\nx"))).otherwise(F.array(F.lit("git"), F.lit("log"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", F.array_join(state.files_from_patch(patch), ",").alias("files"), state.command_text(command).alias("command"))


@query("SELECT o_orderkey, CASE datediff('day', o_orderdate::DATE, DATE '1995-06-15') WHEN 0 THEN '今天' WHEN 1 THEN '昨天' WHEN 2 THEN '前天' WHEN -1 THEN '明天' ELSE '' END AS near, CASE WHEN year(o_orderdate) = 1995 THEN '' ELSE year(o_orderdate) || '年' END || month(o_orderdate) || '月' || day(o_orderdate) || '日 周' || (['一','二','三','四','五','六','日'])[isodow(o_orderdate)] AS words FROM orders")
def scal31_days(spark, d):
    at, today = F.to_date("o_orderdate"), F.lit("1995-06-15").cast("date")
    return table(spark, d, "orders").select("o_orderkey", times.relative_day(at, today).alias("near"), times.date_words(at, today).alias("words"))


@query("SELECT event_id, CASE WHEN user_id = 0 THEN '' WHEN user_id < 60 THEN user_id || ' 分钟' WHEN user_id % 60 = 0 THEN user_id // 60 || ' 小时' ELSE user_id // 60 || ' 小时 ' || user_id % 60 || ' 分钟' END AS duration, CASE WHEN event_id >= 10000 THEN printf('%.1f 万', event_id / 10000) ELSE event_id::VARCHAR END AS number FROM events WHERE event_id < 10000 OR event_id % 1000 = 0")
def scal12_words(spark, d):
    rows = table(spark, d, "events").where("event_id < 10000 OR event_id % 1000 = 0")
    return rows.select("event_id", times.duration_words(F.col("user_id")).alias("duration"), texts.number_words(F.col("event_id")).alias("number"))


# --- state

@query("SELECT coalesce(o.k, c.c_custkey) AS id, CASE WHEN o.k IS NOT NULL AND o.k % 2 = 0 THEN 'new' ELSE c.c_name END AS title, coalesce(o.last, c.c_acctbal) AS last_ts FROM customer c FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS last FROM orders GROUP BY 1) o ON o.k = c.c_custkey")
def set05_upsert_sessions(spark, d):
    """A new title fills in where there is one, the last time overwrites."""
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("last_ts"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("last_ts")).withColumn("title", F.when(F.col("id") % 2 == 0, "new"))
    return e.upsert(stored, new.select("id", "title", "last_ts"), ["id"], {"title": "fill", "last_ts": "new"})


@query("SELECT c_custkey AS day, CASE WHEN c_custkey % 3 = 0 THEN 'edited' ELSE c_name END AS notes, c_mktsegment AS draft FROM customer UNION ALL SELECT NULL, 'twice', NULL")
def set06_upsert_day_state(spark, d):
    """Only the columns that are given change; a null day is a day like any other."""
    c = table(spark, d, "customer")
    none = spark.range(1).select(F.lit(None).cast("long").alias("day"))
    stored = c.select(F.col("c_custkey").cast("long").alias("day"), F.col("c_name").alias("notes"), F.col("c_mktsegment").alias("draft")).unionByName(none.select("day", F.lit("once").alias("notes"), F.lit(None).cast("string").alias("draft")))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("day"), F.lit("edited").alias("notes")).unionByName(none.select("day", F.lit("twice").alias("notes"))).withColumn("draft", F.lit(None).cast("string"))
    return e.upsert(stored, new, ["day"], {"notes": "new", "draft": "keep"})


# --- sources

@query("SELECT o_orderkey AS hash FROM orders WHERE o_custkey % 20 IN (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19) OR contains('x' || o_custkey || '@y', 'clerk#1')")
def flt02_author(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.concat(F.lit("CLERK#"), F.col("o_custkey") % 20).alias("author"), F.concat(F.lit("x"), "o_custkey", F.lit("@y")).alias("email"))
    return vcs.by_author(rows, "Clerk#1").select("hash")


@query("SELECT event_id, 'r' || (user_id % 5) AS repo, CASE event_type WHEN 'click' THEN '??' WHEN 'view' THEN 'R' ELSE 'M' END AS status, CASE WHEN event_type = 'view' THEN 'new' ELSE 'sub' END || (event_id % 4) || '/f' || event_id AS path FROM events WHERE NOT (event_type = 'click' AND event_id % 4 = 1)")
def src05_status(spark, d):
    """SRC-05, FLT-04: status lines, renames, and untracked files of a repository within."""
    ev = table(spark, d, "events")
    path = F.concat(F.lit("sub"), F.col("event_id") % 4, F.lit("/f"), "event_id")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("?? "), path)).when(F.col("event_type") == "view", F.concat(F.lit("R  old -> new"), F.col("event_id") % 4, F.lit("/f"), "event_id")).otherwise(F.concat(F.lit(" M "), path))
    lines = ev.select(F.concat(F.lit("r"), F.col("user_id") % 5).alias("repo"), line.alias("line"))
    repos = spark.range(5).select(F.concat(F.lit("r"), "id").alias("repo"))
    repos = repos.unionByName(repos.select(F.concat("repo", F.lit("/sub1")).alias("repo")))
    rows = vcs.without_nested_untracked(vcs.parse_git_status(lines), repos)
    return rows.select(F.regexp_extract("path", r"/f(\d+)$", 1).cast("long").alias("event_id"), "repo", "status", "path")


@query("SELECT c_custkey AS repo, CASE WHEN c_custkey % 2 = 0 THEN 'host.org/a/b' || c_custkey ELSE 'host.org/me/c' || c_custkey END AS remote FROM customer WHERE c_custkey % 3 <> 0")
def src06_arrivals(spark, d):
    """SRC-06, SCAL-08: repositories that came in a range, with clean remotes."""
    at = lambda x: F.lit(x).cast("timestamp")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 3 == 1, at("1995-05-05")).alias("description_mtime"), F.when(F.col("c_custkey") % 3 == 2, at("1995-06-06")).otherwise(at("1970-01-01")).alias("birthtime"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://me:key@host.org:8443/a/b"), "c_custkey", F.lit(".git"))).otherwise(F.concat(F.lit("git@host.org:me/c"), "c_custkey", F.lit(".git"))).alias("remote"))
    return vcs.arrivals(rows, (F.col("at") >= at("1995-01-01")) & (F.col("at") < at("1996-01-01"))).select("repo", "remote")


@query("SELECT o_orderkey AS revision, 'svn:r' || o_orderkey || '@ab' AS hash, CASE WHEN o_orderkey % 2 = 0 THEN 'src/f' || o_custkey ELSE '' END AS files, epoch_us(o_orderdate) AS at_us FROM orders")
def src09_svn_log(spark, d):
    o = table(spark, d, "orders")
    path = lambda v, k: F.struct(v.alias("_VALUE"), F.lit("M").alias("_action"), F.lit(k).alias("_kind"))
    paths = F.array(path(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/trunk/src/f"), "o_custkey")).otherwise("/branches/x"), "file"), path(F.lit("/trunk/dir"), "dir"))
    rows = o.select(F.col("o_orderkey").alias("_revision"), F.lit("me").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), F.lit("m").alias("msg"), F.struct(paths.alias("path")).alias("paths"))
    return vcs.svn_commits(rows, "/trunk", "ab").select("revision", "hash", F.array_join("files", ",").alias("files"), F.unix_micros("committed_at").alias("at_us"))


@query("SELECT p_partkey, (['M', 'A', '!', 'M', '?'])[p_partkey % 6 + 1] AS status FROM part WHERE p_partkey % 6 < 5")
def src10_svn_status(spark, d):
    item = F.element_at(F.array(*[F.lit(x) for x in ("modified", "added", "missing", "normal", "unversioned", "normal")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_path"), F.struct(item.alias("_item"), F.when(F.col("p_partkey") % 6 == 3, "modified").otherwise("none").alias("_props")).alias("wc-status"))
    return vcs.svn_worktree(rows).select(F.col("path").cast("long").alias("p_partkey"), "status")


_PAGES = "p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS n, count(*) OVER () AS all_pages FROM pages)"


def _places(spark, d, rows: DataFrame) -> DataFrame:
    """rows with the page of each event: its id modulo the number of pages."""
    n = table(spark, d, "pages").count()
    return rows.withColumn("place", F.col("event_id") % n)


@query(f"WITH {_PAGES} SELECT event_id, epoch_us(ts) // 1000 AS ms, url FROM events JOIN p ON n = event_id % all_pages WHERE event_id % 10 NOT IN (4, 5, 6, 8, 9)")
def src16_firefox(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat("page_id", F.lit("|"), "url").alias("url"), F.lit("t").alias("title"))
    v = _places(spark, d, table(spark, d, "events")).select(F.col("place").alias("place_id"), (F.unix_millis("ts") * 1000 + F.col("event_id") % 1000).alias("visit_date"), (F.col("event_id") % 10).alias("visit_type"), "event_id")
    ids = v.select("place_id", F.timestamp_millis(F.expr("visit_date div 1000")).alias("ts"), "event_id", "visit_type").where("visit_type NOT IN (4, 5, 6, 8, 9)")
    got = logs.firefox_visits(v, pages).withColumn("place_id", F.substring_index("url", "|", 1).cast("long")).groupBy("place_id", "ts").agg(F.count("*").alias("n"), F.first("url").alias("url"))
    return ids.join(got, ["place_id", "ts"]).select("event_id", F.unix_millis("ts").alias("ms"), F.expr("substring(url, instr(url, '|') + 1)").alias("url"))


@query(f"WITH {_PAGES} SELECT event_id, epoch_us(ts) // 1000 AS ms, 't' || event_id AS title, url FROM events JOIN p ON n = event_id % all_pages")
def src17_safari(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    v = _places(spark, d, table(spark, d, "events")).select(F.col("place").alias("history_item"), (F.unix_millis("ts") / 1000 - logs.SAFARI_S).alias("visit_time"), F.concat(F.lit("t"), "event_id").alias("title"))
    return logs.safari_visits(v, pages).select(F.substring("title", 2, 20).cast("long").alias("event_id"), F.unix_millis("ts").alias("ms"), "title", "url")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 1996 ELSE 1995 END AS y, p_partkey % 4 = 2 AS created FROM part WHERE p_partkey % 4 IN (1, 2) AND p_partkey % 5 <> 0".replace("CASE WHEN p_partkey % 4 = 2 THEN 1996 ELSE 1995 END AS y, ", ""))
def src13_scan(spark, d):
    """Files changed or new in a range, work files outside repositories only."""
    at = lambda y: F.lit(f"{y}-05-05").cast("timestamp")
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 5 == 0, "/repo/").otherwise("/home/"), F.lit("f"), k, F.when(k % 4 == 3, ".pem").otherwise(".py"))
    inv = table(spark, d, "part").select(path.alias("path"), F.when(k % 4 == 1, at(1995)).otherwise(at(1990)).alias("mtime"), F.when(k % 4 == 2, at(1995)).otherwise(at(1980)).alias("birthtime"), at(1980).alias("ctime"), F.lit(1).alias("size"))
    inside = lambda c: F.year(c) == 1995
    rows = logs.scan_files(inv, inside, spark.createDataFrame([("/repo",)], "root string"))
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("p_partkey"), "created")


@query("SELECT count(*) AS scanned, count(*) FILTER (p_partkey % 3 = 1) AS skipped_sensitive, count(*) FILTER (p_partkey % 3 = 2) AS skipped_noise FROM part")
def agg11_scan_counts(spark, d):
    ends = F.element_at(F.array(F.lit(".py"), F.lit(".pem"), F.lit(".tmp")), (F.col("p_partkey") % 3 + 1).cast("int"))
    none = F.lit(None).cast("timestamp")
    inv = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey", ends).alias("path"), F.current_timestamp().alias("mtime"), none.alias("birthtime"), none.alias("ctime"))
    return logs.scan_counts(inv, lambda t: t.isNotNull()).select("scanned", "skipped_sensitive", "skipped_noise")


# --- titles, words, texts

@query(_with(ITEMS, BLOCKS, KEPT) + ", u AS (SELECT project, block, host, count(*) AS n, min((ts, ordinal)) AS f FROM kept WHERE host IS NOT NULL GROUP BY ALL) SELECT project, block, string_agg(host, ',' ORDER BY n DESC, f) AS tools FROM u GROUP BY ALL")
def agg02_tools(spark, d):
    """Tools by how often they were used; hosts stand for them."""
    rows = day.blocks(items(spark, d).withColumn("provider", F.col("host")))
    return s.describe(rows).select("project", "block", F.array_join("tools", ",").alias("tools"))


_T = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || '…' ELSE {0} END"


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + """, f AS (SELECT project, block, arg_min(label, (ts, ordinal)) FILTER (kind = 'commit') AS c, arg_min(label, (ts, ordinal)) FILTER (kind = 'prompt') AS p, arg_min(label, (ts, ordinal)) FILTER (kind = 'shell') AS sh FROM kept GROUP BY ALL),
    dirs AS (SELECT project, block, string_agg(d || '/', '、' ORDER BY k) AS dirs FROM (SELECT *, row_number() OVER (PARTITION BY project, block ORDER BY n DESC, f) AS k FROM (SELECT project, block, split_part(label, '/', 1) AS d, count(*) AS n, min((ts, ordinal)) AS f FROM kept WHERE kind = 'file' GROUP BY ALL)) WHERE k <= 2 GROUP BY ALL),
    exts AS (SELECT project, block, string_agg('.' || d, '、' ORDER BY k) AS exts FROM (SELECT *, row_number() OVER (PARTITION BY project, block ORDER BY n DESC, f) AS k FROM (SELECT project, block, regexp_extract(label, '\\.([^.]+)$', 1) AS d, count(*) AS n, min((ts, ordinal)) AS f FROM kept WHERE kind = 'file' GROUP BY ALL)) WHERE k <= 3 GROUP BY ALL),
    words AS (SELECT project, block, string_agg(d, '、' ORDER BY k) FILTER (k <= 3) AS words, count(*) AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY project, block ORDER BY n DESC, f) AS k FROM (SELECT project, block, label AS d, sum(repeats) AS n, min((ts, ordinal)) AS f FROM kept WHERE kind = 'shell' GROUP BY ALL)) GROUP BY ALL)
    SELECT project, block, CASE WHEN commits > 0 THEN c || CASE WHEN commits > 1 THEN '（等 ' || commits || ' 个提交）' ELSE '' END WHEN prompts > 0 THEN p WHEN files > 0 THEN '改动 ' || files || ' 个文件：' || dirs || '（' || exts || '）'
        WHEN shell = 1 THEN '终端：' || sh WHEN shell > 1 THEN '终端：' || words || CASE WHEN n_words > 3 THEN ' 等' ELSE '' END || ' ' || shell || ' 条命令' ELSE '零散活动' END AS title
    FROM modules JOIN f USING (project, block) LEFT JOIN dirs USING (project, block) LEFT JOIN exts USING (project, block) LEFT JOIN words USING (project, block)""".replace("\\\\", "\\"))
def agg05_titles(spark, d):
    """AGG-05 to AGG-07: what a block is called."""
    return s.describe(day.blocks(items(spark, d))).select("project", "block", "title")


@query("SELECT DISTINCT c_mktsegment AS key, 2 + count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer")
def join13_images(spark, d):
    c = table(spark, d, "customer")
    modules = c.select(F.col("c_mktsegment").alias("key")).distinct().withColumns({"source_ids": F.array(F.lit("a"), F.lit("b")), "images": F.lit(0).cast("long")})
    images = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("for_key")).unionByName(c.select(F.lit("o").alias("id"), F.lit("nothing").alias("for_key")))
    return extras.attach_images(modules, images).select("key", F.size("source_ids").cast("long").alias("n"))


@query("SELECT 'note@' || doc_id AS key, 1 + doc_id % 2 AS items, 100.0::DOUBLE AS score FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'note@' || doc_id, 1, 100.0 FROM documents WHERE lang IS NULL AND doc_id % 2 = 1")
def ses09_note_modules(spark, d):
    docs = table(spark, d, "documents")
    notes = docs.select(F.lit("1995-01-02").cast("date").alias("local_date"), F.col("doc_id").cast("string").alias("entry_id"), F.col("lang").alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    images = docs.where("doc_id % 2 = 1").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("entry_id"), F.lit("n").alias("name"), F.lit("1995-01-02").cast("timestamp").alias("ts"))
    return day.note_modules(notes, images).select("key", "items", "score")


_QUERIES = ["https://www.google.com/search?q=a+b%20c", "https://cn.bing.com/search?q=x", "https://www.baidu.com/s?wd=%E4%BD%A0", "https://duckduckgo.com/?q=d", "https://github.com/search?q=repo", "https://example.com/search?q=no", "https://www.google.com/maps?q=no"]


@query(f"SELECT doc_id, {_cases(['a b c', 'x', '你', 'd', 'repo', '', ''])} AS term FROM documents")
def scal10_terms(spark, d):
    return said(spark, d, *_QUERIES).select("doc_id", F.coalesce(urls.search_term(F.col("text")), F.lit("")).alias("term"))


_VISITS = ["https://www.google.com/search?q=a+b", "HTTP://Example.com:80/x?y=1#z", "https://accounts.google.com/signin", "file:///C:/a%20b/c.txt", "ftp://h/x", "https://ads.example.org/p", "https://user:pw@www.h.io", "junk"]


@query(f"SELECT * FROM (SELECT doc_id, {_cases(['https://www.google.com/search?q=a%20b', 'http://example.com/x', '', 'C:/a b/c.txt', '', '', 'https://www.h.io/', ''])} AS url, {_cases(['搜索「a b」', 'title', '', 'title', '', '', 'title', ''])} AS title FROM documents) WHERE url <> ''")
def flt09_visits(spark, d):
    """FLT-09, SCAL-09 to SCAL-11: canonical addresses; sign-in pages, other protocols and excluded domains are left out."""
    rows = said(spark, d, *_VISITS).select("doc_id", F.col("text").alias("url"), F.current_timestamp().alias("ts"), F.lit("title").alias("title"))
    return urls.normalize_visits(rows, ("ads.example",)).select("doc_id", "url", "title")


_SECRETS = [(k, v) for k, v in {"openai": "sk-" + "a1" * 24, "github": "ghp_" + "A1b2" * 9, "aws": "AKIA" + "ABCD1234EFGH5678", "none": "plain words"}.items()]


@query("SELECT doc_id, doc_id % 4 < 3 AS found, doc_id % 4 < 3 AS hidden FROM documents")
def scal13_planted_secrets(spark, d):
    """Keys that were put in are found, and are gone after scrubbing."""
    rows = said(spark, d, *[f"before {v} after" for _, v in _SECRETS])
    scrubbed = redact.scrub_secrets(F.col("text"))
    return rows.select("doc_id", redact.has_secret(F.col("text")).alias("found"), F.contains(scrubbed, F.lit("[已抹除]")).alias("hidden"))


@query("SELECT doc_id, '~/src/' || doc_id AS text FROM documents")
def scal15_home(spark, d):
    return table(spark, d, "documents").select("doc_id", redact.redact_home(F.concat(F.lit("/home/me/src/"), "doc_id"), "/home/me").alias("text"))


@query("SELECT doc_id, 'line ' || doc_id || chr(10) || 'more' AS text FROM documents")
def scal18_plain_text(spark, d):
    text = F.concat(F.lit("line "), "doc_id", F.lit("[^ev1]\n> 置信度：x\nmore[^ev2]\n[^ev1]: note"))
    return table(spark, d, "documents").select("doc_id", journal.plain_text(text).alias("text"))


_MD = ["# One *two*\ntext\n### `Three` ##\n#### no", "\n-----\nfirst line\nsecond", "## Same\n## Same\n", "***\n## "]


@query(f"SELECT doc_id, {_cases(['One two|Three', 'first line', 'Same', ''])} AS outline FROM documents")
def scal20_markdown(spark, d):
    return said(spark, d, *_MD).select("doc_id", F.array_join(texts.markdown_outline(F.col("text")), "|").alias("outline"))


_SQLS = ["-- Top\nselect 1; create table if not exists a.b (x int)", "  CREATE OR REPLACE VIEW v as select 1;\ndrop trigger t", "select 2\nfrom x", "create unique x"]


@query(f"SELECT doc_id, {_cases(['Top|create table if not exists a.b', 'CREATE OR REPLACE VIEW v|drop trigger t', 'select 2', 'create unique x'])} AS outline FROM documents")
def scal22_sql(spark, d):
    return said(spark, d, *_SQLS).select("doc_id", F.array_join(texts.sql_outline(F.col("text")), "|").alias("outline"))


_FILES = [("n.ipynb", '{"cells":[{"cell_type":"markdown","source":"# A\\n## B"},{"cell_type":"code","source":["# no"]}]}'), ("m.ipynb", '{"cells":[{"cell_type":"markdown","source":["# C\\n","text"]}]}'), ("c.csv", 'a,"b c",d\te\n1,2,3'), ("t.tsv", "a\tb,c\n"), ("e.ipynb", '{"cells":[{"cell_type":"code","source":"x"}]}'), ("x.bin", "# no")]


@query(f"SELECT doc_id, {_cases(['A|B', 'C', 'a|b c|d\te', 'a|b,c', '', ''])} AS outline, {_cases(['headings', 'headings', 'columns', 'columns', '', ''])} AS kind FROM documents")
def scal26_outlines(spark, d):
    """SCAL-21 and SCAL-26: notebooks with either form of source, tables by their extension."""
    rows = table(spark, d, "documents").select("doc_id")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _FILES]), (F.pmod("doc_id", F.lit(len(_FILES))) + 1).cast("int"))
    files = rows.withColumn("path", F.concat(F.lit("/d"), "doc_id", F.lit("/"), pick(0)))
    got = logs.with_outlines(files, files.select("path", pick(1).alias("text")))
    return got.select("doc_id", F.coalesce(F.array_join("outline", "|"), F.lit("")).alias("outline"), F.coalesce("outline_kind", F.lit("")).alias("kind"))


_ANSWERS = ['Sure: {"a": 1, "b": [2]} done', "no json", '{"a": {"c": 3}}', "{broken"]


@query(f"SELECT doc_id, {_cases(['1', '', '{\"c\":3}', ''])} AS a FROM documents")
def scal28_model_json(spark, d):
    return said(spark, d, *_ANSWERS).select("doc_id", F.coalesce(F.try_variant_get(extras.model_json(F.col("text")), "$.a", "string"), F.lit("")).alias("a"))


_PROMPTS = ["  do\n this ", "<system> x", "[Request interrupted by user]", "Caveat: y", ""]


@query(f"SELECT doc_id, {_cases(['do this', '', '', '', ''])} AS prompt FROM documents")
def turn06_prompts(spark, d):
    return said(spark, d, *_PROMPTS).select("doc_id", F.coalesce(turns.clean_prompt(F.col("text")), F.lit("")).alias("prompt"))


_REPLIES = ["## Done\n- **bold** and `code`\n```py\nx\n```\nsee [docs](http://x)", "plain", "> quoted\n\n1"]


@query(f"SELECT doc_id, {_cases(['Done bold and code [代码] see docs', 'plain', 'quoted 1'])} AS reply FROM documents")
def turn07_replies(spark, d):
    return said(spark, d, *_REPLIES).select("doc_id", texts.clean_reply(F.col("text")).alias("reply"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN md5('a' || chr(10) || conv_id) ELSE md5('') END AS text FROM conversations")
def turn08_blocks(spark, d):
    """The text blocks of a message; reasoning and tools are none."""
    block = lambda k, v: F.struct(F.lit(k).alias("type"), v.cast("string").alias("text"))
    rows = table(spark, d, "conversations").withColumn("blocks", F.when(F.col("role") == "user", F.array(block("text", F.lit("a")), block("thinking", F.lit("no")), block("input_text", F.col("conv_id")))).otherwise(F.array(block("tool_use", F.lit("x")))))
    return rows.select("conv_id", "turn", F.md5(turns.text_of(F.col("blocks")).cast("binary")).alias("text"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def turn09_instants(spark, d):
    """Seconds, milliseconds and ISO times as instants."""
    text = F.when(F.col("event_id") % 3 == 0, F.unix_millis("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.format_string("%.3f", F.unix_millis("ts") / 1000.0)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    return table(spark, d, "events").select("event_id", F.unix_millis(F.date_trunc("MILLISECOND", times.to_instant(text))).alias("ms"))


@query("SELECT conv_id AS session_id, CASE WHEN conv_id % 4 = 0 THEN 'top' WHEN conv_id % 4 = 1 THEN 'sub' WHEN conv_id % 4 = 2 THEN 'sub' ELSE 'elsewhere' END AS project FROM (SELECT DISTINCT conv_id FROM conversations)")
def join03_attribute_sessions(spark, d):
    """By working directory, else by the first file, else by name."""
    k = F.col("conv_id") % 4
    rows = table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("session_id"), F.when(k == 0, "/p").when(k == 1, "/p/sub/x").when(k == 3, "/q/elsewhere").alias("cwd"), F.when(k == 2, F.array(F.lit("/none/a"), F.lit("/p/sub/b"))).otherwise(F.expr("cast(array() as array<string>)")).alias("action_paths"))
    projects = spark.createDataFrame([("/p", "top"), ("/p/sub", "sub")], "root string, project string")
    return a.attribute_sessions(rows, projects).select("session_id", "project")


# --- assistants' logs, written from conversations and read again

TALK = "SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role, md5(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''"


def _talk(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("role IN ('user', 'assistant')").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("n"), "role", "text", F.lit("2024-01-01T00:00:00Z").alias("at"))


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "seq", "role", F.md5(F.col("text").cast("binary")).alias("text"))


def _json(*pairs):
    """A JSON object of (name, column)."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in pairs]))


@query(TALK)
def adp01_typed_lines(spark, d):
    rows = _talk(spark, d)
    line = _json(("type", F.col("role")), ("sessionId", F.col("file")), ("timestamp", F.col("at")), ("message", F.struct(F.col("role").alias("role"), F.col("text").alias("content"))))
    return _read(assistants.typed_lines(spark, rows.select("file", line.alias("value"), "n")))


@query(TALK)
def adp02_rollouts(spark, d):
    rows = _talk(spark, d)
    part = F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), F.col("text").alias("text")))
    line = _json(("type", F.lit("response_item")), ("timestamp", F.col("at")), ("payload", F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), part.alias("content"))))
    meta = rows.select("file").distinct().select("file", F.lit('{"type": "session_meta", "payload": {"cwd": "/w"}}').alias("value"), F.lit(-1).alias("n"))
    return _read(assistants.rollout_lines(spark, rows.select("file", line.alias("value"), "n").unionByName(meta)).where("cwd = '/w'"))


@query(TALK)
def adp03_documents(spark, d):
    message = F.struct("n", F.struct(F.col("at").alias("timestamp"), F.col("role").alias("type"), F.col("text").alias("content")).alias("m"))
    docs = _talk(spark, d).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    return _read(assistants.message_documents(spark, docs.select("file", _json(("sessionId", F.col("file")), ("messages", F.col("messages"))).alias("value"))))


@query(TALK)
def adp04_three_tables(spark, d):
    rows = _talk(spark, d).withColumn("id", F.concat_ws("-", "file", F.lpad(F.col("n").cast("string"), 6, "0")))
    messages = rows.select("id", F.col("file").alias("session_id"), "role", F.col("n").cast("long").alias("created"))
    parts = rows.select(F.concat("id", F.lit("p")).alias("id"), F.col("id").alias("message_id"), F.lit("text").alias("type"), "text")
    return _read(assistants.three_tables(rows.select(F.col("file").alias("id"), F.lit("/w").alias("directory")).distinct(), messages, parts))


@query(TALK)
def adp05_bubbles(spark, d):
    rows = _talk(spark, d)
    ids = F.transform(F.sort_array(F.collect_list("n")), lambda n: F.struct(n.cast("string").alias("bubbleId")))
    heads = rows.groupBy("file").agg(ids.alias("b")).select(F.concat(F.lit("composerData:"), "file").alias("key"), _json(("composerId", F.col("file")), ("createdAt", F.lit(1)), ("fullConversationHeadersOnly", F.col("b"))).alias("value"))
    bubbles = rows.select(F.concat_ws(":", F.lit("bubbleId"), "file", F.col("n").cast("string")).alias("key"), _json(("type", F.when(F.col("role") == "user", 1).otherwise(2)), ("text", F.col("text"))).alias("value"))
    return _read(assistants.bubble_table(heads.unionByName(bubbles)))


@query(TALK)
def adp10_any_shape(spark, d):
    message = F.struct("n", F.struct(F.col("role").alias("author"), F.col("text").alias("text")).alias("m"))
    docs = _talk(spark, d).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    value = _json(("log", F.struct(F.struct(F.col("messages").alias("all")).alias("chat"))))
    return _read(assistants.generic(spark, docs.select("file", value.alias("value"), F.lit(None).cast("timestamp").alias("mtime"))))


@query(TALK)
def adp12_calls(spark, d):
    """Messages and, between them, calls, which are actions."""
    rows = _talk(spark, d)
    said_ = rows.select("file", _json(("type", F.lit("message")), ("role", F.col("role")), ("content", F.col("text"))).alias("value"), (F.col("n") * 2).alias("n"))
    calls = rows.select("file", F.lit('{"type": "function_call", "name": "run", "arguments": "{\\"command\\": \\"ls\\"}"}').alias("value"), (F.col("n") * 2 + 1).alias("n"))
    got = assistants.call_lines(spark, said_.unionByName(calls))
    kept = got.where("role <> 'action' OR text = 'ls' AND kind = 'command'")
    return _read(kept.where("role <> 'action'").withColumn("seq", F.ceil(F.col("seq") / 2).cast("long")))


@query(TALK)
def adp13_role_table(spark, d):
    rows = _talk(spark, d).select(F.col("file").alias("conversation_id"), F.col("n").alias("id"), F.when(F.col("role") == "user", "human").otherwise("bot").alias("sender"), F.col("text").alias("content"))
    return _read(assistants.role_table(rows))
