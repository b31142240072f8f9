"""The library's operators over the star-schema tables, each with SQL that gives the same rows.

`events` stand for a timeline (a user, or a tenth of them, is a project), `conversations` for assistant sessions,
`orders` and `lineitem` for commits and their files, `customer` and `nation` for paths and roots, `documents` and
`labels` for texts and a user's choices, `pages` for visited addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, redact, texts, times, urls
from .operators import attribution as a
from .operators import evidence as e
from .operators import extras
from .operators import sessions as s
from .operators import turns as t
from .operators import web
from .plans import day, journal
from .sources import logs, vcs
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, k in rows.dtypes if k == "timestamp_ntz"})


KINDS = {"purchase": "commit", "signup": "prompt", "error": "shell", "click": "file", "view": "web"}
EXTENSIONS = ["py", "md", "csv", "png"]


def items(spark: SparkSession, d: str, view: str = "web", tenth: bool = True) -> DataFrame:
    """events as a timeline. A project is a tenth of the users, else one user, whose number is told by its last nine digits, as in SQL."""
    k = F.get_json_object("props", "$.k").cast("long")
    path = F.concat(F.lit("src"), k % 3, F.lit("/f"), k, F.lit("."), F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (k % 4 + 1).cast("int")))
    kind = F.element_at(F.create_map(*[x for p in (KINDS | {"view": view}).items() for x in map(F.lit, p)]), F.col("event_type"))
    project = (F.col("user_id") % (10 if tenth else 1_000_000_000)).cast("string")
    return table(spark, d, "events").select(project.alias("project"), F.col("event_id").alias("ordinal"), "ts", kind.alias("kind"), F.when(F.col("event_type") == "click", path).otherwise(F.concat_ws(":", "event_type", k.cast("string"))).alias("label"), F.concat(F.lit("e:"), F.col("event_id")).alias("source_id"), F.concat(F.lit("https://h"), F.col("user_id") % 7, F.lit(".example.com/p"), k).alias("url"), F.concat(F.lit("h"), F.col("user_id") % 7, F.lit(".example.com")).alias("host"), F.col("value").alias("secs"))


ITEMS = """items AS (SELECT (user_id % {tenth})::VARCHAR AS project, event_id AS ordinal, ts,
    CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'prompt' WHEN 'error' THEN 'shell' WHEN 'click' THEN 'file' ELSE '{view}' END AS kind,
    CASE event_type WHEN 'click' THEN 'src' || (k % 3) || '/f' || k || '.' || (['py', 'md', 'csv', 'png'])[k % 4 + 1] ELSE event_type || ':' || k END AS label,
    'e:' || event_id AS source_id, 'https://h' || (user_id % 7) || '.example.com/p' || k AS url, 'h' || (user_id % 7) || '.example.com' AS host, value AS secs
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
BLOCKS = """opened AS (SELECT *, CASE WHEN prev IS NULL OR (kind <> 'reply' AND epoch_us(ts) - epoch_us(prev) > {gap} * 60000000::BIGINT) THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, lag(ts) OVER (PARTITION BY project ORDER BY ts, ordinal) AS prev FROM items)),
    blocks AS (SELECT *, sum(opens) OVER (PARTITION BY project ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM opened)"""
KEPT = """placed AS (SELECT *, row_number() OVER (PARTITION BY project, block, kind, same ORDER BY ts, ordinal) AS place, count(*) OVER (PARTITION BY project, block, kind, same) AS repeats
    FROM (SELECT *, CASE WHEN kind IN ('prompt', 'action-command', 'action-search', 'reply', 'shell') THEN label ELSE '#' || ordinal END AS same FROM blocks)),
    kept AS (SELECT * FROM placed WHERE place = 1)"""
STATS = """stats AS (SELECT project, block, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS items,
    count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (kind = 'prompt') AS prompts, count(*) FILTER (kind = 'shell') AS shell,
    count(DISTINCT CASE WHEN kind = 'file' THEN regexp_extract(label, '[^/]+$') END) AS files,
    count(DISTINCT CASE WHEN kind = 'web' THEN url END) AS pages, count(DISTINCT CASE WHEN kind = 'web' THEN host END) AS sites,
    floor(coalesce(sum(CASE WHEN kind = 'web' THEN secs::DECIMAL(18, 6) END), 0) + 0.5)::BIGINT AS secs,
    coalesce(bool_or(kind = 'file' AND (label LIKE '%.md' OR label LIKE '%.csv')), false) AS document_work,
    2 * count(*) FILTER (kind = 'commit') + count(*) FILTER (kind = 'file' AND label LIKE '%.py') AS code, count(*) FILTER (kind = 'file' AND label LIKE '%.md') AS doc, count(*) FILTER (kind = 'file' AND label LIKE '%.csv') AS data,
    count(*) FILTER (kind IN ('file', 'commit')) AS fileish FROM kept GROUP BY project, block),
    scored AS (SELECT *, greatest(0, floor((epoch_ms(end_ts) - epoch_ms(start_ts)) / 60000.0 + 0.5))::BIGINT AS duration_min FROM stats),
    modules AS (SELECT *, floor((6.0 * commits + 3 * prompts + shell + 3 * sqrt(files) + 2 * sqrt(pages)) * least(1 + duration_min / 120.0, 2) * 10 + 0.5) / 10 AS score,
        commits + prompts + shell + pages = 0 AND files <= 2 AND NOT document_work AS low FROM scored)"""


def _with(*parts: str, view: str = "web", tenth: int = 10, gap: int = 90) -> str:
    return "WITH " + ", ".join(p.format(view=view, tenth=tenth, gap=gap) for p in parts)


def _us(*columns: str) -> list:
    return [F.unix_micros(c).alias(f"{c}_us") for c in columns]


@query(_with(ITEMS, BLOCKS, KEPT, STATS, tenth=1_000_000_000, gap=720) + " SELECT project, block, epoch_us(start_ts) AS start_ts_us, epoch_us(end_ts) AS end_ts_us, items, commits, prompts, files, pages, duration_min, score FROM modules")
def q_work_sessions(spark, d):
    """The flagship: which sessions each project had, how long, of what, with what weight (SES-02/03/04, AGG-01/04)."""
    rows = s.describe(day.blocks(items(spark, d, tenth=False), 720))
    return rows.select("project", "block", *_us("start_ts", "end_ts"), "items", "commits", "prompts", "files", "pages", "duration_min", "score")


@query(_with(ITEMS, BLOCKS) + " SELECT ordinal, project, block FROM blocks")
def ses02_split_by_gap(spark, d):
    return s.split_by_gap(s.complete(items(spark, d))).select("ordinal", "project", "block")


@query(_with(ITEMS, BLOCKS, view="reply") + " SELECT ordinal, project, block FROM blocks")
def ses02_sticky_replies(spark, d):
    return s.split_by_gap(s.complete(items(spark, d, "reply"))).select("ordinal", "project", "block")


@query(_with(ITEMS, BLOCKS, KEPT, view="reply", gap=720) + ", alts AS (SELECT project, block, kind, same, string_agg(source_id, ',' ORDER BY ts, ordinal) AS alts FROM placed WHERE place > 1 GROUP BY ALL) SELECT k.source_id, k.repeats, coalesce(a.alts, '') AS alts FROM kept k LEFT JOIN alts a USING (project, block, kind, same)")
def ses03_dedupe(spark, d):
    rows = day.blocks(items(spark, d, "reply"), 720)
    return rows.select("source_id", "repeats", F.coalesce(F.array_join("alt_source_ids", ","), F.lit("")).alias("alts"))


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + " SELECT project, block, commits, prompts, shell, files, pages, sites, secs, duration_min FROM modules")
def agg01_stats(spark, d):
    return s.describe(day.blocks(items(spark, d))).select("project", "block", "commits", "prompts", "shell", "files", "pages", "sites", "secs", "duration_min")


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + """ SELECT project, block, CASE WHEN prompts >= 3 AND fileish <= 2 THEN 'AI会话' WHEN shell >= 3 AND prompts = 0 AND fileish <= 2 THEN '终端'
    WHEN code + doc + data = 0 THEN CASE WHEN prompts > 0 THEN 'AI会话' ELSE '其他' END WHEN code >= doc AND code >= data THEN '代码' WHEN doc >= data THEN '文档' ELSE '数据' END AS category FROM modules""")
def agg03_category(spark, d):
    return s.describe(day.blocks(items(spark, d))).select("project", "block", "category")


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + ", near AS (SELECT project, block, count(*) AS n, max(near) AS best FROM (SELECT project, block, count(*) OVER (PARTITION BY project, block ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS near FROM kept WHERE kind = 'file') GROUP BY ALL) SELECT project, block, n AS burst_files, best AS burst_best, n >= 3 AND best >= ceil(n * 0.8) AS burst FROM near")
def ses05_bursts(spark, d):
    return s.bursts(day.blocks(items(spark, d)), seconds=3600, least=3)


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + ", rows AS (SELECT project || '@' || strftime(start_ts, '%Y-%m-%dT%H') AS key, score, start_ts, block, items FROM modules WHERE NOT low UNION ALL SELECT 'misc@' || strftime(start_ts, '%Y-%m-%d'), 0, min(start_ts), 0, sum(items)::BIGINT FROM modules WHERE low GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_ts, block) AS n FROM rows) SELECT CASE WHEN n > 1 THEN key || '#' || n ELSE key END AS key, score, items FROM n")
def ses13_modules(spark, d):
    """Modules with unique keys; low signal as one (SES-10..13, FLT-10, SORT-01). The gap of bursts is never met here."""
    return day.build_modules(items(spark, d)).select("key", "score", "items")


WEB = """visits AS (SELECT *, 'web' AS w FROM items WHERE kind = 'web'), wo AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, ordinal) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, ordinal)) > 30 * 60000000::BIGINT THEN 1 ELSE 0 END AS opens FROM visits),
    wb AS (SELECT *, sum(opens) OVER (ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM wo),
    wp AS (SELECT block, url, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS visits, sum(secs) AS secs, arg_min(host, (ts, ordinal)) AS host FROM wb GROUP BY ALL)"""


def visits(spark, d):
    return items(spark, d).where("kind = 'web'").select("ts", "ordinal", "url", "host", F.col("label").alias("title"), F.lit(None).cast("string").alias("term"), "secs")


@query(_with(ITEMS, WEB) + " SELECT block, url, epoch_us(first_ts) AS first_ts_us, epoch_us(last_ts) AS last_ts_us, visits, host FROM wp")
def ses06_web_blocks(spark, d):
    return web.web_blocks(visits(spark, d)).select("block", "url", *_us("first_ts", "last_ts"), "visits", "host")


@query(_with(ITEMS, WEB) + ", wm AS (SELECT block, count(*) AS pages, count(DISTINCT host) AS sites, min(first_ts) AS f, max(last_ts) AS l FROM wp GROUP BY block), x AS (SELECT block, pages, sites, greatest(0, floor((epoch_ms(l) - epoch_ms(f)) / 60000.0 + 0.5))::BIGINT AS duration_min FROM wm WHERE pages >= 3) SELECT *, floor(2 * sqrt(pages) * least(1 + duration_min / 120.0, 2) * 10 + 0.5) / 10 AS score FROM x UNION ALL SELECT -(epoch(f)::BIGINT // 86400), count(DISTINCT url), count(DISTINCT host), 0, 0 FROM wp JOIN (SELECT block, f FROM wm WHERE pages < 3) USING (block) GROUP BY 1")
def ses06_web_modules(spark, d):
    return web.web_modules(visits(spark, d)).select("block", "pages", "sites", "duration_min", "score")


@query(_with(ITEMS) + " SELECT url, arg_min(host, (ts, ordinal)) AS host, epoch_us(min(ts)) AS first_ts_us, epoch_us(max(ts)) AS last_ts_us, count(*) AS visits FROM items WHERE kind = 'web' GROUP BY url ORDER BY visits DESC, sum(secs) DESC, min(ts), url LIMIT 500")
def ses08_top_pages(spark, d):
    """SES-08, SORT-03: the 500 pages visited most."""
    return web.group_pages(visits(spark, d), 500).select("url", "host", *_us("first_ts", "last_ts"), "visits")


TURNS = "m AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM conversations WHERE text IS NOT NULL AND trim(text) <> '')"


def messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


@query(f"WITH {TURNS} SELECT conv_id AS session_id, n AS turn, max(CASE WHEN role = 'user' THEN turn END) AS prompt_seq, max(CASE WHEN role = 'assistant' THEN turn END) AS reply_seq, length(arg_max(text, turn) FILTER (role = 'assistant'))::INT AS reply_length FROM m WHERE n BETWEEN 1 AND 50 GROUP BY ALL")
def turn01_fold(spark, d):
    return t.fold_turns(messages(spark, d)).select("session_id", "turn", "prompt_seq", "reply_seq", F.length("reply").alias("reply_length"))


@query("SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS prompts FROM conversations GROUP BY conv_id HAVING prompts > 0")
def turn05_sessions(spark, d):
    return t.sessions_of(messages(spark, d)).select("session_id", "messages", "prompts")


@query("WITH x AS (SELECT user_id AS session_id, event_type AS kind, json_extract_string(props, '$.k') AS value, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type, json_extract_string(props, '$.k') ORDER BY event_id) AS n FROM events), y AS (SELECT session_id, kind, value, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM x WHERE n = 1) SELECT session_id, kind, value, seq, i AS index FROM y WHERE i < 200")
def turn04_actions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))
    return t.dedupe_actions(rows).select("session_id", "kind", "value", "seq", "index")


PATHS = """paths AS (SELECT c_custkey, '/r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey),
    roots AS (SELECT '/r' || r_regionkey AS root, r_name AS project FROM region UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0)"""


def paths(spark, d):
    nation = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    return rows.select("c_custkey", F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("path"))


def roots(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("/r"), "r_regionkey").alias("root"), F.col("r_name").alias("project"))
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("root"), F.col("n_name").alias("project"))
    return r.unionByName(n)


@query(f"WITH {PATHS} SELECT c_custkey, arg_max(project, length(root)) AS project, arg_max(root, length(root)) AS matched_root FROM paths JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY c_custkey")
def join01_longest_prefix(spark, d):
    return a.longest_prefix(paths(spark, d), roots(spark, d)).select("c_custkey", "project", "matched_root")


@query(f"WITH {PATHS} SELECT root FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE starts_with(r.root, o.root || '/'))")
def set07_without_nested(spark, d):
    return a.without_nested(roots(spark, d))


@query(f"WITH {PATHS} SELECT c_custkey FROM paths WHERE NOT EXISTS (SELECT 1 FROM roots WHERE root LIKE '%/n%' AND starts_with(path, root || '/'))")
def flt08_outside(spark, d):
    return a.outside(paths(spark, d), roots(spark, d).where("root LIKE '%/n%'")).select("c_custkey")


@query(f"WITH {PATHS} SELECT c_custkey, arg_max(root, length(root)) AS marked_root FROM paths LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY c_custkey")
def join05_marked_root(spark, d):
    return a.marked_root(paths(spark, d), roots(spark, d).withColumnRenamed("root", "dir")).select("c_custkey", "marked_root")


@query(f"WITH {PATHS} SELECT c_custkey, root || '/' || split_part(substr(path, length(root) + 2), '/', 1) AS project_dir FROM paths JOIN (SELECT DISTINCT root FROM roots WHERE root NOT LIKE '%/n%') ON starts_with(path, root || '/')")
def join04_project_dir(spark, d):
    return a.project_dir(paths(spark, d), roots(spark, d).where("root NOT LIKE '%/n%'")).select("c_custkey", "project_dir")


@query("""WITH f AS (SELECT o_orderkey AS hash, CASE WHEN l_partkey % 5 = 0 THEN 'core' WHEN l_partkey % 5 = 1 THEN 'web' END AS sub FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT hash, CASE WHEN count(DISTINCT sub) = 1 THEN max(sub) ELSE 'mono' END AS project FROM f GROUP BY hash""")
def join06_route_commits(spark, d):
    """Commits of one repository go to the sub-project that all their files with one agree on."""
    sub = F.when(F.col("l_partkey") % 5 == 0, "core/x").when(F.col("l_partkey") % 5 == 1, "web/x").otherwise("x")
    commits = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_list(sub).alias("files")).withColumn("repo", F.lit("/mono"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"))
    projects = spark.createDataFrame([("/mono", "mono"), ("/mono/core", "core"), ("/mono/web", "web")], "root string, project string")
    return a.route_commits(commits.join(known, "hash"), projects)


@query("""WITH p AS (SELECT c_custkey, 'n' || c_nationkey AS project, '/d' || (c_custkey % 40) || '/n' || c_nationkey || '/' || c_custkey AS root FROM customer),
    q AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, split_part(root, '/', 3) || '/' || c_custkey AS named FROM p),
    r AS (SELECT CASE WHEN n > 1 THEN named ELSE project END AS project, root FROM q), z AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY root) AS k FROM r)
    SELECT root, CASE WHEN k > 1 THEN project || '-' || k ELSE project END AS project FROM z""")
def join08_dedupe_ids(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.concat(F.lit("n"), "c_nationkey").alias("project"), F.concat(F.lit("/d"), F.col("c_custkey") % 40, F.lit("/n"), "c_nationkey", F.lit("/"), "c_custkey").alias("root")).withColumn("name", F.col("project"))
    return a.dedupe_ids(rows).select("root", "project")


@query("SELECT o_orderkey AS hash, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def agg14_numstat(spark, d):
    """Records of a git log made of orders and their lines, parsed again (SRC-04, AGG-14)."""
    line = F.concat_ws("\t", F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.concat(F.lit("f"), "l_partkey"))
    stats = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    head = F.concat_ws(vcs.FIELD, F.col("o_orderkey").cast("string"), F.lit("A"), F.lit("a@b"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("m"))
    records = table(spark, d, "orders").join(stats, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat_ws("\n", head, "lines").alias("record"))
    return vcs.parse_git_log(records).select(F.col("hash").cast("long").alias("hash"), "additions", "deletions", F.size("files").cast("long").alias("files"))


@query("SELECT o_orderkey, ((o_orderdate AT TIME ZONE 'UTC' - INTERVAL 4 HOUR) AT TIME ZONE 'America/New_York')::DATE AS local_date FROM orders")
def scal01_local_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.local_date(F.col("o_orderdate"), 4, "America/New_York").alias("local_date"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08 20:00:00' AND ts < TIMESTAMP '2024-01-15 20:00:00'")
def flt01_week(spark, d):
    """The week up to 14 January in Shanghai, days from 4 o'clock; pushed down to the scan."""
    from datetime import date

    r = times.days(date(2024, 1, 15), 7, 4, "Asia/Shanghai")
    return table(spark, d, "events").where(r.holds(F.col("ts"))).select("event_id")


@query(r"""SELECT doc_id, CASE WHEN length(f) > 32 THEN substr(f, 1, 32) || '…' ELSE f END AS title FROM (SELECT doc_id, CASE WHEN trim(regexp_extract(t, '^[^。！？\n?!]*')) = '' THEN t ELSE trim(regexp_extract(t, '^[^。！？\n?!]*')) END AS f
    FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[\s、，。：:,.\-—]+', '')) AS t FROM documents))""")
def scal04_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.to_title(F.col("text")).alias("title"))


@query("SELECT doc_id, ceil(length(coalesce(text, '')) / 3.5)::BIGINT AS tokens FROM documents")
def scal16_tokens(spark, d):
    """The texts hold no CJK signs; those are a unit test's."""
    return table(spark, d, "documents").select("doc_id", texts.estimate_tokens(F.col("text")).alias("tokens"))


_EMAIL = redact.PERSONAL["email"][0]


@query(f"""WITH e AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}'))::INT AS emails, regexp_replace(coalesce(text, ''), '{_EMAIL}', '[邮箱]', 'g') AS t FROM documents)
    SELECT doc_id, emails, len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda r: regexp_full_match(r, '1[3-9][0-9]{{9}}')))::INT AS phones FROM e""")
def scal14_personal(spark, d):
    """Addresses of mail, and phone numbers in what is left; what replaces them is a unit test's."""
    found = redact.personal_counts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found["email"].alias("emails"), found["cn-phone"].alias("phones"))


_SECRETS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in redact.SECRETS.items())


@query(_SECRETS_SQL)
def scal13_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(redact.scan_secrets(F.col("text"))).alias("hit")).select("doc_id", F.col("hit.kind").alias("kind"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in redact.CREDENTIAL_COMMANDS))
def flt07_credentials(spark, d):
    return table(spark, d, "documents").where(redact.is_credential_command(F.col("text"))).select("doc_id")


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS host FROM pages""")
def scal09_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.current_timestamp().alias("ts"), F.lit("").alias("title"))
    return urls.normalize_visits(rows).select("page_id", "url", "host")


@query("""WITH f AS (SELECT p_partkey, 'f' || p_partkey || (['.py', '.log', '.xlsx', '.zip', '', '.pem', '.tmp', '.MD'])[p_partkey % 8 + 1] AS name FROM part)
    SELECT p_partkey, regexp_matches(name, '\\.(py|xlsx|MD)$') AS work, regexp_matches(name, '\\.pem$') AS sensitive FROM f""".replace("\\\\", "\\"))
def flt05_work_files(spark, d):
    ends = F.array(*[F.lit(x) for x in (".py", ".log", ".xlsx", ".zip", "", ".pem", ".tmp", ".MD")])
    name = F.concat(F.lit("f"), "p_partkey", F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", names.is_work(name).alias("work"), names.is_sensitive(name).alias("sensitive"))


@query("""WITH c AS (SELECT o_orderkey AS fact_id, 'commit:' || o_orderkey AS cited FROM orders UNION ALL SELECT o_orderkey, 'commit:' || o_custkey FROM orders WHERE o_orderkey % 3 <> 0),
    known AS (SELECT DISTINCT 'commit:' || event_id AS cited FROM events WHERE event_type <> 'view')
    SELECT fact_id, CASE WHEN count(*) FILTER (k.cited IS NULL) > 0 THEN 'unverified' ELSE 'confirmed' END AS confidence, count(DISTINCT c.cited) FILTER (k.cited IS NULL)::INT AS missing FROM c LEFT JOIN known k USING (cited) GROUP BY fact_id""")
def join14_validate(spark, d):
    """Facts that cite commits, some of which don't exist."""
    o = table(spark, d, "orders")
    ids = F.array_compact(F.array(F.concat(F.lit("commit:"), "o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("commit:"), "o_custkey"))))
    facts = o.select(F.col("o_orderkey").alias("fact_id"), ids.alias("source_ids"), F.lit("confirmed").alias("confidence"))
    stored = table(spark, d, "events").where("event_type <> 'view'").select(F.lit("commit").alias("source_type"), F.col("event_id").cast("string").alias("source_ref"), F.to_date("ts").alias("local_date"))
    return e.validate(facts, stored).select("fact_id", "confidence", F.size("missing").alias("missing"))


@query("SELECT d.doc_id AS key, coalesce(l.quality = 1, CASE WHEN source LIKE '%src1%' THEN false ELSE n_chars > 500 END) AS selected FROM documents d LEFT JOIN labels l USING (doc_id)")
def sel01_selection(spark, d):
    modules = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("project"), (F.col("n_chars") > 500).alias("selected"))
    overrides = table(spark, d, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("chosen"))
    return e.select_modules(modules, overrides, ("src1",)).select("key", "selected")


@query("SELECT event_id, event_type, user_id FROM (SELECT event_id, event_type, user_id, event_id % 2000 AS k, row_number() OVER (PARTITION BY event_id % 2000 ORDER BY event_id) AS n FROM events) WHERE n = 1")
def set03_insert_new(spark, d):
    """First write wins: the odd half is stored, all is offered again."""
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 2000).alias("k"))
    first = e.insert_new(rows.limit(0), rows.where("event_id < 1000"), ["k"], ["event_id"])
    return e.insert_new(first, rows, ["k"], ["event_id"]).drop("k")


@query("SELECT coalesce(c.c_custkey, o.k) AS k, coalesce(c.c_name, o.name) AS name, coalesce(o.last, c.c_acctbal) AS last, greatest(coalesce(o.last, -1e9), coalesce(c.c_acctbal, -1e9)) AS most FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT o_custkey AS k, 'new' AS name, max(o_totalprice) AS last FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.k")
def set04_upsert(spark, d):
    stored = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("last"), F.col("c_acctbal").alias("most"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("new").alias("name"), F.max("o_totalprice").alias("last")).withColumn("most", F.col("last"))
    return e.upsert(stored, new, ["k"], {"name": "keep", "last": "fill", "most": "max"})


@query(_with(ITEMS, BLOCKS, KEPT, gap=720) + ", p AS (SELECT *, row_number() OVER (PARTITION BY project, block, kind ORDER BY ts, ordinal) AS rn FROM kept) SELECT source_id, rn::INT AS place FROM p WHERE rn <= CASE kind WHEN 'prompt' THEN 12 WHEN 'file' THEN 8 WHEN 'web' THEN 10 ELSE 2147483647 END")
def topk02_capped(spark, d):
    return journal.capped(day.blocks(items(spark, d), 720)).select("source_id", "place")


@query(_with(ITEMS, BLOCKS, KEPT, gap=720) + ", n AS (SELECT project, block, kind, count(*) AS n FROM kept GROUP BY ALL) SELECT project, block, kind, n - CASE kind WHEN 'prompt' THEN 12 WHEN 'file' THEN 8 ELSE 10 END AS more FROM n WHERE n > CASE kind WHEN 'prompt' THEN 12 WHEN 'file' THEN 8 WHEN 'web' THEN 10 ELSE 2147483647 END")
def topk02_more(spark, d):
    return journal.skipped(day.blocks(items(spark, d), 720))


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + " SELECT score, items FROM modules WHERE NOT low ORDER BY score DESC, start_ts, project || '@' || strftime(start_ts, '%Y-%m-%dT%H') LIMIT 5")
def topk01_highlights(spark, d):
    return journal.highlights(day.build_modules(items(spark, d))).select("score", "items")


@query("SELECT epoch_us(ts) // 1000 AS ms, url, floor(value)::BIGINT AS secs, count(*) AS visits FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages) WHERE event_id % 11 NOT IN (3, 4, 8) AND page_id % 7 <> 0 GROUP BY ALL")
def src15_history(spark, d):
    """A Chromium history of events over all pages: microseconds from 1601, transitions, hidden addresses. The reader's own rows, counted."""
    pages = table(spark, d, "pages")
    v = table(spark, d, "events").select((F.col("event_id") % pages.count()).alias("url"), (F.unix_micros("ts") + logs.CHROMIUM_MS * 1000).alias("visit_time"), (F.col("event_id") % 11).alias("transition"), (F.floor("value") * 1_000_000).alias("visit_duration"))
    u = pages.select(F.col("page_id").alias("id"), "url", F.lit("").alias("title"), F.when(F.col("page_id") % 7 == 0, 1).otherwise(0).alias("hidden"))
    rows = logs.chromium_visits(v, u).select(F.unix_millis("ts").alias("ms"), "url", F.col("secs").cast("long").alias("secs"))
    return rows.groupBy("ms", "url", "secs").agg(F.count("*").alias("visits"))


@query("SELECT substr(sha1(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(9) || '/u/' || user_id || chr(9) || 'run ' || event_type), 1, 16) AS id FROM events GROUP BY ALL")
def src19_shell_log(spark, d):
    """Lines of a shell log, parsed, each command once."""
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(F.lit("/u/"), "user_id"), F.concat(F.lit("run   "), "event_type"))
    return logs.collect_shell(logs.parse_shell_log(table(spark, d, "events").select(line.alias("line")))).select("id")


@query(_with(ITEMS, BLOCKS) + ", b AS (SELECT project, block, min(ts) AS f, max(ts) AS l, count(*) AS items, count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (kind = 'prompt') AS prompts FROM blocks GROUP BY ALL) SELECT project, epoch_us(f) AS start_ts_us, epoch_us(l) AS end_ts_us, items, commits, prompts FROM b")
def str02_live_sessions(spark, d):
    """The streaming sessions, over a bounded input."""
    return live.live_sessions(items(spark, d)).select("project", *_us("start_ts", "end_ts"), "items", "commits", "prompts")


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + " SELECT epoch_us(min(start_ts)) AS first_us, epoch_us(max(end_ts)) AS last_us, count(*) AS modules, sum(items)::BIGINT AS items FROM modules WHERE NOT low")
def agg12_headline(spark, d):
    return day.headline(day.work_modules(items(spark, d))).select(F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "modules", "items")


@query("SELECT (event_id % 30)::BIGINT AS local_date, count(*) AS calls, sum(user_id)::BIGINT AS input, sum(floor(value))::BIGINT AS output FROM events WHERE event_type <> 'error' GROUP BY ALL")
def agg09_usage(spark, d):
    runs = table(spark, d, "events").select((F.col("event_id") % 30).alias("local_date"), F.col("user_id").alias("input_tokens"), F.floor("value").alias("output_tokens"), (F.col("event_type") != "error").alias("ok"))
    return extras.usage(runs)


@query("SELECT coalesce(o.k, c.c_custkey) AS id, coalesce(o.name, c.c_name) AS name FROM customer c FULL JOIN (SELECT DISTINCT o_custkey AS k, 'own' AS name FROM orders WHERE o_orderkey % 7 = 0) o ON o.k = c.c_custkey")
def join15_override(spark, d):
    builtin = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    custom = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id"), F.lit("own").alias("name")).distinct()
    return extras.override(builtin, custom)


@query(f"WITH {PATHS}, p AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS n FROM paths GROUP BY ALL ORDER BY n DESC, path LIMIT 6) SELECT path, max(weight) AS weight FROM (SELECT path, n + 100 AS weight FROM p UNION ALL SELECT root, 50 FROM roots) GROUP BY path")
def src23_candidate_roots(spark, d):
    fixed = roots(spark, d).select(F.col("root").alias("path"), F.lit(50).alias("weight"))
    return extras.candidate_roots(paths(spark, d).select(F.col("path").alias("cwd")), fixed, "/home/me")


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + ", h AS (SELECT project, unnest(generate_series(date_trunc('hour', start_ts - INTERVAL 30 MINUTE), date_trunc('hour', end_ts + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS hour FROM modules) SELECT project, epoch_us(hour) AS hour_us, count(*) AS modules FROM h GROUP BY ALL")
def ses14_board_hours(spark, d):
    rows = s.describe(day.blocks(items(spark, d)))
    return extras.board_hours(rows).select("project", *_us("hour"), "modules")


@query(_with(ITEMS, BLOCKS, KEPT, STATS) + " SELECT project, block, score, low FROM modules")
def agg04_score(spark, d):
    """AGG-04 and FLT-10: the weight of each block and whether it is low signal."""
    return s.describe(day.blocks(items(spark, d))).select("project", "block", "score", s.low_signal(F.col("document_work")).alias("low"))


@query("SELECT event_id, event_type AS source_type, event_id::VARCHAR AS source_ref, (ts - INTERVAL 4 HOUR)::DATE AS local_date, CASE WHEN length(props) > 8 THEN substr(props, 1, 8) || '…' ELSE props END AS excerpt FROM events")
def evd01_evidence(spark, d):
    """Events as rows of the evidence table."""
    rows = table(spark, d, "events").withColumn("project", F.col("user_id").cast("string"))
    found = e.evidence(rows, F.col("event_type"), F.col("event_id"), F.col("ts"), F.col("props"), n=8)
    return found.select(F.col("source_ref").cast("long").alias("event_id"), "source_type", "source_ref", "local_date", "excerpt")


@query("SELECT event_id, event_type AS source_type, 'a:' || event_id AS source_ref FROM events")
def evd07_source_ids(spark, d):
    rows = table(spark, d, "events").select("event_id", e.source_id(F.col("event_type"), F.concat(F.lit("a:"), "event_id")).alias("id"))
    return rows.select("event_id", *[c.alias(k) for k, c in e.parse_source_id(F.col("id")).items()])


@query("SELECT user_id AS url_id, arg_max(json_extract_string(props, '$.k'), event_id) AS term FROM events GROUP BY user_id")
def join11_last_term(spark, d):
    terms = table(spark, d, "events").select(F.col("user_id").alias("url_id"), F.col("event_id").alias("rowid"), F.get_json_object("props", "$.k").alias("term"))
    return web.last_term(terms)


@query("SELECT '/c/' || c_custkey AS root, CASE WHEN c_custkey % 3 = 0 THEN 'kept-' || c_custkey ELSE 'new-' || c_custkey END AS project FROM customer")
def join09_reconcile(spark, d):
    """Roots that are stored keep their ids."""
    c = table(spark, d, "customer")
    new = c.select(F.concat(F.lit("/c/"), "c_custkey", F.lit("/")).alias("root"), F.concat(F.lit("new-"), "c_custkey").alias("project"))
    stored = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("/c/"), "c_custkey").alias("root"), F.concat(F.lit("kept-"), "c_custkey").alias("project"))
    return a.reconcile(new, stored).select("root", "project")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unverified' ELSE 'confirmed' END AS confidence, count(*) AS n FROM orders GROUP BY ALL")
def agg10_confidence(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "unverified").otherwise("confirmed").alias("confidence"))
    return journal.confidence_counts(rows)


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS hhmm, 'UTC+08:00' AS label FROM events")
def scal02_hhmm(spark, d):
    """SCAL-02 and SCAL-03."""
    return table(spark, d, "events").select("event_id", times.hhmm(F.col("ts"), "Asia/Shanghai").alias("hhmm"), times.utc_offset_label(F.col("ts"), "Asia/Shanghai").alias("label"))


@query("SELECT event_id, CASE WHEN value >= 60 THEN '停留约 ' || floor(value / 60 + 0.5)::INT || ' 分钟' ELSE '' END AS stay FROM events")
def scal12_stay(spark, d):
    return table(spark, d, "events").select("event_id", texts.stay_words(F.col("value")).alias("stay"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(coalesce(text, ''), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[\r\n]+', ' ', 'g')) AS digest FROM conversations")
def scal17_defused(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(texts.defuse_markdown(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT event_id, repeat('*', length(props) - 2) || right(props, 2) AS masked FROM events")
def scal29_masked(spark, d):
    return table(spark, d, "events").select("event_id", extras.mask_key(F.col("props"), 2).alias("masked"))


@query(r"SELECT doc_id, regexp_extract(name, '[^/]+$') AS base, d AS dir, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext FROM (SELECT doc_id, 'x/' || coalesce(source, 'none') || '/' || doc_id || '.TXT' AS name, coalesce(source, 'none') AS d FROM documents)")
def scal06_names(spark, d):
    path = F.concat(F.lit("x/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".TXT"))
    return table(spark, d, "documents").select("doc_id", texts.base_name(path).alias("base"), texts.dir_name(path).alias("dir"), texts.extension(texts.base_name(path)).alias("ext"))


@query("SELECT o_orderkey, o_orderdate + to_days((o_custkey % 5)::INT) >= TIMESTAMP '1995-01-01' AND o_orderdate + to_days((o_custkey % 5)::INT) < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate < TIMESTAMP '1995-01-01' AND o_orderdate + to_days((o_custkey % 5)::INT) >= TIMESTAMP '1996-01-01' AS touched FROM orders")
def turn10_overlaps(spark, d):
    until = F.timestamp_add("DAY", (F.col("o_custkey") % 5).cast("int"), F.col("o_orderdate"))
    start, end = (F.lit(f"{y}-01-01").cast("timestamp") for y in (1995, 1996))
    return table(spark, d, "orders").select("o_orderkey", t.overlaps(until, F.col("o_orderdate"), start, end).alias("touched"))
