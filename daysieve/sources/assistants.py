"""Session logs of assistants, read to one table of messages: (session_id, seq, role, text, ts, is_final, cwd, kind).

Roles are user, assistant and action. Formats are data: a name, how lines or documents are read, and a projection.
Bad lines are null rows of a permissive reader and are skipped; one source never ends another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import to_instant
from ..operators.turns import text_of

MESSAGES = ["session_id", "seq", "role", "text", "ts", "is_final", "cwd", "kind"]
_BLOCKS = "array<struct<type: string, text: string, name: string, input: map<string, string>>>"
_TYPED = f"type string, sessionId string, timestamp string, cwd string, gitBranch string, isSidechain boolean, message struct<role: string, content: string>"  # noqa: F541
_ROLLOUT = "timestamp string, type string, payload struct<id: string, type: string, role: string, phase: string, cwd: string, name: string, arguments: string, input: string, content: array<struct<type: string, text: string>>>"
_DOCUMENT = "sessionId string, messages array<struct<timestamp: string, type: string, role: string, content: string>>"
_REQUESTS = "sessionId string, creationDate long, requests array<struct<timestamp: long, message: struct<text: string>, response: array<struct<value: string>>>>"
_EVENTS = "array<struct<ts: long, type: string, say: string, ask: string, text: string>>"


def _lines(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """Lines of the files at path, or of rows (file, value, n)."""
    if isinstance(path, DataFrame):
        rows = path.select(F.from_json("value", schema).alias("r"), "file", F.lit(0).cast("long").alias("__at"), F.col("n").cast("long").alias("__n"))
        return rows.select("r.*", "file", F.struct("__at", "__n").alias("__order"))
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"))
    return rows.select("r.*", "file", F.struct("__at", "__n").alias("__order"))


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, value, mtime) of the files at path, or of rows with these."""
    return path if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_modification_time").alias("mtime"))


def _documents(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    rows = _files(spark, path).select(F.from_json("value", schema).alias("r"), "file")
    return rows.select("r.*", "file") if not schema.startswith("array") else rows


def _finish(rows: DataFrame, role: Column, text: Column, ts: Column, session: Column, order: Column, final: Column | None = None, cwd: Column | None = None, kind: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    out = rows.select(session.cast("string").alias("session_id"), role.alias("role"), text.alias("text"), ts.alias("ts"), (F.lit(False) if final is None else F.coalesce(final, F.lit(False))).alias("is_final"), (null if cwd is None else cwd).alias("cwd"), (null if kind is None else kind).alias("kind"), order.alias("__order"))
    from pyspark.sql import Window

    out = out.where("role IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("__order")).cast("long")).select(*MESSAGES)


def typed_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {type, sessionId, timestamp, cwd, isSidechain, message: {content}}, content a text or typed blocks."""
    rows = _lines(spark, path, _TYPED).where("type IN ('user', 'assistant') AND NOT coalesce(isSidechain, false)")
    content = F.col("message.content")
    blocks = F.from_json(content, _BLOCKS)
    text = F.when(content.startswith("["), text_of(blocks)).otherwise(content)
    said = rows.withColumns({"__text": text, "__role": F.col("type"), "__part": F.lit(0), "__kind": F.lit(None).cast("string")})
    used = rows.withColumn("__use", F.explode(F.filter(blocks, lambda b: b["type"] == "tool_use")))
    value = F.coalesce(F.col("__use.input")["file_path"], F.col("__use.input")["command"], F.col("__use.input")["query"])
    kind = F.when(F.col("__use.input")["file_path"].isNotNull(), "file").when(F.col("__use.input")["command"].isNotNull(), "command").otherwise("search")
    used = used.withColumns({"__text": value, "__role": F.lit("action"), "__part": F.lit(1), "__kind": kind}).drop("__use")
    every = said.unionByName(used)
    return _finish(every, F.col("__role"), F.col("__text"), to_instant(F.col("timestamp")), F.coalesce("sessionId", "file"), F.struct("__order", "__part", "__text"), cwd=F.col("cwd"), kind=F.col("__kind"))


def rollout_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {timestamp, type, payload}; a payload of phase final_answer is final, one of session_meta tells the directory. A file is a session."""
    from pyspark.sql import Window

    from ..operators.state import command_text

    rows = _lines(spark, path, _ROLLOUT)
    rows = rows.withColumn("__cwd", F.max(F.when(F.col("type") == "session_meta", F.col("payload.cwd"))).over(Window.partitionBy("file"))).where("type = 'response_item'")
    call = F.col("payload.type").isin("function_call", "local_shell_call", "custom_tool_call")
    # three generations of calls: a list of arguments, a text, a patch or command as the whole input
    given = lambda k: F.get_json_object("payload.arguments", f"$.{k}")
    listed = F.from_json(F.coalesce(given("command"), given("cmd")), "array<string>")
    command = F.coalesce(F.when(F.size(listed) > 0, command_text(listed)), given("command"), given("cmd"), F.col("payload.input"))
    role = F.when(call, "action").otherwise(F.col("payload.role"))
    text = F.when(call, command).otherwise(text_of(F.col("payload.content")))
    return _finish(rows, F.when(role.isin("user", "assistant", "action"), role), text, to_instant(F.col("timestamp")), F.col("file"), F.col("__order"), F.col("payload.phase") == "final_answer", cwd=F.col("__cwd"), kind=F.when(call, "command"))


def message_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents {sessionId, messages: [{timestamp, type, content}]}."""
    rows = _documents(spark, path, _DOCUMENT).select("sessionId", "file", F.posexplode("messages").alias("__i", "m"))
    role = F.coalesce("m.role", "m.type")
    return _finish(rows, F.when(role == "user", "user").when(role.isin("assistant", "gemini", "model"), "assistant"), F.col("m.content"), to_instant(F.col("m.timestamp")), F.coalesce("sessionId", "file"), F.col("__i"))


def request_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents {sessionId, requests: [{timestamp, message, response}]}; a request without a time has that of the one before."""
    from pyspark.sql import Window

    rows = _documents(spark, path, _REQUESTS).select(F.coalesce("sessionId", "file").alias("s"), "creationDate", F.posexplode("requests").alias("__i", "q"))
    carried = F.last(F.col("q.timestamp"), ignorenulls=True).over(Window.partitionBy("s").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__ts", F.timestamp_millis(F.coalesce(carried, "creationDate")))
    asked = rows.withColumns({"__role": F.lit("user"), "__text": F.col("q.message.text"), "__part": F.lit(0)})
    answered = rows.withColumns({"__role": F.lit("assistant"), "__text": F.array_join(F.transform("q.response", lambda x: x["value"]), ""), "__part": F.lit(1)})
    return _finish(asked.unionByName(answered), F.col("__role"), F.col("__text"), F.col("__ts"), F.col("s"), F.struct("__i", "__part"))


def ui_events(spark: SparkSession, path: str) -> DataFrame:
    """Documents that are arrays of {ts, say, ask, text}: the first text and feedback are prompts, a completion is a final answer."""
    rows = _documents(spark, path, _EVENTS).select("file", F.posexplode("r").alias("__i", "e"))
    from pyspark.sql import Window

    said = F.col("e.say")
    nth = F.sum((said == "text").cast("int")).over(Window.partitionBy("file").orderBy("__i"))
    rows = rows.withColumn("__nth", nth)
    role = F.when((said == "text") & (F.col("__nth") == 1) | (said == "user_feedback"), "user").when(said.isin("completion_result", "text"), "assistant").when(said.isin("command", "tool") | F.col("e.ask").isin("command", "tool"), "action")
    return _finish(rows, role, F.col("e.text"), F.timestamp_millis("e.ts"), F.col("file"), F.col("__i"), said == "completion_result", kind=F.when(role == "action", "command"))


def three_tables(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Tables session (id, directory), message (id, session_id, role, created ms) and part (id, message_id, type, text), joined by their keys."""
    p = parts.where("type = 'text'").groupBy("message_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    m = messages.select(F.col("id").alias("message_id"), "session_id", "role", "created").join(p, "message_id").join(sessions.select(F.col("id").alias("session_id"), "directory"), "session_id")
    return _finish(m, F.when(F.col("role").isin("user", "assistant"), F.col("role")), F.col("text"), F.timestamp_millis("created"), F.col("session_id"), F.struct("created", "message_id"), cwd=F.col("directory"))


def role_table(messages: DataFrame, candidates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A table of messages whose columns go by one of several names each."""
    names = candidates or {"session": ("session_id", "sessionId", "conversation_id", "conv_id"), "role": ("role", "sender", "type"), "text": ("content", "text", "message"), "ts": ("timestamp", "created_at", "ts"), "order": ("id", "seq", "turn", "timestamp")}
    pick = {k: next((c for c in v if c in messages.columns), None) for k, v in names.items()}
    col = lambda k: F.col(pick[k]) if pick[k] else F.lit(None).cast("string")
    role = F.lower(col("role"))
    ts = to_instant(col("ts").cast("string")) if pick["ts"] else F.lit(None).cast("timestamp")
    return _finish(messages, F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai", "model", "bot"), "assistant"), col("text"), ts, col("session"), col("order"))


def history_and_chat(histories: DataFrame, chats: DataFrame) -> DataFrame:
    """Prompt histories (dir, text: `# time` and `+line`) with the first answer to each prompt's first line in chats (dir, text: `#### prompt`, then its answer)."""
    from pyspark.sql import Window

    def numbered(rows: DataFrame, is_head: Column) -> DataFrame:
        lines = rows.select("dir", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).withColumn("head", is_head)
        return lines.withColumn("n", F.sum(F.col("head").cast("int")).over(Window.partitionBy("dir").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("n > 0")

    join = lambda when, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("i", value.alias("v"))))), lambda x: x["v"]), "\n")
    stamp = r"^# (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:\.\d+)?\s*$"
    asked = numbered(histories, F.col("line").rlike(stamp)).groupBy("dir", "n").agg(F.try_to_timestamp(F.regexp_extract(F.min_by("line", "i"), stamp, 1)).alias("ts"), join(F.col("line").startswith("+"), F.substring("line", 2, 1_000_000)).alias("prompt"))
    asked = asked.where("ts IS NOT NULL AND prompt <> ''").withColumn("first", F.trim(F.element_at(F.split("prompt", "\n"), 1)))
    said = numbered(chats.withColumn("text", F.regexp_replace("text", r"(?m)^# aider chat started at .*$", "> ")), F.col("line").startswith("#### "))
    said = said.groupBy("dir", "n").agg(F.trim(F.substring(F.min_by("line", "i"), 6, 1_000_000)).alias("first"), F.regexp_replace(join(~F.col("head") & ~F.col("line").startswith("> "), F.col("line")), r"^\s+|\s+$", "").alias("reply")).where("reply <> ''")
    said = said.groupBy("dir", "first").agg(F.min_by("reply", "n").alias("reply"))
    rows = asked.join(said, ["dir", "first"], "left")
    ask, tell = rows.withColumns({"role": F.lit("user"), "said": F.col("prompt"), "part": F.lit(0)}), rows.withColumns({"role": F.lit("assistant"), "said": F.col("reply"), "part": F.lit(1)})
    return _finish(ask.unionByName(tell), F.col("role"), F.col("said"), F.col("ts"), F.col("dir"), F.struct("n", "part"), cwd=F.col("dir"))


_MODEL_IO = "sessionId string, turnId string, startedAt string, completedAt string, request struct<messages: array<struct<role: string, content: string>>>, response struct<text: string>"


def model_io_lines(spark: SparkSession, path: str, noise: tuple[str, ...] = ("<", "[Request interrupted")) -> DataFrame:
    """JSON lines of a model's requests and responses: of a turn the first request's last user message and the last response."""
    rows = _lines(spark, path, _MODEL_IO).where("size(request.messages) > 0")
    of = lambda role: F.filter("request.messages", lambda m: m["role"] == role)
    rows = rows.where(~F.exists(of("system"), lambda m: m["content"].rlike("(?i)^Generate a concise title")))
    bad = lambda m: F.trim(m["content"]).rlike("^(?:" + "|".join(x.replace("[", r"\[") for x in noise) + ")") | (F.trim(m["content"]) == "")
    asked = F.try_element_at(F.filter(of("user"), lambda m: ~bad(m)), F.lit(-1))["content"]
    rows = rows.withColumns({"s": F.coalesce("sessionId", "file"), "turn": F.coalesce("turnId", F.col("__order").cast("string")), "asked": asked, "told": F.nullif(F.trim("response.text"), F.lit(""))})
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("__order"))
    turns = rows.groupBy("s", "turn").agg(F.min("__order").alias("o"), F.min_by("asked", has("asked")).alias("asked"), F.min_by("startedAt", has("asked")).alias("at"), F.max_by("told", has("told")).alias("told"), F.max_by(F.coalesce("completedAt", "startedAt"), has("told")).alias("done"))
    ask, tell = turns.withColumns({"role": F.lit("user"), "said": F.col("asked"), "t": F.col("at"), "part": F.lit(0)}), turns.withColumns({"role": F.lit("assistant"), "said": F.col("told"), "t": F.col("done"), "part": F.lit(1)})
    return _finish(ask.unionByName(tell), F.col("role"), F.col("said"), to_instant(F.col("t")), F.col("s"), F.struct("o", "part"))


def bubble_table(kv: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """A table (key, value) of `composerData:<id>` headers and `bubbleId:<id>:<bubble>` messages, in the headers' order; a message without a time has that of the one before. workspaces (session_id, cwd) is optional."""
    from pyspark.sql import Window

    head = F.from_json("value", "composerId string, createdAt long, fullConversationHeadersOnly array<struct<bubbleId: string>>")
    heads = kv.where(F.col("key").startswith("composerData:")).select(head.alias("h"), F.substring("key", len("composerData:") + 1, 1000).alias("k"))
    heads = heads.select(F.coalesce("h.composerId", "k").alias("id"), F.col("h.createdAt").alias("created"), F.posexplode("h.fullConversationHeadersOnly").alias("i", "b"))
    body = kv.where(F.col("key").startswith("bubbleId:")).select("key", F.from_json("value", "type int, text string, createdAt string").alias("m"))
    rows = heads.withColumn("key", F.concat_ws(":", F.lit("bubbleId"), "id", "b.bubbleId")).join(body, "key")
    so_far = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ts = F.coalesce(F.last(to_instant(F.col("m.createdAt")), ignorenulls=True).over(so_far), F.timestamp_millis("created"))
    rows = rows.withColumn("ts", ts)
    rows = rows.withColumn("cwd", F.lit(None).cast("string")) if workspaces is None else rows.join(workspaces.select(F.col("session_id").alias("id"), "cwd"), "id", "left")
    return _finish(rows, F.when(F.col("m.type") == 1, "user").when(F.col("m.type") == 2, "assistant"), F.col("m.text"), F.col("ts"), F.col("id"), F.col("i"), cwd=F.col("cwd"))


# Names of roles and of keys that hold times.
_USER, _ASSISTANT = ["user", "human"], ["assistant", "ai", "bot", "model", "agent"]
_TIMES = ["timestamp", "createdAt", "created_at", "time", "ts", "date", "created"]


def any_messages(files: DataFrame, depth: int = 6) -> DataFrame:
    """Messages in JSON of any shape: files (file, text, mtime), whole documents or lines. What has a role and a text is a message and is not looked into; up to depth levels are."""
    # one chain of rows: found messages pass through the levels below theirs, so the files are read and parsed once
    whole = F.when(~F.contains("text", F.lit("\n{")), F.try_parse_json(F.trim("text")))  # else lines of their own
    rows = files.select("file", "mtime", "text", whole.alias("whole"))
    lines = F.transform(F.split("text", r"\r?\n"), lambda line: F.try_parse_json(line))
    rows = rows.select("file", "mtime", F.posexplode(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(lines)).alias("i", "v")).where("v IS NOT NULL")
    null = F.lit(None).cast("string")
    rows = rows.select("file", "mtime", "v", F.array("i").alias("o"), null.alias("role"), null.alias("said"), null.alias("at"))
    get = lambda *keys: F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in keys])
    role = F.lower(get("role", "type", "author", "sender"))
    text = get("content", "text", "message.content", "message")
    for level in range(depth):
        if level:  # what is found has no v and stays one row
            rows = rows.sparkSession.sql("SELECT n.file, n.mtime, e.value AS v, IF(n.v IS NULL, n.o, array_append(n.o, e.pos)) AS o, n.role, n.said, n.at FROM {n} AS n, LATERAL variant_explode_outer(n.v) AS e", n=rows)
            rows = rows.where("role IS NOT NULL OR v IS NOT NULL")
        shape = F.schema_of_variant("v")
        rows = rows.withColumn("__shape", F.when(F.col("role").isNull(), F.when(shape.startswith("OBJECT"), "o").when(shape.startswith("ARRAY"), "a")))
        own = F.col("__shape") == "o"
        rows = rows.withColumns({"__role": F.when(own, F.when(role.isin(_USER), "user").when(role.isin(_ASSISTANT), "assistant")), "__said": F.when(own, text)})
        hit = F.col("__role").isNotNull() & F.coalesce(F.trim("__said") != "", F.lit(False))
        rows = rows.where(F.col("role").isNotNull() | hit | (F.col("__shape").isNotNull() if level < depth - 1 else F.lit(False)))
        rows = rows.select("file", "mtime", F.when(F.col("role").isNull() & ~hit, F.col("v")).alias("v"), "o", F.coalesce("role", F.when(hit, F.col("__role"))).alias("role"), F.when(hit, F.col("__said")).otherwise(F.col("said")).alias("said"), F.when(hit, get(*_TIMES)).otherwise(F.col("at")).alias("at"))
    found = rows.where("role IS NOT NULL")
    from pyspark.sql import Window

    so_far = Window.partitionBy("file").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("ts", F.coalesce(F.last(to_instant(F.col("at")), ignorenulls=True).over(so_far), F.col("mtime")))
    return _finish(rows, F.col("role"), F.col("said"), F.col("ts"), F.col("file"), F.col("o"))


_CALLS = "type string, timestamp string, role string, name string, arguments string, cwd string, sessionId string, content string"


def call_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """JSON lines {type, role, content, name, arguments}: messages and function calls. A file is a session unless lines name one."""
    rows = _lines(spark, path, _CALLS).where("type IN ('message', 'function_call')")
    call = F.col("type") == "function_call"
    given = lambda k: F.get_json_object("arguments", f"$.{k}")
    file = F.coalesce(given("file_path"), given("path"))
    value = F.coalesce(file, given("command"), given("query"))
    blocks = F.from_json("content", "array<struct<type: string, text: string>>")
    text = F.when(F.col("content").startswith("["), text_of(blocks)).otherwise(F.col("content"))
    kind = F.when(file.isNotNull(), "file").when(given("command").isNotNull(), "command").otherwise("search")
    role = F.when(call, "action").when(F.col("role").isin("user", "assistant"), F.col("role"))
    return _finish(rows, role, F.when(call, value).otherwise(text), to_instant(F.col("timestamp")), F.coalesce("sessionId", "file"), F.col("__order"), cwd=F.col("cwd"), kind=F.when(call, kind))


def session_titles(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(session_id, title): the last title that lines {type: ai-title or custom-title, sessionId, title} give, a user's before a model's. Titles count whatever the range."""
    rows = _lines(spark, path, "type string, sessionId string, title string, customTitle string, aiTitle string").where("type IN ('ai-title', 'custom-title')")
    title = F.coalesce("customTitle", "aiTitle", "title")
    order = F.struct((F.col("type") == "custom-title").alias("own"), F.col("__order"))
    return rows.where(title.isNotNull()).groupBy(F.coalesce("sessionId", "file").alias("session_id")).agg(F.max_by(title, order).alias("title"))


def generic(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages in JSON files of any shape."""
    return any_messages(_files(spark, path).withColumnRenamed("value", "text"))


def json_trees(spark: SparkSession, path: str) -> DataFrame:
    """Folders session, message and part of JSON documents below path."""
    doc = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}", multiLine=True, recursiveFileLookup=True)
    messages = doc("message", "id string, sessionID string, role string, time struct<created: long>").select("id", F.col("sessionID").alias("session_id"), "role", F.col("time.created").alias("created"))
    parts = doc("part", "id string, messageID string, type string, text string").withColumnRenamed("messageID", "message_id")
    return three_tables(doc("session", "id string, directory string"), messages, parts)


def exported_bubbles(spark: SparkSession, path: str) -> DataFrame:
    """A key and value table, exported as Parquet."""
    return bubble_table(spark.read.parquet(path))


def exported_messages(spark: SparkSession, path: str) -> DataFrame:
    """A table of messages, exported as Parquet."""
    return role_table(spark.read.parquet(path))


def folders_of_history(spark: SparkSession, path: str) -> DataFrame:
    """Prompt histories and chats beside one another in folders below path."""
    own = lambda name: _files(spark, f"{path}/*/{name}").select(F.regexp_replace("file", r"/[^/]*$", "").alias("dir"), F.col("value").alias("text"))
    return history_and_chat(own(".aider.input.history"), own(".aider.chat.history.md"))


#: How each registered kind of log is read.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **dict.fromkeys(("claude-code", "codebuddy"), typed_lines),
    "workbuddy": call_lines,
    "zcode": model_io_lines,
    "opencode": json_trees,
    "cursor": exported_bubbles,
    "hermes": exported_messages,
    "aider": folders_of_history,
    **dict.fromkeys(("kimi-code", "deepseek", "grok-build", "copilot-cli", "goose", "crush"), generic),
    "codex": rollout_lines,
    **dict.fromkeys(("gemini-cli", "qwen-code", "iflow"), message_documents),
    **dict.fromkeys(("copilot-chat", "antigravity", "trae", "windsurf"), request_documents),
    **dict.fromkeys(("cline", "roo-code", "kilo-code"), ui_events),
}
#: What is tried next where a reader finds no message.
FALLBACKS: dict[str, tuple] = {"codebuddy": (generic,), "workbuddy": (typed_lines, generic), **dict.fromkeys(("copilot-chat", "antigravity", "trae", "windsurf"), (generic,))}


#: Readers of lines and of whole documents, which take contents that were read file by file.
_OF_LINES = (typed_lines, call_lines, model_io_lines, rollout_lines)
_OF_DOCUMENTS = (message_documents, request_documents, ui_events, generic)


def _own_folders(spark: SparkSession, reader: Callable, path: str) -> DataFrame | None:
    """What a reader with folders of its own finds; None where there are none."""
    from pyspark.errors import AnalysisException

    try:
        return reader(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_sessions(spark: SparkSession, paths: dict[str, str], depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Messages with their provider, and a report (provider, status, files, unread, sessions, error) of each.

    A path is a file or a folder. Each file is opened once, by the task that returns its lines, and what becomes of it
    is a row as well, so a broken one takes nothing with it: status is ok, empty, absent, unknown, or denied or failed if
    no file could be read. Where the messages of a reader's fallbacks are asked for is decided by counts in the same
    plan, so nothing runs until a result is. What was read is kept on disk by persist().
    """
    from pyspark import StorageLevel

    from .files import read_contents
    from .files import report as file_report
    from .inventory import walk

    every, reports, taken = [], [], {}
    for provider in (p for p in paths if p in READERS):
        path, readers = paths[provider], (READERS[provider], *FALLBACKS.get(provider, ()))
        files = None
        for choice, reader in enumerate(readers):
            if reader in _OF_LINES or reader in _OF_DOCUMENTS:
                if files is None:
                    found = walk(spark, [path], depth=depth, skip=("node_modules", ".git"), dots=False)
                    own = spark.createDataFrame([(path.removeprefix("file://"), None)], "path string, mtime timestamp")
                    listed = found.where("kind = 'file'").select("path", "mtime")
                    # a root that is a file, or can't be listed, stands for itself
                    files = listed.unionByName(own.join(listed.limit(1).select(F.lit(1).alias("__any")), how="left").where("__any IS NULL").drop("__any"))
                whole = reader in _OF_DOCUMENTS
                if (provider, whole) not in taken:
                    taken[provider, whole] = read_contents(files, whole, ("mtime",)).persist(StorageLevel.DISK_ONLY)
                    if not choice:
                        reports.append(file_report(taken[provider, whole], ()).select(F.lit(provider).alias("provider"), "*"))
                contents = taken[provider, whole].where("value IS NOT NULL")
                rows = reader(spark, contents.drop("status", "error"))
            else:
                rows = _own_folders(spark, reader, path)
                if rows is None:
                    reports.append(spark.createDataFrame([(provider, "absent", 0, 0, 0, None)], "provider string, status string, files bigint, unread bigint, rows bigint, error string"))
                    continue
                reports.append(spark.createDataFrame([(provider, "ok", None, None, None, None)], "provider string, status string, files bigint, unread bigint, rows bigint, error string"))
            every.append(rows.select(*MESSAGES, F.lit(provider).alias("provider"), F.lit(choice).alias("__choice")))
    messages = None
    for rows in every:
        messages = rows if messages is None else messages.unionByName(rows)
    if messages is None:
        messages = spark.createDataFrame([], "session_id string, seq bigint, role string, text string, ts timestamp, is_final boolean, cwd string, kind string, provider string, __choice int")
    # a provider has one row here, of which there are no more than registered readers
    counts = messages.groupBy("provider", "__choice").agg(F.count_distinct("session_id").alias("sessions"))
    first = counts.groupBy("provider").agg(F.min("__choice").alias("__choice"), F.min_by("sessions", "__choice").alias("sessions"))
    known = None
    for rows in reports:
        known = rows if known is None else known.unionByName(rows)
    unknown = spark.createDataFrame([(p, "unknown", 0, 0, 0, None) for p in paths if p not in READERS], "provider string, status string, files bigint, unread bigint, rows bigint, error string")
    known = unknown if known is None else known.unionByName(unknown)
    known = known.join(F.broadcast(first.drop("__choice")), "provider", "left")
    status = F.when((F.col("status") == "ok") & F.col("sessions").isNull(), "empty").otherwise(F.col("status"))
    report = known.select("provider", status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("sessions", F.lit(0)).alias("sessions"), "error")
    return messages.join(F.broadcast(first.drop("sessions")), ["provider", "__choice"]).select(*MESSAGES, "provider"), report
