"""Turns of assistant sessions. Messages: session columns `by`, seq (orders a session), role, text, and where known is_final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import cut

MOST_PROMPTS, MOST_REPLIES, MOST_ACTIONS = 50, 50, 200


def number_turns(messages: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """messages with turn: 0 before the first prompt, then the number of prompts so far."""
    so_far = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(so_far))


def fold_turns(messages: DataFrame, by: tuple[str, ...] = ("session_id",), most: int | None = MOST_PROMPTS) -> DataFrame:
    """(by, turn, prompt, prompt_seq, reply, reply_seq): each prompt with the last text that answers it, a final answer before all others.

    Texts before any prompt and empty ones are dropped; of `most` prompts on, so are the answers.
    """
    rows = number_turns(messages.where("text IS NOT NULL AND trim(text) <> ''"), by).where("turn > 0")
    if most is not None:
        rows = rows.where(F.col("turn") <= most)
    final = F.coalesce(F.col("is_final"), F.lit(False)) if "is_final" in messages.columns else F.lit(False)
    is_reply, is_prompt = F.col("role") == "assistant", F.col("role") == "user"
    rank = F.when(is_reply, F.struct(final.alias("final"), F.col("seq")))
    return rows.groupBy(*by, "turn").agg(F.max(F.when(is_prompt, F.col("text"))).alias("prompt"), F.max(F.when(is_prompt, F.col("seq"))).alias("prompt_seq"), F.max_by(F.when(is_reply, F.col("text")), rank).alias("reply"), F.max_by(F.when(is_reply, F.col("seq")), rank).alias("reply_seq"))


def dedupe_actions(actions: DataFrame, by: tuple[str, ...] = ("session_id",), most: int = MOST_ACTIONS, lengths: dict[str, int] = {"command": 200, "search": 80}) -> DataFrame:  # noqa: B006
    """The first of equal actions (kind, value) of a session, the first `most` of them, their values cut before they are compared."""
    value = F.col("value")
    for kind, n in lengths.items():
        value = F.when(F.col("kind") == kind, F.substring(F.col("value"), 1, n)).otherwise(value)
    rows = actions.withColumn("value", value)
    first = F.row_number().over(Window.partitionBy(*by, "kind", "value").orderBy("seq"))
    rows = rows.withColumn("__n", first).where("__n = 1")
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("seq")) - 1).where(F.col("index") < most).drop("__n")


def sessions_of(messages: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(by, messages, prompts, first_ts, last_ts) of the sessions with a prompt or an action."""
    agg = [F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("prompts"), F.count_if(F.col("role") == "action").alias("actions")]
    if "ts" in messages.columns:
        agg += [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    return messages.groupBy(*by).agg(*agg).where("prompts + actions > 0")


def text_of(blocks: Column) -> Column:
    """The text blocks of a message, never its reasoning, joined by newlines; blocks is array<struct<type, text>>."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")


def clean_prompt(c: Column, noise: tuple[str, ...] = ("<", "Caveat:", "[Request interrupted"), n: int = 400) -> Column:
    """A prompt on one line and cut; null if it is a harness's."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    bad = F.lit(False)
    for p in noise:
        bad = bad | t.startswith(p)
    return F.when(bad | (t == ""), F.lit(None)).otherwise(cut(t, n))


# How a desktop client wraps what was typed, and the heading that the typed text follows.
WRAPPERS = ("# Files mentioned by the user", "# Response annotations", "## My request:", "## My request for Codex")
REQUEST = r"(?im)^#{1,3}[ \t]*My request(?: for Codex)?[ \t]*:?[ \t]*$"
IMAGE = r"(?is)<image\b[^>]*>.*?</image>"


def typed_prompt(c: Column, noise: tuple[str, ...] = (), n: int = 400) -> Column:
    """What was typed of a prompt that a client wrapped in a template: what follows the last request heading; null if there is none, or if it is a harness's or one whole element."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(c, IMAGE, " "), r"(?i)</?image\b[^>]*>", " "))
    wrapped = F.lit(False)
    for w in WRAPPERS:
        wrapped = wrapped | raw.startswith(w)
    parts = F.split(raw, REQUEST)
    inner = F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1), F.lit(" \t\r\n")))
    text = F.when(wrapped, inner).otherwise(raw)
    return F.when(~text.rlike(r"(?is)^<[a-z_]+>.*</[a-z_]+>$"), clean_prompt(text, noise, n))


def overlaps(updated: Column, created: Column, start: Column, end: Column) -> Column:
    """Whether a session was touched within [start, end)."""
    within = lambda t: (t >= start) & (t < end)
    return F.coalesce(within(updated), F.lit(False)) | F.coalesce(within(created), F.lit(False)) | F.coalesce((created < start) & (updated >= end), F.lit(False))
