"""The same over streams: sessions and turns in the order of events, sessions by event time alone, and evidence that is written once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import GAP_MINUTES

#: Rows that are kept together in a state at most.
CHUNK = 10_000
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_sessions(items: DataFrame, gap_minutes: int = GAP_MINUTES, late: str = "1 hour", by: str = "project") -> DataFrame:
    """(by, start_ts, end_ts, items, commits, prompts) of sessions of a stream of items; one is done once the watermark passes its end.

    Items with the same gap as in split_by_gap() meet in one session; there are no sticky replies here, live_blocks() has them.
    """
    gap = F.session_window("ts", f"{gap_minutes} minutes")
    rows = items.withWatermark("ts", late).groupBy(by, gap).agg(F.count("*").alias("items"), F.max("ts").alias("end_ts"), F.count_if(F.col("kind") == "commit").alias("commits"), F.count_if(F.col("kind") == "prompt").alias("prompts"))
    return rows.select(by, F.col("session_window.start").alias("start_ts"), "end_ts", "items", "commits", "prompts")


class Blocks:
    """Folds items in order to blocks: a new one after more than a gap, unless the item is sticky. The first column of what is open is the time of its last item."""

    item, open = "kind string", "last long, start long, items long, commits long, prompts long"
    out = "end_us long, start_us long, items long, commits long, prompts long"

    def __init__(self, gap_us: int, sticky: str):
        self.gap_us, self.sticky = gap_us, sticky

    def step(self, block: tuple | None, us: int, item: tuple) -> tuple[tuple | None, tuple | None]:
        """(what is open now, what is done)."""
        (kind,) = item
        one = (int(kind == "commit"), int(kind == "prompt"))
        if block is None or us - block[0] > self.gap_us and kind != self.sticky:
            return (us, us, 1, *one), block
        _, start, n, commits, prompts = block
        return (us, start, n + 1, commits + one[0], prompts + one[1]), None

    def rest(self, block: tuple) -> tuple | None:
        """What stays of a block that was given out."""
        return None


class Turns:
    """Folds messages in order to turns: a prompt with the last text that answers it, a final answer before all others. What stands before the first prompt is dropped."""

    item, open = "role string, text string, is_final boolean", "last long, turn long, prompt string, reply string, is_final boolean"
    out = "last_us long, turn long, prompt string, reply string, is_final boolean"

    def step(self, turn: tuple | None, us: int, item: tuple) -> tuple[tuple | None, tuple | None]:
        role, text, final = item
        if not text or not text.strip():
            return turn, None
        if role == "user":
            return (us, turn[1] + 1 if turn else 1, text, None, False), turn if turn and turn[2] is not None else None
        if turn is None or turn[2] is None or role != "assistant" or turn[4] and not final:
            return turn, None
        return (us, turn[1], turn[2], text, bool(final)), None

    def rest(self, turn: tuple) -> tuple | None:
        """Its number, without a prompt."""
        return turn[0], turn[1], None, None, False


class InOrder(StatefulProcessor):
    """Holds what came of a key until the watermark has passed it, then folds it in the order of (time, ordinal), however it came. What is open is given out when something new opens, or after a time without anything."""

    def __init__(self, fold, hold_ms: int):
        self.fold, self.hold_ms = fold, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows string")  # chunks of rows as JSON: a call for each chunk, not each row
        self.opened = handle.getValueState("opened", self.fold.open)

    def _rows(self, key: tuple, done: list[tuple]) -> Iterator[pd.DataFrame]:
        if done:
            columns = ["key", *(c.split()[0] for c in self.fold.out.split(", "))]
            yield pd.DataFrame([(key[0], *r) for r in done], columns=columns)

    def _wait(self, at_ms: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        columns = ["us", "ordinal", *(c.split()[0] for c in self.fold.item.split(", "))]
        for batch in rows:
            if len(batch):
                came = [[None if x is None or x != x else x for x in batch[c].tolist()] for c in columns]
                self.pending.appendValue((json.dumps(list(zip(*came))),))
                first = min(came[0]) if first is None else min(first, min(came[0]))
        if first is not None:
            due = first // 1000 + 1
            timers = [t for t in self.handle.listTimers()]
            if not timers or due < min(timers):
                self._wait(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.opened.get()) if self.opened.exists() else None
        ready, later = {}, {}  # what comes again counts once, as it came last
        for (chunk,) in self.pending.get():
            for us, ordinal, *item in json.loads(chunk):
                (ready if us // 1000 < now else later)[us, ordinal] = tuple(item)
        left = min(later)[0] if later else None
        done = []
        for us, ordinal in sorted(ready):
            item = ready[us, ordinal]
            if state is not None and us // 1000 - state[0] // 1000 > self.hold_ms:  # it was quiet for long: done before this came
                done.append(state)
                state = self.fold.rest(state)
            state, closed = self.fold.step(state, us, item)
            if closed is not None:
                done.append(closed)
        if ready:
            self.pending.clear()
            kept = [(*k, *v) for k, v in later.items()]
            for at in range(0, len(kept), CHUNK):
                self.pending.appendValue((json.dumps(kept[at : at + CHUNK]),))
        due = None if left is None else left // 1000 + 1
        rests = state is None or state == self.fold.rest(state)
        if not rests and left is None:
            if state[0] // 1000 + self.hold_ms < now:
                done.append(state)
                state = self.fold.rest(state)
            else:
                due = state[0] // 1000 + self.hold_ms + 1
        if state is None:
            self.opened.clear()
        else:
            self.opened.update(state)
        if due is not None:
            self._wait(max(due, now + 1))
        yield from self._rows(key, [r for r in done if r != self.fold.rest(r)])

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, by: str, fold, late: str, hold_minutes: int) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)  # the only one with state of several columns
    kind = rows.schema[by].dataType.simpleString()
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    done = rows.groupBy(by).transformWithStateInPandas(InOrder(fold, hold_minutes * 60_000), f"key {kind}, {fold.out}", "Append", "EventTime")
    return done.withColumnRenamed("key", by)


def live_blocks(items: DataFrame, gap_minutes: float = GAP_MINUTES, late: str = "1 hour", by: str = "project", sticky: str = "reply", hold_minutes: int = 1440) -> DataFrame:
    """(by, start_ts, end_ts, items, commits, prompts) of the blocks of a stream of items (by, ts, ordinal, kind), as split_by_gap() splits them: replies stay with the block before.

    Items may come in any order within the watermark; what comes again (same by, ts and ordinal) counts once. A block is
    done when another opens, or hold_minutes after its last item: a reply that comes later than that opens one.
    """
    done = _in_order(items.where("ts IS NOT NULL").select(by, "ts", F.col("ordinal").cast("long").alias("ordinal"), "kind"), by, Blocks(int(gap_minutes * 60_000_000), sticky), late, hold_minutes)
    return done.select(by, F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "items", "commits", "prompts")


def live_turns(messages: DataFrame, late: str = "1 hour", by: str = "session_id", hold_minutes: int = 1440) -> DataFrame:
    """(by, turn, prompt, reply, is_final) of a stream of messages (by, ts, seq, role, text, is_final), as fold_turns() folds them.

    A turn is done with the next prompt, or hold_minutes after its last message; answers that come after that are dropped,
    prompts go on being numbered.
    """
    rows = messages.where("ts IS NOT NULL").select(by, "ts", F.col("seq").cast("long").alias("ordinal"), "role", "text", F.coalesce("is_final", F.lit(False)).alias("is_final"))
    return _in_order(rows, by, Turns(), late, hold_minutes).drop("last_us")


def new_evidence(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Evidence of a stream (source_type, source_ref, occurred_at), the first of each within the watermark."""
    return rows.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["source_type", "source_ref"])
