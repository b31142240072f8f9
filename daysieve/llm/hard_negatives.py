"""Hard negatives by Fagin's threshold algorithm on integer inner products.

Each component becomes floor(SCALE * x); a row's score for an anchor is the inner product of these integers. An anchor's
positives are its nearest rows of the same label. For each, negatives are the nearest rows of other labels whose scores
lie within shares of the positive's: above the window a row is likely a missed positive, below it is too easy.

Rows are dealt to shards of bounded size, and a shard keeps, for each dimension, the list of its rows in the order of
that component. An anchor reads all lists at once, from the top where its own component is positive and from the bottom
where it is negative (dimensions in which it is zero tell nothing). What it meets is scored at once by random access to
the whole vector. The threshold is the inner product of the anchor with the components at which the lists stand: no row
that was not met can score more. Reading ends when the threshold is strictly below the k-th score found of each window
(strictly, as ties go to the smaller id), or below the window. Anchors are dealt to blocks, each block meets each shard
once, a shard returns its best for each window, and these meet by window. Positives are found first, as they give the windows.

Lists are read some places at a time, twice as many each time: reading further than needed finds nothing wrong, only more.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; of several
rows of one id the one with the least vector (then label) does; other rows of an anchor are those of other ids; vectors
of different lengths are compared over the components that both have, and empty ones score 0; sums beyond a long are held
at its ends; windows of negative positives are empty; ties go to the smaller id; with fewer rows all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, empty

SCALE = 256
SHARD_ROWS = 4096
BLOCK_ANCHORS = 2048
#: Places of each list that are read first.
FIRST_PLACES = 16
#: Sums below are exact in float64.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(x: np.ndarray) -> np.ndarray:
    """Integers, as float64."""
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * x.astype(np.float64), -top, top))


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with a, held within a long."""
    if float(np.abs(a).sum()) * float(np.abs(x).max(initial=0.0)) < EXACT:
        return (x @ a).astype(np.int64)
    own = [int(c) for c in a]
    return np.array([max(-LONG, min(LONG, sum(int(c) * b for c, b in zip(row, own)))) for row in x.tolist()], np.int64)


class Shard:
    """Rows in the order of their ids, and for each dimension the rows by that component, ascending."""

    def __init__(self, ids: np.ndarray, labels: list[str], x: np.ndarray, order: np.ndarray):
        self.ids, self.x, self.order = ids, x, order
        self.codes: dict[str, int] = {}
        self.label = np.array([self.codes.setdefault(c, len(self.codes)) for c in labels], np.int64)

    def read(self, anchor: np.ndarray, enough: Callable[[int, np.ndarray, np.ndarray], bool]) -> tuple[np.ndarray, np.ndarray]:
        """(known, scores): sorted access until enough(threshold, known, scores)."""
        m, d = len(self.ids), min(len(anchor), self.x.shape[1])
        x, a = self.x[:, :d], anchor[:d]
        up, down = np.flatnonzero(a < 0), np.flatnonzero(a > 0)
        met, known, scores = np.zeros(m, bool), np.zeros(m, bool), np.zeros(m, np.int64)
        if not len(up) and not len(down):
            return ~known, scores
        at, step = 0, FIRST_PLACES
        while at < m:
            to = min(m, at + step)
            met[self.order[up, at:to].ravel()] = True
            met[self.order[down, m - to : m - at].ravel()] = True
            new = np.flatnonzero(met & ~known)
            scores[new] = products(x[new], a)
            known[new] = True
            at, step = to, 2 * step
            stand = np.zeros(d)
            stand[up], stand[down] = x[self.order[up, to - 1], up], x[self.order[down, m - to], down]
            if enough(int(products(stand[None, :], a)[0]), known, scores):
                break
        return known, scores

    def best(self, which: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The first k of which by score; rows are in the order of their ids, so ties are as well."""
        return which[np.argsort(-scores[which], kind="stable")[:k]]

    def positives(self, own: int, label: str, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        fit = (self.label == self.codes.get(label, -1)) & (self.ids != own)
        if not fit.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        few = int(fit.sum())

        def enough(threshold: int, known: np.ndarray, scores: np.ndarray) -> bool:
            found = scores[known & fit]
            return len(found) == few or len(found) >= k and threshold < np.partition(found, len(found) - k)[len(found) - k]

        known, scores = self.read(anchor, enough)
        which = self.best(np.flatnonzero(known & fit), scores, k)
        return self.ids[which], scores[which]

    def negatives(self, label: str, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        fit = self.label != self.codes.get(label, -1)

        def enough(threshold: int, known: np.ndarray, scores: np.ndarray) -> bool:
            found = scores[known & fit]
            for low, high in windows:
                if threshold < low or low > high:
                    continue
                inside = found[(found >= low) & (found <= high)]
                if len(inside) < k or threshold >= np.partition(inside, len(inside) - k)[len(inside) - k]:
                    return False
            return True

        known, scores = self.read(anchor, enough)
        out = []
        for low, high in windows:
            which = self.best(np.flatnonzero(known & fit & (scores >= low) & (scores <= high)), scores, k)
            out.append((self.ids[which], scores[which]))
        return out


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest integer from low to high per cent of score."""
    return -(-low * score // 100), high * score // 100


def takers(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one of each id."""
    v = F.col(embedding).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, those that are shorter filled up by zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _lists(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: ids, labels, the matrix of integers and the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = scaled(_matrix(t.column("v").combine_chunks()))
            order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
            small = np.abs(x).max(initial=0.0) < 1 << 31
            row = {"shard": t.column("shard")[0].as_py(), "ids": t.column("vec_id").to_numpy().astype(np.int64).tobytes(), "labels": t.column("label").to_pylist(), "x": x.astype(np.int32 if small else np.float64).tobytes(), "order": order.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("x", pa.binary()), ("order", pa.binary())])
        for batch in batches:
            of = batch.column(0).to_numpy()
            turns = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *turns], [*turns, len(of)]):
                if held and b > a and held[-1].column(0)[0].as_py() != of[a]:
                    yield made()
                    held.clear()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield made()

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "label", "v")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(run, "shard int, ids binary, labels array<string>, x binary, order binary")


def _shard(row: dict) -> Shard:
    ids = np.frombuffer(row["ids"], np.int64)
    order = np.frombuffer(row["order"], np.uint16).reshape(-1, len(ids))
    kind = np.int32 if len(row["x"]) == 4 * order.size else np.float64
    return Shard(ids, row["labels"], np.frombuffer(row["x"], kind).astype(np.float64).reshape(len(ids), -1), order)


def _meet(lists: DataFrame, anchors: DataFrame, shards: int, blocks: int, ask: Callable[[Shard, dict, np.ndarray], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    """What ask yields for each anchor in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if row["ids"] is not None:  # it comes before the anchors that it meets
                    shard = _shard(row)
                else:
                    found += ask(shard, row, scaled(np.array(row["v"], np.float64)))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names)

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = lists.select("shard", every(blocks).alias("block"), F.lit(0).alias("turn"), "ids", "labels", "x", "order")
    asks = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("turn", F.lit(1)).withColumn("shard", every(shards))
    both = index.unionByName(asks, allowMissingColumns=True).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "turn")
    return both.mapInArrow(run, schema)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is an expression on vec_id, low and high are per cent of the positive's score."""
    rows = cut(takers(rows, vec_id, embedding, label))
    n = rows.count()
    if not n:
        return empty(rows.sparkSession, OUT)
    shards = -(-n // SHARD_ROWS)
    lists = cut(_lists(rows, shards))
    anchors = cut(rows.where(is_anchor))
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))

    def near(shard: Shard, row: dict, a: np.ndarray) -> Iterator[tuple]:
        ids, scores = shard.positives(row["vec_id"], row["label"], a, positives)
        return ((row["vec_id"], i, s) for i, s in zip(ids.tolist(), scores.tolist()))

    def hard(shard: Shard, row: dict, a: np.ndarray) -> Iterator[tuple]:
        found = shard.negatives(row["label"], a, [window(p["score"], low, high) for p in row["positives"]], negatives)
        return ((row["vec_id"], p["id"], p["score"], i, s) for p, (ids, scores) in zip(row["positives"], found) for i, s in zip(ids.tolist(), scores.tolist()))

    asked = anchors.select("vec_id", F.col("label").alias("label"), "v")
    found = _meet(lists, asked, shards, blocks, near, "anchor_id long, id long, score long", ["anchor_id", "id", "score"])
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    asked = cut(asked.join(found, "vec_id"))
    found = _meet(lists, asked, shards, blocks, hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
