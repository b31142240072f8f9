"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample. A vector is represented by the order of the pivots by nearness, and posted in
the inverted file of each of its first POSTED. A query looks into the files of its own LOOKED nearest pivots, ranks what
it finds by the footrule distance of the orders, taken over its first RANKED pivots, and reranks the nearest share by
the inner product of the original vectors in double precision.

The inverted files are partitioned by vector, as those of text search engines are: a shard of bounded size holds its
part of every file, so each vector moves once (by file it would move POSTED times) and no pivot, however many vectors
crowd about it, makes a task large. Queries are dealt to blocks and each block meets each shard once; a shard returns
its best k for each query, and these meet by query. What a shard doesn't find is found by others; a query that found
fewer than k vectors in all looks into every file once more. Equal vectors are indexed once, with their smallest ids.

Nearness is the inner product, while orders tell directions only. So a vector is posted in more files the longer it is
(POSTED times the square of its length by the median's), and what a query finds is ranked by length times the cosine
that its footrule distance lets expect, by a line fitted on the sample. With equal lengths this is the order by footrule.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have another number of
components than most take no part, nor do null ids; repeated rows of one id are one candidate, with the best of its
vectors' scores if these differ; a query id with several vectors asks with the least of them; ties go to the smaller
id; with fewer candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, empty

#: Pivots are drawn from at most so many vectors, those of the least hashes.
PIVOT_SAMPLE = 20_000
PIVOTS = 256
#: Files that a vector is posted in, and that a query looks into.
POSTED = 8
LOOKED = 28
#: Pivots of the query over which orders are compared.
RANKED = 32
#: The share of all vectors that is reranked is RERANKED + RERANKED_MORE / sqrt(their number): orders of few vectors tell less.
RERANKED, RERANKED_MORE = 0.05, 10.0
#: Vectors of a shard and queries of a block, about.
SHARD_VECTORS = 8192
BLOCK_QUERIES = 8192


def vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    return rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # no negative zero


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Pivots:
    x: np.ndarray  # directions
    length: float  # the median of the sample's
    near: float  # the cosine to expect at footrule distance 0, and how much less it gets by 1
    less: float

    def orders(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x / np.linalg.norm(x, axis=1, keepdims=True) @ self.x.T), axis=1, kind="stable")


def footrule(places: np.ndarray, ranked: int) -> np.ndarray:
    """places: for the first pivots of a query (rows) where each vector (column) has them; the sum of how far they are apart."""
    apart = places[:ranked] - np.arange(min(ranked, len(places)), dtype=np.int16)[:, None]
    return np.abs(apart, out=apart).sum(axis=0, dtype=np.int32)


def places_of(orders: np.ndarray) -> np.ndarray:
    """A row for each pivot: its place in each of orders."""
    place = np.empty(orders.shape, np.int16)
    np.put_along_axis(place, orders, np.arange(orders.shape[1], dtype=np.int16)[None, :], axis=1)
    return np.ascontiguousarray(place.T)


def choose_pivots(distinct: DataFrame) -> Pivots:
    """Directions of up to PIVOTS vectors of a bounded sample, each drawn with a chance that grows with its distance from those before, so that a crowd of near copies gets few."""
    sample = distinct.orderBy(F.xxhash64("first_id"), "first_id").limit(PIVOT_SAMPLE).select("v").collect()
    x = np.array([r.v for r in sample], np.float64)
    lengths = np.linalg.norm(x, axis=1)
    x /= lengths[:, None]
    rng = np.random.default_rng(3)
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(min(PIVOTS, len(x)) - 1):
        odds = np.maximum(far, 0) ** 2
        odds[chosen] = 0
        if odds.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(x), p=odds / odds.sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    found = Pivots(x[chosen], float(np.median(lengths)), 1.0, 1e-6)
    some = x[:2000]
    orders = found.orders(some)
    place = places_of(orders)
    foot = np.concatenate([footrule(place[orders[i]], RANKED) for i in range(0, len(some), 20)])
    cosine = np.concatenate([some @ some[i] for i in range(0, len(some), 20)])
    if foot.std() > 0 and (less := -float(np.polyfit(foot, cosine, 1)[0])) > 0:
        found.less = less
        found.near = float(max(cosine.mean() + less * foot.mean(), less * (foot.max() + 1)))  # above 0 at any distance
    return found


class Shard:
    """Some vectors with their part of every inverted file."""

    def __init__(self, ids: list[list[int]], v: np.ndarray, pivots: Pivots):
        self.ids, self.v, self.pivots = ids, v, pivots
        perm = pivots.orders(v)
        self.place, self.length = places_of(perm), np.linalg.norm(v, axis=1)
        posted = np.clip(np.round(POSTED * (self.length / pivots.length) ** 2), 1, perm.shape[1])
        owner, place = np.nonzero(np.arange(perm.shape[1]) < posted[:, None])
        file = perm[owner, place]
        order = np.argsort(file, kind="stable")
        self.posting, self.start = owner[order], np.searchsorted(file[order], np.arange(perm.shape[1] + 1))

    def best(self, q: np.ndarray, looked: int, share: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, vectors, scores): what each row of q finds here."""
        some = max(k, math.ceil(len(self.v) * share))
        for i, perm in enumerate(self.pivots.orders(q)):
            seen = np.zeros(len(self.v), bool)
            for file in perm[:looked]:
                seen[self.posting[self.start[file] : self.start[file + 1]]] = True
            near = np.flatnonzero(seen)
            if len(near) > some:
                foot = footrule(self.place[perm[:RANKED]][:, near], RANKED)
                hope = self.length[near] * (self.pivots.near - self.pivots.less * foot)
                near = near[hope >= np.partition(hope, len(hope) - some)[len(hope) - some]]  # ties stay
            score = (self.v[near] * q[i]).sum(axis=1)
            if len(score) > k:
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                near, score = near[best], score[best]
            yield i, near, score


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest candidates but its own id."""
    rows = vectors(candidates, vec_id, embedding)
    # equal vectors once: the k + 1 smallest ids are all that a query can return of them
    ids = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(ids)).where(F.col("place") <= k + 1)
    distinct = rows.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = cut(distinct)
    size = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return empty(candidates.sparkSession, "query_id long, rank int, vec_id long, score double")
    distinct = distinct.where(F.size("v") == size.d)
    asked = vectors(queries, vec_id, embedding).where(F.size("v") == size.d).groupBy("vec_id").agg(F.min("v").alias("v"))
    pivots = choose_pivots(distinct)
    share = min(1.0, RERANKED + RERANKED_MORE / math.sqrt(size.n))
    asked = cut(asked)
    found = cut(_search(asked, distinct, size.n, pivots, LOOKED, share, k))
    # fewer than k were found: for these queries all files, and all that is in them
    lacking = asked.join(found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    lacking = cut(lacking)
    if lacking.count():
        found = found.unionByName(_search(lacking, distinct, size.n, pivots, len(pivots.x), 1.0, k))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(asked: DataFrame, distinct: DataFrame, n: int, pivots: Pivots, looked: int, share: float, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best k and more of each query."""
    shards, blocks = -(-n // SHARD_VECTORS), max(1, -(-asked.count() // BLOCK_QUERIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, shard = None, [], [], None
        for batch in batches:
            of = batch.column(0).to_numpy().astype(np.int64) * blocks + batch.column(1).to_numpy()
            is_query = batch.column(2).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(of) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, len(of)]):
                if a == b:
                    continue
                x, own = _matrix(batch.column(4).slice(a, b - a)), batch.column(3).slice(a, b - a).to_pylist()
                if of[a] != now:
                    now, ids, held, shard = of[a], [], [], None
                if not is_query[a]:  # these come first
                    ids += own
                    held.append(x)
                elif held:
                    shard = shard or Shard(ids, np.concatenate(held), pivots)
                    found = []
                    for i, near, score in shard.best(x, looked, share, k + 1):
                        q = own[i][0]
                        found += [(q, y, s) for j, s in zip(near.tolist(), score.tolist()) for y in ids[j] if y != q]
                    q, y, s = zip(*found) if found else ((), (), ())
                    yield pa.record_batch([pa.array(q, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = distinct.select(F.pmod(F.xxhash64("first_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(False).alias("is_query"), "ids", "v")
    asks = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_query"), F.array("vec_id").alias("ids"), "v")
    met = index.unionByName(asks).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "is_query")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
