"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Texts of one set are one class; classes are joined, and texts take their class's component.

* Light: a class of up to `boundary` shingles emits all its subsets of each size that could be the overlap of a link.
  Two classes that share such a subset link, without a look at the sets. The boundary is the size up to which
  subsets cost less than inverted lists, from the counts of classes by size.
* Heavy: larger classes (and the light ones that may link with them) go to inverted lists. By prefix filtering in hash
  order, linked sets share `l` shingles among their first n - need + l. Counts over all such shingles drop those that
  no other class has and classes with too few others; the rest are prefix-filtered again, rarest shingles first.
  Classes that share a posting form families; each family's sets meet once, in blocks of bounded size, where
  scanning the block's inverted lists gives every overlap exactly. A family beyond a block is dealt as pairs of pieces.
  Blocks return a spanning forest of links, never pairs of a group.

Defined results: a text without words (or null) has no shingles and is its own component; rows of one doc_id are one
document and share links; a null doc_id gets its set's component if another row has that set or a link to it, else
null; other columns are ignored; an empty table gives an empty result. Links are exact but for 64-bit hashing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .cluster import components, cut, dealt, empty, small_side, without

#: Shingles of a block of sets that meet in one task (8 bytes each).
BLOCK_SHINGLES = 400_000
#: No class with more shingles is tried as light.
LIGHT_MOST = 16


def required(n: int, m: int, num: int, den: int) -> int:
    """The least overlap with which sets of n and m link: den * overlap >= num * union."""
    return -(-num * (n + m) // (num + den))


def partners(n: int, num: int, den: int) -> range:
    """Sizes of the sets that one of n may link with."""
    return range(-(-num * n // den), den * n // num + 1)


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets by which a set of n finds other sets; none if it only links with equals."""
    need = {required(n, m, num, den) for m in partners(n, num, den)}
    sizes = sorted(c for c in need if c <= n)
    return sizes if sizes != [n] or any(required(n, m, num, den) <= n for m in partners(n, num, den) if m != n) else []


def subset_count(n: int, num: int, den: int) -> int:
    import math

    return sum(math.comb(n, c) for c in subset_sizes(n, num, den))


def light_boundary(by_size: dict[int, int], num: int, den: int, list_cost: float = 24.0) -> int:
    """The size at which all classes' subsets below and inverted lists above cost least; list_cost is what bringing a set to its family costs in rows."""
    best, least = 0, None
    for b in range(LIGHT_MOST + 1):
        cost = sum(c * (subset_count(n, num, den) if n <= b else list_cost + 0.25 * n) for n, c in by_size.items() if n <= LIGHT_MOST)
        if least is None or cost < least:
            best, least = b, cost
    return best


def _sid(u: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = vec.mix(u).sum(dtype=np.uint64), vec.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _longer(n, num: int, den: int):
    """The number of shingles that two linked sets of at least n share among their prefixes."""
    return 1 + n // 12


def shingle_table(docs: DataFrame, k: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, h1, h2, first): the size and identity of each row's set and its first shingles in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            for _, u in vec.shingle_sets(batch.column(1), k):
                n = len(u)
                take = min(n, n - -(-num * n // den) + _longer(n, num, den)) if n > LIGHT_MOST else n
                rows.append((n, *_sid(u), take))
                parts.append(u[:take].copy())
            if not rows:
                continue
            n, h1, h2, take = zip(*rows)
            at = pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32))
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts).view(np.int64)))], ["doc_id", "n", "h1", "h2", "first"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, first array<long>")


def light_edges(classes: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """(a, b): links of classes (rep, n, first) of up to boundary shingles, enough of them to connect what is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, reps, ns = [], [], [], []
            for rep, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                codes = vec.mix(np.array(first, np.int64).view(np.uint64))
                for c in subset_sizes(n, num, den):
                    chosen = np.array(list(itertools.combinations(range(n), c)))
                    keys.append(vec.mix(codes[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(c)).view(np.int64))
                    sizes.append(np.full(len(chosen), c))
                    reps.append(np.full(len(chosen), rep))
                    ns.append(np.full(len(chosen), n))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, sizes, reps, ns)], ["key", "c", "rep", "n"])

    rows = classes.where(F.col("n").between(1, boundary)).select("rep", "n", "first").mapInArrow(run, "key long, c long, rep long, n long")
    # of one subset, the smallest class stands for all: if any two link by it, the smallest links with both, as the overlap needed grows with size
    w = Window.partitionBy("key", "c").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = rows.select("rep", "n", "c", F.first("rep").over(w).alias("b"), F.first("n").over(w).alias("m")).where("rep <> b")
    return pairs.where((num + den) * F.col("c") >= num * (F.col("n") + F.col("m"))).select(F.col("rep").alias("a"), "b").distinct()


def counted(lists: DataFrame) -> DataFrame:
    """Postings (token, rep, n) of tokens that stand in several, with their number df; of crowded tokens, which are counted in parts, it is an upper bound, and the same for all postings of one."""
    lists = dealt(lists, "token", "rep")
    df = F.coalesce("crowd", F.count("*").over(Window.partitionBy("token", "part")))
    return lists.withColumn("df", df).where("df > 1").drop("crowd", "part")


def heavy_families(classes: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(rep, n, family) of the classes of at least `least` shingles that may have a link."""
    longer = lambda n: 1 + F.floor(n / 12)  # noqa: E731  _longer as a column
    lists = classes.where(F.col("n") >= least).select("rep", "n", F.explode("first").alias("token"))
    shared = counted(lists)
    # linked sets share that many of their first shingles, so as many of these must be shared with someone
    need = longer(F.ceil(F.col("n") * num / F.lit(float(den))))
    own = Window.partitionBy("rep")
    ranked = shared.withColumn("spare", F.count("*").over(own) - need + 1).withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
    postings = cut(ranked.where("rank <= spare").select("token", "rep", "n"))
    # a second key makes the join shuffle both sides anew, so a crowded token can be split over tasks
    code = F.xxhash64("token").alias("code")
    hubs = postings.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select(code, "token", "hub")
    edges = postings.select(code, "token", "rep").join(hubs, ["code", "token"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "family").join(postings.select("rep", "n").distinct(), "rep")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_links(reps: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by scanning their inverted lists."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    count = np.bincount(token, minlength=len(tokens))
    start = np.cumsum(count) - count
    posting = owner[order]
    common = count[token] > 1
    token, owner = token[common], owner[common]
    at = np.searchsorted(owner, np.arange(len(sets) + 1))
    forest, links = _Forest(len(sets)), []
    for i in range(len(sets)):
        own = token[at[i] : at[i + 1]]
        if (den + 0.0) * len(own) < num * size[i]:
            continue
        overlap = np.bincount(posting[vec.spread(start[own], count[own])], minlength=len(sets))[:i]
        for j in np.flatnonzero((num + den) * overlap >= num * (size[i] + size[:i])).tolist():
            if forest.join(i, j):
                links.append((reps[i], reps[j]))
    return links


def heavy_edges(docs: DataFrame, classes: DataFrame, families: DataFrame, k: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    """(a, b): links within families (rep, n, family), enough of them to connect what is connected."""
    spark = docs.sparkSession
    weight = families.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("pieces"))
    code = F.xxhash64("family").alias("code")  # a second key, so that a large family can be split over tasks
    members = cut(families.select("*", code).join(weight.select("*", code), ["code", "family"]).withColumn("piece", F.pmod(F.xxhash64("rep"), "pieces")).select("rep", "family", "pieces", "piece"))
    count = members.count()
    if not count:
        return empty(spark, "a long, b long")
    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text")).join(small_side(members, count), "rep")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [u.tobytes() for _, u in vec.shingle_sets(batch.column(4), k)]
            yield pa.record_batch([*batch.columns[:4], pa.array(sets, pa.binary())], ["rep", "family", "pieces", "piece", "shingles"])

    sets = rows.select("rep", "family", "pieces", "piece", "text").mapInArrow(to_sets, "rep long, family long, pieces long, piece long, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    sets = sets.select("rep", "family", "shingles", "piece", other).select("rep", "family", F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), "shingles")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, held = None, [], []

        def close() -> pa.RecordBatch:
            links = block_links(reps, held, num, den)
            return pa.record_batch([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            rep, family, x, y = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(zip(family, x, y)):
                if key != now:
                    if len(held) > 1:
                        yield close()
                    now, reps, held = key, [], []
                reps.append(rep[i])
                held.append(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64).copy())
        if len(held) > 1:
            yield close()

    dealt = sets.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    return dealt.select("rep", "family", "x", "y", "shingles").mapInArrow(blocks, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: texts link when den * overlap >= num * union of their sets of k-word shingles."""
    rows = cut(shingle_table(docs, k, num, den, text, doc_id))
    spark = docs.sparkSession
    classes = cut(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first")))
    by_size = {r.n: r["count"] for r in classes.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}  # a row for each size at most
    boundary = light_boundary(by_size, num, den)
    families = cut(heavy_families(classes, -(-num * (boundary + 1) // den), num, den))
    edges = light_edges(classes, boundary, num, den).unionByName(heavy_edges(docs, classes, families, k, num, den, text, doc_id))
    found = components(edges)
    known = classes.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    return rows.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs but those that may reach a smaller doc_id over links, with all their columns."""
    return without(docs, near_groups(docs, k, num, den, text, doc_id).where("doc_id <> component_id").select("doc_id"), doc_id)
