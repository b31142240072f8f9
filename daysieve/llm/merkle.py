"""A Merkle manifest of a dataset: a tree of digests by source, a tree of the sources' roots above, proofs for every row.

H is the lowercase hex SHA-256 of its inputs, one after another, digests as hex text. A row's leaf is H of its columns,
each `-` if null, else its UTF-8 byte count, `:`, and the value. A source's leaves ascend by id; while there are several
nodes, every FAN consecutive ones (the last run may be shorter, even a single node) become their H. What remains is the
source's subroot; subroots in the order of their sources (null first, bytewise) become the root in the same way.

Checkpoint and recompute: only every STRIDE-th level is stored. The stored nodes under one stored ancestor are an aligned
subtree of FAN ** STRIDE nodes at most, which is what a group of rows is; the levels within are made again when proofs
are taken, the siblings on each node's way are emitted, and the levels are dropped. Proofs go from the root downwards: a
stored node's way to the root stands once beside its subtree, so a row never carries more than its own way.

Places are given by a range partitioning by (source, id, leaf), running counts of its partitions, and no window over a
source, so a source with a third of all rows, or a third of all rows alike, is many tasks. All else moves by subtree.

Defined results: null values are `-`; ids may be null (first) or stand more than once: rows of one id follow their
leaves' order, and rows that are alike have leaves and places of their own; an empty or very long text is a value as
any other; a source of one row has its leaf as subroot; siblings may be none, then a proof is H of nothing; an empty
table has no root and no proofs; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, empty, small_side

FAN = 16
#: Levels from one stored level to the next: a subtree has FAN ** STRIDE stored nodes at most.
STRIDE = 2
DIGEST = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 2048

PATH = "array<struct<at:int,siblings:string>>"
ABOVE = f"tree string, at bigint, path {PATH}, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; changed replaces columns by expressions."""
    values = [(changed or {}).get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def grown(nodes: list[str], n: int, stride: int) -> list[list[str]]:
    """The levels from the nodes of an aligned subtree up to its top, given how many nodes their whole tree has at this level."""
    levels = [nodes]
    while n > 1 and len(levels) <= stride:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return levels


def way(levels: list[list[str]], j: int) -> list[tuple[int, str]]:
    """(place in its run, siblings) of node j of the lowest level, up to the subtree's top."""
    steps = []
    for level in levels[:-1]:
        run = j // FAN * FAN
        steps.append((j - run, "".join(level[run:j] + level[j + 1 : run + FAN])))
        j //= FAN
    return steps


def fold(node: str, steps: list[tuple[int, str]]) -> str:
    """The root that a node and its siblings give."""
    for at, siblings in steps:
        node = digest(siblings[: at * DIGEST] + node + siblings[at * DIGEST :])
    return node


def proof_digest(steps: list[tuple[int, str]]) -> str:
    return digest("".join(siblings for _, siblings in steps))


@dataclass
class Manifest:
    """leaves: tree (the source), at, n, digest and what else a row carries; levels: stored nodes (tree, at, n, digest) of the source trees, the leaves first and the subroots last; tops: the same of the tree over sources, whose rows carry their source."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]
    stride: int
    root: str | None

    def subroots(self) -> DataFrame:
        """(source, subroot)."""
        return self.levels[-1].select(F.col("tree").alias("source"), F.col("digest").alias("subroot"))


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with at, the place within their tree by order, and n, how many the tree has; and the greatest n. The order of rows alike doesn't matter, but they are told apart, so that no range must hold all of them."""
    order = ["tree", *order, "__row"]
    rows = cut(rows).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()).drop("__row"))
    part = F.shiftright("__n", 33).alias("__part")
    counts = rows.groupBy(part, "tree").agg(F.min("__n").alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn("n", F.sum("here").over(Window.partitionBy("tree"))))
    known = counts.agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    counts = small_side(counts.withColumnRenamed("tree", "__tree"), known.rows)
    joined = rows.withColumn("__at", part).join(counts, (F.col("__at") == F.col("__part")) & F.col("tree").eqNullSafe(F.col("__tree")))
    return joined.withColumn("at", F.col("__n") - F.col("first") + F.col("before")).drop("__n", "__at", "__part", "__tree", "first", "here", "before"), known.most or 0


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each subtree; they come sorted by their first two columns, tree and subtree."""
    rows, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                if rows:
                    yield rows
                rows, now = [], row[:2]
            rows.append(row)
    if rows:
        yield rows


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows, each subtree in one partition and in order; sub is the stored ancestor's place."""
    return rows.withColumn("sub", F.expr(f"at div {size}")).repartition("tree", "sub")


def _raise(nodes: DataFrame, stride: int) -> DataFrame:
    """The next stored level."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops():
            for rows in _subtrees(batches):
                tree, sub, _, n, _ = rows[0]
                levels = grown([r[4] for r in rows], n, stride)
                for _ in levels[1:]:
                    n = -(-n // FAN)
                yield tree, sub, n, levels[-1][0]

        yield from _batches(tops(), schema)

    rows = _dealt(nodes.select("tree", "at", "n", "digest"), FAN**stride).select("tree", "sub", "at", "n", "digest").sortWithinPartitions("tree", "sub", "at")
    return rows.mapInArrow(run, "tree string, at bigint, n bigint, digest string")


def _stored(nodes: DataFrame, most: int, stride: int) -> list[DataFrame]:
    """All stored levels over nodes, the top included; each is written, so none is made twice."""
    levels = [nodes]
    while most > 1:
        levels.append(cut(_raise(levels[-1], stride)))
        most = -(-most // FAN**stride)
    return levels


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", source: str = "source", changed: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of docs. With changed, a row also carries now: the leaf of what it holds after these changes, or null where that is what it was."""
    own = leaf(columns)
    now = F.nullif(leaf(columns, changed), own) if changed else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("tree"), own.alias("digest"), now.alias("now"))
    leaves, most = _placed(rows, ["doc_id", "digest"])
    leaves = cut(leaves)
    levels = _stored(leaves, most, stride)
    tops, many = _placed(levels[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    tops = _stored(cut(tops), many, stride)
    root = tops[-1].first() if most else None
    return Manifest(leaves, levels, tops, stride, root and root.digest)


_STEP = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))


def _lowered(nodes: DataFrame, above: DataFrame, stride: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of nodes, sorted by subtree, after the row of above that belongs to it: tree, sub, at (-1: of above), n, digest, *carry, path, subroot, root."""
    nodes = _dealt(nodes.select("tree", "at", "n", "digest", *carry), FAN**stride)
    above = above.select("tree", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carry), F.col("at").alias("sub"), "path", "subroot", "root")
    both = nodes.unionByName(above, allowMissingColumns=True).repartition("tree", "sub").sortWithinPartitions("tree", "sub", "at")
    return both.select("tree", "sub", "at", "n", "digest", *carry, "path", "subroot", "root")


def _ways(batches: Iterator[pa.RecordBatch], stride: int) -> Iterator[tuple[tuple, list[tuple[int, str]], str, str]]:
    """(row, way to the root, subroot, root) of each node."""
    for rows in _subtrees(batches):
        *_, path, subroot, root = rows[0]
        rest = [(s["at"], s["siblings"]) for s in path]
        levels = grown([r[4] for r in rows[1:]], rows[1][3], stride)
        for j, row in enumerate(rows[1:]):
            yield row, way(levels, j) + rest, subroot, root


def _down(nodes: DataFrame, above: DataFrame, stride: int) -> DataFrame:
    """The ways of a stored level, given those of the next."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", _STEP), ("subroot", pa.string()), ("root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = lambda path: [{"at": at, "siblings": s} for at, s in path]
        yield from _batches(((row[0], row[2], steps(path), subroot, root) for row, path, subroot, root in _ways(batches, stride)), schema)

    return _lowered(nodes, above, stride).mapInArrow(run, ABOVE)


def _over_leaves(m: Manifest) -> DataFrame:
    """The ways of the stored level next to the leaves (of the subroots, where there is none between)."""
    spark, root = m.leaves.sparkSession, m.root
    above = m.tops[-1].select("tree", "at", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(root).alias("root"))
    for level in reversed(m.tops[:-1]):
        above = cut(_down(level, above, m.stride))
    own = m.tops[0].select("at", F.col("source"), F.col("digest").alias("__subroot"))
    above = own.join(above.select("at", "path", "root"), "at").select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("at"), "path", F.col("__subroot").alias("subroot"), "root")
    for level in reversed(m.levels[1:-1]):
        above = cut(_down(level, above, m.stride))
    return above if root else empty(spark, ABOVE)


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path): path has a step for each level, with the row's place in its run and its siblings' digests, left to right."""
    stride, doc_id = m.stride, m.leaves.schema["doc_id"].dataType
    if not m.root:
        return empty(m.leaves.sparkSession, f"doc_id {doc_id.simpleString()}, source string, leaf string, subroot string, root string, path {PATH}")
    rows = _lowered(m.leaves, _over_leaves(m), stride, ("doc_id",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), *((x, pa.string()) for x in ("source", "leaf", "subroot", "root")), ("path", _STEP)])
        steps = lambda path: [{"at": at, "siblings": s} for at, s in path]
        yield from _batches(((row[5], row[0], row[4], subroot, root, steps(path)) for row, path, subroot, root in _ways(_chain(first, batches), stride)), schema)

    return rows.mapInArrow(run, f"doc_id {doc_id.simpleString()}, source string, leaf string, subroot string, root string, path {PATH}")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def audit(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): what each row holds now (its leaf, or now where it was changed), folded with the siblings of its proof, against the root. Siblings are hashed as they are taken, not moved."""
    stride, doc_id = m.stride, m.leaves.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {doc_id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not m.root:
        return empty(m.leaves.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), *((x, pa.string()) for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

        def found():
            for (_, _, _, _, own, doc_id, now, *_), path, subroot, root in _ways(_chain(first, batches), stride):
                folded = fold(own if now is None else now, path)
                yield doc_id, own, subroot, root, proof_digest(path), folded, folded == root

        yield from _batches(found(), schema)

    return _lowered(m.leaves, _over_leaves(m), stride, ("doc_id", "now")).mapInArrow(run, out)
