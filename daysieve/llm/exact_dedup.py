"""Exact dedup by content-defined chunk recipes.

Each text, with A-Z lower-cased, is cut where a rolling hash of its last 32 bytes has its top bits clear, so equal
passages are cut alike wherever they stand. Chunks are deduplicated by 64-bit digest *and* content: a digest is a
verified identifier once all its chunks were found to have one content. A text is then its recipe, the ordered list
of identifiers, and only recipes (8 bytes for about 2 KB of text) are compared and shuffled. Contents move once, and
only one copy of each from a task. Texts with a digest that stands for several contents are compared as whole texts.

Defined results: a null text counts as empty, and all empty texts are equal; a null doc_id never stays unless its
whole group has none (keep_id is then null and kept false); repeated rows of one doc_id are one document, each row
is answered alike; rows of one doc_id with different texts are in different groups; a very long text is many chunks;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .cluster import cut, small_side

#: A cut falls after about so many bytes (a power of two), and at the latest after LONGEST.
MEAN_BYTES = 2048
LONGEST = 65536
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_CONTENT_BASE = 0xA24BAED4963EE407 | 1


def chunk_bounds(buf: np.ndarray, offs: np.ndarray, mean: int = MEAN_BYTES, longest: int = LONGEST) -> np.ndarray:
    """Ascending byte offsets, each text's ends among them, that delimit the chunks of the texts in buf."""
    h = _GEAR[buf]
    step = 1
    while step < 32:  # h[i] is the gear hash of the last 2 * step bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    cuts = np.flatnonzero(h >> np.uint32(32 - (mean.bit_length() - 1)) == 0) + 1
    doc = np.searchsorted(offs, cuts - 1, side="right") - 1
    cuts = cuts[cuts - offs[doc] >= 32]  # nearer to its start the hash holds bytes of the text before
    bounds = np.union1d(cuts, offs)
    far = np.flatnonzero(np.diff(bounds) > longest)
    if len(far):
        bounds = np.union1d(bounds, np.concatenate([np.arange(bounds[i] + longest, bounds[i + 1], longest) for i in far]))
    return bounds


def _cut(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets, chunk bounds, chunk digests)."""
    for row, buf, offs in vec.chunks(column):
        buf = vec.LOWER[buf]
        bounds = chunk_bounds(buf, offs)
        s, e = bounds[:-1], bounds[1:]
        digests = vec.mix(vec._span_hash(vec._BYTE_CODES[buf], _CONTENT_BASE, s, e) + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
        yield row, buf, offs, bounds, digests


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, _, bounds, digests in _cut(batch.column(0)):
            _, first = np.unique(digests, return_index=True)  # a second content of a digest must not be lost:
            same = np.setdiff1d(np.arange(len(digests)), first)
            raw = buf.tobytes()
            out = {(int(digests[i]), raw[bounds[i] : bounds[i + 1]]) for i in (*first, *same)}
            yield pa.record_batch([pa.array(np.array([d for d, _ in out], np.uint64).view(np.int64)), pa.array([c for _, c in out], pa.binary())], ["digest", "content"])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, offs, bounds, digests in _cut(batch.column(1)):
            raw = buf.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(bounds, offs).astype(np.int32)), pa.array(digests.view(np.int64)))
            yield pa.record_batch([batch.column(0).slice(row, len(sha)), pa.array(sha), lists], ["doc_id", "text_sha256", "recipe"])


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, recipe array<bigint>) of each row."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_recipes, "doc_id long, text_sha256 string, recipe array<bigint>")


def unverified(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest): those that stand for several contents. All others are verified identifiers."""
    seen = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contents, "digest long, content binary")
    return seen.groupBy("digest", "content").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) of each row of docs; of equal texts the largest doc_id stays."""
    rows = cut(recipes(docs, text, doc_id))
    if bad := [r.digest for r in unverified(docs, text).limit(10_001).collect()]:  # none in practice: 64-bit collisions
        if len(bad) > 10_000:
            raise ValueError("digests do not tell contents apart")
        doubtful = F.arrays_overlap("recipe", F.array(*[F.lit(x) for x in bad]))
        # sha-256 takes the place of identifiers where one of those is in doubt
        rows = rows.withColumn("recipe", F.when(doubtful, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring("text_sha256", i * 16 + 1, F.lit(16)), 16, -10).cast("long"))).otherwise(F.col("recipe")))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # a second key makes the join shuffle both sides anew, so a large group's rows can be split over tasks
    code = F.xxhash64("recipe")
    return rows.withColumn("code", code).join(groups.withColumn("code", code), ["code", "recipe"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs of each text, with all its columns: of the largest doc_id, and of a group without ids any one.

    Rows are named by doc_id and text, so another text of an id stays if it is the last of its own group.
    """
    groups = cut(exact_groups(docs, text, doc_id).select("doc_id", "kept", F.col("keep_id").isNull().alias("nameless"), F.unhex("text_sha256").alias("sha")))
    folded = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    sha = F.unhex(F.sha2(folded.cast("binary"), 256))
    gone = cut(groups.where("NOT kept AND NOT nameless").select(F.col("doc_id").alias("__gone"), F.col("sha").alias("__sha")).distinct())
    rows = docs.withColumn("__own", sha)
    rows = rows.join(small_side(gone, gone.count()), F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__sha")), "left_anti")
    # only if a row that stays was there twice are rows moved to find its like
    if not groups.where("kept OR nameless").groupBy("doc_id", "sha").count().where("count > 1").isEmpty():
        rows = rows.withColumn("__id", F.col(doc_id).cast("long")).dropDuplicates(["__id", "__own"])
    return rows.select(*docs.columns)
