"""Language identification by the nearest of several centroids for each language.

A text is the vector of its hashed letter n-grams (one to three bytes within words, A-Z folded), damped counts times
inverse document frequency over all rows that may be learned from, normalised. Each language's sample is clustered by spherical k-means into a few centroids;
the language of the centroid with the highest cosine is predicted. The score is that cosine's lead over the best
centroid of another language, as a share from 0 to 1. A text further from its centroid than nearly all of that
language's sample is marked as rejected; its nearest language is still named.

Defined results: a text that is null or has no letter is `und` with score 0; repeated rows are answered alike, and are
learned from once; without any learned language all are `und`; ties go to the language that sorts first; a very long text
is counted whole; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, vec
from .cluster import least_of_each

DIMENSIONS = 2048
#: At most so many rows of each language are learned from, those of the least hashes, and so many in all; one of each language at least.
SAMPLE_ROWS = 1500
SAMPLE_IN_ALL = 20_000
CENTROIDS = 4
#: The share of a language's sample that lies within its rejection distance.
WITHIN = 0.995


def _counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram counts of each text, whether it has a letter)."""
    for row, buf, offs in vec.chunks(column):
        docs = len(offs) - 1
        if not len(buf):
            yield row, np.zeros((docs, DIMENSIONS), np.float32), np.zeros(docs, bool)
            continue
        cps, at = bpe.code_points(buf)
        letter = bpe._classes()[cps] == bpe.LETTER
        doc_of_char = np.searchsorted(offs, at, side="right") - 1
        has = np.bincount(doc_of_char[letter], minlength=docs) > 0
        # letters as folded code points, everything else as one boundary sign
        folded = np.where((cps >= 65) & (cps <= 90), cps + 32, cps).astype(np.uint64)
        sign = np.where(letter, folded, np.uint64(0))
        n = len(sign)
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = doc_of_char[1:] != doc_of_char[:-1]
        out = np.zeros((docs, DIMENSIONS), np.float32)
        flat = np.zeros(docs * DIMENSIONS)
        prev1 = np.concatenate((np.zeros(1, np.uint64), sign[:-1]))
        prev1[new] = 0
        prev2 = np.concatenate((np.zeros(1, np.uint64), prev1[:-1]))
        prev2[new] = 0
        for code, ok in ((sign, letter), (prev1 << np.uint64(21) | sign | np.uint64(1 << 60), letter | (prev1 > 0)), (prev2 << np.uint64(42) | prev1 << np.uint64(21) | sign, prev1 > 0)):
            slot = (vec.mix(code[ok]) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
            flat += np.bincount(doc_of_char[ok] * DIMENSIONS + slot, minlength=len(flat))
        out[:] = flat.reshape(docs, DIMENSIONS)
        yield row, out, has


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    centroids: np.ndarray  # a row for each
    language: np.ndarray  # of each centroid, as a position in names
    names: list[str]
    radius: np.ndarray  # the least cosine of each language that is not rejected

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row of counts."""
        x = _normal(np.log1p(counts) * self.idf)  # logarithms of float32 counts
        cosine = x @ self.centroids.T
        best = np.full((len(x), len(self.names)), -1.0, np.float32)
        for j, k in enumerate(self.language):
            best[:, k] = np.maximum(best[:, k], cosine[:, j])
        first = best.argmax(axis=1)
        top = best[np.arange(len(x)), first]
        best[np.arange(len(x)), first] = 0
        second = np.maximum(best.max(axis=1), 0) if best.shape[1] > 1 else np.zeros(len(x))
        return first, np.clip(1 - second / np.maximum(top, 1e-9), 0, 1), top < self.radius[first]


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of normalised rows."""
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(15):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(k)])
        centroids = _normal(sums)
    return centroids


def train(damped: np.ndarray, languages: list[str], idf: np.ndarray, seed: int = 5) -> Centroids | None:
    """Centroids of the rows of damped, which are log(1 + count) of each n-gram."""
    if not languages:
        return None
    names = sorted(set(languages))
    label = np.searchsorted(names, languages)
    x = _normal(damped * idf)
    rng = np.random.default_rng(seed)
    centroids, owner, radius = [], [], []
    for k in range(len(names)):
        own = x[label == k]
        c = _cluster(own, CENTROIDS, rng)
        centroids.append(c)
        owner += [k] * len(c)
        radius.append(np.quantile((own @ c.T).max(axis=1), 1 - WITHIN))
    return Centroids(idf, np.concatenate(centroids).astype(np.float32), np.array(owner), names, np.array(radius))


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The IDF of each slot over all rows of docs that have a letter; DIMENSIONS sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, x, has in _counts(batch.column(0)):
                df += (x[has] > 0).sum(axis=0)
                n += int(has.sum())
        yield pa.record_batch([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([n], df)))], ["slot", "df"])

    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    got = {r.slot: r.df for r in sums}
    df = np.array([got.get(i, 0) for i in range(DIMENSIONS)])
    return (np.log((1 + got.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, in_all: int = SAMPLE_IN_ALL) -> Centroids | None:
    """Centroids from rows with a language that are not held out (crc32 of the id as text mod 5 is 0): those of the least hashes of each language, at most sample_rows of each and in_all together."""
    from .quality import is_held_out

    learnable = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL").where(~is_held_out("id"))
    known = learnable.select("id", "lang").distinct().withColumn("code", F.xxhash64("id"))
    languages = known.select(F.count_distinct("lang")).first()[0]
    if not languages:
        return None
    chosen = least_of_each(known, "lang", ["code", "id"], max(1, min(sample_rows, in_all // languages))).select("id", "lang")
    rows = learnable.join(F.broadcast(chosen), ["id", "lang"])  # in_all rows at most, or one of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, has in _counts(batch.column(2)):
                slots = [np.flatnonzero(r).astype("<u2") for r in x]
                packed = [i.tobytes() if ok else None for i, ok in zip(slots, has)]
                damped = [np.log1p(r[i]).astype("<f4").tobytes() for r, i in zip(x, slots)]
                yield pa.record_batch([batch.column(0).slice(row, len(x)), batch.column(1).slice(row, len(x)), pa.array(packed, pa.binary()), pa.array(damped, pa.binary())], ["id", "lang", "slots", "damped"])

    sparse = rows.select("id", "lang", "text").mapInArrow(run, "id long, lang string, slots binary, damped binary").where("slots IS NOT NULL").collect()
    got = sorted({(r.id, r.lang, bytes(r.slots), bytes(r.damped)) for r in sparse})
    if not got:
        return None
    damped = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, (_, _, slots, values) in enumerate(got):
        damped[i, np.frombuffer(slots, "<u2")] = np.frombuffer(values, "<f4")
    return train(damped, [x[1] for x in got], inverse_frequencies(learnable, "text"))


def identify(docs: DataFrame, model: Centroids | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with lang_pred, score and rejected of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, has in _counts(batch.column(0)):
                if model:
                    first, score, far = model.predict(x)
                    names = [model.names[k] if ok else "und" for k, ok in zip(first, has)]
                    score, far = np.where(has, score, 0.0).astype(np.float64), far | ~has
                else:
                    names, score, far = ["und"] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
                yield pa.record_batch([*(c.slice(row, len(x)) for c in batch.columns[1:]), pa.array(names, pa.string()), pa.array(score), pa.array(far)], [*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "lang_pred string, score double, rejected boolean"]))
