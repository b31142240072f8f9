"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear score of features of its text. The preferences are all pairs of a learnable document of
label 1 over one of label 0; the weights minimise the mean logistic loss on the differences of the pairs' features,
which is the Bradley-Terry likelihood of the preferences. A pair's loss depends only on the difference of two scores, so
the sums over all pairs follow from how many documents of each label have which score, and a pass over the documents
serves all their pairs: one counts scores on a grid, one sums gradient and curvature by the counts, and Newton steps
need few of either. The threshold is the quantile of all their scores at the share of label 0; scores are mapped so
that it lies at 0.3.

Features come from the whole text by array operations: shares of kinds of bytes, shapes of words, repetition. Those of
all learnable documents are kept in the shared folder while weights and threshold are sought.

Defined results: null and empty texts have the features of no words and get a score like any other; repeated rows are
scored alike, and each is learned from; labels of null or unknown documents are ignored; without labels of both kinds
all scores are 0.5; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .cluster import cut

#: A text is kept from this score on.
THRESHOLD = 0.3
#: Standardised features are multiples of 1 / FINE and weights of 1 / FINER, so scores are exact whatever the order of their sums.
FINE, FINER = 1 << 12, 1 << 20
#: Scores are counted on a grid of 1 / GRID, a score's count shared by its two neighbours in parts of 1 / PARTS; between them all functions of a score are linear.
GRID, PARTS = 64, 256
#: Groups of scores, of each label, whose mean features stand for theirs in the mixed terms of the curvature.
GROUPS = 32
#: Steps end where the next would lower the mean loss by less.
ENOUGH = 1e-7
#: A task of a pass takes in about so many rows of features.
TASK_ROWS = 32_768

_UPPER, _LOWER, _DIGIT, _HIGH, _PUNCT = 0, 1, 2, 3, 4
_KIND = np.full(256, 5, np.int64)  # 5: separators and controls
_KIND[33:127] = _PUNCT
_KIND[48:58] = _DIGIT
_KIND[65:91] = _UPPER
_KIND[97:123] = _LOWER
_KIND[128:] = _HIGH
_MARKS = b"!?.,;:'\"|*#%&$@/\\<>{}[]()=+-_~^`"


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, a row of features for each text)."""
    for row, buf, offs in vec.chunks(column):
        docs = len(offs) - 1
        starts, ends, at = vec.word_spans(buf, offs)
        n_words = np.diff(at)
        n_bytes = np.diff(offs)
        of_byte = np.repeat(np.arange(docs), n_bytes)
        by_value = np.bincount(of_byte * 256 + buf, minlength=docs * 256).reshape(docs, 256)
        kinds = np.stack([by_value[:, _KIND == k].sum(axis=1) for k in range(6)], axis=1)
        marks = by_value[:, list(_MARKS)]
        words = np.maximum(n_words, 1)
        solid = np.maximum(n_bytes - kinds[:, 5], 1)
        doc = np.repeat(np.arange(docs), n_words)
        length = ends - starts
        per_doc = lambda flag: np.bincount(doc, weights=flag, minlength=docs)
        if len(starts):
            hashes = vec.word_hashes(vec.LOWER[buf], starts, ends)
            first, last = _KIND[buf[starts]], _KIND[buf[ends - 1]]
            caps = np.concatenate(([0], np.cumsum(_KIND[buf] == _UPPER)))
            shouted = (caps[ends] - caps[starts]) * 2 > length
            same = np.zeros(len(starts))
            same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
            tail = _KIND[buf[np.maximum(ends - 2, starts)]] == _PUNCT  # two marks at its end
            bare = (first == _PUNCT) & (last == _PUNCT) & (length <= 2)
            order = np.lexsort((hashes, doc))
            h, d = hashes[order], doc[order]
            distinct = np.bincount(d, weights=np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))), minlength=docs)
            shape = [per_doc(x) / words for x in (shouted, same, tail & (last == _PUNCT), bare, first == _UPPER, last == _PUNCT, length, np.minimum(length, 30) ** 2 / 30)] + [distinct / words]
        else:
            shape = [np.zeros(docs)] * 9
        lines = by_value[:, 10]
        columns = [np.log1p(n_words), np.log1p(n_words) ** 2 / 10, lines / words, n_words == 0, *shape]
        x = np.column_stack([*columns, *(kinds[:, :5] / solid[:, None]).T, *np.sqrt(marks / solid[:, None]).T, *((marks / words[:, None]) > 0.3).T])
        yield row, x.astype(np.float64)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.rint(np.clip((x.astype(np.float32) - mean) / scale, -8, 8) * FINE) / FINE


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, THRESHOLD at the cut."""
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: What a pass makes of some rows' features and labels: keys, and a value for each.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: The distinct keys, ascending, and the sum of each one's values, of a part over all rows.
Pass = Callable[[Part], tuple[np.ndarray, np.ndarray]]


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=values, minlength=len(distinct))


def _total(over: Pass, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part, an array of one length for any rows."""

    def keyed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = part(x, y)
        return np.arange(len(values)), values

    return over(keyed)[1]


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, so that sums in another order end alike."""
    return np.array([float(f"{v:.8e}") for v in x])


def _convolved(p: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """sum over j of p[j] * f(i - j) for each i, where kernel holds f from 1 - len(p) to len(p) - 1."""
    n = 1 << (3 * len(p)).bit_length()
    return np.fft.irfft(np.fft.rfft(p, n) * np.fft.rfft(kernel, n), n)[len(p) - 1 : 2 * len(p) - 1]


class _Scores:
    """How the scores of each label lie on the grid, and what follows for all pairs."""

    def __init__(self, over: Pass, ranker: Ranker):
        def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.rint(ranker.raw(x) * (GRID * PARTS)).astype(np.int64)
            place, rest = at // PARTS, at % PARTS
            return _added(np.concatenate((2 * place + y, 2 * place + 2 + y)), np.concatenate((PARTS - rest, rest)))

        keys, counts = over(part)
        self.first = int(keys[0] // 2)
        size = int(keys[-1] // 2) - self.first + 1
        self.share = np.zeros((2, size))  # of each label
        self.share[keys % 2, keys // 2 - self.first] = counts
        self.share /= self.share.sum(axis=1, keepdims=True)
        bad, good = self.share
        lead = np.arange(1 - size, size) / GRID
        below = 1 / (1 + np.exp(np.clip(lead, -40, 40)))  # the share of the loss's slope that a lead leaves
        self.loss = float(good @ _convolved(bad, np.logaddexp(0, -lead)))
        self.slope = np.stack([_convolved(good, below[::-1]), -_convolved(bad, below)])
        self._bend = below * (1 - below)
        self.bend = np.maximum(np.stack([_convolved(good, self._bend), _convolved(bad, self._bend)]), 0)
        mass = np.cumsum((self.share * self.bend).sum(axis=0))
        self.group = np.minimum((mass * (GROUPS / max(mass[-1], 1e-300))).astype(np.int64), GROUPS - 1)

    def mixed(self) -> np.ndarray:
        """The bend of all pairs of a group of label 1 and one of label 0, as shares of all pairs."""
        bad, good = self.share
        out = np.zeros((GROUPS, GROUPS))
        for j in np.unique(self.group):
            out[:, j] = np.bincount(self.group, weights=good * _convolved(np.where(self.group == j, bad, 0), self._bend), minlength=GROUPS)
        return out


def _slope_and_curvature(over: Pass, ranker: Ranker, at: _Scores, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean loss over all pairs, by the weights; rows: how many there are of each label."""
    width = len(ranker.weights)
    upper = np.triu_indices(width)
    first, last, slopes, bends, group = at.first, len(at.group) - 1, at.slope, at.bend, at.group

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _standard(x, ranker.mean, ranker.scale)
        place = (z @ ranker.weights) * GRID - first
        low = np.clip(np.floor(place).astype(np.int64), 0, last)
        high, rest = np.minimum(low + 1, last), np.clip(place - low, 0, 1)
        slope, bend = (((1 - rest) * f[y, low] + rest * f[y, high]) / rows[y] for f in (slopes, bends))
        own = np.zeros((2 * GROUPS, len(z)))
        own[2 * group[low] + y, np.arange(len(z))] = bend
        return np.concatenate((slope @ z, (z.T @ (z * bend[:, None]))[upper], own.sum(axis=1), (own @ z).ravel()))

    gradient, square, mass, sums = np.split(_total(over, part), np.cumsum([width, len(upper[0]), 2 * GROUPS]))
    curvature = np.zeros((width, width))
    curvature[upper] = square
    curvature += np.triu(curvature, 1).T
    means = sums.reshape(GROUPS, 2, width) / np.maximum(mass, 1e-300).reshape(GROUPS, 2, 1)
    mixed = means[:, 1].T @ at.mixed() @ means[:, 0]
    return gradient, curvature - mixed - mixed.T


def _ranked(over: Pass, value: Callable[[np.ndarray], np.ndarray], places: list[float], worth: np.ndarray) -> list[int]:
    """The least whole values, of 48 bits with sign, up to which rows weigh as much as each of places; worth: of a row of each label. Exact: three passes tell 16 bits each."""
    found = [(None, 0.0)] * len(places)  # higher bits, and what rows of lesser ones weigh
    for shift in (32, 16, 0):
        known = None if shift == 32 else np.array(sorted({p for p, _ in found}))

        def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v = value(x)
            ok = slice(None) if known is None else np.isin(v >> (shift + 16), known)
            return _added(2 * (v[ok] >> shift) + y[ok], np.ones(len(v[ok])))

        keys, counts = over(part)
        bits, weights = _added(keys // 2, counts * worth[keys % 2])
        for k, place in enumerate(places):
            higher, before = found[k]
            own = slice(None) if higher is None else bits >> 16 == higher
            running = before + np.cumsum(weights[own])
            i = min(int(np.searchsorted(running, place)), len(running) - 1)
            found[k] = int(bits[own][i]), float(running[i - 1]) if i else before
    return [v for v, _ in found]


def _learned(over: Pass, labelled: tuple[int, int] | None, l2: float, steps: int) -> Ranker | None:
    """A ranker of the rows that over passes over."""
    sums = _total(over, lambda x, y: np.concatenate((np.bincount(y, minlength=2), x.sum(axis=0))))
    if not len(sums) or not sums[:2].all():
        return None
    rows, n = sums[:2], sums[:2].sum()
    mean = _rounded(sums[2:] / n)
    scale = _rounded(np.sqrt(_total(over, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n))
    scale[scale < 1e-6 * np.maximum(np.abs(mean), 1e-3)] = 1  # all alike, but for what float32 and nine digits leave
    penalty = lambda w: l2 / 2 * float(w @ w)
    best = Ranker(mean, scale, np.zeros(len(mean)), 0.0, 1.0)
    at = _Scores(over, best)
    for _ in range(steps):
        gradient, curvature = _slope_and_curvature(over, best, at, rows)
        gradient = gradient + l2 * best.weights
        step = -np.linalg.solve(curvature + l2 * np.eye(len(mean)), gradient)
        if -(gradient @ step) / 2 < ENOUGH:
            break
        for halved in range(12):
            tried = Ranker(mean, scale, np.rint((best.weights + step / 2**halved) * FINER) / FINER, 0.0, 1.0)
            there = _Scores(over, tried)
            if there.loss + penalty(tried.weights) < at.loss + penalty(best.weights):
                break
        else:
            break
        best, at = tried, there
    unit = FINE * FINER
    whole = lambda x: (best.raw(x) * unit).astype(np.int64)
    n_bad, n_good = labelled or rows
    low, high = _ranked(over, whole, [n_bad * (1 - 1e-12), n_bad * (1 + 1e-12)], np.array([n_bad, n_good]) / rows)
    middle = (low + high) // 2
    spread = _ranked(over, lambda x: np.abs(whole(x) - middle), [n / 2], np.ones(2))[0] / unit
    return Ranker(mean, scale, best.weights, middle / unit, float(3.0 / max(spread, 1e-9)))


def bradley_terry(x: np.ndarray, y: np.ndarray, labelled: tuple[int, int] | None = None, l2: float = 1e-3, steps: int = 50) -> Ranker | None:
    """Weights from all pairs of a row of label 1 over one of label 0, in Newton steps; None without both. labelled: how many rows of labels 0 and 1 there are, where x and y are some of them."""
    x, y = np.asarray(x, np.float32).astype(np.float64), np.asarray(y, np.int64)
    return _learned(lambda part: _added(*part(x, y)), labelled, l2, steps)


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _passes(rows: DataFrame) -> Pass:
    """Passes over rows (label, x: its features as bytes of float32): each task adds up its own, Spark theirs by key."""

    def over(part: Part) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                if len(batch):
                    y = batch.column(0).to_numpy().astype(np.int64)
                    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(len(y), -1).astype(np.float64)
                    more, amounts = part(x, y)
                    keys, values = _added(np.concatenate((keys, more)), np.concatenate((values, amounts)))
            yield pa.record_batch([pa.array(keys), pa.array(values)], ["key", "value"])

        sums = rows.mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow().sort_by("key")
        return sums["key"].to_numpy(), sums["value"].to_numpy()

    return over


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", l2: float = 1e-3, steps: int = 50) -> Ranker | None:
    """A ranker, from all labelled rows that are not held out."""
    chosen = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~is_held_out("id"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(~is_held_out("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in _features(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(row, len(x)), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], ["id", "x"])

    # features are shuffled, not texts, and no number of labels is broadcast
    found = cut(rows.mapInArrow(run, "id long, x binary").join(chosen.distinct().hint("merge"), "id").select("label", "x"))
    return _learned(_passes(found.coalesce(max(1, -(-found.count() // TASK_ROWS)))), None, l2, steps)


def scores(docs: DataFrame, ranker: Ranker | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with score and predicted (1 if score >= THRESHOLD) of each row's text."""
    rows = docs.select(*keep, *[F.col(text).cast("string").alias("__text")] * (text not in keep))
    place = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in _features(batch.column(place)):
                s = ranker.score(x) if ranker else np.full(len(x), 0.5)
                yield pa.record_batch([*(c.slice(row, len(s)) for c in batch.columns[: len(keep)]), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "score double, predicted int"]))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are predicted to have label 1, with all their columns."""
    clash = {c: f"__{c}" for c in ("score", "predicted") if c in docs.columns}
    rows = scores(docs.withColumnsRenamed(clash), fit(docs, labels, text, doc_id), text, tuple(clash.get(c, c) for c in docs.columns))
    return rows.where("predicted = 1").drop("score", "predicted").withColumnsRenamed({v: k for k, v in clash.items()})
