"""Numpy primitives over Arrow string columns: words, word hashes and window hashes of many texts at once.

Texts of a batch are treated as one byte array with document offsets, in chunks of a bounded number of bytes
(a single longer text is a chunk of its own), so that no per-word Python code runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

#: The bytes that separate words: space and 0x09 to 0x0D.
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_BASE_BYTE = 0x9E3779B97F4A7C15 | 1
_BASE_WORD = 0xD1B54A32D192ED03 | 1
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            t = np.full(size, np.uint64(b))
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = tables[0], tables[1]
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def _span_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free polynomial hashes of values[start:end]."""
    up, down = _pow(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most limit bytes, or of one row; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        column, wide = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        last = min(last, n)
        yield row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def word_spans(buf: np.ndarray, offs: np.ndarray, is_sep: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offsets of each document's words among them."""
    sep = is_sep[buf]
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = sep[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_span_hash(_BYTE_CODES[buf], _BASE_BYTE, starts, ends) + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given the words' hashes; runs of other lengths have other hashes."""
    return mix(_span_hash(words, _BASE_WORD, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def spread(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """arange(count) for each count, one after another, plus each value."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(values - (ends - counts), counts) + np.arange(total)


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text: k words each, the whole sequence where there are fewer words, none without words."""
    for row, buf, offs in chunks(column):
        if lower:
            buf = LOWER[buf]
        starts, ends, at = word_spans(buf, offs)
        words = word_hashes(buf, starts, ends)
        n = np.diff(at)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = spread(at[:-1], count)
        hashes = run_hashes(words, first, first + np.repeat(np.minimum(n, k), count))
        bounds = np.concatenate(([0], np.cumsum(count)))
        for i in range(len(n)):
            yield row + i, np.unique(hashes[bounds[i] : bounds[i + 1]])
