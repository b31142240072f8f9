"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding from retained offsets.

Pre-tokenisation is that of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`
without a regex engine. Code points become classes (letter, number, space, other) by a table, equal classes become
runs, and each run becomes a function on four states: how much of the run the piece before it has taken (nothing;
it gave its space; one letter; two letters). Such a function fits into one byte, their composition is a table of
256 x 256 bytes and associative, so a blocked scan gives the state before every run at once, and from it the pieces.

Defined results: a null text counts as empty, no ids; a null doc_id stays null; repeated rows are encoded alike; a very
long text is a chunk of its own and a single long piece is merged with a heap; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pieces that a worker keeps the ids of; beyond, it starts anew.
CACHE_PIECES = 500_000
#: Longer pieces are merged one by one with a heap.
SHORT_BYTES = 48

# States before a run, and functions on them as bytes: bits 2s and 2s + 1 hold the image of state s.
FRESH, GIVEN, ONE, TWO = 0, 1, 2, 3


def _function(*images: int) -> int:
    return sum(x << 2 * s for s, x in enumerate(images))


TO_FRESH = _function(FRESH, FRESH, FRESH, FRESH)
TO_GIVEN = _function(GIVEN, GIVEN, GIVEN, GIVEN)
APOSTROPHE_ONE = _function(ONE, FRESH, ONE, ONE)  # after a space that it takes, an apostrophe starts no contraction
APOSTROPHE_TWO = _function(TWO, FRESH, TWO, TWO)


@cache
def _compose() -> np.ndarray:
    """table[f * 256 + g] is g after f."""
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        out |= (g >> 2 * ((f >> 2 * s) & 3) & 3) << 2 * s
    return out.astype(np.uint8).ravel()


def scan(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """Exclusive scan under composition: what all functions before each one make of the identity."""
    table = _compose()
    identity = np.uint8(_function(0, 1, 2, 3))
    n = len(functions)
    if n <= block:
        out, acc = np.empty(n, np.uint8), int(identity)
        for i, f in enumerate(functions.tolist()):
            out[i] = acc
            acc = int(table[acc << 8 | f])
        return out
    rows = -(-n // block)
    padded = np.full(rows * block, identity, np.uint8)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, block).T).astype(np.int32)
    inner = np.empty((block, rows), np.uint8)
    acc = np.full(rows, identity, np.uint8)
    for j in range(block):
        inner[j] = acc
        acc = table[acc.astype(np.int32) << 8 | columns[j]]
    before = scan(acc, block).astype(np.int32) << 8
    return table[before[None, :] | inner].T.ravel()[:n]


@cache
def _classes() -> np.ndarray:
    """A class for each code point. The members are asked of the tokenizer library once, with a vocabulary of bytes, so that both agree on the version of Unicode."""
    import tiktoken

    every = [cp for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000]
    text, single = "".join(map(chr, every)), {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        members = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        out[[ord(c) for c in bytes(members).decode()]] = kind
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each starts."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    cps = lead.copy()
    padded = np.concatenate((buf, np.zeros(3, np.uint8)))
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            x = lead[which] & mask
            for j in range(1, more + 1):
                x = x << 6 | (padded[at[which] + j] & 0x3F).astype(np.int32)
            cps[which] = x
    return cps, at


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ascending byte offsets at which the pieces of all texts in buf start."""
    if not len(buf):
        return np.zeros(0, np.int64)
    cps, at = code_points(buf)
    n = len(cps)
    kind = _classes()[cps]
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(at, offs)] = True
    text_start[n] = True
    new = text_start[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    length = ends - runs
    kinds = kind[runs]
    last_of_text = text_start[ends]

    functions = np.full(len(runs), TO_FRESH, np.uint8)
    is_space = kinds == SPACE
    gives = is_space & ~last_of_text & (cps[ends - 1] == 0x20)
    functions[gives] = TO_GIVEN
    quote = np.flatnonzero((kinds == OTHER) & (length == 1) & (cps[runs] == 0x27) & ~last_of_text)
    if len(quote):
        room = length[quote + 1]
        c1 = cps[runs[quote + 1]]
        c2 = np.where(room > 1, cps[np.minimum(runs[quote + 1] + 1, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        functions[quote[one]] = APOSTROPHE_ONE
        functions[quote[two]] = APOSTROPHE_TWO
    state = scan(functions) & 3  # the image of FRESH, in which the first run of all is

    starts = np.zeros(n + 1, bool)
    solid = ~is_space
    starts[runs[solid & (state == FRESH)]] = True
    starts[runs[solid & (state == GIVEN)] - 1] = True
    for s, taken in ((ONE, 1), (TWO, 2)):
        cut = solid & (state == s) & (length > taken)
        starts[runs[cut] + taken] = True
    starts[runs[is_space & ~(gives & (length == 1))]] = True
    alone = is_space & ~last_of_text & ~gives & (length > 1)
    starts[ends[alone] - 1] = True
    return at[np.flatnonzero(starts[:n])]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the adjacent pair of lowest rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list, for pieces on which the search for the least pair would be quadratic."""
    import heapq

    n = len(parts)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and (y := after[x]) >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, live in zip(parts, alive) if live]


class Table:
    """A hash table from 64-bit keys to positions, open addressing, looked up and filled by whole arrays."""

    def __init__(self, entries: int):
        self.mask = np.uint64((1 << (2 * entries).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)
        self.count = 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            out[open_] = self.values[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in it yet."""
        self.count += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[won]
            self.values[slot[won]] = values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


class Codec:
    """Encodes and decodes; keeps the ids of the pieces that it has seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = Table(len(pairs))
        self.pairs.put(vec.mix(np.array([*pairs], np.uint64)), np.array([*pairs.values()], np.int32))
        whole = [(vec.word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0], r) for t, r in ranks.items()]
        self.whole = Table(len(whole))
        self.whole.put(np.array([h for h, _ in whole], np.uint64), np.array([r for _, r in whole], np.int32))
        self._forget()

    def _forget(self) -> None:
        self.seen = Table(CACHE_PIECES + (1 << 18))
        self.ids = np.zeros(1 << 22, np.int32)
        self.id_start = np.zeros(CACHE_PIECES + (1 << 18) + 1, np.int64)
        self.used = 0  # pieces; id_start[used] is where the next one's ids go

    def _merge_many(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short pieces, one after another, and how many each has: in each round every piece merges its pair of lowest rank."""
        size = ends - starts
        ids = self.single[buf[vec.spread(starts, size)]]
        owner = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int32(2**31 - 1)
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            same = np.flatnonzero(owner[:-1] == owner[1:])
            found = self.pairs.get(vec.mix(ids[same].astype(np.uint64) << np.uint64(32) | ids[same + 1].astype(np.uint64)))
            rank[same] = np.where(found < 0, none, found)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(ids)))
            low_each = np.repeat(low, counts)
            ended = low_each == none
            if ended.any():
                done.append((owner[ended], ids[ended]))
            hit = np.flatnonzero((rank == low_each) & ~ended)
            hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))] if len(hit) else hit  # the leftmost
            ids[hit] = rank[hit]
            keep = ~ended
            keep[hit + 1] = False
            ids, owner = ids[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(size))

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Adds pieces of which none is known, each once."""
        rank = self.whole.get(hashes)
        size = ends - starts
        counts, parts = np.ones(len(starts), np.int64), []
        short = np.flatnonzero((rank < 0) & (size <= SHORT_BYTES))
        merged, n = self._merge_many(buf, starts[short], ends[short])
        counts[short] = n
        long = [(i, merge(buf[starts[i] : ends[i]].tobytes(), self.ranks)) for i in np.flatnonzero((rank < 0) & (size > SHORT_BYTES))]
        for i, x in long:
            counts[i] = len(x)
        total = int(counts.sum())
        at = np.cumsum(counts) - counts
        parts = np.zeros(total, np.int32)
        known = np.flatnonzero(rank >= 0)
        parts[at[known]] = rank[known]
        parts[vec.spread(at[short], n)] = merged
        for i, x in long:
            parts[at[i] : at[i] + len(x)] = x
        place = int(self.id_start[self.used])
        if place + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(total, len(self.ids)), np.int32)))
        self.ids[place : place + total] = parts
        self.id_start[self.used + 1 : self.used + 1 + len(starts)] = place + np.cumsum(counts)
        self.seen.put(hashes, np.arange(self.used, self.used + len(starts), dtype=np.int32))
        self.used += len(starts)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in buf, where each text's ids start among them, the bytes that the ids stand for, and the byte at which each id's start."""
        starts = piece_starts(buf, offs)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        hashes = vec.word_hashes(buf, starts, ends)
        if self.used > CACHE_PIECES:
            self._forget()
        entry = self.seen.get(hashes)
        fresh = np.flatnonzero(entry < 0)
        while len(fresh):
            _, first = np.unique(hashes[fresh], return_index=True)
            new = fresh[first]
            room = len(self.id_start) - 1 - self.used
            if len(new) > room:  # only a text of many megabytes gets here
                return self._finish(buf, offs, starts, *self._one_by_one(buf, starts, ends))
            self._learn(buf, starts[new], ends[new], hashes[new])
            entry[fresh] = self.seen.get(hashes[fresh])
            fresh = fresh[entry[fresh] < 0]
        counts = self.id_start[entry + 1] - self.id_start[entry]
        ids = self.ids[vec.spread(self.id_start[entry], counts)]
        out = self._finish(buf, offs, starts, ids, counts)
        if not np.array_equal(out[2], buf):  # two pieces of one hash
            out = self._finish(buf, offs, starts, *self._one_by_one(buf, starts, ends))
        return out

    def _one_by_one(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [merge(buf[a:b].tobytes(), self.ranks) for a, b in zip(starts, ends)]
        return np.array([x for ids in lists for x in ids], np.int32), np.array([len(x) for x in lists], np.int64)

    def _finish(self, buf, offs, starts, ids, counts):
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(starts, offs)], *self.decode(ids)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the offset at which each id's bytes start."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        length = self.length[ids]
        return self.bytes[vec.spread(self.start[ids], length)], np.cumsum(length) - length


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, read once in a process."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with ids array<int> and offsets array<bigint>, the byte at which each token starts, of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(0)):
                ids, at, _, places = own.encode(buf, offs)
                places = places - np.repeat(offs[:-1], np.diff(at))
                at = pa.array(at.astype(np.int32))
                yield pa.record_batch([*(c.slice(row, len(offs) - 1) for c in batch.columns[1:]), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(places))], [*keep, "ids", "offsets"])

    rows = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "ids array<int>", "offsets array<bigint>"]))


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with bytes, which the ids of each row stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(out, pa.binary())], [*keep, "bytes"])

    rows = rows.select(F.col(ids).cast("array<int>").alias("__ids"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "bytes binary"]))


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of each row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(1)):
                ids, at, _, _ = own.encode(buf, offs)
                back, places = own.decode(ids)
                raw, places = back.tobytes(), np.append(places, len(back))
                n = np.diff(at)
                bounds, packed = at.tolist(), ids.astype("<u4")
                ids_sha = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                spots = places[at].tolist()
                back_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(spots, spots[1:])]
                yield pa.record_batch([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(ids_sha), pa.array(back_sha), pa.array(np.diff(places[at]))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
