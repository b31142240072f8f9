"""BPE with word ends: an Aho-Corasick backtracking encoder, decoding from an offset table.

A vocabulary of this kind (a `tokenizers` file) puts texts into NFC, folds them to lower case one code point at a time, drops
white space, and cuts what is left into `'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`. A piece is its
UTF-8 bytes, the last of them with the mark of a word end, and merges go by rank, the leftmost first.

Merging is not replayed. A sequence of tokens is what the merges give exactly if each two neighbours are what the merges
give of the two together; so an encoder need only find a sequence in which all neighbours are compatible:

* an Aho-Corasick automaton over the tokens finds the longest token that starts at each place of a piece in one pass;
* two tokens are compatible if no merge across their border would have come before the merges that made its two sides;
  answers are kept in a table;
* the encoder takes the longest token, the next shorter one if its neighbour doesn't bear it, and steps back from a place
  where none fits. The tokens before a place are unique, so a place that failed once has failed for good, and each place
  is entered once: time grows with the length, also for pieces of megabytes.

Pieces that were seen are kept by 64-bit hash; the bytes of what was encoded are compared with the pieces, and a chunk in
which two pieces share a hash is encoded again piece by piece. Token strings lie one after another in one array, and an
offset table tells where each starts, so decoding gathers slices; token strings are joined by one space, as the library
does for a vocabulary without a decoder.

Special tokens that stand in a text are their ids, as in the library; what lies between them is normalised by itself.

Defined results: a null text counts as empty, no ids; a null doc_id stays null; repeated rows are encoded alike; a very
long text is a chunk of its own; bytes that are not UTF-8 count as U+FFFD; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .bpe import LETTER, NUMBER, OTHER, SPACE, Table

#: Distinct pieces that a worker keeps the ids of, and pairs of tokens it keeps the answer for; beyond, it starts anew.
CACHE_PIECES = 500_000
CACHE_PAIRS = 1_000_000

#: What the method holds for; other vocabularies are refused.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NEVER = 1 << 60


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """The class of each code point, its lower case, and the lower cases of more than one code point. The library is asked once, so that both agree on the version of Unicode."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c != 10]
    text = "\n".join(every)
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s")):
        for run, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(every)):
            kinds[[ord(c) for c in run]] = kind
    kinds[10] = SPACE
    low, wide = np.arange(0x110000, dtype=np.uint32), {}
    for c, x in zip(every, normalizers.Lowercase().normalize_str(text).split("\n")):
        if c != x:
            if len(x) > 1:
                wide[ord(c)] = x
            else:
                low[ord(c)] = ord(x)
    return kinds, low, wide


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_spans(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all texts in cps, lower-case code points with the texts' offsets."""
    n = len(cps)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e
    kind = _unicode()[0][cps]
    first = np.zeros(n + 1, bool)  # of a text
    first[offs] = True
    new = first[:n] | (kind == NUMBER)
    new[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    # an apostrophe that is a run of its own takes the first letters after it
    quote = np.flatnonzero((kinds[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (cps[starts[:-1]] == 0x27) & (kinds[1:] == LETTER) & ~first[ends[:-1]])
    if len(quote):
        letters = starts[quote + 1]
        c1, room = cps[letters], ends[quote + 1] - letters
        c2 = np.where(room > 1, cps[np.minimum(letters + 1, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        taken = np.where(one, 1, np.where(two, 2, 0))
        ends[quote] += taken
        starts[quote + 1] += taken
    stay = (kinds != SPACE) & (starts < ends)
    return starts[stay], ends[stay]


class Vocabulary:
    """Tokens as strings of 512 symbols: a byte, or a byte at a word's end. A merge makes one token of two, ranks ascend with what they are made of."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        kinds = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", ())]
        split = [x["pattern"]["Regex"] for x in (data["pre_tokenizer"] or {}).get("pretokenizers", ()) if x["type"] == "Split"]
        mark = model["end_of_word_suffix"]
        if kinds != NORMALISERS or split != [PATTERN] or not mark or data["decoder"] or model["unk_token"] or model["byte_fallback"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a vocabulary of lower-case bytes with word ends")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in what stands beside them")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.names = [""] * n
        for name, i in (*ids.items(), *self.special.items()):
            self.names[i] = name
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        self.pairs: dict[tuple[int, int], int] = {}
        self.symbols = [""] * n
        signs = _byte_signs()
        made = {ids[a + b] for a, b in map(self._pair, model["merges"])}
        for name, i in ids.items():
            if i not in made:
                end = len(name) > 1 and name.endswith(mark)
                self.symbols[i] = chr(signs[name.removesuffix(mark) if end else name] + 256 * end)
        for rank, (a, b) in enumerate(map(self._pair, model["merges"])):
            i, x, y = ids[a + b], ids[a], ids[b]
            if not self.symbols[x] or not self.symbols[y] or self.symbols[i]:
                raise ValueError(f"merge {rank} of {path} comes before its parts, or makes a token again")
            self.left[i], self.right[i], self.rank[i] = x, y, rank
            self.pairs[x, y] = rank
            self.symbols[i] = self.symbols[x] + self.symbols[y]
        self.base = {s: i for i, s in enumerate(self.symbols) if len(s) == 1}
        if len(self.base) != 512:
            raise ValueError(f"{path} lacks bytes")

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        return a, b

    def edge(self, token: int, part: list[int], until: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side of token in turn while it is made, and the rank at which each is merged into the next; the last until `until`."""
        out = []
        while token >= 0:
            out.append((token, until))
            token, until = part[token], self.rank[token]
        return out

    def bear(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge across the border of a and b comes before rank `until`. Of equal merges the left one is first."""
        second = self.edge(b, self.left, until)
        for x, x_goes in self.edge(a, self.right, until):
            for y, y_goes in second:
                rank = self.pairs.get((x, y))
                if rank is not None and rank < x_goes and rank <= y_goes and rank < until:
                    return False
        return True


class Encoder:
    """The backtracking encoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = v = vocabulary
        # a token that the merges never leave whole is none
        self.live = [bool(s) and v.rank[i] < 0 for i, s in enumerate(v.symbols)]
        for i in sorted((i for i, r in enumerate(v.rank) if r >= 0), key=v.rank.__getitem__):
            self.live[i] = self.live[v.left[i]] and self.live[v.right[i]] and v.bear(v.left[i], v.right[i], v.rank[i])
        by_symbols = {s: i for i, s in enumerate(v.symbols) if self.live[i]}
        self.length = [len(s) for s in v.symbols]
        self.shorter = [-1] * len(v.symbols)
        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((by_symbols[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_symbols), -1)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def fit(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[a, b] = self.v.bear(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece of one byte or more."""
        text = piece[:-1].decode("latin-1") + chr(256 + piece[-1])
        n, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            if token < 0:  # nothing fits here: the token before must be shorter
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
            elif dead[at + length[token]] or out and not self.fit(out[-1], token):
                token = shorter[token]
            else:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
        return out


class Codec:
    """Encodes and decodes whole arrays of texts; keeps the ids of the pieces that it has seen."""

    def __init__(self, path: str):
        from tokenizers import normalizers

        self.nfc = normalizers.NFC().normalize_str
        v = Vocabulary(path)
        self.encoder, self.special = Encoder(v), v.special
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, v.special), key=lambda x: (-len(x), x))) + ")") if v.special else None
        self.special_bytes = [x.encode() for x in v.special]
        names = [x.encode() + b" " for x in v.names]
        self.names, self.name_size = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        raw = [bytes(ord(c) & 255 for c in s) for s in v.symbols]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        _, _, wide = _unicode()
        self.wide, self.is_wide = wide, re.compile("[" + "".join(map(re.escape, map(chr, wide))) + "]") if wide else None
        self._forget()

    def _forget(self) -> None:
        self.seen, self.used = Table(CACHE_PIECES), 0
        self.ids = np.zeros(1 << 20, np.int32)
        self.id_start = np.zeros(CACHE_PIECES + 1, np.int64)  # of piece i; [used] is where the next one's ids go

    def _parts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What lies between special tokens, with an empty string for each of these; its special id or -1; where each text's parts start."""
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs.tolist(), offs[1:].tolist())]
        if not any(x in raw for x in self.special_bytes):
            return texts, np.full(len(texts), -1, np.int32), np.arange(len(texts) + 1)
        parts, ids, at = [], [], [0]
        for text in texts:
            for x in self.specials.split(text):
                ids.append(self.special.get(x, -1))
                parts.append(x if ids[-1] < 0 else "")
            at.append(len(parts))
        return parts, np.array(ids, np.int32), np.array(at)

    def normalised(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all parts in NFC and lower case, and the parts' offsets."""
        parts = [x if x.isascii() else self.nfc(x) for x in parts]
        whole = "".join(parts)
        if self.is_wide and self.is_wide.search(whole):
            parts = [x.translate(self.wide) for x in parts]
            whole = "".join(parts)
        cps = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        return _unicode()[1][cps], np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))

    def _learn(self, pieces: list[bytes], hashes: np.ndarray) -> None:
        """Adds pieces of which none is known, each once, as many as there is room for."""
        found = [self.encoder.encode(x) for x in pieces]
        ends = int(self.id_start[self.used]) + np.cumsum([len(x) for x in found])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.int32)))
        self.ids[self.id_start[self.used] : ends[-1]] = [i for x in found for i in x]
        self.id_start[self.used + 1 : self.used + 1 + len(pieces)] = ends
        self.seen.put(hashes, np.arange(self.used, self.used + len(pieces), dtype=np.int32))
        self.used += len(pieces)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in buf, and where each text's ids start among them."""
        parts, special, of_text = self._parts(buf, offs)
        cps, offs = self.normalised(parts)
        starts, ends = piece_spans(cps, offs)
        text = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), dtype=np.int64)))
        ids, counts = self._pieces(text, at[starts], at[ends])
        before = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offs)]
        which = np.flatnonzero(special >= 0)
        if len(which):
            ids = np.insert(ids, before[which], special[which])
            before = before + np.concatenate(([0], np.cumsum(special >= 0)))
        return ids, before[of_text]

    def _pieces(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes = vec.word_hashes(text, starts, ends)
        raw = text.tobytes()
        whole = lambda i: raw[starts[i] : ends[i]]
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        entry = self.seen.get(distinct)
        fresh = np.flatnonzero(entry < 0)
        if self.used + len(fresh) > CACHE_PIECES:
            self._forget()
            entry = np.full(len(distinct), -1, np.int32)
            fresh = np.arange(len(distinct))
        if len(fresh) > CACHE_PIECES:  # only a text of many megabytes gets here
            return self._one_by_one([whole(i) for i in range(len(starts))])
        if len(fresh):
            self._learn([whole(i) for i in first[fresh]], distinct[fresh])
            entry[fresh] = self.seen.get(distinct[fresh])
        entry = entry[back]
        counts = self.id_start[entry + 1] - self.id_start[entry]
        ids = self.ids[vec.spread(self.id_start[entry], counts)]
        if not np.array_equal(self.raw[vec.spread(self.raw_start[ids], self.raw_size[ids])], text[vec.spread(starts, ends - starts)]):
            return self._one_by_one([whole(i) for i in range(len(starts))])  # two pieces of one hash
        return ids, counts

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encoder.encode(x) for x in pieces]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ids, a space after each, and the offset at which each id's string starts."""
        size = self.name_size[ids]
        return self.names[vec.spread(self.name_start[ids], size)], np.cumsum(size) - size


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary, read once in a process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with ids array<int> of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(0)):
                ids, at = own.encode(buf, offs)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([*(c.slice(row, len(offs) - 1) for c in batch.columns[1:]), lists], [*keep, "ids"])

    rows = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "ids array<int>"]))


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with text, the token strings of each row's ids joined by one space; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64))[0][:-1].tobytes().decode() for x in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(out, pa.string())], [*keep, "text"])

    rows = rows.select(F.col(ids).cast("array<int>").alias("__ids"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "text string"]))


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(1)):
                ids, at = own.encode(buf, offs)
                strings, places = own.decode(ids)
                raw, packed, bounds = strings.tobytes(), ids.astype("<u4"), at.tolist()
                spots = np.append(places, len(raw))[at].tolist()
                ids_sha = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                text_sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(spots, spots[1:])]
                n = np.diff(at)
                yield pa.record_batch([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
