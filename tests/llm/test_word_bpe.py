import hashlib
import json
import random
import struct
from functools import cache

import pyarrow as pa
import pytest

from daysieve.llm import queries, vec, word_bpe

from .helpers import frame, odd_documents

DATA = "/root/testdata/sf0.001"


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe_path())


def ids_of(texts):
    own, out = word_bpe.codec(queries.word_bpe_path()), []
    for _, buf, offs in vec.chunks(pa.array(texts, pa.string())):
        ids, at = own.encode(buf, offs)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def wanted(texts):
    return [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_as_the_library():
    texts = [f"{chr(i)}a{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert ids_of(texts) == wanted(texts)


def test_random_texts_as_the_library():
    rng = random.Random(4)
    parts = ["a", "b", "'", "s", "t", "re", "ve", "ll", " ", "\n", "é", "é", "1", "!", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "中", "İ", "́", "ſ", "Å", "ᄀ", "ᅡ", "\u0085"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyztheing", k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["", "'s", "''s", "don't!'s 'RE'll'Ve 'r 'l", "e<|endoftext|>́a", "<|endof", "text|>", "a" * 50_000, "ab" * 30_000 + "!" * 9999]
    assert ids_of(texts) == wanted(texts)


def plain_merges(piece, pairs):
    """Merges by rank, the leftmost first."""
    while len(piece) > 1:
        rank, i = min((pairs.get((a, b), (1 << 60, 0))[0], i) for i, (a, b) in enumerate(zip(piece, piece[1:])))
        if rank == 1 << 60:
            break
        piece = [*piece[:i], pairs[piece[i], piece[i + 1]][1], *piece[i + 2 :]]
    return piece


def test_small_vocabularies_by_replaying_merges(tmp_path):
    """Random merges, also some whose token the merges never leave whole."""
    with open(queries.word_bpe_path(), encoding="utf-8") as f:
        data = json.load(f)
    base = list(data["model"]["vocab"])[:512]
    rng = random.Random(6)
    for k in range(12):
        tokens, merges = [*"ab", "a</w>", "b</w>"], []
        for _ in range(200):
            x, y = rng.choice([t for t in tokens if not t.endswith("</w>")]), rng.choice(tokens)
            if x + y not in tokens and len(x + y) < 14:
                tokens.append(x + y)
                merges.append([x, y])
        data["model"] |= {"merges": merges, "vocab": {t: i for i, t in enumerate(dict.fromkeys([*base, *tokens]))}}
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(data), encoding="utf-8")
        v = word_bpe.Vocabulary(str(path))
        own, pairs = word_bpe.Encoder(v), {(a, b): (r, data["model"]["vocab"][v.names[a] + v.names[b]]) for (a, b), r in v.pairs.items()}
        for _ in range(400):
            piece = "".join(rng.choices("ab", k=rng.randrange(1, 30)))
            single = [v.base[c] for c in piece[:-1]] + [v.base[chr(256 + ord(piece[-1]))]]
            assert own.encode(piece.encode()) == plain_merges(single, pairs)


def test_other_vocabularies_are_refused(tmp_path):
    with open(queries.word_bpe_path(), encoding="utf-8") as f:
        data = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": None}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(data | change), encoding="utf-8")
        with pytest.raises(ValueError):
            word_bpe.Vocabulary(str(path))


def digests(text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    back = library().decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_documents(seed=3)
    got = word_bpe.round_trip(frame(spark, rows), queries.word_bpe_path()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *digests(r[1]))) for r in rows)
    assert word_bpe.round_trip(frame(spark, rows).limit(0), queries.word_bpe_path()).count() == 0


def test_ids_decode_to_what_the_library_gives(spark):
    rows = [(1, "Hello  WORLD's <|endoftext|>"), (2, None), (3, "")]
    ids = word_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), queries.word_bpe_path())
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: library().encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.text for r in word_bpe.decode(ids, queries.word_bpe_path()).collect()} == {1: "hello</w> world</w> 's</w> <|endoftext|>", 2: "", 3: ""}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op13_word_bpe(spark, DATA).collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:] == digests(docs[r.doc_id]) for r in got)


def test_forgetting_and_shared_hashes(monkeypatch):
    texts = [f"word{i} x{i % 7}" for i in range(3000)]
    monkeypatch.setattr(word_bpe, "CACHE_PIECES", 64)
    monkeypatch.setattr(word_bpe, "_codecs", {})
    assert ids_of(texts[:1000]) == wanted(texts[:1000])
    monkeypatch.setattr(word_bpe, "CACHE_PIECES", 4096)
    monkeypatch.setattr(word_bpe, "_codecs", {})
    real = vec.word_hashes
    monkeypatch.setattr(vec, "word_hashes", lambda *a: real(*a) % 997)
    assert ids_of(texts) == wanted(texts)
