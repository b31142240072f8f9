import hashlib

import numpy as np
import pytest
import tiktoken

from daysieve.llm import bpe, cluster, exact_dedup, ngram_join, queries, substring_dedup

from .helpers import SCHEMA, components, fold, frame, odd_documents, words

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize(("seed", "k", "num"), [(0, 4, 85), (1, 5, 80)])
def test_near_groups_against_all_pairs(spark, seed, k, num):
    rows = odd_documents(seed=seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame(spark, rows), k, num, 100).collect()}
    assert got == components(rows, k, num, 100)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_groups_of_a_short_text_and_its_extensions(spark, k, num):
    # the extensions link with the short text only: not with each other
    short = " ".join(f"w{i}" for i in range(k + 5))
    rows = [(1, short, "en", "a"), (2, f"{short} x", "en", "a"), (3, f"{short} y", "en", "a"), (4, f"z {short}", "en", "a")]
    want = components(rows, k, num, 100)
    assert {c for _, c in want.values()} == {1} and components(rows[1:], k, num, 100)[3][1] == 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame(spark, rows), k, num, 100).collect()}
    assert got == want


def test_near_groups_of_crowded_tokens(spark, monkeypatch):
    monkeypatch.setattr(cluster, "CROWD", 2)
    rows = odd_documents(seed=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame(spark, rows), 4, 85, 100).collect()}
    assert got == components(rows, 4, 85, 100)


def test_near_groups_in_pieces_of_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    rows = odd_documents(seed=2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame(spark, rows), 4, 85, 100).collect()}
    assert got == components(rows, 4, 85, 100)


def test_light_boundary_follows_cost():
    assert ngram_join.light_boundary({8: 1000}, 85, 100) == 8
    assert ngram_join.light_boundary({16: 1000}, 85, 100) < 16
    assert ngram_join.subset_sizes(5, 85, 100) == []  # it links with equals only
    assert 6 in ngram_join.subset_sizes(6, 85, 100)


def test_near_empty_table(spark):
    assert ngram_join.near_groups(spark.createDataFrame([], SCHEMA), 4, 85, 100).collect() == []
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert substring_dedup.repeat_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), queries.ranks_path()).collect() == []


def test_keep_one_of_each_group(spark):
    rows = odd_documents(seed=3)
    want = {d for d, (_, c) in components(rows, 5, 80, 100).items() if d == c and d is not None}
    kept = ngram_join.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want and kept.columns == frame(spark, rows).columns


def test_exact_groups(spark):
    rows = odd_documents(seed=4) + [(900, "w1 W2 w3", "en", "a"), (901, "W1 w2 W3", "en", "a"), (902, "É", "fr", "a"), (903, "é", "fr", "a")]
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(fold(t), []).append(d)
    for r in exact_dedup.exact_groups(frame(spark, rows)).collect():
        text = next(fold(t) for d, t, *_ in rows if d == r.doc_id)
        ids = [d for d in groups[text] if d is not None]
        keep = max(ids, default=None)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[text]), keep is not None and r.doc_id == keep, sha(text.encode()))


def test_digests_that_do_not_tell_contents_apart(spark, monkeypatch):
    rows = [(1, "a b", "en", "a"), (2, "a b", "en", "a"), (3, "a c", "en", "a")]
    df = frame(spark, rows)
    assert exact_dedup.unverified(df).collect() == []
    clash = exact_dedup.recipes(df).select("recipe").first().recipe[0]
    monkeypatch.setattr(exact_dedup, "unverified", lambda *a: spark.createDataFrame([(clash,)], "digest long"))
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df).collect()) == [(1, 2), (2, 2), (3, 3)]


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000, dtype=np.uint8)
    moved = np.concatenate((rng.integers(97, 123, 777, dtype=np.uint8), body))

    def pieces(b):
        cuts = exact_dedup.chunk_bounds(b, np.array([0, len(b)]))
        return {b[x:y].tobytes() for x, y in zip(cuts, cuts[1:])}

    a, b = pieces(body), pieces(moved)
    assert len(a) > 10 and len(a - b) <= 1
    assert max(np.diff(exact_dedup.chunk_bounds(np.full(300_000, 97, np.uint8), np.array([0, 300_000])))) <= exact_dedup.LONGEST


@pytest.mark.parametrize(("width", "crowd", "bits"), [(5, 4096, 32), (13, 4096, 32), (5, 1, 32), (13, 3, 4), (5, 4096, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, width, crowd, bits):
    """With few bits many windows share a hash, so that only their words tell them apart."""
    monkeypatch.setattr(cluster, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "EDGE_BITS", bits)
    rows = odd_documents(seed=5) + [(800, "w1 " * 40, "en", "a"), (801, "w1 " * 30, "en", "a")]
    rows += [(17, "w5 w6", "en", "a"), (17, f"{rows[20][1]} w1 w2 {rows[30][1]}", "en", "a"), (3, f"{rows[25][1]} other words", "en", "b")]  # other texts of an id
    rows += [(900, "\t".join(rows[40][1].split()) + "\n" + rows[41][1] + "  " + rows[42][1], None, None)]
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - width + 1) if d is not None else ():
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        want.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    got = [tuple(r) for r in substring_dedup.repeat_digest(frame(spark, rows), width, 3).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    if bits != 3:
        texts = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(frame(spark, rows), width, 3).collect()}
        assert sha(texts[801].encode()) == next(x[3] for x in want if x[0] == 801)


def test_paths_are_nonbranching(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w), "en", "a"), (2, " ".join(w[:40]), "en", "a"), (3, " ".join(["x", *w[20:], "y"]), "en", "a"), (4, " ".join(w), "en", "a")]
    edges = substring_dedup.repeated_edges(frame(spark, rows), 5, 3, "text", "doc_id")
    walks = substring_dedup.walks(edges)
    got = sorted(tuple(r) for r in walks.select("doc_id", "place", "n", "s", "s_place").collect())
    assert got == [(2, 0, 36, 1, 0), (3, 1, 36, 1, 20), (4, 0, 56, 1, 0)]
    lists = {r.doc_id: (r.spans, r.own) for r in substring_dedup.span_lists(walks).collect()}
    cuts = {d: list(zip(spans[::3], spans[1::3])) for d, (spans, _) in lists.items() if spans}
    # texts enter at 20 and leave at 36, so the source has three paths
    assert cuts == {2: [(0, 20), (20, 16)], 3: [(1, 16), (17, 20)], 4: [(0, 20), (20, 16), (36, 20)]}
    own = lists[1][1]
    assert list(zip(own[::3], own[1::3])) == [(0, 20), (20, 16), (36, 20)]
    assert own[2::3] == lists[4][0][2::3] and own[2:6:3] == lists[2][0][2::3] and own[5::3] == lists[3][0][2::3]


def test_repeats_of_no_rows(spark):
    assert substring_dedup.repeat_digest(frame(spark, odd_documents()).limit(0)).collect() == []


def encoding():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.ranks_path()), special_tokens={})


def test_pieces_and_ids_equal_the_library_s():
    import random

    import pyarrow as pa

    from daysieve.llm import vec

    rng = random.Random(3)
    signs = ["'", "'s", "'re", "'ll", "'t", " ", "  ", "\n", "\t", "a", "S", "é", "1", "²", "漢", "!", "?", " ", "\x1c", "́", "😀", "ll", "re", "m", "Ⅷ", "\x85", "ſ"]
    texts = [None, "", "'s", " 's", "''s", "  's", "a  ", "   ", "I'll've been", "a" * 3000, "ab" * 400 + "!" * 300] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    texts += [chr(cp) + "a" + chr(cp) + "1 " + chr(cp) for cp in range(0, 0x30000, 7) if not 0xD800 <= cp < 0xE000]
    own, other = bpe.codec(queries.ranks_path()), encoding()
    for row, buf, offs in vec.chunks(pa.array(texts), 20_000):
        ids, at, back, places = own.encode(buf, offs)
        assert back.tobytes() == buf.tobytes() and len(places) == len(ids)
        for i in range(len(offs) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == other.encode_ordinary(texts[row + i] or "")


def test_cache_that_overflows_and_hashes_that_collide(monkeypatch):
    import pyarrow as pa

    from daysieve.llm import vec

    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    own, other = bpe.Codec(bpe.load_ranks(queries.ranks_path())), encoding()
    texts = [f"some words{i} more{i * 7}" for i in range(300)]
    real = vec.word_hashes
    for hashes in (real, lambda buf, s, e: real(buf, s, e) & np.uint64(0xFFFF)):
        monkeypatch.setattr(vec, "word_hashes", hashes)
        for row, buf, offs in vec.chunks(pa.array(texts), 200):
            ids, at, back, _ = own.encode(buf, offs)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [other.encode_ordinary(texts[row + i]) for i in range(len(offs) - 1)]
        own._forget()


def test_scan_is_the_fold():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 40_000):
        f = rng.choice(np.array([bpe.TO_FRESH, bpe.TO_GIVEN, bpe.APOSTROPHE_ONE, bpe.APOSTROPHE_TWO], np.uint8), n)
        state, want = 0, []
        for x in f.tolist():
            want.append(state)
            state = x >> 2 * state & 3
        assert (bpe.scan(f) & 3).tolist() == want


def test_round_trip_and_decode(spark):
    rows = odd_documents(seed=6)
    df, other = frame(spark, rows), encoding()
    got = {r.doc_id: r for r in bpe.round_trip(df, queries.ranks_path()).collect()}
    for d, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
    coded = bpe.encode(df, queries.ranks_path(), keep=("doc_id", "n"))
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, queries.ranks_path(), keep=("doc_id", "n")).collect()}
    assert back == {d: (t or "").encode() for d, t, *_ in rows}
    row = coded.where("doc_id = -6").first()
    assert row.offsets[0] == 0 and row.offsets == sorted(row.offsets)
