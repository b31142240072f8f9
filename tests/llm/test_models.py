import heapq
import html
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daysieve.llm import ann, html_text, language, licenses, mixing, quality, queries

from .helpers import SCHEMA, WORD, fold, frame, odd_documents

DATA = "/root/testdata/sf0.001"


def test_mixing_against_plain_water_filling(spark):
    rows = odd_documents(seed=7)
    got = mixing.mix(frame(spark, rows), shard_tokens=200, block=4).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left = {}, dict(weight)
    while True:  # stop those above twice their size, share the excess again
        rate = (1.5 * sum(sizes.values()) - sum(full.values())) / sum(left.values())
        over = [s for s in left if rate * left[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]
    want = full | {s: rate * w for s, w in left.items()}
    source = {}
    for d, t, _, s in rows:
        source.setdefault((d, len(WORD.findall(t or ""))), s)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        shards = max(1, -(-sizes[s] // 200))
        assert abs(taken[s] - want[s]) <= 4 * (shards + 1)
    again = mixing.mix(frame(spark, rows).orderBy(F.rand(1)), shard_tokens=200, block=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_seats_are_sainte_lague(spark):
    rng = np.random.default_rng(2)
    for n, seats in ((1, 5), (3, 10), (7, 100), (20, 33)):
        weights = [float(x) for x in rng.integers(0, 1000, n)] if n > 1 else [3.0]
        df = spark.createDataFrame([("g", i, w, seats) for i, w in enumerate(weights)], "g string, name int, w double, seats long")
        got = {r.name: r.quota for r in mixing.apportion(df, ["g"], "w", "seats", "name").collect()}
        best = sorted(((w / (2 * k + 1), -i) for i, w in enumerate(weights) if w for k in range(seats)), reverse=True)[:seats]
        assert got == {i: sum(-j == i for _, j in best) for i in range(n)}


@pytest.mark.parametrize("weights, seats", [([0.9] + [0.0001] * 1000, 1000), ([1.0] * 1000, 1), ([2.0**-i for i in range(40)] * 25, 777), ([5.0, 0.0, 1e-9], 10_000)])
def test_seats_of_skewed_weights(spark, weights, seats):
    """Against a heap of quotients."""
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "name int, w double, seats long")
    got = {r.name: r.quota for r in mixing.apportion(df, [], "w", "seats", "name").collect()}
    want, heap = dict.fromkeys(range(len(weights)), 0), [(-w, i) for i, w in enumerate(weights) if w]
    heapq.heapify(heap)
    for _ in range(seats):
        _, i = heap[0]
        want[i] += 1
        heapq.heapreplace(heap, (-weights[i] / (2 * want[i] + 1), i))
    assert got == want


def test_many_small_sources_beside_a_large_one(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('word ', 60) AS text", "'a' AS source").unionByName(spark.range(2000, 5000).selectExpr("id AS doc_id", "'one two three' AS text", "concat('s', id) AS source"))
    rows = mixing.mix(docs, weights=(1,)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.sum("target").alias("target"), F.count("*").alias("n"), F.max("target").alias("most")).collect()
    got = {r.source_size: r for r in rows}
    assert abs(got[120_000].taken - got[120_000].most) <= 16 and got[3].taken == 6 * 3000
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * 129_000, abs=16)


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_quotas_of_many_shards(spark, fan):
    rng = np.random.default_rng(3)
    sizes = {(s, i): int(x) for s, n in (("a", 23), ("b", 1), (None, 4)) for i, x in enumerate(rng.integers(0, 1000, n))}
    blocks = {"a": 400, "b": 7, None: 0}
    df = spark.createDataFrame([(s, i, x, blocks[s]) for (s, i), x in sizes.items()], "source string, shard long, shard_size long, blocks long")
    got = {(r.source, r.shard): r.quota for r in mixing.shard_quotas(df, 23, fan).collect()}
    assert got.keys() == sizes.keys()

    def seats(parties, n):
        best = sorted(((w / (2 * k + 1), -i) for i, w in parties.items() if w for k in range(n)), reverse=True)[:n]
        return {i: sum(-j == i for _, j in best) for i in parties}

    def deal(parties, n, level):  # groups of fan ** level shards
        if level < 0:
            return {next(iter(parties)): n}
        groups = {}
        for i, w in parties.items():
            groups.setdefault(i // fan**level, {})[i] = w
        won = seats({g: sum(p.values()) for g, p in groups.items()}, n)
        return {i: q for g, p in groups.items() for i, q in deal(p, won[g], level - 1).items()}

    levels = next(n for n in range(1, 9) if fan**n >= 23)
    for s, n in blocks.items():
        assert {i: got[s, i] for (x, i) in sizes if x == s} == deal({i: w for (x, i), w in sizes.items() if x == s}, n, levels - 1)


def test_small_targets_get_something(spark):
    rows = [(i, "w " * 10, "en", "abcdefgh"[i % 8]) for i in range(16)]
    got = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        s = "abcdefgh"[r.doc_id % 8]
        got[s] = (got.get(s, (0, 0))[0] + r.taken, r.target)
    assert all(abs(n - t) <= 1 for n, t in got.values())


def test_mixed_rows_are_what_was_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i)), "en", "abc"[i % 3]) for i in range(30)]
    rows += [(3, "another text of three", "en", "b"), (3, "and one more", "en", None), (None, "without an id", "en", "a"), (None, "nor has this one", "en", "c"), rows[5], (50, None, "en", "a"), (51, "", "en", None)]
    df = frame(spark, rows)
    taken = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in mixing.mix(df).collect())
    assert len(taken) == len(rows)
    want = {}
    for null, d, _, n in taken:
        want[None if null else d] = want.get(None if null else d, 0) + n
    got = dict.fromkeys(want, 0)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    kept = sorted(str(tuple(r)) for r in out.collect())
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == want
    assert sorted(str(tuple(r)) for r in mixing.mixed(df.orderBy(F.rand(2))).collect()) == kept
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == [] == mixing.mixed(spark.createDataFrame([], SCHEMA)).collect()
    nothing = mixing.mix(frame(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in nothing) and len(nothing) == 2
    assert mixing.mixed(frame(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect() == []


def plain_scan(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "cc by cc by, CC-BY", "ALL rights\nreserved. General public license version 3; GNU General Public License, version 3", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "license apache under", "no such thing", "general public licenseé", "mit " * 3000, "éall rights reserved"]
    rows = odd_documents(n=20, seed=8) + [(100 + i, t, "en", "a") for i, t in enumerate(texts)] + [(200 + i, "plain words of the day and of the night", "en", "a") for i in range(40)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, t, *_ in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert [got[100 + i].labels for i in range(7)] == ["cc-by,cc-by-nc", "cc-by", "gpl,gpl-3.0,reserved", "mit", "apache-2.0", "", ""]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_licenses_of_several_notices(spark):
    every = sorted(licenses.TEMPLATES)
    few = ["apache-2.0", "bsd", "isc", "mit", "mpl-2.0"]
    notice = {n: licenses.TEMPLATES[n][0] for n in every}
    plain = [(1000 + i, "plain words of the day and of the night", "en", "a") for i in range(40)]
    rows = [(1, ". ".join(notice[n] for n in few), "en", "a"), (2, " and more words here ".join(notice[n] for n in reversed(few)), "en", "a"), (3, "\n".join(notice[n].upper() for n in every), "en", "a")]
    # a key phrase far from its notice, words of a notice out of place, folding of A-Z only
    rows += [(4, "mit license " + "and so on " * 40 + "permission is hereby granted free of charge to any person", "en", "a"), (5, "license mit the under released", "en", "a"), (6, "released under the M\u0130T licen\u017fe, all rights re\u017ferved \u212a", "en", "a")]
    rows += [(7, "x " * 20_000 + notice["isc"] + " y" * 20_000, "en", "a"), (8, "of this software is released under the mit", "en", "a"), (9, "the MIT license permission is", None, None), (None, "Released under the MIT License.", "en", "a")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows + plain)).collect()}
    base = {n: licenses.BASE[p] for p in licenses.BASE for n in every if p in notice[n]}
    assert got[1].labels == got[2].labels == ",".join(few) and got[1].score < 1 and not got[1000].labels
    assert got[3].labels == ",".join(sorted({*every, *base.values()}))
    assert [got[i].labels for i in (4, 5, 6, 7, 8, 9, None)] == ["", "", "", "isc", "", "mit", "mit"]
    # words that all documents hold
    same = licenses.scan(frame(spark, [(i, f"file {i} {notice['mit']}", "en", "a") for i in range(40)])).collect()
    assert {r.labels for r in same} == {"mit"} and all(r.score > 0 for r in same)
    assert {r.labels for r in licenses.scan(frame(spark, rows[:1]), base={}).collect()} == {",".join(few)}
    assert {r.labels for r in licenses.scan(frame(spark, rows[:1]), templates={}).collect()} == {""}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k):
    """{query: its k nearest as (id, score)}, an id's best vector, a query's least."""
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q in {i for i, _ in ok if i % 20 == 0}:
        own = np.array(min(v.tolist() for i, v in ok if i == q))
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((v * own).sum()))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df, k=20, by="vec_id % 20 = 0"):
    out = {}
    for r in ann.nearest(df.where(by), df, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(200 + i, rows[0][1], 0) for i in range(60)]  # a common vector
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0] * 7 + [None], 0), (303, [float("nan")] * 8, 0), (304, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (305, [1.0], 0), (306, [], 0), rows[3], (307, [-0.0] * 7 + [1.0], 0), (308, [0.0] * 7 + [1.0], 0)]
    rows += [(40, rows[7][1], 0), (41, rows[8][1], 0), (41, rows[9][1], 0)]  # other vectors of one id
    df, want = vectors(spark, rows), brute(rows, 20)
    for shard, block in ((8192, 8192), (50, 4)):
        monkeypatch.setattr(ann, "SHARD_VECTORS", shard)
        monkeypatch.setattr(ann, "BLOCK_QUERIES", block)
        got = found(df)
        assert got.keys() == want.keys() and all(len(got[q]) == len({i for i, _ in got[q]}) == 20 for q in got)
        score = {q: dict(brute(rows, 1000)[q]) for q in want}
        assert all(s == pytest.approx(score[q][i]) for q in got for i, s in got[q])
        assert all(got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) for q in got)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    # with all files and all of the share it is brute force
    monkeypatch.setattr(ann, "LOOKED", 256)
    monkeypatch.setattr(ann, "RERANKED", 1.0)
    got = found(df)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    few = vectors(spark, rows[:5])
    assert ann.nearest(few.where("vec_id = 0"), few).count() == 4


def test_queries_that_find_too_few_look_everywhere(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(100)]
    monkeypatch.setattr(ann, "LOOKED", 1)
    monkeypatch.setattr(ann, "POSTED", 1)
    assert {q: [i for i, _ in x] for q, x in found(vectors(spark, rows)).items()} == {q: [i for i, _ in x] for q, x in brute(rows, 20).items()}


@pytest.mark.parametrize(("n", "sigma"), [(1000, 0.0), (50_000, 0.0), (20_000, 0.5)])
def test_recall(spark, tmp_path, n, sigma):
    """Against all vectors, with several shards, on vectors without clusters; of equal and of unequal lengths."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(rng.normal(size=(n, 1)) * sigma).astype(np.float32)
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), str(tmp_path / "v.parquet"), row_group_size=5000)
    got = found(spark.read.parquet(str(tmp_path / "v.parquet")), by=f"vec_id % {max(50, n // 200)} = 0")
    x = x.astype(np.float64)
    hits = []
    for q, pairs in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len({i for i, _ in pairs} & set(np.argpartition(-s, 20)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scores(docs, quality.fit(docs, labels)).withColumn("held_out", quality.is_held_out()).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in got)


def test_quality_of_odd_rows(spark):
    df = frame(spark, odd_documents(seed=9))
    none = quality.fit(df, spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, quality int"))
    assert none is None and {r.score for r in quality.scores(df, none).collect()} == {0.5}
    labels = df.where("doc_id IS NOT NULL").select("doc_id", (F.length("text") > 60).cast("int").alias("quality"))
    ranker = quality.fit(df, labels)
    assert all(0 <= r.score <= 1 for r in quality.scores(df, ranker).collect()) and quality.scores(df, ranker).count() == df.count()
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.scores(spark.createDataFrame([], SCHEMA), ranker).collect() == []


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x @ [2.0, -1, 0, 0.5, 0] + rng.normal(size=400) * 0.3 > 0.8).astype(int)
    r = quality.bradley_terry(x, y)
    s = r.score(x)
    assert np.mean([s[a] > s[b] for a, b in itertools.product(np.flatnonzero(y)[:40], np.flatnonzero(y == 0)[:40])]) > 0.95
    assert quality.bradley_terry(x, np.ones(400, int)) is None


def test_weights_and_threshold_against_plain_versions():
    """The loss over all pairs has its least where plain descent finds it, and the cut is the quantile."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = (x @ [1.0, -2, 0.5] + rng.normal(size=60) > 0.3).astype(int)
    r = quality.bradley_terry(x, y, steps=3000)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pairs = [(a, b) for a in np.flatnonzero(y) for b in np.flatnonzero(y == 0)]
    w = np.zeros(3)
    for _ in range(1500):
        gradient = 1e-3 * w
        for a, b in pairs:
            d = z[a] - z[b]
            gradient = gradient - d / (1 + np.exp(d @ w)) / len(pairs)
        w = w - 0.5 * gradient
    assert r.weights @ w / np.linalg.norm(r.weights) / np.linalg.norm(w) > 0.995
    raw = z @ r.weights
    assert sum(raw < r.cut) == sum(y == 0)  # its share of label 0 is the sample's
    other = quality.bradley_terry(x, y, (9000, 1000), steps=3000)
    weights = np.where(y == 1, 1000 / sum(y == 1), 9000 / sum(y == 0))
    assert weights[z @ other.weights < other.cut].sum() == pytest.approx(9000, abs=weights.max())
    assert np.all((r.score(x) >= quality.THRESHOLD) == (raw >= r.cut))


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of each label than were once sampled: the model is that of all rows, and the cut is their quantile. Labels of unknown documents count for nothing."""
    rng = np.random.default_rng(4)
    worth = rng.random(14_000)
    shouted = rng.random((len(worth), 24)) > worth[:, None] * 0.6 + 0.3
    rows = [(i, " ".join(f"W{k}" * 3 if up else f"w{k}" for up, k in zip(s[: 9 + i % 16], rng.integers(0, 400, 24)))) for i, s in enumerate(shouted)]
    y = (worth + rng.normal(size=len(worth)) * 0.2 > 0.45).astype(int)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([*enumerate(y.tolist()), *((i, 1) for i in range(20_000, 29_000))], "doc_id long, quality int")
    ranker = quality.fit(docs, labels)
    mine = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(rows))])
    x = np.concatenate([x for _, x in quality._features(pa.array([t for _, t in rows]))])[mine]
    y = y[mine]
    assert min(np.bincount(y)) > 4000
    assert abs((ranker.score(x) < quality.THRESHOLD).sum() - (y == 0).sum()) <= 3  # but for equal scores
    want = quality.bradley_terry(x, y)
    assert np.allclose(ranker.weights, want.weights, atol=1e-5) and ranker.cut == pytest.approx(want.cut, abs=1e-4) and ranker.slope == pytest.approx(want.slope, rel=1e-3)


def test_features_against_plain_counts():
    texts = ["One two two TWO three!!", "", None, "a\tb\nc  d", "é? ,, x9"]
    got = np.concatenate([x for _, x in quality._features(pa.array(texts))])
    for t, row in zip(texts, got):
        w = WORD.findall(t or "")
        n = max(len(w), 1)
        folded = [fold(x) for x in w]
        raw = (t or "").encode()
        assert row[0] == pytest.approx(np.log1p(len(w))) and row[2] == pytest.approx(raw.count(b"\n") / n) and row[3] == (not w)
        assert row[5] == pytest.approx(sum(a == b for a, b in zip(folded, folded[1:])) / n)
        assert row[10] == pytest.approx(sum(len(x.encode()) for x in w) / n) and row[12] == pytest.approx(len(set(folded)) / n)


def plain_grams(text):
    """{slot: count} of the n-grams of one to three signs in which a letter follows or ends them."""
    from daysieve.llm import bpe, vec

    letters = bpe._classes()
    signs = [ord(fold(c)) if letters[ord(c)] == bpe.LETTER else 0 for c in text]
    out = {}
    for i, c in enumerate(signs):
        b = signs[i - 1] if i else 0
        a = signs[i - 2] if i > 1 else 0
        codes = [c] * (c > 0) + [b << 21 | c | 1 << 60] * (c > 0 or b > 0) + [a << 42 | b << 21 | c] * (b > 0)
        for code in codes:
            slot = int(vec.mix(np.array([code], np.uint64))[0]) % language.DIMENSIONS
            out[slot] = out.get(slot, 0) + 1
    return out


def test_language_against_a_plain_version(spark):
    texts = ["The cat and the dog.", "le chat et le chien!", "Der Hund, die Katze", "un perro y un gato", "the the the", "le le", "zzz qqq", "x", "É"]
    rows = [(i, t, "en fr de es en fr en de fr".split()[i], "a") for i, t in enumerate(texts)] + [(100 + i, texts[i % 4] * 2 + " " + texts[i % 4 + 1 if i % 8 < 4 else i % 4], "en fr de es".split()[i % 4], "a") for i in range(60)]
    df = frame(spark, rows)
    for _, x, has in language._counts(pa.array(texts)):
        for i, t in enumerate(texts):
            assert {int(k): int(x[i, k]) for k in np.flatnonzero(x[i])} == plain_grams(t) and has[i]
    model = language.fit(df, sample_rows=12)
    import zlib

    learned = [(d, t) for d, t, _, _ in rows if zlib.crc32(str(d).encode()) % 5]
    df_of = {}
    for _, t in learned:
        for k in plain_grams(t):
            df_of[k] = df_of.get(k, 0) + 1
    idf = {k: np.log((1 + len(learned)) / (1 + n)) + 1 for k, n in df_of.items()}
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    for d, t, *_ in rows:
        v = {k: np.log1p(n) * idf.get(k, np.log(1 + len(learned)) + 1) for k, n in plain_grams(t).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        best = {}
        for j, c in enumerate(model.centroids):
            name = model.names[model.language[j]]
            best[name] = max(best.get(name, -1), sum(x * c[k] for k, x in v.items()) / norm)
        first = max(sorted(best), key=lambda n: best[n])
        second = max(0.0, *(x for n, x in best.items() if n != first))
        assert got[d].lang_pred == first or best[got[d].lang_pred] == pytest.approx(best[first], abs=1e-4)
        assert got[d].score == pytest.approx(1 - second / best[first], abs=1e-3)
        assert got[d].rejected == (best[first] < model.radius[model.names.index(first)]) or best[first] == pytest.approx(model.radius[model.names.index(first)], abs=1e-4)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 300 // 26)}{chr(97 + i % 26)} " * 20, f"l{i % 300:03}", "a") for i in range(1500)]
    model = language.fit(frame(spark, rows), in_all=1000)
    assert len(model.names) == 300 and len(model.centroids) <= 1000


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.fit(docs)).withColumn("held_out", quality.is_held_out()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_language_of_odd_rows(spark):
    df = frame(spark, [*odd_documents(seed=10), (500, "123 !!", "en", "a"), (501, "é", "fr", "a")])
    got = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert {got[d].lang_pred for d in (-1, -2, -3, 500)} == {"und"} and got[500].score == 0
    assert got[501].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.fit(spark.createDataFrame([], SCHEMA)) is None


def test_cuts_are_minimal():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        gain = rng.normal(size=n).tolist()
        edges = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (int(rng.integers(0, 12)), 2)) if a != b]
        cost = lambda side: sum(max(g, 0) * (not s) + max(-g, 0) * s for g, s in zip(gain, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        least = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert cost(html_text.minimum_cut(gain, edges)) == pytest.approx(least)


@pytest.mark.parametrize("seed", range(4))
def test_long_pages_of_doubtful_blocks(seed):
    """A listing of 100,000 blocks in boxes of five, none of which is decided by itself; small graphs against all labellings are above."""
    import time

    rng = np.random.default_rng(seed)
    n = 100_000
    gain = [rng.uniform(-1, 1, n), np.repeat([0.7, -0.7], n // 2), rng.choice([0.5, -0.01], n, p=[0.02, 0.98]), np.sin(np.arange(n) / 500) * 0.8][seed].tolist()
    edges = [(i - 1, i, 0.6 + 0.9 * (i % 5 > 0)) for i in range(1, n)] + [(i - 5, i, 0.45) for i in range(5, n, 5)]
    began = time.perf_counter()
    side = html_text.minimum_cut(gain, edges)
    assert time.perf_counter() - began < 60 and len(side) == n
    near = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    for i in range(0, n, 37):  # no block and no run of equal ones would be cheaper on the other side
        for run in (range(i, i + 1), range(i - i % 5, i - i % 5 + 5), range(i, min(n, i + 300))):
            if len({side[j] for j in run}) == 1:
                out = sum(gain[j] if side[j] else -gain[j] for j in run)
                assert out + sum(w if side[j] == side[k] else -w for j in run for k, w in near[j] if k not in run) >= -1e-6


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies &amp; more. Please accept all of this long sentence now.</div>
<div class="wrap"><article><h1>Title &lt;1&gt;</h1><p>First <b>bo</b>ld&nbsp;text
here.<br>Next<p>Second para.<div class="ad">Buy <a href=#>now</a> cheap stuff and things.</div><p>Ti.</article></div>
<aside><p>Related long text of the side bar which goes on.</p></aside><form><p>Sign up here please</p></form>
<section class="comments"><p>Nice article, thanks a lot for that!</p></section><footer>&copy; me &middot; all rights reserved here and there.</footer><script>var a="</p>";"""


def test_pages(spark):
    assert html_text.main_text(PAGE) == "Title <1> First bold text here. Next Second para. Ti."
    for page in (None, "", "<", "<a", "<!-- x", "<script>x", "&#0;", "</p></p>", "<p" * 50, "<a href='x>" * 30, "<div>" * 3000 + "deep" + "</div>" * 3000):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("a < b &am &amp c<foo") == "a < b &am & c"
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (1, "u", PAGE, "x"), (3, "u", "<p>" + "long text here. " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == len("long text here. " * 100_000) - 1
    assert html_text.extract(df.limit(0)).collect() == []


def test_ordinary_names_keep_their_article():
    long = "This is a sentence of the article with quite a few words in it. " * 2
    for within in ('<p class="text-center header-image">%s</p>', '<div class="related-work"><p>%s</p></div>', '<div class="share-price">%s</div>', '<div id="main-header-story">%s</div>', "<section>%s</section>"):
        assert html_text.main_text(f"<body><nav><a href=x>Home page</a></nav><article><h1>On it</h1><p>{long}</p>{within % long}</article></body>").count("quite a few") == 4, within
    assert "quite" in html_text.main_text(f'<div id="main-header-story">{long}</div>')
    assert "quite" in html_text.main_text(f"<form id=aspnet><article><p>{long}</p></article></form>")
    assert html_text.main_text(f'<article><p>{long}</p></article><section class="comments"><article class="comment"><p>{long}</p></article></section>').count("quite") == 2
    assert html_text.main_text(f"<head><title>x</title><p>{long}").count("quite") == 2
    for gone in ('<div class="site-footer">%s</div>', '<ul role="navigation"><li>%s</ul>', '<div class="ad">%s</div>', '<div id="comments"><p>%s</p></div>', "<select><option>%s</select>", '<div hidden>%s</div>', "<template>%s</template>", "<textarea>%s</textarea>"):
        assert html_text.main_text(f"<article><p>{long}</p></article>{gone % 'Words of another kind here.'}").count("another kind") == 0, gone


def test_markup_is_read_as_browsers_do():
    body = lambda x: html_text.main_text(f"<article>{x}</article>")
    assert body("one <script src=a.js/>code < 1</script>two") == "one two"
    assert body("<p>sum <math><mi>x</mi></math> of <svg><text>y</text><path/></svg><object>z</object> <noscript>w</noscript>") == "sum x of y z w"
    assert body("a<!-->b<!--->c<!-- > -->d</ x>e</>f<?php x?>g") == "abcdefg"
    assert body('<p title="a > b" data-x=\'<p>\'>in</p><p \' ">out</p>') == "in out"
    assert body("<div/>one</div><br/>two<p>three<div>four") == "one two three four"
    assert body("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a b c d e f g"


def test_cut_decides_where_the_classifier_doubts():
    long = "<p>This is a sentence of the page, and it has quite a few words in it, as the others have.</p>"
    page = f'<div>{long}{long}<p><a href="x">See</a> it all in the list of them here</p>{long}<div class="share-price">At 3 it was.</div>{long}</div>'
    found = html_text.blocks(page)
    gain, edges = html_text.graph(found, [*html_text.WEIGHTS.values()])
    keep = html_text.minimum_cut(gain, edges)
    assert [g > 0 for g in gain].count(False) == 1 and all(keep)
    alone = html_text.blocks('<nav><p><a href="x">See</a> it</p></nav><p><a href="x">See</a> it</p>')
    assert not any(html_text.minimum_cut(*html_text.graph(alone, [*html_text.WEIGHTS.values()])))


def test_weights_are_fitted(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = html_text.fit(pages, sample_pages=50)
    assert got == html_text.fit(pages.orderBy(F.rand(1)), sample_pages=50) and len(got) == len(html_text.WEIGHTS)
    x = np.array([f for r in pages.collect() for f, _ in html_text.weak_labels(html_text.blocks(r.html))])
    y = np.array([t for r in pages.collect() for _, t in html_text.weak_labels(html_text.blocks(r.html))])
    loss = lambda w: np.mean(np.where(y == 1, np.log1p(np.exp(-x @ w)) / (y == 1).mean(), np.log1p(np.exp(x @ w)) / (y == 0).mean()))
    assert loss(np.array(got[: x.shape[1]])) < loss(np.array([*html_text.WEIGHTS.values()][: x.shape[1]]))
    assert html_text.fit(pages.limit(0)) == [*html_text.WEIGHTS.values()]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "<p>x"), (2, None)], "page_id long, html string")
    assert html_text.fit(odd) == [*html_text.WEIGHTS.values()]


def test_pages_take_linear_time():
    import time

    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<b>x" * 60_000, "<p><b>" * 40_000, "<li><b>" * 40_000, "<a '>" * 60_000, '<a x="' * 60_000, "</p>" * 100_000, "<div>" * 60_000 + "</p></span>" * 60_000, "<article>" + "<p>some text, here. " * 60_000, "<p><a href=x>a</a> b" * 40_000, "<head><p>" * 40_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_pages_of_the_data(spark):
    import re

    for r in queries.op10_html_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").drop("url"), "page_id").collect():
        inner = re.sub(r"<[a-zA-Z/][^<>]*$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want


def test_word_counts_equal_arrow_chunks():
    from daysieve.llm import vec

    texts = [None, "", " a  b\tc", "é\x85x y", "x" * 5_000_000]
    got = []
    for _, buf, offs in vec.chunks(pa.array(texts)):
        got += np.diff(vec.word_spans(buf, offs)[2]).tolist()
    assert got == [len(WORD.findall(t or "")) for t in texts]
