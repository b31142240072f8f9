import hashlib
import random

import pytest
from pyspark.sql import functions as F

from daysieve.llm import merkle

from .helpers import fold, odd_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at long, tree string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof digest) of each row by whole levels in memory."""

    def up(nodes):
        """The top, and for each node its siblings level by level."""
        ways, at = [""] * len(nodes), list(range(len(nodes)))
        while len(nodes) > 1:
            for i, j in enumerate(at):
                ways[i] += "".join(x for k, x in enumerate(nodes) if k // 16 == j // 16 and k != j)
            at = [j // 16 for j in at]
            nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], ways

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = ordered, *up([leaf(r) for r in ordered])
    root, tops = up([trees[s][1] for s in sources])
    return sorted(str((r[0], leaf(r), trees[s][1], root, h(way + top))) for s, top in zip(sources, tops) for r, way in zip(trees[s][0], trees[s][2]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def given(rows):
    return [(d, s, lang, None if t is None else len(t), t) for d, t, lang, s in rows]


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_proofs_and_roots_by_plain_levels(spark, stride):
    rng = random.Random(stride)
    rows = given(odd_documents(seed=stride))
    rows += [(i, "hot", None, i, f"T{rng.random()}") for i in range(700)]  # three levels
    rows += [(i, f"é{i % 40}", "en", None, None) for i in range(60)]  # several levels of sources
    rows += [(77, "alike", "en", 1, "Same")] * 40  # rows alike
    changed = {"text": F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    m = merkle.build(frame(spark, rows), changed=changed, stride=stride)
    got = merkle.audit(m).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got) == plain(rows)
    touched = {leaf(r) for r in rows if r[0] is not None and r[0] % 3 == 0 and r[4] is not None and fold(r[4]) != r[4]}
    assert touched and all(r.verified == (r.leaf not in touched) == (r.folded_root == r.root) for r in got)
    assert m.root == got[0].root
    # the proofs themselves lead to the root and have no node of the row's own
    for p in merkle.proofs(m).collect():
        steps = [(s["at"], s["siblings"]) for s in p.path]
        assert merkle.fold(p.leaf, steps) == p.root and all(len(s) % 64 == 0 and at * 64 <= len(s) for at, s in steps)


def test_only_every_other_level_is_stored(spark):
    m = merkle.build(frame(spark, [(i, "s", "en", 1, str(i)) for i in range(5000)]))
    assert [level.count() for level in m.levels] == [5000, 20, 1]
    assert [r.source for r in m.subroots().collect()] == ["s"]


def test_one_row_one_source_no_rows(spark):
    (only,) = merkle.audit(merkle.build(frame(spark, [(None, None, None, None, None)]))).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root == h("-----") and only.proof_sha256 == h() and only.verified
    none = merkle.build(frame(spark, []))
    assert none.root is None and merkle.audit(none).collect() == merkle.proofs(none).collect() == []


def test_a_changed_sibling_is_seen(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    before = merkle.proofs(merkle.build(frame(spark, rows))).collect()
    rows[7] = (7, "s", "en", 1, "other")
    root = merkle.build(frame(spark, rows)).root
    assert all(merkle.fold(p.leaf, [(s["at"], s["siblings"]) for s in p.path]) != root for p in before)
