"""The pipeline, and each query of this subpackage against its SQL."""

import pytest

import __spark_entry__
import corpus_pipeline
from daysieve.llm import bpe, queries

from ..test_queries import DATA, duck, rows  # noqa: F401
from .helpers import components, fold, frame, odd_documents, words

NAMES = sorted(k for k in __spark_entry__.oracle_sql() if k.startswith("op"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got = __spark_entry__.queries()[name](spark, DATA)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs, seen = queries.table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == before.columns
    quality = seen["quality"]
    last = {}
    for r in quality:
        last[fold(r[1])] = max(last.get(fold(r[1]), r[0]), r[0])
    exact = [r for r in quality if last[fold(r[1])] == r[0]]
    assert sorted(exact) == sorted(seen["exact_dedup"])
    near = components(exact, 5, 80, 100)
    assert sorted(r for r in exact if near[r[0]][1] == r[0]) == sorted(seen["near_dedup"])
    size = {r[0]: len(words(r[1])) for r in seen["near_dedup"]}
    taken = {}
    for r in seen["mixing"]:
        taken[r[0]] = taken.get(r[0], 0) + len(words(r[1]))
    assert all(0 < n <= 2 * size[d] for d, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    own = bpe.codec(queries.ranks_path())
    texts = sorted((r[0], r[1]) for r in seen["mixing"])
    back = sorted((r[0], b"".join(own.bytes[own.start[i] : own.start[i] + own.length[i]].tobytes() for i in r[4]).decode()) for r in seen["byte_bpe"])
    assert back == texts


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    rows = [*odd_documents(seed=11), (None, None, None, None), (None, "no id at all here", "fr", "b"), (3, "another text of an id that is there", "en", "c")]
    df = frame(spark, rows)
    out = stage(spark, df, DATA)
    assert out.count() > 0
    assert stage(spark, df.limit(0), DATA).collect() == []
    if name != "byte_bpe":
        assert out.columns == df.columns
    if name == "exact_dedup":
        assert sorted(fold(r.text) for r in out.collect()) == sorted({fold(t) for _, t, *_ in rows})
    if name == "mixing":
        known = {(d, t) for d, t, *_ in rows}
        whole = [(r.doc_id, r.text) for r in out.collect()]
        assert any(d is None for d, _ in whole) and sum(x in known for x in whole) >= len(whole) - 40
