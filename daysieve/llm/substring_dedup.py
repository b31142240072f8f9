"""Substring dedup over a compacted de Bruijn graph.

A window of `width` words is an edge of the de Bruijn graph, from the run of its first width - 1 words to that of its
last. The graph is far larger than the text, so it is partitioned by minimiser first: consecutive windows of a text
whose least hashed `anchor`-word gram is the same move as one row, by that gram, and equal windows meet there. Edges of
a single document are dropped; each other occurrence is sent to a source coordinate, a place in a document with a
smaller id. Then the graph of the repeated edges is compacted:

* Occurrences whose source places follow one another walk the source's text along one path of the graph. They are
  joined to walks (document, begin, length, source, place).
* A node of a source is branching (its in- or out-degree is above one) where some walk enters or leaves. Between two
  such nodes the path is nonbranching: one edge of the compacted graph, held once by its source coordinates. A join with
  the sources' branching nodes cuts the walks into occurrences of these paths.
* The words of each path, once at its source, and of each occurrence are read again at their coordinates and digested
  by SHA-256. A path is verified if all its digests are one. Windows on other paths, where hashes agreed by chance, are
  decided by their words among all windows of such hashes. Only then is a span removed.

Grams that crowd, as those of a passage in a third of all texts, are dealt to parts: edges with a smaller doc_id in their
part are decided there, and the few others meet once more, so no task takes in all that hangs on a gram.

Defined results: a null or short text has no windows and keeps its words; rows of one doc_id are one document, but each
row (doc_id and 64-bit hash of its text) has its own spans; rows with a null doc_id keep all and count for nothing; a
very long text is one row of any task that reads it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .cluster import cut, dealt, small_side

#: Bits by which windows on one gram are told apart before their words are compared.
EDGE_BITS = 32
#: The spans that are decided by their words are broadcast up to so many numbers.
FEW_NUMBERS = 2_000_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, code): code tells the rows of one doc_id apart."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("code", F.xxhash64("text"))


def paths(docs: DataFrame, width: int, anchor: int, text: str, doc_id: str) -> DataFrame:
    """(gram, doc_id, code, start, edges array<int>): runs of windows with one least gram, by their first word and the windows' hashes."""
    shift = np.uint64(64 - EDGE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(1)):
                starts, ends, at = vec.word_spans(buf, offs)
                n = len(starts)
                windows = np.maximum(np.diff(at) - width + 1, 0)
                if not windows.sum():
                    continue
                words = vec.word_hashes(buf, starts, ends)
                i = np.arange(n - anchor + 1)
                grams = _least(vec.run_hashes(words, i, i + anchor), width - anchor + 1)
                first = vec.spread(at[:-1], windows)  # the windows that stay within their text
                grams, edges = grams[first], (vec.run_hashes(words, first, first + width) >> shift).astype(np.uint32)
                doc = np.repeat(np.arange(len(windows)), windows)
                cuts = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))))
                own = pa.array(doc[cuts])
                ids, codes = (batch.column(j).slice(row, len(windows)).take(own) for j in (0, 2))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(grams)).astype(np.int32)), pa.array(edges.view(np.int32)))
                yield pa.record_batch([pa.array(grams[cuts].view(np.int64)), ids, codes, pa.array((first[cuts] - at[doc[cuts]]).astype(np.int32)), lists], ["gram", "doc_id", "code", "start", "edges"])

    return _rows(docs, text, doc_id).where("doc_id IS NOT NULL").mapInArrow(run, "gram long, doc_id long, code long, start int, edges array<int>")


def repeated_edges(docs: DataFrame, width: int, anchor: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, code, place, s, s_code, s_place): where windows start whose hashes also start at a place of a document s with a smaller id."""
    rows = dealt(paths(docs, width, anchor, text, doc_id), "gram", "doc_id")
    on_gram = Window.partitionBy("gram", "part")
    rows = rows.withColumn("low", F.min("doc_id").over(on_gram)).withColumn("high", F.max("doc_id").over(on_gram)).where("low < high OR crowd IS NOT NULL")
    edges = rows.select("gram", "part", "crowd", "doc_id", "code", "start", F.posexplode("edges").alias("i", "edge"))
    edges = edges.select("gram", "part", "crowd", "edge", "doc_id", "code", (F.col("start") + F.col("i")).alias("place"))

    def with_source(rows: DataFrame, *key: str) -> DataFrame:
        least = Window.partitionBy(*key).orderBy("doc_id", "code", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({"s": F.first("doc_id").over(least), "s_code": F.first("code").over(least), "s_place": F.first("place").over(least)})

    edges = with_source(edges, "gram", "part", "edge").where("s < doc_id OR crowd IS NOT NULL")
    # the least document of a crowded edge in its part meets those of the other parts; both branches read one shuffle
    rest = with_source(edges.where("s = doc_id").drop("s", "s_code", "s_place"), "gram", "edge")
    columns = ["doc_id", "code", "place", "s", "s_code", "s_place"]
    return edges.select(*columns).unionByName(rest.select(*columns)).where("s < doc_id")


def walks(edges: DataFrame) -> DataFrame:
    """(doc_id, code, place, n, s, s_code, s_place): n windows from a place on that are those from a place of s on."""
    ahead = (F.col("s_place") - F.col("place")).alias("ahead")
    runs = edges.groupBy("doc_id", "code", "s", "s_code", ahead).agg(F.collect_list("place").alias("places"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            values, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, owner))
            values, owner = values[order].astype(np.int64), owner[order]
            new = np.concatenate(([True], (np.diff(values) > 1) | (np.diff(owner) > 0)))[: len(values)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(values))[: len(first)] - 1
            ids = batch.take(pa.array(owner[first]))
            place = values[first]
            yield pa.record_batch([ids.column(0), ids.column(1), pa.array(place), pa.array(values[last] - place + 1), ids.column(2), ids.column(3), pa.array(place + ids.column(4).to_numpy())], ["doc_id", "code", "place", "n", "s", "s_code", "s_place"])

    return runs.mapInArrow(join, "doc_id long, code long, place long, n long, s long, s_code long, s_place long")


def branching(found: DataFrame) -> DataFrame:
    """(s, s_code, nodes array<bigint>): the nodes of each source where walks enter or leave; there are no more than its words."""
    ends = found.select("s", "s_code", F.explode(F.array("s_place", F.col("s_place") + F.col("n"))).alias("node")).distinct()
    return ends.groupBy("s", "s_code").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def nonbranching(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walks with own, the branching nodes of their source from their first to their last: between two of these lies an occurrence of one nonbranching path."""
    key = F.xxhash64("s", "s_code").alias("key")  # a second key, so that the walks of one source can be split over tasks
    met = found.select("*", key).join(nodes.select("*", key), ["key", "s", "s_code"]).drop("key")
    return met.withColumn("own", F.filter("nodes", lambda x: (x >= F.col("s_place")) & (x <= F.col("s_place") + F.col("n")))).drop("nodes")


def _pieces(nodes: str, shift: Column) -> Column:
    """Flat triples (place, windows, path) of the paths between nodes of the source (s, s_code)."""
    path = lambda a, b: F.xxhash64("s", "s_code", a, b)
    triple = lambda a, i: F.array(a + shift, F.get(nodes, i + 1) - a, path(a, F.get(nodes, i + 1)))
    return F.flatten(F.transform(F.slice(nodes, 1, F.size(nodes) - 1), triple))


def span_lists(found: DataFrame) -> DataFrame:
    """(doc_id, code, spans, own): flat triples (place, windows, path) of each row's occurrences of paths, and of those that have it as their source."""
    nodes = cut(branching(found))
    none = F.expr("cast(array() as array<bigint>)")
    spans = nonbranching(found, nodes).select("doc_id", "code", _pieces("own", F.col("place") - F.col("s_place")).alias("spans"), none.alias("own"))
    own = nodes.select(F.col("s").alias("doc_id"), F.col("s_code").alias("code"), none.alias("spans"), _pieces("nodes", F.lit(0)).alias("own"))
    both = spans.unionByName(own).groupBy("doc_id", "code")
    return both.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("own")).alias("own"))


def _normal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins; the last entry is the end."""
    size = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[vec.spread(at[:-1], size - 1)] = buf[vec.spread(starts, size - 1)]
    return out.tobytes(), at


def _with_lists(docs: DataFrame, lists: DataFrame, text: str, doc_id: str, how: str, few: bool = False) -> DataFrame:
    """Rows of docs with (doc_id, code, spans array<bigint>, ...). Texts and lists are shuffled by row, and the lists, which are the smaller, are hashed, so that texts needn't be sorted; few lists, where they are few numbers, are broadcast."""
    side = lists.hint("shuffle_hash")
    if few:
        arrays = [f for f in lists.columns if f not in ("doc_id", "code")]
        weight = lists.agg(F.sum(sum((F.size(c) for c in arrays), F.lit(4)))).first()[0] or 0
        side = F.broadcast(lists) if weight <= FEW_NUMBERS else side
    return _rows(docs, text, doc_id).join(side, ["doc_id", "code"], how)


def _flat(lists: pa.ListArray, row: int, docs: int, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """(which document, numbers) of each group of so many numbers in the lists of some documents; nulls are empty."""
    own = lists.slice(row, docs)
    per = np.nan_to_num(own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) // numbers
    return np.repeat(np.arange(docs), per), own.flatten().to_numpy().reshape(-1, numbers)


def read_again(docs: DataFrame, spans: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, code, place, digest): of the words of the window at each of spans (doc_id, code, place), joined by one space."""
    lists = cut(spans.groupBy("doc_id", "code").agg(F.collect_set("place").alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(2)):
                starts, ends, at = vec.word_spans(buf, offs)
                raw, where = _normal(buf, starts, ends)
                doc, place = _flat(batch.column(3), row, len(offs) - 1, 1)
                first = np.minimum(at[doc] + place[:, 0], at[doc + 1])
                last = np.minimum(first + width, at[doc + 1])
                digests = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(where[first].tolist(), where[last].tolist())]
                own = pa.array(doc + row)
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(place[:, 0]), pa.array(digests, pa.binary())], ["doc_id", "code", "place", "digest"])

    rows = _with_lists(docs, lists, text, doc_id, "inner", few=True).select("doc_id", "code", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, code long, place long, digest binary")


def decided_by_words(docs: DataFrame, doubtful: DataFrame, width: int, anchor: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, code, place): windows that repeat, among all those whose hashes are those of windows on doubtful (doc_id, code, place, n)."""
    windows = doubtful.select("doc_id", "code", F.explode(F.sequence(F.col("place").cast("int"), (F.col("place") + F.col("n") - 1).cast("int"))).alias("place")).distinct()
    every = paths(docs, width, anchor, text, doc_id).select("gram", "doc_id", "code", "start", F.posexplode("edges").alias("i", "edge")).select("gram", "edge", "doc_id", "code", (F.col("start") + F.col("i")).alias("place"))
    keys = cut(every.join(small_side(windows, windows.count()), ["doc_id", "code", "place"], "left_semi").select("gram", "edge").distinct())
    places = every.join(small_side(keys, keys.count()), ["gram", "edge"], "left_semi").select("doc_id", "code", F.col("place").cast("long").alias("place"))
    read = cut(read_again(docs, places, width, text, doc_id).distinct())
    least = read.groupBy("digest").agg(F.min("doc_id").alias("least"))
    return read.join(least, "digest").where("doc_id > least").select("doc_id", "code", "place")


def remove_repeats(docs: DataFrame, width: int = 13, anchor: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row; the words that stay are joined by one space."""
    lists = cut(span_lists(cut(walks(repeated_edges(docs, width, anchor, text, doc_id)))))
    # texts aren't written: the digests are taken first, then the texts are cut
    read = cut(_apply(docs, lists, width, text, doc_id, None))
    if other := _decided(docs, lists, read, width, anchor, text, doc_id):
        lists = lists.join(other, ["doc_id", "code"], "left_anti").unionByName(other)
    return _apply(docs, lists, width, text, doc_id, "kept_text").select("doc_id", "n_words", "n_removed", "kept_text")


def repeat_digest(docs: DataFrame, width: int = 13, anchor: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    lists = cut(span_lists(cut(walks(repeated_edges(docs, width, anchor, text, doc_id)))))
    read = cut(_apply(docs, lists, width, text, doc_id, "kept_sha256"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if other := _decided(docs, lists, read, width, anchor, text, doc_id):
        again = _apply(docs, other, width, text, doc_id, "kept_sha256", few=True)
        rows = other.select("doc_id", "code")
        read = read.join(small_side(rows, rows.count()), ["doc_id", "code"], "left_anti").select(*columns).unionByName(again.select(*columns))
    return read.select(*columns)


def _decided(docs: DataFrame, lists: DataFrame, read: DataFrame, width: int, anchor: int, text: str, doc_id: str) -> DataFrame | None:
    """None if read (paths, digests) verifies all paths, else the new lists of those rows that lie on another path or whose windows there repeat."""
    each = read.select(F.explode(F.arrays_zip("paths", "digests")).alias("x")).select(F.col("x.paths").alias("path"), F.col("x.digests").alias("digest"))
    wrong = cut(each.groupBy("path").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("path"))
    n = wrong.count()
    if not n:
        return None
    triples = F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(3)), lambda i: F.struct(F.get("spans", i).alias("place"), F.get("spans", i + 1).alias("n"), F.get("spans", i + 2).alias("path")))
    spans = lists.where(F.size("spans") > 0).select("doc_id", "code", F.explode(triples).alias("x")).select("doc_id", "code", "x.*")
    doubtful = cut(spans.join(small_side(wrong, n), "path", "left_semi"))
    again = cut(decided_by_words(docs, doubtful, width, anchor, text, doc_id).withColumns({"n": F.lit(1).cast("long"), "path": F.lit(0).cast("long")}))
    rows = cut(doubtful.select("doc_id", "code").unionByName(again.select("doc_id", "code")).distinct())
    kept = spans.join(small_side(wrong, n), "path", "left_anti").join(small_side(rows, rows.count()), ["doc_id", "code"], "left_semi").unionByName(again)
    new = kept.groupBy("doc_id", "code").agg(F.flatten(F.collect_list(F.array("place", "n", "path"))).alias("spans"))
    none = F.expr("cast(array() as array<bigint>)")
    return cut(rows.join(new, ["doc_id", "code"], "left").select("doc_id", "code", F.coalesce("spans", none).alias("spans"), none.alias("own")))


def _apply(docs: DataFrame, lists: DataFrame, width: int, text: str, doc_id: str, name: str | None, few: bool = False) -> DataFrame:
    """(doc_id, code, n_words, n_removed, name: the text without the spans or its sha256, paths, digests) of each row of docs, with few only of those in lists, and of all its spans and own paths the digest of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in vec.chunks(batch.column(1)):
                starts, ends, at = vec.word_spans(buf, offs)
                docs = len(offs) - 1
                doc, spans = _flat(batch.column(2), row, docs, 3)
                raw, where = _normal(buf, starts, ends)
                begin = np.minimum(at[doc] + spans[:, 0], at[doc + 1])
                end = np.minimum(begin + spans[:, 1] + width - 1, at[doc + 1])
                out = [batch.column(0).slice(row, docs), batch.column(4).slice(row, docs), pa.array(np.diff(at))]
                if name:
                    edge = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, end, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
                    kept, spot = _normal(buf, starts[stay], ends[stay])
                    to = np.searchsorted(stay, at)
                    texts = [kept[a : max(a, b - 1)] for a, b in zip(spot[to[:-1]].tolist(), spot[to[1:]].tolist())]
                    texts = [hashlib.sha256(t).hexdigest() for t in texts] if name == "kept_sha256" else [t.decode() for t in texts]
                    out += [pa.array(np.diff(at) - np.diff(to)), pa.array(texts, pa.string())]
                if name != "kept_text":
                    more, own = _flat(batch.column(3), row, docs, 3)
                    first = np.minimum(at[more] + own[:, 0], at[more + 1])
                    last = np.minimum(first + own[:, 1] + width - 1, at[more + 1])
                    of = np.concatenate((doc, more))
                    order = np.argsort(of, kind="stable")
                    a, b = np.concatenate((begin, first))[order], np.concatenate((end, last))[order]
                    digests = [hashlib.sha256(raw[x:y]).digest()[:16] for x, y in zip(where[a].tolist(), where[b].tolist())]
                    bounds = pa.array(np.searchsorted(of[order], np.arange(docs + 1)).astype(np.int32))
                    out += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate((spans[:, 2], own[:, 2]))[order])), pa.ListArray.from_arrays(bounds, pa.array(digests, pa.binary()))]
                yield pa.record_batch(out, names)

    schema = {"doc_id": "long", "code": "long", "n_words": "long"} | ({"n_removed": "long", name: "string"} if name else {}) | ({"paths": "array<long>", "digests": "array<binary>"} if name != "kept_text" else {})
    names = list(schema)
    rows = _with_lists(docs, lists, text, doc_id, "inner" if few else "left", few).select("doc_id", "text", "spans", "own", "code")
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in schema.items()))
