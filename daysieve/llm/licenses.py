"""License scans by a positional index of rare tokens; DataFrame functions only.

Base labels are phrases whose words stand consecutively. Further labels come from templates, short license notices,
whose words are postings (word -> template, position). A notice is aligned where at least AGREE of its words stand at
one distance from their positions in it, and it is labelled if its mandatory key phrase stands within that alignment.
Of each template only the words with the highest IDF over all documents are looked up: all but its AGREE - 1 commonest
postings, since any alignment of AGREE words holds one of the others. So common words start no lookup, and yet no notice
is missed, however many a text holds and whatever the other texts are.

Texts are split into words once. What is kept of them is which template words they hold, and the words themselves only
where all words of some phrase occur; document frequencies (a row for each template word) and alignments come from that.
All matching happens within a row, so no text is shuffled; it takes time in proportion to the text.

Defined results: a null or empty text has no words, no labels and score 0; first_word and last_word are null without a
base phrase; a null doc_id stays null; repeated rows are answered alike; a very long text is matched whole; other
columns are ignored; an empty table gives an empty result. The score is w / (w + 1), w the number of base phrases and,
for each label of a template, of the words that agree in its best alignment.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut

#: Runs of ASCII letters and digits and of everything beyond ASCII (a positive class: negated ones are ten times slower).
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Phrases and the labels that they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as their licences give them, shortened, with the phrase that must be there.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "bsl-1.0": ("distributed under the boost software license version 1 0", "boost software license"),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial license cc by nc 4 0", "cc by nc"),
    "cc-by-nd": ("this work is licensed under a creative commons attribution noderivatives license cc by nd 4 0", "cc by nd"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike license cc by sa 4 0", "cc by sa"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal public domain dedication", "public domain dedication"),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3 as published by the free software foundation", "general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "lesser general public license"),
    "mit": ("released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "ofl-1.1": ("this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released into the public domain"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
}
#: How many words of a notice (all of a shorter one) must stand at their distances from one another.
AGREE = 4


def words_of(text: Column) -> Column:
    """The words of text, A-Z lower-cased and no other letter; lower() is the faster way to that where all is ASCII."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def needed(notice: str) -> int:
    return min(AGREE, len(notice.split()))


def anchors(templates: dict[str, tuple[str, str]], idf: dict[str, float]) -> dict[str, list[tuple[str, int]]]:
    """word -> (label, position): of each notice all postings but the needed - 1 of the least IDF."""
    found: dict[str, list[tuple[str, int]]] = {}
    for label, (notice, _) in sorted(templates.items()):
        postings = sorted(((-idf[w], w, i) for i, w in enumerate(notice.split())))
        for _, w, i in postings[: len(postings) - needed(notice) + 1]:
            found.setdefault(w, []).append((label, i))
    return found


def held_words(docs: DataFrame, base: dict[str, str], templates: dict[str, tuple[str, str]], text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_words, held, joined): the words of phrases and notices that a text holds, and all its words if those of some phrase are among them."""
    phrases = sorted({*base, *(key for _, key in templates.values())})
    vocabulary = sorted({w for p in (*phrases, *(notice for notice, _ in templates.values())) for w in p.split()})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _strings(vocabulary)).alias("held"), "words")
    some = F.lit(False)
    for p in phrases:
        some = some | F.forall(_strings(sorted(set(p.split()))), lambda w: F.array_contains("held", w))
    return cut(rows.select("doc_id", "n_words", "held", F.when(some, F.array_join("words", " ")).alias("joined")))


def word_idf(held: DataFrame, words: set[str]) -> dict[str, float]:
    """The IDF of each of words over all documents: held (held array<string>) has a row for each."""
    n = held.count()
    df = {r.word: r["count"] for r in held.select(F.explode("held").alias("word")).groupBy("word").count().collect()}  # a row for each word of the phrases and notices at most
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in words}


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, str]] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    rows = held_words(docs, base, templates, text, doc_id)
    idf = word_idf(rows, {w for notice, _ in templates.values() for w in notice.split()}) if templates else {}
    index = anchors(templates, idf)
    firsts = sorted({p.split()[0] for p in base})
    # the few places where something may begin; all further steps look at these only
    rows = rows.withColumn("words", F.split("joined", " "))
    looked_up = sorted({*firsts, *index})
    none = F.expr("cast(array() as array<int>)")
    spots = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(looked_up), i))) if looked_up else none
    rows = rows.withColumn("spots", F.coalesce(spots, none))
    rows = rows.withColumns({f"hit{j}": F.filter("spots", _phrase_at(p.split())) for j, p in enumerate(base)})
    starts = F.concat(none, *[F.col(f"hit{j}") for j in range(len(base))])
    named = F.array_compact(F.array(*[F.when(F.size(f"hit{j}") > 0, F.lit(label)) for j, label in enumerate(base.values())])) if base else _strings([])
    verified, strength = _strings([]), F.lit(0)
    if templates:
        rows = rows.withColumn("begins", F.array_distinct(_begins(index)))
        rows = rows.withColumn("aligned", F.filter(F.transform("begins", _agreement(templates)), lambda a: a["label"].isNotNull()))
        verified = F.array_distinct(F.transform("aligned", lambda a: a["label"]))
        strength = sum((_best("aligned", label) for label in sorted(templates)), F.lit(0))
    n_base = F.size(starts).cast("long")
    weight = n_base + strength
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, verified))), ",").alias("labels"),
        (weight / (weight + 1)).cast("double").alias("score"),
    )


def _begins(index: dict[str, list[tuple[str, int]]]) -> Column:
    """(label, begin): where the postings of the words at spots would have their notices begin."""
    table = F.create_map(*[x for w, p in sorted(index.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("at")) for label, i in p]))])
    none = F.expr("cast(array() as array<struct<label: string, at: int>>)")
    return F.flatten(F.transform("spots", lambda i: F.transform(F.coalesce(F.try_element_at(table, F.get("words", i)), none), lambda p: F.struct(p["label"].alias("label"), (i - p["at"]).alias("begin")))))


def _agreement(templates: dict[str, tuple[str, str]]):
    """(label, agree) of a begin: how many words of the notice stand in their places; null if too few, or if the key phrase isn't among the words there."""
    of = lambda value: F.create_map(*[x for label, t in sorted(templates.items()) for x in (F.lit(label), value(t))])
    notices, keys, least = of(lambda t: _strings(t[0].split())), of(lambda t: F.lit(f" {t[1]} ")), of(lambda t: F.lit(needed(t[0])))

    def at(b: Column) -> Column:
        notice = F.element_at(notices, b["label"])
        agree = F.size(F.filter(notice, lambda w, j: F.coalesce(F.get("words", b["begin"] + j) == w, F.lit(False))))
        window = F.slice("words", F.greatest(b["begin"], F.lit(0)) + 1, F.size(notice) + F.least(b["begin"], F.lit(0)))
        there = F.contains(F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" ")), F.element_at(keys, b["label"]))
        return F.struct(F.when((agree >= F.element_at(least, b["label"])) & there, b["label"]).alias("label"), agree.alias("agree"))

    return at


def _best(aligned: str, label: str) -> Column:
    own = F.filter(aligned, lambda a: a["label"] == label)
    return F.coalesce(F.array_max(F.transform(own, lambda a: a["agree"])), F.lit(0))


def _phrase_at(phrase: list[str]):
    """Whether the words of phrase stand from a place on."""

    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(phrase):
            same = same & (F.get("words", i + k) == F.lit(w))
        return F.coalesce(same, F.lit(False))

    return at
