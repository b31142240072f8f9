"""Plain-Python versions of the operators, and odd rows that all of them must take."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def odd_documents(n=70, seed=0):
    """Rows with nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(seed)
    rows = [(-1, None, None, None), (-2, "", "en", "a"), (-3, " \n\t", "en", None), (-4, "One", "en", "a"), (-5, "ONE", "en", "b"), (-6, "one é", "fr", "b"), (-6, "one é", "fr", "b"), (None, "no id at all here", "en", "a")]
    rows.append((-7, " ".join(f"long{rng.randrange(3000)}" for _ in range(30_000)), "en", "c"))
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(80)}"
        else:
            w = [f"w{rng.randrange(80)}" for _ in range(rng.choice([1, 3, 7, 9, 12, 14, 25, 60]))]
        texts.append(" ".join(w))
        rows.append((i, texts[-1].capitalize() if rng.random() < 0.2 else texts[-1], rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    return rows


#: Extra columns whose names clash with those that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, size long, score double, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 0.5, 7, "x") for r in rows], SCHEMA)


def components(rows, k, num, den):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = []
    for _, text, *_ in rows:
        w = words(fold(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o) or rows[i][0] == rows[j][0]:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)}
