"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, hard_negatives, html_text, language, licenses, merkle, mixing, ngram_join, quality, substring_dedup, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Python workers that start from now on find this package also where it isn't installed but lies beside its caller."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, *paths) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, ranker).withColumn("held_out", quality.is_held_out()).select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digest(table(spark, sf_dir, "documents"), width=13)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).withColumn("held_out", quality.is_held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows.where("vec_id % 20 = 0"), rows, k=20)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, weights=html_text.fit(pages))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    folded = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.audit(merkle.build(docs, changed={"text": F.when(tampered, folded).otherwise(F.col("text"))}))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_join, op2_exact_dedup, op3_byte_bpe, op4_quality, op5_substring_dedup, op6_language, op7_mixing, op8_licenses, op9_permutation_index, op10_html_text, op11_hard_negatives, op12_merkle_manifest, op13_word_bpe)
    return {f.__name__: f for f in found}


#: Texts are folded by A-Z only, so translate() stands where lower() would also fold other letters.
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"


def _mixing_sql() -> str:
    """Every quotient of every party is ranked, as many as there are seats, where the operator ranks those between two divisors."""
    return f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
        t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2::DOUBLE * source_size AS cap FROM t),
        r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
                     (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
              FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, cap <= rate * w AS filled FROM r),
        g AS (SELECT source, source_size, filled, CASE WHEN filled THEN cap ELSE (SELECT rate FROM f WHERE NOT filled ORDER BY k LIMIT 1) * w END AS target FROM f),
        size AS (SELECT greatest(1, least({mixing.BLOCK_TOKENS}, floor(sum(target) / {mixing.LEAST_BLOCKS})))::BIGINT AS block FROM g),
        seats AS (SELECT round(coalesce(sum(target) FILTER (NOT filled), 0) / any_value(block))::BIGINT AS n FROM g, size),
        quotients AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) AS place
                      FROM (SELECT source, target, unnest(range(0, n)) AS j FROM g, seats WHERE NOT filled)),
        blocks AS (SELECT source, count(*) FILTER (place <= n) AS blocks FROM quotients, seats GROUP BY source),
        s AS (SELECT g.*, coalesce(blocks, 0) AS blocks, greatest(1, ceil(g.source_size / {mixing.SHARD_TOKENS}))::BIGINT AS shards FROM g LEFT JOIN blocks b ON g.source IS NOT DISTINCT FROM b.source),
        rows AS (SELECT d.*, source_size, target, filled, blocks, ('0x' || substr(code, 1, 8))::BIGINT % shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        shards AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(blocks) AS blocks, any_value(filled) AS filled, any_value(source_size) AS source_size FROM rows GROUP BY source, shard),
        shard_quotients AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * j + 1) DESC, shard, j) AS place
                            FROM (SELECT *, unnest(range(0, blocks)) AS j FROM shards WHERE shard_size > 0)),
        won AS (SELECT source, shard, count(*) FILTER (place <= blocks) AS quota FROM shard_quotients GROUP BY source, shard),
        quotas AS (SELECT a.source, a.shard, shard_size, CASE WHEN filled THEN 2 * shard_size ELSE least(coalesce(quota, 0) * block, 2 * shard_size) END AS quota
                   FROM size, shards a LEFT JOIN won b ON a.source IS NOT DISTINCT FROM b.source AND a.shard = b.shard),
        laid AS (SELECT r.*, shard_size, quota, coalesce(sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY code, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
                 FROM rows r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard)
        SELECT doc_id, size, source_size, target, (greatest(0, least(size, quota - before)) + greatest(0, least(size, quota - shard_size - before)))::BIGINT AS taken FROM laid"""


def _licenses_sql() -> str:
    """Base phrases by their words, and every begin of every notice by joins over numbered words: no lookup is spared, as the operator does by IDF."""
    notices = ", ".join(f"('{label}', '{notice}', '{key}', {licenses.needed(notice)})" for label, (notice, key) in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{label}', '{p}', {len(p.split())})" for p, label in licenses.BASE.items())
    return f"""
        WITH notices(label, notice, key, needed) AS (VALUES {notices}), phrases(label, phrase, n) AS (VALUES {phrases}),
        post AS (SELECT label, unnest(string_split(notice, ' ')) AS word, unnest(range(0, len(string_split(notice, ' ')))) AS at_ FROM notices),
        d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        w AS (SELECT id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM d),
        hits AS (SELECT d.id, label, i FROM d, phrases, unnest(range(0, len(words))) r(i) WHERE list_contains(words, string_split(phrase, ' ')[1]) AND array_to_string(words[i + 1:i + n], ' ') = phrase),
        base AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS base_list FROM hits GROUP BY id),
        begins AS (SELECT id, label, i - at_ AS b, count(*) AS n FROM w JOIN post USING (word) GROUP BY ALL),
        aligned AS (SELECT id, label, max(begins.n) AS n FROM begins JOIN notices USING (label) JOIN d USING (id)
                    WHERE begins.n >= needed AND contains(' ' || array_to_string(words[greatest(b, 0) + 1:b + len(string_split(notice, ' '))], ' ') || ' ', ' ' || key || ' ') GROUP BY id, label),
        own AS (SELECT id, list(label) AS own_list, sum(n)::BIGINT AS strength FROM aligned GROUP BY id),
        x AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
                     list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(own_list, [])))) AS all_labels, coalesce(n_base, 0) + coalesce(strength, 0) AS weight
              FROM d LEFT JOIN base USING (id) LEFT JOIN own USING (id))
        SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, array_to_string(all_labels, ',') AS labels, weight / (weight + 1)::DOUBLE AS score FROM x"""


def _merkle_tree_sql(name: str, levels: int) -> str:
    """CTEs {name}1, {name}2, ... over {name}0 (tree, i, n, d), a level each while a tree has several nodes, and {name}_runs: the nodes of each run."""
    steps = [f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16, n)" for k in range(levels)]
    runs = " UNION ALL ".join(f"SELECT {k} AS level, tree, i // 16 AS run, list(d ORDER BY i) AS ds FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16" for k in range(levels))
    top = " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*steps, f"{name}_runs AS ({runs})", f"{name}_top AS ({top})"])


def _merkle_steps_sql(name: str, before: str, after: str, levels: int, i: str, tree: str) -> str:
    """CTEs that fold `now` of the rows of `before` up the levels of a tree and gather the siblings on the way."""
    out = []
    for k in range(levels):
        place = f"({i} // {16**k}) % 16"
        left, right = f"array_to_string(ds[1:{place}], '')", f"array_to_string(ds[{place} + 2:], '')"
        out.append(f"{after if k == levels - 1 else f'{after}{k}'} AS (SELECT b.* EXCLUDE (now, proof), CASE WHEN ds IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now, proof || CASE WHEN ds IS NULL THEN '' ELSE {left} || {right} END AS proof FROM {before if k == 0 else f'{after}{k - 1}'} b LEFT JOIN {name}_runs r ON r.level = {k} AND r.tree IS NOT DISTINCT FROM {tree} AND r.run = {i} // {16 ** (k + 1)})")
    return ", ".join(out)


def _merkle_sql(levels: int = 8) -> str:
    """All levels of both trees (up to 16 ** levels rows of a source, and sources), none left out; CRC-32 bit by bit."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    row = " || ".join(value(c) for c in merkle.COLUMNS[:-1])
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(id) + 1), lambda p: ascii(id[p])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
        WITH d AS (SELECT doc_id, source, sha256({row} || {value("text")}) AS leaf, sha256({row} || {value("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lower, doc_id::VARCHAR AS id FROM documents),
        leaves AS (SELECT doc_id, source AS tree, leaf, CASE WHEN {crc} % 5 = 0 THEN lower ELSE leaf END AS now, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n
                   FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
        a0 AS (SELECT tree, i, n, leaf AS d FROM leaves), {_merkle_tree_sql("a", levels)},
        sources AS (SELECT tree AS source, d AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM a_top),
        b0 AS (SELECT 0 AS tree, j AS i, n, subroot AS d FROM sources), {_merkle_tree_sql("b", levels)},
        s0 AS (SELECT doc_id, leaf, now, i, l.tree, subroot, j, 0 AS top, '' AS proof FROM leaves l JOIN sources s ON l.tree IS NOT DISTINCT FROM s.source),
        {_merkle_steps_sql("a", "s0", "up", levels, "i", "b.tree")}, {_merkle_steps_sql("b", "up", "whole", levels, "j", "b.top")}
        SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = d AS verified FROM whole, b_top"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mixing": _mixing_sql(),
        "op8_licenses": _licenses_sql(),
        "op12_merkle_manifest": _merkle_sql(),
        "op11_hard_negatives": """
            WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
                  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
            WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""",
        "op1_ngram_join": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, {WORD}) AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                         ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
            link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
            ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
            reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
            least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id""",
        "op2_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {FOLD} AS folded FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY folded)""",
        "op5_substring_dedup": f"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
            win AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, array_to_string(words[i:i + 12], ' ') AS win FROM w),
            again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM win) WHERE least < doc_id),
            gone AS (SELECT doc_id, list(DISTINCT i + k) AS spots FROM again, range(0, 13) r(k) GROUP BY doc_id),
            kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(spots), 0) AS n_removed,
                            list_transform(list_filter(range(1, len(words) + 1), lambda p: spots IS NULL OR NOT list_contains(spots, p)), lambda p: words[p]) AS stay
                     FROM w LEFT JOIN gone USING (doc_id))
            SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(stay, ' '), '')) AS kept_sha256 FROM kept""",
    }
