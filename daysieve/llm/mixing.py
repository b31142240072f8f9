"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

A source's target is its weight's share of the mix, at most `most_copies` times what it has; the excess goes to the
others by weight (water filling: sources in order of cap by weight, running sums, no loop). The mix is counted in
blocks of equal tokens, BLOCK_TOKENS or so many that there are LEAST_BLOCKS at least. Sources at their cap are taken
whole; the blocks of the rest go to the other sources by the highest quotients target / (2k + 1), then to groups of a source's shards and at last to shards of about `shard_tokens` by the
same rule, FAN parties at a time, so however many shards a hot source has, no task ranks them all. Every shard has an
integer quota and fills it alone: its documents, in an order seeded by md5, are laid end to end, at most `most_copies`
times, and the first quota * block tokens are taken. Of a document that a quota ends in, only the first words are taken.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source, after all others; a null
doc_id is an id; repeated rows are documents of their own, ordered among themselves by size and text; a very long text
may exceed a shard's size, which then holds little else; other columns are ignored; an empty table gives an empty
result; if all sizes are 0, all targets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a block, of fewer if the mix has fewer than LEAST_BLOCKS of them.
BLOCK_TOKENS = 16
LEAST_BLOCKS = 4096
#: Shards, or groups of them, that seats are dealt to at a time.
FAN = 1024
#: About so many tokens of one source are a shard.
SHARD_TOKENS = 65_536
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_copies: int) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size); weights go to sources by code point, null last, repeating."""
    everything = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((order - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * most_copies)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", left / weight_left).withColumn("full", F.col("cap") <= F.col("rate") * F.col("weight"))
    # once one source isn't full, none after it is; the rate of all of them is that of the first
    rows = rows.withColumn("need", F.when(~F.col("full"), F.row_number().over(by_need)))
    rate = F.min_by("rate", "need").over(everything)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(rate * F.col("weight")).alias("target"), F.col("full"))


def apportion(parties: DataFrame, by: list[str], weight: str, seats: str, order: str) -> DataFrame:
    """parties with `quota`: within each group of columns by, its `seats` go to the highest weight / (2k + 1); ties to the first in order.

    Of n parties with seats s in all, a divisor of (sum of weights) / (s + n / 2) gives s seats at least, as no share loses
    more than a half, and one of (sum of weights) / (s - n / 2) gives s at most. Quotients above the second win without
    being ranked, those below the first lose; what lies between are about two quotients a party, however skewed weights are.
    """
    group = Window.partitionBy(*by)
    rows = parties.where(F.col(weight) > 0).withColumn("__sum", F.sum(weight).over(group)).withColumn("__half", F.count("*").over(group) / 2)
    share = lambda of: F.col(weight) * of / F.col("__sum")
    # a seat more on both sides, as shares are rounded floats
    rows = rows.withColumn("__base", F.greatest(F.lit(0).cast("long"), F.floor(share(F.col(seats) - F.col("__half")) + 0.5).cast("long") - 1))
    rows = rows.withColumn("__top", F.ceil(share(F.col(seats) + F.col("__half")) + 0.5).cast("long") + 1)
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__base").over(group))
    asked = rows.withColumn("__k", F.explode(F.sequence(F.col("__base"), F.col("__top"))))
    rank = F.row_number().over(group.orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc(), F.col(order).asc_nulls_last(), "__k"))
    won = asked.withColumn("__won", (rank <= F.col("__left")).cast("long"))
    keys = [*by, order]
    won = won.groupBy(*dict.fromkeys(keys)).agg((F.first("__base") + F.sum("__won")).alias("quota"))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in dict.fromkeys(keys)]
    return parties.alias("p").join(won.alias("q"), on, "left").select("p.*", F.coalesce("q.quota", F.lit(0)).cast("long").alias("quota"))


def shard_quotas(shards: DataFrame, most: int, fan: int) -> DataFrame:
    """shards (source, shard, shard_size, blocks) with quota: each source's blocks go to groups of fan ** level consecutive shards, these groups' to smaller ones, and so on; most is the largest number of shards of a source."""
    levels = 1
    while fan**levels < most:
        levels += 1
    seats = shards.groupBy("source").agg(F.first("blocks").alias("seats")).select(F.col("source").alias("__source"), F.lit(0).cast("long").alias("__of"), "seats")
    for level in reversed(range(levels)):
        group = F.floor(F.col("shard") / fan**level).cast("long")
        parties = shards.groupBy("source", group.alias("group")).agg(F.sum("shard_size").alias("size")).withColumn("of", F.floor(F.col("group") / fan) if level < levels - 1 else F.lit(0).cast("long"))
        parties = parties.join(seats, F.col("source").eqNullSafe(F.col("__source")) & (F.col("of") == F.col("__of"))).drop("__source", "__of")
        quotas = cut(apportion(parties, ["source", "of"], "size", "seats", "group"))
        seats = quotas.select(F.col("source").alias("__source"), F.col("group").alias("__of"), F.col("quota").alias("seats"))
    return shards.join(seats, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__of"))).select(*shards.columns, F.col("seats").alias("quota"))


def _laid(docs: DataFrame, keep: list[str], weights: tuple[float, ...], share: float, most_copies: int, block: int, shard_tokens: int, seed: str, fan: int, text: str, doc_id: str, source: str) -> DataFrame:
    """The columns keep of docs with __doc, __size, __source_size, __target and __taken of each row."""
    sized = docs.select(*keep, F.col(doc_id).cast("long").alias("__doc"), F.col(source).cast("string").alias("__source"), n_words(F.col(text)).alias("__size"), F.xxhash64(F.col(text).cast("string")).alias("__tie"))
    sized = sized.withColumn("__code", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__doc").cast("string"), F.lit(""))).cast("binary")))
    # without other columns the rows are small: they are written once; with them the texts are counted twice rather than written
    rows = sized if keep else cut(sized)
    sources = cut(targets(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), weights, share, most_copies))
    known = sources.agg(F.count("*").alias("n"), F.sum("target").alias("total"), F.sum(F.when(~F.col("full"), F.col("target"))).alias("open")).first()
    n = known.n
    if not n:
        return rows.select(*keep, "__doc", "__size", F.lit(0).cast("long").alias("__source_size"), F.lit(0.0).alias("__target"), F.lit(0).cast("long").alias("__taken"))
    block = max(1, min(block, int((known.total or 0.0) / LEAST_BLOCKS)))
    # full sources are taken whole; only what the others share is dealt in blocks
    seats = sources.withColumn("seats", F.lit(round((known.open or 0.0) / block)).cast("long")).withColumn("open", F.when(F.col("full"), 0.0).otherwise(F.col("target")))
    seats = apportion(seats, [], "open", "seats", "source").withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_tokens)))
    seats = cut(seats.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("full").alias("__full"), F.col("quota").alias("__blocks"), F.col("shards").alias("__shards")))
    most = seats.agg(F.max("__shards")).first()[0]
    rows = rows.join(small_side(seats, n), F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__shard", F.conv(F.substring("__code", 1, 8), 16, 10).cast("long") % F.col("__shards"))
    shards = cut(rows.groupBy(F.col("__source").alias("source"), F.col("__shard").alias("shard")).agg(F.sum("__size").alias("shard_size"), F.first("__blocks").alias("blocks"), F.first("__full").alias("full")))
    shards = shard_quotas(shards, most, fan)
    cap = F.col("shard_size") * most_copies
    shards = cut(shards.select(F.col("source").alias("__in"), F.col("shard").alias("__part"), F.col("shard_size").alias("__shard_size"), F.when(F.col("full"), cap).otherwise(F.least(F.col("quota") * block, cap)).alias("__quota")))
    rows = rows.join(small_side(shards, shards.count()), F.col("__source").eqNullSafe(F.col("__in")) & (F.col("__shard") == F.col("__part")))
    laid = Window.partitionBy("__source", "__shard").orderBy("__code", F.col("__doc").asc_nulls_first(), "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__size").over(laid), F.lit(0)))
    none = F.lit(0).cast("long")
    taken = sum((F.greatest(none, F.least(F.col("__size"), F.col("__quota") - c * F.col("__shard_size") - F.col("__before"))) for c in range(most_copies)), none)
    return rows.select(*keep, "__doc", "__size", "__source_size", "__target", taken.alias("__taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED, fan: int = FAN, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs."""
    rows = _laid(docs, [], weights, share, most_copies, block, shard_tokens, seed, fan, text, doc_id, source)
    return rows.toDF("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED, fan: int = FAN, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of the mix with all columns of docs: a row stands in it as often as mix() takes it, the last time with its first words, joined by a space, if only those are taken."""
    rows = _laid(docs, docs.columns, weights, share, most_copies, block, shard_tokens, seed, fan, text, doc_id, source).where("__taken > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__taken") - 1) / F.col("__size")))))
    words = F.col("__taken") - F.col("__copy") * F.col("__size")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    return rows.withColumn(text, F.when(words >= F.col("__size"), F.col(text)).otherwise(head)).select(*docs.columns)
