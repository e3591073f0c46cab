"""Mix sources to target weights by capped water-filling.

Every source asks for its share of the mix by weight. A source that would be read more than
``max_epochs`` times is clamped there and what it leaves is shared among the others by weight, again
and again until no target is above its cap. A target is met by whole repetitions of the source and
one fraction: documents in a seeded order until the rest is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import ranked, saved, word_count

SEED = 7
# Hex digits of the seeded order that cut a source into blocks; only the block of the cut is sorted.
BLOCK_DIGITS = 3


def order_key(key: Column, seed: int = SEED) -> Column:
    """Seeded place of a document within its source; documents of one id share it."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give ``sources`` (distinct ``source``) weights in turn, by code point, null last."""
    numbered = ranked(sources, [F.col("source").asc_nulls_last()], "place")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return numbered.withColumn("weight", pick).drop("place")


def fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: as much of ``total`` as the caps allow.

    Two sums per round reach the driver. Sources without a weight, or with one of zero or less, get nothing.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    level, before = 0.0, -1.0
    while level != before:
        before = level
        clamped = cap <= weight * F.lit(level)
        at_cap, free = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0.0))
        ).first()
        if not free:
            return sources.withColumn("target", F.when(weight > 0, cap).otherwise(F.lit(0.0)))
        level = max(level, (total - at_cap) / free)
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, place``: the narrow table that the mix is planned on."""
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order_key(F.col(key), seed).alias("place")
    )


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source: ``source, source_size, target, whole`` repetitions, and ``cut``.

    Documents whose place is at most ``cut`` are taken once more than ``whole``. The cut comes as
    near to the target as a document allows. Sizes of blocks of the seeded order are summed first,
    so that only the block that holds the cut is ordered, whatever the source's size.
    """
    sums = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filled = fill(saved(cyclic_weights(sums, weights)), share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = saved(filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    block = F.substring("place", 1, BLOCK_DIGITS)
    blocks = sized.groupBy("source", block.alias("block")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = (
        blocks.alias("b")
        .join(filled.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .filter("b.base < s.rest")
        .groupBy("s.source", "s.rest")
        .agg(F.max(F.struct("b.block", "b.base")).alias("at"))
        .select("source", "rest", "at.block", "at.base")
    )
    within = sized.alias("d").join(
        last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.substring("d.place", 1, BLOCK_DIGITS) == F.col("l.block"))
    )
    places = within.groupBy("l.source", "l.rest", "l.block", "l.base", "d.place").agg(F.sum("d.size").alias("n"))
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") / 2
    cuts = places.withColumn("fits", so_far <= F.col("rest")).groupBy("source", "block").agg(F.max(F.when(F.col("fits"), F.col("place"))).alias("cut"))
    cuts = cuts.select(F.col("source").alias("cut_source"), F.coalesce("cut", "block").alias("cut"))
    joined = filled.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return joined.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def copies(place: Column) -> Column:
    """How often a document is taken, beside the columns of its source's plan."""
    return (F.col("whole") + F.when(place <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix(
    docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, text: str = "text", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row: its words, its source's, and those the mix takes.

    Null sources are one source, after all others; null texts have no words; rows of one id are
    taken alike. Null ids share one place. An empty table gives no rows.
    """
    sized = saved(sizes(docs, text, source, key))
    planned = saved(plan(sized, weights, share, max_epochs))
    rows = sized.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return rows.select("d.doc_id", "d.size", "p.source_size", "p.target", (copies(F.col("d.place")) * F.col("d.size")).alias("taken"))


def sampled(
    docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, text: str = "text", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken. Texts are not shuffled unless sources are too many to broadcast."""
    planned = saved(plan(saved(sizes(docs, text, source, key)), weights, share, max_epochs)).select(F.struct("source", "whole", "cut").alias("__plan"))
    rows = docs.join(planned, docs[source].eqNullSafe(planned["__plan"]["source"]))
    taken = F.col("__plan.whole") + F.when(order_key(docs[key]) <= F.col("__plan.cut"), 1).otherwise(0)
    repeated = rows.withColumn("__copies", F.explode(F.array_repeat(F.lit(0), taken.cast("int"))))
    return repeated.select(*[repeated[c] for c in docs.columns])
