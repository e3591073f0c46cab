"""Exact ranks and top-k over groups of any size.

A plain ``row_number`` over one query's hits would pull the whole corpus into one task when a query
matches everything. ``exact_rank`` splits each group by its sort levels and by blocks of consecutive
document positions, ranks inside those bounded pieces, and shifts each piece by how many rows come
before it. ``top_k`` keeps the row-number form, for which Spark limits each partition before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators import joins

# Documents per block are at most 2 ** BLOCK_BITS, whatever the corpus size.
BLOCK_BITS = 14
# Blocks per span are at most 2 ** SPAN_BITS.
SPAN_BITS = 10


def _ordering(levels: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in levels]


def exact_rank(
    df: DataFrame,
    groups: list[str],
    levels: list[tuple[str, bool]],
    pos: str = "doc_pos",
    ties: tuple[str, ...] = ("region_idx",),
    out: str = "rank",
    block_bits: int = BLOCK_BITS,
    only: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based rank within ``groups`` by ``levels`` (name, ascending), then ``pos``, then ``ties``.

    ``only`` (``groups``, ``pos``, ``ties``) names the few rows that are wanted: their ranks are among all
    rows of ``df``, but of the others only counts are shuffled, and the pieces that hold a wanted row.

    ``levels`` should hold few distinct values per group (rounded scores do); ``pos`` is an integer
    corpus position. Counts per piece are combined before their shuffle. Their offsets are summed in
    two steps: over the blocks of a span of ``2 ** SPAN_BITS`` blocks, and over the spans of a group.
    """
    split = df.withColumn("_block", F.shiftright(F.col(pos), block_bits))
    names = [name for name, _ in levels]
    piece, span = [*groups, *names, "_block"], [*groups, *names, "_span"]
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = split.groupBy(*piece).agg(F.count("*").alias("_n")).withColumn("_span", F.shiftright("_block", SPAN_BITS))
    inside = counts.withColumn("_inside", earlier(Window.partitionBy(*span).orderBy("_block"))).drop("_n")
    spans = counts.groupBy(*span).agg(F.sum("_n").alias("_n"))
    spans = spans.withColumn("_before", earlier(Window.partitionBy(*groups).orderBy(*_ordering(levels), F.col("_span").asc()))).drop("_n")
    offsets = inside.join(spans, span).withColumn("_offset", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_span")
    local = F.row_number().over(Window.partitionBy(*piece).orderBy(pos, *ties))
    wanted = [*groups, pos, *ties]
    if only is not None:
        n_wanted = only.count()  # no more pieces than that hold one
        only = joins.hinted(only.select(*wanted).distinct(), n_wanted)
        pieces = split.join(only, wanted, "left_semi").select(*piece).distinct()
        split = split.join(joins.hinted(pieces, n_wanted), piece, "left_semi")
    placed = split.withColumn("_local", local)
    return (
        (placed if only is None else placed.join(only, wanted, "left_semi"))
        .join(offsets, piece)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_block")
    )


def top_k(
    df: DataFrame, groups: list[str], order: list[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group with their rank; ``k <= 0`` ranks nothing away."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(out) <= k) if k > 0 else ranked
