"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the ``k`` smallest distinct hashes of a text's shingles, in order. Sketches of parts
merge into that of the whole, and from two of them resemblance, containment and the number of
distinct shingles are estimated. Every step is a column expression inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import words

SHINGLE = 5
K = 128
# Hex digits of a hash: 48 bits.
DIGITS = 12
# Rows of a block of neighbouring ids, and the most blocks; wider tables get longer blocks.
BLOCK_ROWS, FAN = 1000, 128


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """Hash of each shingle, in hex; a text of fewer words is one shingle, one of none has none."""
    joined = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(1))),
        lambda i: F.substring(F.md5(F.array_join(F.slice(tokens, i, size), " ").cast("binary")), 1, DIGITS),
    )
    return F.when(F.size(tokens) > 0, joined).otherwise(F.array().cast("array<string>"))


def sketch(tokens: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct shingle hashes, rising."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(tokens, size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two texts' shingles; two empty texts are alike."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    top = F.conv(F.element_at(a, F.lit(k)), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 where ``a`` has none."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merged(parts: DataFrame, group: str, sketches: str = "sketch", k: int = K) -> DataFrame:
    """``group, sketch``: sketches of parts of one group merged, hashes combined before their shuffle."""
    hashes = parts.select(F.col(group), F.explode(sketches).alias("hash")).distinct()
    order = Window.partitionBy(group).orderBy("hash")
    least = hashes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, size: int = SHINGLE) -> DataFrame:
    """``doc_id, sketch`` of every whole text; null texts are empty, rows that repeat come back as they are."""
    tokens = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("tokens"))
    return tokens.select("doc_id", sketch(F.col("tokens"), k, size).alias("sketch"))


def _block(ids: Column, bounds: list[int]) -> Column:
    """How many of the falling ``bounds`` are above an id, looked up in two short lists; null ids are last."""
    rows = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    row = F.size(F.filter(longs([r[-1] for r in rows[:-1]]), lambda b: b >= ids))
    inner = F.get(F.array(*[longs(r) for r in rows]), row)
    place = row * FAN + F.size(F.filter(inner, lambda b: b >= ids))
    return F.when(ids.isNull(), F.lit(len(bounds) + 1)).otherwise(place)


def with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """``doc_id, text`` cut into blocks of falling id, each closed by a copy of the row that follows it.

    Returns the rows with ``block`` and ``border`` (True for the copies), and the window under which
    ``lead`` reads the next row: falling id, then text; after the last the first. One shuffle of the texts; the
    number of blocks grows with the table up to ``FAN`` squared, so no group is unbounded.
    """
    n = rows.count()
    blocks = max(1, min(FAN * FAN, math.ceil(n / BLOCK_ROWS)))
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else None
    found = rows.agg(F.percentile_approx("doc_id", shares, 1_000_000)).first()[0] if blocks > 1 else None
    bounds = sorted(set(found or []), reverse=True)
    placed = rows.withColumn("block", _block(F.col("doc_id"), bounds))
    firsts = placed.groupBy("block").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("block")  # a row for each block
    before = F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("first", before.alias("into"))
    copies = rows.join(F.broadcast(firsts), rows["doc_id"].eqNullSafe(firsts["first"]))
    copies = copies.groupBy("into").agg(F.min(F.struct("text", "doc_id")).alias("row")).select("row.doc_id", "row.text", F.col("into").alias("block"))
    both = placed.withColumn("border", F.lit(False)).unionByName(copies.withColumn("border", F.lit(True)))
    return both, Window.partitionBy("block").orderBy("border", F.col("doc_id").desc_nulls_last(), "text")


def edited_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Each text beside an edit of it and beside the next document, by falling id; after the last comes the first.

    The edit replaces the last third of the code points by as many from the head of the next text.
    Returns ``doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next``. Rows
    of one id follow each other by text; null ids come last; a single row is its own next.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both, window = with_next(rows)
    tokens = both.withColumn("next", F.lead("text").over(window)).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next", F.lit(1), third))
    tokens = tokens.select("doc_id", "block", "border", "text", "n_chars", words(F.col("text")).alias("tokens"), F.when(~F.col("border"), edited).alias("edited"))
    tokens = tokens.withColumn("edited_tokens", words(F.col("edited")))
    sketches = tokens.select(
        "doc_id", "block", "border", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("tokens"), k, size).alias("sketch"), sketch(F.col("edited_tokens"), k, size).alias("edited_sketch"),
    )
    paired = sketches.withColumn("next_sketch", F.lead("sketch").over(window)).filter(~F.col("border"))
    return paired.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
