"""A written index for substring search over the words of units.

A query term holds no whitespace, so a text contains it just when one of the text's whitespace-separated
words does. The index therefore has two steps: grams of three letters lead to the distinct words that hold
them, and words lead to their units. A term of three letters and more is looked up by its rarest gram and
verified against the words found. A shorter term has no gram: it is held against the distinct words, which
are far fewer than the words of the texts. No text is read.

``path/words`` holds, per kind of unit and word, blocks of units; ``path/grams`` the words of each gram.
Both are laid out by bucket and sorted, so a lookup prunes folders and row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import joins
from docquarry.session import checkpoint_folder, cut_lineage, freed_shuffles

GRAM, BUCKETS = 3, 16
# Units of one word are kept in blocks of so many (two to the power) consecutive document positions.
BLOCK_BITS = 14
# Keys that are named in a filter of a scan; more are joined.
LITERALS = 1000
# Passes that an index is written in, each with whole blocks of document positions.
PASSES = 8


@dataclass(frozen=True)
class SubstringIndex:
    """Where an index lies, what names a unit, its kind, and the document position that cuts blocks."""

    path: str
    keys: tuple[str, ...] = ("doc_pos", "region_idx")
    kind: str = "type"
    pos: str = "doc_pos"
    buckets: int = BUCKETS

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), self.buckets).cast("int")


def grams(word: Column, size: int = GRAM) -> Column:
    """Distinct substrings of ``size`` letters, none of a shorter word."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(word) - (size - 1)), lambda i: F.substr(word, i, F.lit(size)))
    return F.when(F.length(word) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def build(units: DataFrame, index: SubstringIndex, text: str = "text") -> None:
    """Write the index of ``units`` (keys, kind, text): by blocks of documents, then grams of the distinct words.

    The postings of some blocks are shuffled at a time, and their shuffle files freed once they are written.
    """
    spark = units.sparkSession
    words = F.array_distinct(tx.words(F.lower(F.col(text))))
    rows = unnest(units.filter(F.col(text).isNotNull()), [*index.keys, index.kind], words, "word").drop("_pos")
    rows = rows.withColumn("bucket", index.bucket(F.col("word"))).withColumn("block", F.shiftright(F.col(index.pos), BLOCK_BITS))
    place = F.coalesce(F.shiftright(F.col(index.pos), BLOCK_BITS), F.lit(0))
    last = units.agg(F.max(place), F.min(place)).first()
    passes = 1 if last[0] is None else min(PASSES, last[0] - last[1] + 1)
    for at in range(passes):
        some = rows.filter(F.pmod(F.coalesce("block", F.lit(0)), F.lit(passes)) == at) if passes > 1 else rows
        blocks = some.repartition("bucket", "block").groupBy("bucket", "block", index.kind, "word").agg(F.collect_list(F.struct(*index.keys)).alias("units"))
        _write(blocks.drop("block"), f"{index.path}/words", ["word"], "append" if at else "overwrite")
    words = spark.read.parquet(f"{index.path}/words").select("word").distinct()
    found = words.select("word", F.explode(grams(F.col("word"))).alias("gram")).withColumn("bucket", index.bucket(F.col("gram")))
    # Letters stand in very many words: a bucket's rows are dealt on by word.
    _write(found.repartition("bucket", F.pmod(F.xxhash64("word"), F.lit(4))), f"{index.path}/grams", ["gram", "word"])


def _write(rows: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    with freed_shuffles(rows.sparkSession):
        rows.sortWithinPartitions("bucket", *order).write.mode(mode).partitionBy("bucket").parquet(path)


def _lookup(table: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of ``table`` for ``keys`` (``bucket`` and ``column``, distinct), and whether the keys are few.

    Few keys are named in a filter of the scan, more are joined.
    """
    some = keys.limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        return table.filter(F.col("bucket").isin(sorted({r["bucket"] for r in some})) & F.col(column).isin([r[column] for r in some])), True
    return table.join(joins.bounded(keys), ["bucket", column], "left_semi"), False


def _joinable(side: DataFrame, few: bool) -> DataFrame:
    """A side with some rows for each key of a lookup: broadcast if the keys were few or a count allows it."""
    return F.broadcast(side) if few else joins.bounded(side)


def words_with(spark: SparkSession, index: SubstringIndex, terms: DataFrame) -> DataFrame:
    """``term, word`` of all indexed words that contain a term of a one-column table ``term``."""
    terms = terms.select("term").filter("term <> ''").distinct()
    asked = cut_lineage(terms.select("term", F.posexplode_outer(grams(F.col("term"))).alias("_", "gram")).withColumn("bucket", index.bucket(F.col("gram"))))
    long = asked.filter("gram is not null")
    held, few = _lookup(spark.read.parquet(f"{index.path}/grams"), "gram", long.select("bucket", "gram").distinct())
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))  # one row per gram that is asked for
    # A gram that no word has is the rarest: its term is nowhere.
    rarest = long.join(_joinable(counts, few), "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = held.select("gram", "word").join(joins.bounded(rarest), "gram")
    found = found.filter(F.col("word").contains(F.col("term"))).select("term", "word")
    short = [r["term"] for r in asked.filter("gram is null").select("term").limit(LITERALS + 1).collect()]
    if not short:
        return found
    words = spark.read.parquet(f"{index.path}/words").select("word").distinct()
    if len(short) > LITERALS:
        pieces = F.concat(*[grams(F.col("word"), size) for size in range(1, GRAM)])
        return found.unionByName(words.select(F.explode(F.array_distinct(pieces)).alias("term"), "word").join(joins.bounded(terms), "term"))
    named = F.array(*[F.lit(t) for t in short])
    return found.unionByName(words.select(F.explode(F.filter(named, lambda t: F.contains(F.col("word"), t))).alias("term"), "word"))


def term_units(spark: SparkSession, index: SubstringIndex, terms: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """``term``, kind and keys of the units whose text contains a term, once each; all kinds, or those named.

    ``same`` tells whether the term is one of the text's words as a whole.
    """
    words = cut_lineage(words_with(spark, index, terms).withColumn("bucket", index.bucket(F.col("word"))))
    blocks = spark.read.parquet(f"{index.path}/words")
    blocks = blocks.filter(F.col(index.kind).isin(*kinds)) if kinds else blocks

    def met(part: DataFrame, mine: DataFrame) -> DataFrame:
        rows = part.join(joins.bounded(mine), ["bucket", "word"])
        rows = rows.select("term", index.kind, F.inline("units"), (F.col("word") == F.col("term")).alias("same"))
        return rows.groupBy("term", index.kind, *index.keys).agg(F.max("same").alias("same"))

    if words.count() <= joins.BROADCAST_ROWS:
        return met(_lookup(blocks, "word", words.select("bucket", "word").distinct())[0], words)
    # The blocks of one bucket at a time, or they would all be shuffled to meet the words.
    path = f"{checkpoint_folder(spark)}/units-{uuid.uuid4().hex}"
    for bucket in range(index.buckets):
        rows = met(blocks.filter(F.col("bucket") == bucket), words.filter(F.col("bucket") == bucket))
        with freed_shuffles(spark):
            rows.write.mode("append").parquet(path)
    units = spark.read.schema(rows.schema).parquet(path)
    return units.groupBy("term", index.kind, *index.keys).agg(F.max("same").alias("same"))


def found_terms(spark: SparkSession, index: SubstringIndex, queries: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, n_terms, found, same``, kind and keys: how many of a query's terms each unit contains, repeats included.

    ``same`` counts the distinct terms that are words of the text as a whole.

    ``queries`` (``query_id, query``) may be of any number. Units without a term of the query are left out.
    """
    asked = queries.select("query_id", tx.words(F.lower("query")).alias("terms"))
    asked = asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    asked = cut_lineage(asked.groupBy("query_id", "n_terms", "term").agg(F.count("*").alias("times")))
    units = term_units(spark, index, asked.select("term"), kinds)
    by = ["query_id", "n_terms", index.kind, *index.keys]
    return units.join(joins.bounded(asked), "term").groupBy(*by).agg(F.sum("times").alias("found"), F.count_if("same").alias("same"))
