"""A written BM25 index: postings in blocks with bounds, searched without the texts.

Units of similar length share a *range* of about ``RANGE_UNITS`` units. A block holds the postings of one
term in one range, strongest first, and in its head the term's count and the pairs of frequency and
length that no other posting of the block beats: whatever the mean length, ``k1`` and ``b`` are, the
greatest share of the block is that of one of these pairs.

A search reads the heads of its terms' blocks, sums their greatest shares to a bound per range, scores
the ranges of highest bound first, and then only what can still reach the ``k``-th score found there:
first whole ranges are left out, then single postings. Results equal those of scoring every unit.

``path/blocks`` is laid out by segment and by bucket of the term, sorted by term; each unit also stands
in one block of the null term, which carries lengths for the collection's statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import let, unnest
from docquarry.operators import index as ix
from docquarry.operators import joins, ranking
from docquarry.session import cut_lineage

# Units of a range, units of a folder slice (one task and file each), folders by term.
RANGE_UNITS, SLICE_UNITS, BUCKETS = 1024, 1 << 20, 16
# Tasks that a bucket's slice is dealt to, by term; the null term by range.
PIECES = 8
# Terms or ranges that are named in a filter of the scan; more are joined.
LITERALS = 1000
# Sums of shares may differ by rounding between a bound and a score.
SLACK = 1e-9
UNITS_BUCKET = -1
# Query terms of a batch that a scan takes, and units that it scores at once.
SCAN_TERMS, SCAN_UNITS = 20_000, 1024
# Types of the keys that units are known by; others are strings, and so are groups.
KEY_TYPES = {"doc_pos": "bigint", "region_idx": "int", "epoch": "bigint"}


@dataclass(frozen=True)
class SparseIndex:
    """Where an index lies, what names a unit, and the columns that keep collections apart."""

    path: str
    keys: tuple[str, ...]
    groups: tuple[str, ...] = ()
    buckets: int = BUCKETS

    @property
    def blocks(self) -> str:
        return f"{self.path}/blocks"

    @property
    def schema(self) -> str:
        keys = ",".join(f"{k}:{KEY_TYPES.get(k, 'string')}" for k in self.keys)
        groups = "".join(f"{g} string, " for g in self.groups)
        pairs = "impacts array<struct<tf:int,dl:int>>"
        return f"{groups}term string, range bigint, n bigint, tokens bigint, {pairs}, docs array<struct<tf:int,dl:int,{keys}>>, segment bigint, bucket int"

    def bucket(self, term: Column) -> Column:
        return F.when(term.isNull(), UNITS_BUCKET).otherwise(F.pmod(F.xxhash64(term), self.buckets)).cast("int")


def term_counts(tokens: Column) -> Column:
    """``term, tf`` of an array of tokens, by the lengths of the runs of its sorted form."""

    def runs(ordered: Column) -> Column:
        first = F.array_compact(F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)))
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(
            F.get(ordered, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(ordered)) - p).alias("tf"))))

    return let(F.sort_array(tokens), runs)


def placed(rows: DataFrame, index: SparseIndex, length: Column, units: DataFrame | None = None, range_units: int = RANGE_UNITS) -> DataFrame:
    """Add ``range`` and ``slice``: ranges hold units of similar ``length``, dealt by hash within a length class.

    ``units`` has the rows to count if ``rows`` has several for a unit.
    """
    by = [*index.groups, "_class"]
    class_ = F.floor(F.log2(length + 1) * 4).cast("int")
    counted = (rows if units is None else units).groupBy(*index.groups, class_.alias("_class")).agg(F.ceil(F.count("*") / range_units).alias("_parts"))
    part = F.pmod(F.xxhash64(*index.keys), F.col("_parts"))
    placed_rows = rows.withColumn("_class", class_).join(joins.bounded(counted), by)
    placed_rows = placed_rows.withColumn("range", F.col("_class").cast("bigint") * F.lit(1 << 40) + part)
    return placed_rows.withColumn("slice", F.floor(part / max(1, SLICE_UNITS // range_units)).cast("int")).drop("_class", "_parts")


def _opens(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
    return differs | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))


def _blocks(batches: Iterator[pa.RecordBatch], by: list[str], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that are sorted by ``_hash`` of ``by``, each by falling frequency and rising length.

    Postings are put in order within a batch, and a block is then a piece of the batch's columns. Of a
    batch's last hash the rest may follow, so it waits for the next batch. The head has the pairs of
    frequency and length that no other posting beats: those shorter than all before them.
    """
    rest: pa.Table | None = None
    order = [*[(c, "ascending") for c in ("_hash", *by)], ("tf", "descending"), ("dl", "ascending"), *[(c, "descending") for c in keys]]

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        starts = np.flatnonzero(np.append([True], np.any([_opens(rows[c]) for c in by], axis=0)))
        ends = np.append(starts[1:], rows.num_rows)
        dl = rows["dl"].to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.repeat(np.arange(len(starts)), ends - starts)
        falling = dl - block * (int(dl.max()) + 1)  # each block lies below the one before it, so one running minimum serves all
        best = np.append([True], falling[1:] < np.minimum.accumulate(falling)[:-1])
        offset = np.append(0, np.cumsum(np.add.reduceat(best.astype(np.int64), starts))).astype(np.int32)
        docs = pa.StructArray.from_arrays([rows[c] for c in ("tf", "dl", *keys)], ["tf", "dl", *keys])
        pairs = pa.StructArray.from_arrays([rows[c].filter(pa.array(best)) for c in ("tf", "dl")], ["tf", "dl"])
        heads = [rows[c].take(pa.array(starts)) for c in by]
        lists = [pa.ListArray.from_arrays(pa.array(offset), pairs), pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows).astype(np.int32)), docs)]
        return pa.RecordBatch.from_arrays(
            [*heads, pa.array(ends - starts), pa.array(np.add.reduceat(dl, starts)), *lists], [*by, "n", "tokens", "impacts", "docs"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        hashes = rows["_hash"].to_numpy()
        last = int(np.searchsorted(hashes, hashes[-1]))
        if last:
            yield of(rows.slice(0, last).to_batches()[0])
        rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield of(rest.combine_chunks().to_batches()[0])


def unit_postings(units: DataFrame, index: SparseIndex, text: str = "text", range_units: int = RANGE_UNITS) -> DataFrame:
    """``groups, keys, range, slice, dl, term, tf`` of units, with one row of the null term each; counted within the row."""
    unit = [*index.groups, *index.keys, "range", "slice", "dl"]
    tokens = placed(units.select(*index.groups, *index.keys, F.coalesce(F.col(text), F.lit("")).alias(text)), index, F.length(text), range_units=range_units)
    tokens = tokens.withColumn("tokens", ix.index_tokens(F.col(text))).withColumn("dl", F.size("tokens"))
    counts = F.concat(term_counts(F.col("tokens")), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))))
    return unnest(tokens, unit, counts, "t").select(*unit, "t.term", "t.tf")


def packed(postings: DataFrame, index: SparseIndex) -> DataFrame:
    """Postings as blocks, by one shuffle; a range is bounded, and so is a block."""
    piece = F.pmod(F.coalesce(F.when(F.col("term").isNotNull(), F.xxhash64(F.lit(1), "term")), F.xxhash64("range")), PIECES)
    by, keys = ["bucket", *index.groups, "term", "range"], list(index.keys)
    rows = postings.withColumn("bucket", index.bucket(F.col("term"))).withColumn("_piece", piece).repartition("bucket", "slice", "_piece")
    rows = rows.withColumn("tf", F.col("tf").cast("int")).withColumn("dl", F.col("dl").cast("int"))
    # one number to sort by, which Spark does by digits; the rest of the order is made in the batches
    rows = rows.withColumn("_hash", F.xxhash64(*by)).sortWithinPartitions("_hash")
    rows = rows.select("_hash", *by, "tf", "dl", *[F.col(c).cast(KEY_TYPES.get(c, "string")).alias(c) for c in keys])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    heads = ", ".join(f"`{c}` {kind[c]}" for c in by)
    docs = ",".join(f"{c}:{kind[c]}" for c in ("tf", "dl", *keys))
    return rows.mapInArrow(lambda it: _blocks(it, by, keys), f"{heads}, n bigint, tokens bigint, impacts array<struct<tf:int,dl:int>>, docs array<struct<{docs}>>")


def write_blocks(blocks: DataFrame, index: SparseIndex, segment: int) -> None:
    """Write blocks as one segment of the index; one of that number is replaced."""
    rows = blocks.sortWithinPartitions("bucket", *index.groups, "term", "range")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.blocks}/segment={segment}")


def write_segment(units: DataFrame, index: SparseIndex, segment: int = 0, text: str = "text", range_units: int = RANGE_UNITS) -> None:
    """Write ``units`` (groups, keys, text) as one segment of the index."""
    write_blocks(packed(unit_postings(units, index, text, range_units), index), index, segment)


def read_blocks(spark: SparkSession, index: SparseIndex) -> DataFrame:
    return spark.read.schema(index.schema).parquet(index.blocks)


def collection_stats(blocks: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Unit count and mean length per collection, units without terms included; reads no posting."""
    return blocks.filter(F.col("bucket") == UNITS_BUCKET).groupBy(*groups).agg(
        F.sum("n").alias("n_units"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))


def _only(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """Blocks that match a table of distinct values on its columns: by a filter of the scan if it is short, else by a join."""
    some = values.limit(LITERALS + 1).collect()
    if len(some) > LITERALS:
        return blocks.join(joins.bounded(values), values.columns, "left_semi")
    for column in values.columns:
        blocks = blocks.filter(F.col(column).isin(sorted({r[column] for r in some})))
    return blocks


def search(
    spark: SparkSession, index: SparseIndex, queries: DataFrame, k: int = 10, order: list[str] | None = None,
    k1: float = ix.BM25_K1, b: float = ix.BM25_B, blocks: DataFrame | None = None, stats: DataFrame | None = None, dead: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` units per query (``query_id, query``) and collection, as groups, keys, ``query_id, score, rank``.

    Units without a term of the query are left out; ties go by ``order`` (the keys). ``k`` must be
    positive. Which blocks are read depends on bounds alone, so the rows are those of a full scan.
    ``blocks`` and ``stats`` stand in for those of the whole index; units that match ``dead`` on its
    columns, which are keys, are no hits.
    """
    if k < 1:
        raise ValueError("k must be positive")
    groups, keys = list(index.groups), list(index.keys)
    blocks = read_blocks(spark, index) if blocks is None else blocks
    place, asked_by = ["segment", "range"], [*groups, "query_id"]
    asked = cut_lineage(ix.query_terms(queries).withColumn("bucket", index.bucket(F.col("term"))))
    picked = _only(blocks, asked.select("bucket", "term").distinct())

    heads = cut_lineage(picked.select(*groups, *place, "term", "n", "impacts"))
    weights = (
        heads.groupBy(*groups, "term").agg(F.sum("n").alias("df"))
        .join(collection_stats(blocks, index.groups) if stats is None else stats, groups).withColumn("idf", ix.idf(F.col("n_units"), F.col("df")))
        .join(asked, "term").select(*groups, "term", "query_id", "avgdl", (F.col("idf") * F.col("qtf")).alias("weight"))
    )
    weights = cut_lineage(weights)
    best = F.array_max(F.transform("impacts", lambda i: ix.bm25_part(i["tf"], i["dl"], F.col("avgdl"), k1, b))) * F.col("weight")
    n_weights = weights.count()
    tops = heads.join(joins.hinted(weights, n_weights), [*groups, "term"]).select(*asked_by, *place, "n", best.alias("top"))
    ranges = cut_lineage(tops.groupBy(*asked_by, *place).agg(F.sum("top").alias("bound"), F.max("n").alias("n")))
    n_ranges = ranges.count()

    def scored(chosen: DataFrame) -> DataFrame:
        """Scores of the units of chosen ranges, without postings whose unit cannot reach the range's ``least``."""
        read = _only(picked, chosen.select("range").distinct()).select(*groups, *place, "term", "impacts", "docs")
        met = read.join(joins.hinted(weights, n_weights), [*groups, "term"]).join(joins.hinted(chosen, n_ranges), [*asked_by, *place])
        rows = met.select(*asked_by, "weight", "avgdl", (F.col("bound") - best).alias("rest"), "least", F.explode("docs").alias("d"))
        rows = rows.withColumn("part", F.col("weight") * ix.bm25_part(F.col("d.tf"), F.col("d.dl"), F.col("avgdl"), k1, b))
        rows = rows.filter(tx.pyround(F.col("part") + F.col("rest") + SLACK, 4) >= F.col("least"))
        sums = rows.select(*asked_by, "d.*", "part").groupBy(*asked_by, *keys).agg(F.sum("part").alias("_s"))
        sums = sums if dead is None else sums.join(dead, dead.columns, "left_anti")
        return sums.select(*groups, *keys, "query_id", tx.pyround(F.col("_s"), 4).alias("score")).filter("score > 0")

    # A range holds at least as many hits as the longest of its blocks, so k ranges are enough to seed.
    highest = ranking.top_k(ranges, asked_by, [F.col("bound").desc(), *[F.col(c) for c in place]], k, out="_at")
    earlier = Window.partitionBy(*asked_by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    seeds = cut_lineage(highest.withColumn("_before", before).filter(F.col("_before") < k).withColumn("least", F.lit(0.0)).drop("_at", "_before", "n"))
    kth = ranking.top_k(scored(seeds), asked_by, [F.col("score").desc()], k, out="_at").filter(F.col("_at") == k)
    kth = kth.select(*asked_by, F.col("score").alias("least"))
    chosen = ranges.drop("n").join(joins.hinted(kth, n_ranges), asked_by, "left").fillna(0.0, ["least"])
    chosen = cut_lineage(chosen.filter(tx.pyround(F.col("bound") + SLACK, 4) >= F.col("least")))
    by = [F.col("score").desc(), *[F.col(c).asc() for c in (order or keys)]]
    return ranking.top_k(scored(chosen), asked_by, by, k)


def scan(units: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_pos", text: str = "text", k1: float = ix.BM25_K1, b: float = ix.BM25_B) -> DataFrame | None:
    """The rows of ``search`` over units of one collection, by a pass over their texts instead of an index, for one batch of queries.

    Of a unit only counts of the batch's terms are written. Tasks score blocks of units against all
    queries and pass on what is among the best ``k`` of theirs, so pairs of queries and units are never shuffled.
    ``None`` where a batch has more than ``SCAN_TERMS`` terms or none, or where ``key`` is no integer that tells the units apart.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = ix.query_terms(queries.filter("query_id IS NOT NULL")).limit(SCAN_TERMS + 1).collect()
    if not asked or len(asked) > SCAN_TERMS or units.schema[key].dataType.simpleString() not in ("bigint", "int"):
        return None
    repeats = units.groupBy(key).count().agg(F.max("count"), F.count_if(F.col(key).isNull())).first()
    if (repeats[0] or 0) > 1 or repeats[1]:
        return None
    terms = sorted({r["term"] for r in asked})
    counted = let(ix.index_tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.struct(
        F.size(t).alias("dl"), term_counts(F.filter(t, lambda w: w.isin(terms))).alias("counts")))
    rows = unnest(units, [F.col(key).cast("bigint").alias("unit")], F.array(counted), "u").select("unit", "u.dl", "u.counts")
    rows = cut_lineage(rows)
    n_units, avgdl = rows.agg(F.count("*"), F.sum("dl") / F.count("*")).first()
    df = rows.select(F.explode("counts.term").alias("term")).groupBy("term").count().collect()  # no more than the batch's terms
    df = {r["term"]: r["count"] for r in df}
    names = sorted({r["query_id"] for r in asked})
    place, number = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    asked = sorted((number[r["term"]], place[r["query_id"]], r["qtf"] * float(np.log((n_units - n + 0.5) / (n + 0.5) + 1.0))) for r in asked if (n := df.get(r["term"], 0)))
    at_term, at_query = np.array([t for t, _, _ in asked], np.int64), np.array([q for _, q, _ in asked], np.int64)
    weight, starts = np.array([w for _, _, w in asked]), np.searchsorted(at_term, np.arange(len(terms) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, least = pa.array(terms, pa.string()), np.zeros(len(names))
        for batch in (whole.slice(i, SCAN_UNITS) for whole in batches for i in range(0, whole.num_rows, SCAN_UNITS)):
            order = np.argsort(batch["unit"].to_numpy(), kind="stable")  # ties in order of the units
            batch = batch.take(pa.array(order))
            counts = batch["counts"]
            sizes = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = counts.flatten()
            term = pc.index_in(flat.field("term"), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
            tf, unit = flat.field("tf").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            norm = k1 * ((1.0 - b) + b * batch["dl"].to_numpy() / avgdl) if avgdl else np.zeros(len(sizes))
            share = tf * (k1 + 1.0) / (tf + norm[unit])
            times = starts[term + 1] - starts[term]
            one = np.repeat(np.arange(len(term)), times)
            other = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times) + starts[term][one]
            pair = unit[one] * len(names) + at_query[other]
            score = np.bincount(pair, share[one] * weight[other], len(sizes) * len(names)).reshape(len(sizes), len(names))
            score = np.rint(score * 10000.0) / 10000.0
            best = np.argsort(-score, axis=0, kind="stable")[:k]
            top = np.take_along_axis(score, best, axis=0)
            row, query = np.nonzero((top > 0) & (top >= least))
            if len(best) == k:
                least = np.maximum(least, top[-1])
            found = batch["unit"].to_numpy()[best[row, query]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(query, pa.int64()), pa.array(top[row, query])], ["unit", "query", "score"])

    hits = rows.mapInArrow(run, "unit bigint, query bigint, score double")
    ids = F.array(*[F.lit(q) for q in names])
    hits = hits.select(F.col("unit").cast(units.schema[key].dataType).alias(key), F.get(ids, F.col("query").cast("int")).cast(queries.schema["query_id"].dataType).alias("query_id"), "score")
    return ranking.top_k(hits, ["query_id"], [F.col("score").desc(), F.col(key).asc()], k)
