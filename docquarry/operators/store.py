"""A corpus written once for searching: regions, the words of their texts, and typed tables.

Whatever depends on a region alone is worked out when it is written: token counts, body length,
visual words, and for tables the columns' types, the fault that keeps a table from being created, and its
rows as typed ``VARIANT`` records, whose fields differ from table to table. A search reads the words of
its terms and these narrow facts; texts are read for the regions that it returns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import RouterConfig
from docquarry.functions import text as tx
from docquarry.functions.rows import let, present
from docquarry.operators import joins
from docquarry.operators import retrieve as rv
from docquarry.operators import route as rt
from docquarry.operators import substring as ss
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts

FACTS = ("n_tokens", "body_len", "visual_text")


@dataclass(frozen=True)
class RegionStore:
    path: str

    @property
    def words(self) -> ss.SubstringIndex:
        return ss.SubstringIndex(f"{self.path}/words", ("doc_pos", "region_idx", *FACTS))

    def regions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/regions")

    def tables(self, spark: SparkSession) -> DataFrame:
        """``doc_pos, region_idx, columns, types, error, rows, records``."""
        return spark.read.parquet(f"{self.path}/tables")


def typed_tables(regions: DataFrame) -> DataFrame:
    """Tables of table regions with their types, fault and typed records, each inferred here and nowhere later."""
    found = tb.with_region_table(regions.filter("type = 'table'"))
    found = present(found, ["doc_pos", "region_idx"], ts.region_table(F.col("table"), F.col("text")), "_t")
    found = found.select("doc_pos", "region_idx", F.col("_t.columns").alias("columns"), F.col("_t.rows").alias("rows"))
    found = found.withColumn("types", ts.infer_types(F.col("columns"), F.col("rows")))
    found = found.withColumn("error", ts.table_error(F.col("columns"), F.col("rows"), F.col("types")))
    return found.withColumn("records", F.parse_json(F.to_json(ts.typed_records(F.col("columns"), F.col("rows"), F.col("types")))))


def write_store(regions: DataFrame, store: RegionStore) -> None:
    """Write ``regions`` (``doc_pos, region_idx, document_id, type, text``) and what searches need of them."""
    write_regions(regions, store)
    write_words(regions.sparkSession, store)
    write_tables(regions.sparkSession, store)


def write_regions(regions: DataFrame, store: RegionStore) -> None:
    regions.select("doc_pos", "region_idx", "document_id", "type", "modality", "text").write.mode("overwrite").parquet(f"{store.path}/regions")


def write_words(spark: SparkSession, store: RegionStore) -> None:
    """The word index of the written regions."""
    facts = [
        F.size(F.array_distinct(tx.words(F.lower("text")))).alias("n_tokens"), rv.body_length(F.col("text")).alias("body_len"),
        rv.is_visual_text(F.lower("text")).alias("visual_text"),
    ]
    ss.build(store.regions(spark).select("doc_pos", "region_idx", "type", "text", *facts), store.words)


def write_tables(spark: SparkSession, store: RegionStore) -> None:
    """The typed tables of the written regions."""
    typed_tables(store.regions(spark)).write.mode("overwrite").parquet(f"{store.path}/tables")


def keyword_hits(spark: SparkSession, store: RegionStore, routed: DataFrame) -> DataFrame:
    """Hits of the text, table and figure paths for routed queries of any number."""
    found = ss.found_terms(spark, store.words, routed)
    use = routed.select("query_id", F.size("tokens").alias("_n"), *[f"use_{m}" for m in rt.MODALITIES])
    rows = found.join(joins.bounded(use), "query_id")
    kind, number = F.col("type"), F.col("region_idx").cast("bigint") + 1
    score = rv.keyword_score(kind, F.col("found"), F.col("n_terms"))
    hit = (
        F.when(kind.isin("title", "body", "paragraph") & F.col("use_text"), rv._hit(rv.BATCH_TEXT, "text", score, number))
        .when((kind == "table") & F.col("use_table"), rv._hit(rv.BATCH_TABLE, "table", score, number))
        .when((kind == "figure") & F.col("use_vision"), rv._hit(rv.BATCH_VISION, "vision", score, F.lit(None)))
    )
    union = F.col("_n") + F.col("n_tokens") - F.col("same")
    overlap = F.when((F.col("_n") > 0) & (F.col("n_tokens") > 0), F.col("same") / F.greatest(F.lit(1), union)).otherwise(F.lit(0.0))
    out = rows.select("query_id", "doc_pos", "region_idx", "type", "body_len", "visual_text", overlap.alias("jaccard"), hit.alias("h"))
    return out.filter("h is not null").select("query_id", "doc_pos", "region_idx", "type", "body_len", "visual_text", "jaccard", "h.*")


def table_hits(spark: SparkSession, store: RegionStore, queries: rv.Queries, config: RouterConfig | None = None, route_all: bool = False) -> DataFrame:
    """Hits of the table statements: every table answers every query that is routed to tables, and scores by it."""
    tables = store.tables(spark).select(
        "doc_pos", "region_idx", F.transform("columns", F.lower).alias("_columns"), F.col("error").isNotNull().alias("_broken"),
        (F.get("types", F.lit(0)) != ts.VARCHAR).alias("_numeric"))
    facts = store.regions(spark).filter("type = 'table'").select("doc_pos", "region_idx", F.lower("text").alias("_low"), rv.body_length(F.col("text")).alias("body_len"))
    base = facts.join(tables, ["doc_pos", "region_idx"])
    passes = []
    for part in rv.batches(queries):
        routed = [r.asDict() for r in rv.routed_queries(spark, part, config).collect()]
        routed = [r for r in routed if route_all or r["use_table"]]
        if not routed:
            continue
        vocabulary = rv._string_array(sorted({t for r in routed for t in r["tokens"]}))
        known = let(F.array_distinct(tx.words(F.col("_low"))), lambda t: F.struct(F.size(t).alias("n"), F.array_intersect(vocabulary, t).alias("known")))
        rows = base.select("doc_pos", "region_idx", "body_len", rv.is_visual_text(F.col("_low")).alias("visual_text"), known.alias("_t"), "_columns", "_broken", "_numeric")
        rows = rows.withColumn("q", F.explode(rv.query_literals(routed)))
        concept = F.exists(rv._string_array(ts.CONCEPTS), lambda c: F.contains(F.col("q.lowered"), c))
        failed = F.coalesce(F.col("_broken") | (F.col("_numeric") & concept), F.lit(False))
        score = ts.match_score(F.col("q.lowered"), F.col("_columns"), failed)
        common = F.size(F.array_intersect("q.tokens", "_t.known"))
        union = F.size("q.tokens") + F.col("_t.n") - common
        overlap = F.when((F.size("q.tokens") > 0) & (F.col("_t.n") > 0), common / F.greatest(F.lit(1), union)).otherwise(F.lit(0.0))
        hit = rv._hit(rv.BATCH_SQL, "table", score, F.col("region_idx"))
        passes.append(rows.select("q.query_id", "doc_pos", "region_idx", F.lit("table").alias("type"), "body_len", "visual_text", overlap.alias("jaccard"), hit.alias("h")).select(
            "query_id", "doc_pos", "region_idx", "type", "body_len", "visual_text", "jaccard", "h.*"))
    return reduce(DataFrame.unionByName, passes) if passes else None


def hits(
    spark: SparkSession, store: RegionStore, queries: rv.Queries, config: RouterConfig | None = None, use_sql: bool = True, route_all: bool = False
) -> DataFrame:
    """All hits of all paths, as ``retrieve.region_hits`` gives them, from the store."""
    routed = rv.routed_queries(spark, queries, config)
    if route_all:
        routed = routed.withColumns({f"use_{m}": F.lit(True) for m in rt.MODALITIES})
    found = keyword_hits(spark, store, routed)
    tables = table_hits(spark, store, queries, config, route_all) if use_sql else None
    return found if tables is None else found.unionByName(tables)
