"""End-to-end hybrid retrieval for a batch of queries as one set of Spark jobs.

Corpus text is read once to score every path and once more to fetch the few winners. Everything
between works on narrow hit rows, which are checkpointed because normalisation, ranking and fusion
all branch from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import EngineConfig
from docquarry.operators import fuse as fu
from docquarry.operators import joins
from docquarry.operators import rank as rk
from docquarry.operators import ranking
from docquarry.operators import retrieve as rv
from docquarry.operators import route as rt
from docquarry.session import cut_lineage

# Bounds and final scores are rounded alike; their sums may differ by rounding.
BOUND_SLACK = 1e-6
PAYLOAD = ["document_id", "doc_pos", "region_idx", "type", "body_len", "visual_text", "jaccard"]


def _item_id(doc):
    suffix = F.when(F.col("modality") == "text", "-region-").otherwise("-table-")
    return F.when(F.col("item_no").isNotNull(), F.concat(doc, suffix, F.col("item_no").cast("string"))).otherwise(
        F.concat_ws("-", doc, "modality", F.col("rank").cast("string"))
    )


def reachable(hits: DataFrame, config: EngineConfig, charts: bool) -> DataFrame:
    """Names (query, run, region, list) of the hits that can be in the final cut, by bounds that need no rank.

    What fusion adds to an item's score is small and bounded: each of its occurrences at most its
    weight over the first rank's divisor. The score from overlap alone is thus a lower bound of a hit's
    final score, and with the greatest fused score an upper one. Hits whose upper bound is below the
    ``k``-th lower bound of their query go. Only tables can occur twice in one item, by keyword and by
    statement: they give no lower bounds, and one that stays keeps its twin.
    """
    cfg, k = config.reranker, config.reranker.final_top_k
    if k <= 0 or cfg.heading_penalty_multiplier < 0:
        return hits

    def bound(score: float, modality: Column) -> Column:
        return rk.rank_score(F.lit(score), F.col("jaccard"), modality, F.col("body_len"), cfg.short_heading_char_threshold, cfg.heading_penalty_multiplier)

    # No weight is above one; two occurrences at rank one.
    most = 2 * 100.0 / (config.retrieval.rrf_k + 1)
    upper = bound(most, F.col("modality"))
    if charts:
        upper = F.greatest(upper, F.when(F.col("visual_text") | (F.col("modality") == "vision"), bound(most, F.lit("vision"))))
    lower = hits.filter(F.col("modality") != "table").select("query_id", bound(0.0, F.col("modality")).alias("lower"))
    least = ranking.top_k(lower, ["query_id"], [F.col("lower").desc()], k, out="_at").filter(F.col("_at") == k)
    least = joins.bounded(cut_lineage(least.select("query_id", F.col("lower").alias("_least"))))  # one row per query
    kept = hits.join(least, "query_id", "left").filter(F.coalesce(upper + F.lit(BOUND_SLACK) >= F.col("_least"), F.lit(True))).drop("_least")
    table = kept.filter("modality = 'table'")
    item = ["query_id", "modality", "doc_pos", "item_no"]
    twins = hits.filter("modality = 'table'").join(joins.bounded(cut_lineage(table.select(*item).distinct())), item, "left_semi")
    return cut_lineage(kept.filter("modality <> 'table'").unionByName(twins).select("query_id", "modality", "doc_pos", "region_idx", "batch"))


def fused_candidates(
    hits: DataFrame, queries: rv.Queries, config: EngineConfig, routed_weights: bool, charts: bool = False
) -> DataFrame:
    """Normalise and fuse those of the written hits that can be in the final cut. One row per fused item and query."""
    scaled = fu.normalize(hits, ["query_id", "batch"], few_groups=len(queries) <= rv.BATCH_QUERIES)
    ranked = fu.rank_runs(scaled, only=reachable(hits, config, charts)).withColumn("document_id", F.col("doc_pos").cast("string"))
    if routed_weights:
        routes = rv.routed_queries(hits.sparkSession, queries, config.router).select(
            "query_id", F.create_map(*[x for m in rt.MODALITIES for x in (F.lit(m), F.col(f"w_{m}"))]).alias("_w")
        )
        # The query list is the caller's own bounded batch.
        ranked = ranked.join(F.broadcast(routes), "query_id").withColumn("weight", F.col("_w")[F.col("modality")])
    else:
        ranked = ranked.withColumn("weight", fu.default_weight(F.col("modality")))
    ranked = ranked.withColumn("item_id", _item_id(F.col("document_id")))
    return fu.fuse_rrf(ranked, PAYLOAD, config.retrieval.rrf_k)


def _cut(candidates: DataFrame, config: EngineConfig) -> DataFrame:
    cfg = config.reranker
    scored = candidates.withColumn(
        "rank_score",
        rk.rank_score(
            F.col("score"),
            F.col("jaccard"),
            F.col("modality"),
            F.col("body_len"),
            cfg.short_heading_char_threshold,
            cfg.heading_penalty_multiplier,
        ),
    )
    order = [
        F.col("rank_score").desc(),
        F.col("from_chart").asc(),
        F.col("score").desc(),
        F.col("first_seen").asc(),
    ]
    return ranking.top_k(scored, ["query_id"], order, cfg.final_top_k)


def _with_text(best: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """Fetch document ids and texts of the winners.

    With a cut there are at most ``k`` rows per query, a bounded side worth broadcasting; without
    one the join is left to the planner.
    """
    best = cut_lineage(best.drop("document_id"))
    side = F.broadcast(best) if k > 0 else best
    texts = regions.select("doc_pos", "region_idx", "document_id", "text")
    out = texts.join(side, ["doc_pos", "region_idx"])
    # Item ids carry the document position until here, so the long id is attached once.
    return out.withColumn(
        "item_id", F.concat("document_id", F.regexp_replace("item_id", r"^\d+", ""))
    )


def written_hits(regions: DataFrame, queries: rv.Queries, config: EngineConfig, use_sql: bool = True) -> DataFrame:
    """Score every path in one pass and keep the narrow hits."""
    return cut_lineage(rv.region_hits(regions, queries, config.router, use_sql=use_sql))


def hybrid_retrieve(
    regions: DataFrame, queries: rv.Queries, config: EngineConfig | None = None, hits: DataFrame | None = None
) -> DataFrame:
    """Routed text, table, table-SQL and figure retrieval, fused, with chart evidence, reranked, cut.

    ``hits`` takes those of ``written_hits``, or of a region store, when the caller has them.
    """
    config = config or EngineConfig()
    hits = written_hits(regions, queries, config) if hits is None else hits
    fused = fused_candidates(hits, queries, config, routed_weights=True, charts=True)
    copies = F.when(
        (F.col("modality") == "vision") | F.col("visual_text"),
        F.array(F.struct(F.lit(False).alias("c"), F.col("modality").alias("m")), F.struct(F.lit(True).alias("c"), F.lit("vision").alias("m"))),
    ).otherwise(F.array(F.struct(F.lit(False).alias("c"), F.col("modality").alias("m"))))
    candidates = fused.withColumn("_copy", F.explode(copies))
    candidates = (
        candidates.withColumn("from_chart", F.col("_copy.c")).withColumn("modality", F.col("_copy.m")).drop("_copy")
    )
    return _with_text(_cut(candidates, config), regions, config.reranker.final_top_k)


def query_service(
    regions: DataFrame, queries: rv.Queries, config: EngineConfig | None = None, hits: DataFrame | None = None
) -> DataFrame:
    """The library entry: keyword paths only, default fusion weights, no chart evidence."""
    config = config or EngineConfig()
    hits = written_hits(regions, queries, config, use_sql=False) if hits is None else hits
    fused = fused_candidates(hits, queries, config, routed_weights=False)
    return _with_text(
        _cut(fused.withColumn("from_chart", F.lit(False)), config), regions, config.reranker.final_top_k
    )
