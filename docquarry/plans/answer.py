"""Question answering for a batch: retrieve, run table SQL, write the template answer, attribute it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.config import EngineConfig
from docquarry.operators import attribute as at
from docquarry.operators import fuse as fu
from docquarry.operators import generate as ge
from docquarry.operators import ranking
from docquarry.operators import retrieve as rv
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts
from docquarry.plans import hybrid as hy
from docquarry.session import cut_lineage


def evidence_lists(best: DataFrame) -> DataFrame:
    """Ranked rows to one ``evidence`` array per query; its length is the final cut."""
    entry = F.struct("rank", "document_id", "modality", "text")
    packed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return packed.select(
        "query_id",
        F.transform("_e", lambda e: F.struct(e["document_id"], e["modality"], e["text"])).alias("evidence"),
    )


def top_table_answers(
    hits: DataFrame, regions: DataFrame, queries: rv.Queries, config: EngineConfig, tables: DataFrame | None = None
) -> DataFrame:
    """Per query the best table's statement and its rows, for queries routed to tables.

    ``tables`` takes the typed tables of a region store; without them the winners' tables are typed here.
    """
    hits = hits.filter(F.col("batch") == rv.BATCH_SQL)
    order = [F.col("score").desc(), F.col("doc_pos").asc(), F.col("region_idx").asc()]
    best = ranking.top_k(hits, ["query_id"], order, 1).select("query_id", "doc_pos", "region_idx")
    asked = rv.routed_queries(regions.sparkSession, queries, config.router).select("query_id", "lowered")
    # One row per query of the batch on both small sides.
    chosen = cut_lineage(best.join(F.broadcast(asked), "query_id"))
    if tables is None:
        found = tb.with_region_table(regions.filter(F.col("type") == "table"))
        found = found.withColumn("table", ts.region_table(F.col("table"), F.col("text"))).select("doc_pos", "region_idx", "table.columns", "table.rows")
        t = found.join(F.broadcast(chosen), ["doc_pos", "region_idx"])
        t = t.withColumn("types", ts.infer_types(F.col("columns"), F.col("rows")))
    else:
        t = tables.select("doc_pos", "region_idx", "columns", "rows", "types").join(F.broadcast(chosen), ["doc_pos", "region_idx"])
    t = t.withColumn("plan", ts.template_plan(F.col("lowered"), F.col("columns"), F.col("types")))
    return t.select(
        "query_id",
        ts.template_sql(F.col("plan")).alias("sql_query"),
        ts.template_result(F.col("plan"), F.col("columns"), F.col("rows"), F.col("types")).alias("sql_rows"),
    )


def answer_queries(
    regions: DataFrame, queries: rv.Queries, config: EngineConfig | None = None, hits: DataFrame | None = None, tables: DataFrame | None = None
) -> DataFrame:
    """One row per query: answer, statement, evidence, citations and attribution.

    ``hits`` and ``tables`` take those of a region store.
    """
    config = config or EngineConfig()
    hits = hy.written_hits(regions, queries, config) if hits is None else hits
    evidence = evidence_lists(hy.hybrid_retrieve(regions, queries, config, hits))
    asked = rv.routed_queries(regions.sparkSession, queries, config.router)
    rows = (
        asked.select("query_id", "query")
        .join(evidence, "query_id", "left")
        .join(top_table_answers(hits, regions, queries, config, tables), "query_id", "left")
        .withColumn("evidence", F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType)))
    )
    rows = rows.withColumn("answer", ge.template_answer(F.col("evidence"), F.col("sql_rows")))
    first = F.when(
        F.size("sql_rows") > 0, ge.sql_block(F.col("sql_query"), F.to_json("sql_rows"))
    )
    packed = ge.pack_context(F.col("query"), F.col("evidence"), config.generation.max_context_tokens, first)
    rows = rows.withColumn("_p", packed)
    rows = rows.withColumn("citations", ge.citations(F.col("evidence"), F.col("_p"))).drop("_p")
    cfg = config.attribution
    return at.attribute(rows, enabled=cfg.enable_nli, threshold=cfg.flag_threshold_precision)


def service_answers(
    regions: DataFrame, queries: rv.Queries, config: EngineConfig | None = None, hits: DataFrame | None = None
) -> DataFrame:
    """The service wrapper: keyword paths, a second late fusion of the cut list, canned answer."""
    config = config or EngineConfig()
    best = cut_lineage(hy.query_service(regions, queries, config, hits))
    # The cut list is ranked anew per modality by its fused score; it holds a few rows per query.
    ranked = best.withColumnRenamed("rank", "_was")
    order = [F.col("score").desc(), F.col("_was").asc()]
    ranked = ranking.top_k(ranked, ["query_id", "modality"], order, config.reranker.final_top_k)
    ranked = ranked.withColumn("weight", fu.default_weight(F.col("modality")))
    # Items keep their region id; figures have none and are known by document, modality and new rank.
    ranked = ranked.withColumn(
        "item_id",
        F.when(
            F.col("modality") == "vision",
            F.concat_ws("-", "document_id", "modality", F.col("rank").cast("string")),
        ).otherwise(F.col("item_id")),
    )
    fused = fu.fuse_rrf(ranked.drop("rrf_score", "score"), ["document_id", "text"])
    order = [F.col("score").desc(), F.col("first_seen").asc()]
    fused = ranking.top_k(fused, ["query_id"], order, 0)
    asked = rv.routed_queries(regions.sparkSession, queries, config.router).select("query_id", "query")
    evidence = evidence_lists(fused)
    rows = asked.join(evidence, "query_id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType))
    )
    rows = rows.withColumn("prompt", ge.citation_prompt(F.col("query"), F.col("evidence")))
    rows = rows.withColumn("answer", ge.tagged_answer(F.col("query"), F.col("evidence")))
    return at.attribute(rows)
