"""Exports of evaluated runs: retriever triplets, reranker pairs and instruction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.evaluate import related

INSTRUCTION = "Synthesize a grounded answer using the provided multi-modal evidence context."
EVIDENCE_ITEMS, PAIR_DEPTH = 3, 10


def judged(results: DataFrame, qrels: DataFrame, both_ways: bool) -> DataFrame:
    """Results with ``relevant``: a semi-join on the matching predicate, spelled as a flag."""
    match = (
        related(F.col("rel_id"), F.col("document_id")) if both_ways else F.contains("document_id", F.col("rel_id"))
    )
    keys = ["query_id", "rank"]
    hit = (
        results.select(*keys, "document_id")
        .join(qrels.select("query_id", "rel_id"), "query_id")
        .filter(match)
        .select(*keys)
        .distinct()
        .withColumn("relevant", F.lit(True))
    )
    return results.join(hit, keys, "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def retriever_triplets(queries: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """First relevant and first irrelevant result of each query that has both."""
    def first(flag: bool) -> Column:
        chosen = F.when(F.col("relevant") == flag, F.col("rank"))
        return F.min_by(F.struct("document_id", "text"), chosen)

    best = (
        judged(results, qrels, both_ways=False)
        .groupBy("query_id")
        .agg(
            first(True).alias("p"),
            first(False).alias("n"),
            F.max("relevant").alias("_has_p"),
            F.min("relevant").alias("_has_no_n"),
        )
        .filter(F.col("_has_p") & ~F.col("_has_no_n"))
    )
    return best.join(queries, "query_id").select(
        "query_id",
        "query",
        F.col("p.text").alias("positive"),
        F.col("n.text").alias("negative"),
        F.col("p.document_id").alias("positive_id"),
        F.col("n.document_id").alias("negative_id"),
    )


def reranker_pairs(queries: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Top ten results of each query labelled 1.0 or 0.0."""
    top = results.filter(F.col("rank") <= PAIR_DEPTH)
    return (
        judged(top, qrels, both_ways=True)
        .join(queries, "query_id")
        .select(
            "query_id",
            "rank",
            "query",
            F.col("text").alias("document"),
            F.when(F.col("relevant"), 1.0).otherwise(0.0).alias("label"),
            "document_id",
        )
    )


def instruction_records(df: DataFrame, query: str = "query", evidence: str = "evidence", answer: str = "answer") -> DataFrame:
    """Instruction, query with its first three evidence texts, and answer."""
    context = F.array_join(
        F.transform(
            F.slice(evidence, 1, EVIDENCE_ITEMS),
            lambda e: F.concat(F.lit("["), F.upper(e["modality"]), F.lit("] "), e["text"]),
        ),
        "\n\n",
    )
    return df.withColumn("instruction", F.lit(INSTRUCTION)).withColumn(
        "input", F.concat(F.lit("Query: "), F.col(query), F.lit("\n\nEvidence Context:\n"), context)
    ).withColumn("output", F.col(answer))
