"""Query routing: keyword probabilities, flags, weights, and the trained vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import RouterConfig
from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import joins

MODALITIES = ("text", "table", "vision")

# The labelled routing queries.
LABELED_QUERIES = [
    ("revenue growth report", ["text"], "text-only"),
    ("revenue by region", ["text", "table"], "mixed"),
    ("adoption chart figure", ["vision"], "figure-heavy"),
    ("quarterly revenue table total", ["text", "table"], "mixed"),
    ("bar chart breakdown of market share", ["vision", "text"], "mixed"),
    ("executive summary risk factors", ["text"], "text-only"),
]


def labeled_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELED_QUERIES, "query string, labels array<string>, target string")


def probability(query: Column, modality: str, config: RouterConfig | None = None) -> Column:
    """Sigmoid of the number of keywords found as substrings; a floor when none is."""
    config = config or RouterConfig()
    lowered = F.lower(query)
    matches = sum(
        (F.when(lowered.contains(kw), 1).otherwise(0) for kw in config.modality_keywords[modality]),
        F.lit(0),
    )
    floor = 0.5 if modality == "text" else 0.1
    score = F.when(matches == 0, F.lit(floor)).otherwise(
        F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-config.sigmoid_lambda) * matches))
    )
    return tx.pyround(score, 3)


def with_routes(df: DataFrame, query: str = "query", config: RouterConfig | None = None) -> DataFrame:
    """Add ``p_*``, ``use_*`` and ``w_*`` per modality; all are expressions of the row's query."""
    config = config or RouterConfig()
    for m in MODALITIES:
        df = df.withColumn(f"p_{m}", probability(F.col(query), m, config))
    total = F.col("p_text") + F.col("p_table") + F.col("p_vision")
    for m in MODALITIES:
        df = df.withColumn(f"use_{m}", F.col(f"p_{m}") >= config.threshold)
        df = df.withColumn(f"w_{m}", tx.pyround(F.col(f"p_{m}") / total, 3))
    return df


def train(labeled: DataFrame) -> DataFrame:
    """Token weights per modality: each occurrence adds 1.0 where labelled, 0.1 elsewhere.

    ``query STRING, labels ARRAY<STRING>``. Counting the two kinds separately keeps the sums exact
    and lets them combine before the shuffle.
    """
    tokens = unnest(labeled, ["labels"], tx.words(F.lower("query")), "token")
    marks = tokens.select(
        "token",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("modality"), F.array_contains("labels", m).alias("hit"))
                    for m in MODALITIES
                ]
            )
        ).alias("m"),
    )
    return (
        marks.groupBy("token", "m.modality")
        .agg(F.count(F.when(F.col("m.hit"), 1)).alias("hits"), F.count("*").alias("n"))
        .select(
            "token",
            "modality",
            tx.pyround(F.col("hits") + (F.col("n") - F.col("hits")) * F.lit(0.1), 2).alias("weight"),
        )
    )


def infer(queries: DataFrame, vocabulary: DataFrame, key: str = "query_id") -> DataFrame:
    """Probabilities from a trained vocabulary: Σ weight / max(1, 2·tokens), capped at 1.

    The vocabulary is broadcast only when small; otherwise both sides shuffle on the token.
    """
    wide = vocabulary.groupBy("token").agg(
        *[F.sum(F.when(F.col("modality") == m, F.col("weight"))).alias(m) for m in MODALITIES]
    )
    counted = queries.select(key, tx.words(F.lower("query")).alias("_tokens")).withColumn(
        "_n", F.size("_tokens")
    )
    tokens = counted.select(key, "_n", F.explode_outer("_tokens").alias("token"))
    scored = tokens.join(joins.bounded(wide), "token", "left").groupBy(key, "_n")
    totals = scored.agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MODALITIES])
    return totals.select(
        key,
        *[
            tx.pyround(
                F.least(F.lit(1.0), F.col(m) / F.greatest(F.lit(1.0), F.col("_n") * F.lit(2.0))), 3
            ).alias(f"p_{m}")
            for m in MODALITIES
        ],
    )
