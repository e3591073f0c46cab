"""Score normalisation, weighted reciprocal rank fusion and chart evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import joins, ranking
from docquarry.operators import retrieve as rv

# Default fusion weights, and the weight of an unlisted modality.
DEFAULT_WEIGHTS = {"text": 0.45, "table": 0.35, "vision": 0.20}
OTHER_WEIGHT = 0.33
RRF_K = 60


def normalize(
    hits: DataFrame, keys: list[str], score: str = "score", out: str = "nscore", few_groups: bool = False
) -> DataFrame:
    """Divide by the group's best score, two digits; 0 where the best is 0.

    The maxima are combined before their shuffle and joined back, one row per group. ``few_groups``
    states that the caller has bounded them (a query batch times its lists); otherwise their number
    is checked before they are broadcast.
    """
    best = hits.groupBy(*keys).agg(F.max(score).alias("_best"))
    best = F.broadcast(best) if few_groups else joins.bounded(best)
    scaled = F.when(F.col("_best") != 0, tx.pyround(F.col(score) / F.col("_best"), 2)).otherwise(0.0)
    return hits.join(best, keys).withColumn(out, scaled).drop("_best")


def modality_order(modality: Column) -> Column:
    return F.when(modality == "text", 0).when(modality == "table", 1).when(modality == "vision", 2).otherwise(3)


def default_weight(modality: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in DEFAULT_WEIGHTS.items():
        out = F.when(modality == name, F.lit(weight)).otherwise(out)
    return out


def rank_runs(
    hits: DataFrame, levels: list[tuple[str, bool]] | None = None, keys: tuple[str, ...] = ("query_id", "modality"), only: DataFrame | None = None
) -> DataFrame:
    """Rank each modality's run; batches of one modality are concatenated before sorting.

    With ``only`` (``keys``, ``doc_pos``, ``region_idx``, ``batch``) the ranks of those hits among all.
    """
    levels = levels or [("nscore", False), ("batch", True), ("score", False)]
    ties = ("region_idx", "batch") if "batch" in hits.columns else ("region_idx",)
    return ranking.exact_rank(hits, list(keys), levels, ties=ties, only=only)


def fuse_rrf(
    ranked: DataFrame, payload: list[str], rrf_k: int = RRF_K, keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Merge ranked runs: Σ weight / (k + rank) per item.

    Needs ``modality, rank, weight, item_id`` plus ``payload``. The payload of the item's last
    occurrence wins, ties later fall back to the first occurrence (``first_seen``).
    """
    at = F.struct(modality_order(F.col("modality")).alias("run"), F.col("rank").alias("rank"))
    merged = (
        ranked.withColumn("_at", at)
        .withColumn("_part", F.col("weight") / (F.lit(rrf_k) + F.col("rank")))
        .groupBy(*keys, "item_id")
        .agg(
            F.sum("_part").alias("_rrf"),
            F.max_by(F.struct("modality", *payload), "_at").alias("_payload"),
            F.min("_at").alias("first_seen"),
            F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("fused_modalities"),
        )
    )
    return merged.select(
        *keys,
        "item_id",
        "_payload.*",
        tx.pyround(F.col("_rrf"), 5).alias("rrf_score"),
        tx.pyround(F.col("_rrf") * F.lit(100.0), 3).alias("score"),
        "fused_modalities",
        "first_seen",
    )


def chart_type(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(lowered.contains("bar"), "bar_chart")
        .when(lowered.contains("line") | lowered.contains("trend"), "line_chart")
        .when(lowered.contains("pie"), "pie_chart")
        .when(lowered.contains("scatter"), "scatter_plot")
        .when(lowered.contains("diagram"), "diagram")
        .otherwise("chart")
    )


def is_visual(modality: Column, text: Column) -> Column:
    return (modality == "vision") | rv.is_visual_text(F.lower(text))


def chart_evidence(hits: DataFrame, query: Column | None = None) -> DataFrame:
    """Visual hits as linearised chart evidence.

    Uses ``modality, text, page_no``, and ``figure_type`` when present. Page 0 and unknown pages
    read ``N/A``.
    """
    known = F.nullif(F.col("figure_type"), F.lit("")) if "figure_type" in hits.columns else F.lit(None).cast("string")
    page = F.coalesce(F.when(F.col("page_no") != 0, F.col("page_no").cast("string")), F.lit("N/A"))
    kind = F.coalesce(known, chart_type(F.col("text")))
    query = F.lit("") if query is None else query
    out = (
        hits.filter(is_visual(F.col("modality"), F.col("text")))
        .withColumn("chart_type", kind)
        .withColumn("_page", page)
        .withColumn(
            "linearized",
            F.concat(
                F.lit("["), F.upper("chart_type"), F.lit(" - Page "), F.col("_page"), F.lit("] "), tx.strip(F.col("text"))
            ),
        )
        .withColumn(
            "reasoning",
            F.concat(
                F.lit("Extracted visual chart evidence matching '"),
                query,
                F.lit("' (Type: "),
                F.col("chart_type"),
                F.lit(", Page: "),
                F.col("_page"),
                F.lit(")"),
            ),
        )
        .withColumn("modality", F.lit("vision"))
    )
    return out.drop("_page")


def expand_parent(hits: DataFrame) -> DataFrame:
    """Swap in the parent text where it is longer, keeping the child's."""
    longer = F.coalesce(F.length("parent_text") > F.length("text"), F.lit(False))
    return hits.withColumn("child_text", F.when(longer, F.col("text"))).withColumn(
        "text", F.when(longer, F.col("parent_text")).otherwise(F.col("text"))
    )
