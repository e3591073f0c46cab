"""Reranking by token overlap, with a pluggable pair scorer in :mod:`docquarry.operators.adapters`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import text as tx

SHORT_HEADING_CHARS = 45
HEADING_PENALTY = 0.5


def modality_weight(modality: Column) -> Column:
    return F.when(modality == "table", 1.3).when(modality == "vision", 1.1).otherwise(1.0)


def heading_penalty(
    modality: Column, body_len: Column, threshold: int = SHORT_HEADING_CHARS, factor: float = HEADING_PENALTY
) -> Column:
    return F.when((body_len < threshold) & (modality == "text"), F.lit(factor)).otherwise(F.lit(1.0))


def rank_score(
    score: Column,
    jaccard: Column,
    modality: Column,
    body_len: Column,
    threshold: int = SHORT_HEADING_CHARS,
    factor: float = HEADING_PENALTY,
) -> Column:
    """(0.7 · fused score + 30 · Jaccard · modality weight) · heading penalty, three digits."""
    raw = score * F.lit(0.7) + jaccard * F.lit(100.0) * F.lit(0.3) * modality_weight(modality)
    return tx.pyround(raw * heading_penalty(modality, body_len, threshold, factor), 3)


def model_score(score: Column, modality: Column, body_len: Column) -> Column:
    """Cross-encoder score with the same penalty. A negative score is raised by it, as specified."""
    return tx.pyround(score * heading_penalty(modality, body_len), 4)
