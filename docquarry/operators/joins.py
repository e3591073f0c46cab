"""Join sides that are broadcast only after their size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Narrow rows only (ids, terms, weights): about 100 bytes each.
BROADCAST_ROWS = 200_000


def hinted(df: DataFrame, at_most: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a side already known to have no more than ``at_most`` rows."""
    return F.broadcast(df) if at_most <= max_rows else df


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows, else leave a shuffle join to AQE.

    The check reads at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
