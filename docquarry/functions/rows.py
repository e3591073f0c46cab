"""Turning nested columns into rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so ``body`` may use it often and it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, items: Column, item: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, dropping empty arrays.

    The outer generator plus a filter on its output is used on purpose: for a plain explode the
    optimizer infers ``size(items) > 0`` and pushes it below, which evaluates ``items`` twice.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())


def present(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """Rows whose ``value`` is not NULL, with it as column ``name``.

    A filter on a projected expression is pushed below the projection, which evaluates the
    expression once to filter and once more to project. Filtering generated rows cannot be pushed.
    """
    return unnest(df, keep, F.filter(F.array(value), lambda v: v.isNotNull()), name).drop("_pos")


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row: a union and a maximum, no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
