"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import saved


def _pairs(df: DataFrame, a, b) -> DataFrame:
    """Links from the larger node ``a`` to the smaller ``b``."""
    return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    Alternates two steps until nothing changes: each node hands its smallest neighbour to its larger
    ones, then to its smaller ones. The rounds grow with the logarithm of the longest chain. Minima
    combine before their shuffle, and a hub's links stay rows of a join that can be split; no
    neighbour list is built and nothing but two totals per round reaches the driver. Null ends and
    self links are left out; an empty table gives an empty result.
    """
    edges = saved(_pairs(links.select(F.col(a).alias("a"), F.col(b).alias("b")), F.col("a"), F.col("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.join(least, "u").filter("v > u"), F.col("v"), F.col("m")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = saved(
            joined.select("a", F.col("m").alias("b"))
            .unionByName(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
