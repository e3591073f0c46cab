"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.session import checkpoint_folder, freed_shuffles

# Words are runs of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors, and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; empty where it is null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the 0-based position of each row in a global order, without a global window.

    Rows are range-partitioned and numbered within their partition; only one count per partition is
    summed up. The partitioning is written down first, as a second run of it may cut elsewhere.
    """
    pid, local, before = f"_{out}_pid", f"_{out}_local", f"_{out}_before"
    parts = saved(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    counts = parts.groupBy(pid).agg(F.count("*").alias("_n"))
    start = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(pid), F.coalesce(F.sum("_n").over(start), F.lit(0)).alias(before))
    numbered = parts.withColumn(local, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    return (
        numbered.join(F.broadcast(counts), pid)  # one row per shuffle partition
        .withColumn(out, (F.col(local) + F.col(before) - 1).cast("long"))
        .drop(pid, local, before)
    )


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by ``keys``: each group is in one table.

    Holds one batch and the rest of the group that the batch before it broke off.
    """
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        last = {k: rows[k][rows.num_rows - 1].as_py() for k in keys}
        cut, high = 0, rows.num_rows - 1
        while cut < high:  # first row of the last group
            mid = (cut + high) // 2
            if all(rows[k][mid].as_py() == last[k] for k in keys):
                high = mid
            else:
                cut = mid + 1
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest
