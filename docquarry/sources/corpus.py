"""Corpus artefacts: nested documents, Parquet tables, JSON lines, reload and log sinks.

Parquet tables are the working form. JSON lines carry one whole document per line, built inside the
document's own row, so writing them needs no grouping either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schema
from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import segment as sg
from docquarry.operators import tables as tb


def nested_documents(docs: DataFrame) -> DataFrame:
    """Documents with ``regions`` to the nested schema, regions and chunks included."""
    doc = sg.document_id(F.col("path"))
    title = F.get(F.filter("regions", lambda r: r["type"] == "title"), F.lit(0))["text"]
    base = docs.withColumn("id", doc)

    def region(r, i):
        table = F.when(r["type"] == "table", tb.table_from_grid(tb.markdown_grid(r["text"])))
        return F.struct(
            sg.region_id(F.col("id"), i).alias("id"),
            r["type"].alias("type"),
            r["text"].alias("text"),
            r["start"].alias("start"),
            r["end"].alias("end"),
            F.lit(-1).alias("page_no"),
            F.lit(None).cast(schema.BBOX).alias("bbox"),
            F.lit("rule").alias("layout_source"),
            F.when(table.isNotNull(), r["text"]).alias("table_markdown"),
            table.alias("table"),
        )

    def chunk(r, i):
        rid = sg.region_id(F.col("id"), i)
        return F.struct(
            sg.chunk_id(rid, i).alias("id"),
            F.col("id").alias("document_id"),
            rid.alias("region_id"),
            sg.modality_of(r["type"]).alias("modality"),
            r["text"].alias("text"),
        )

    source = sg.file_name(F.col("path"))
    return base.select(
        "id",
        source.alias("source"),
        F.coalesce(tx.strip(title), sg.file_stem(F.col("path"))).alias("title"),
        F.transform("regions", region).cast(schema.DOCUMENT["regions"].dataType).alias("regions"),
        F.transform("regions", chunk).alias("chunks"),
        F.create_map(
            F.lit("document_id"),
            F.col("id"),
            F.lit("source_path"),
            source,
            F.lit("chunk_count"),
            F.size("regions").cast("string"),
            F.lit("namespace"),
            F.lit(sg.NAMESPACE),
        ).alias("metadata"),
    )


def write_documents(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.DOCUMENT).json(path)


def region_rows(nested: DataFrame) -> DataFrame:
    keys = [F.col("id").alias("document_id"), "title"]
    return unnest(nested, keys, F.col("regions"), "r", "region_idx").select("document_id", "title", "region_idx", "r.*")


def chunk_rows(nested: DataFrame) -> DataFrame:
    return unnest(nested, [], F.col("chunks"), "c").select("c.*")


def write_regions(regions: DataFrame, path: str) -> None:
    """Region table partitioned by modality, so a path's scan reads its own files only."""
    regions.write.mode("overwrite").partitionBy("modality").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to completion, on any Hadoop file system."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def load_or_build(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Reload nested documents from ``path``, building and writing them first when absent or forced."""
    if force or not exists(spark, path):
        write_documents(build(), path)
    return read_documents(spark, path)


def append_failures(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
