"""Folders of mixed formats through converters, page by page, with failures kept as rows.

Files are listed and read by Spark's ``binaryFile`` source, so any file system that Spark reaches will do, and
folders grow into streams by the same functions. A converter takes a path and the bytes and gives the
file's pages; what it raises is the file's failure and ends nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.sources import files as fl

Convert = Callable[[str, bytes], list[str]]
# What stands between the pages of a document.
PAGE_BREAK = "\n\n"


def convert_pages(files: DataFrame, convert: Convert) -> DataFrame:
    """``path, page_no, text, error`` of ``path, content`` files, a row per page from 1; one with an error if a file fails.

    Files without a page have no row. Works on a stream as well. A task holds one file at a time beside its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name, pages, error = path.as_py(), [], None
                try:
                    pages = [None if p is None else str(p) for p in convert(name, content.as_py() or b"")]
                except Exception as fault:  # of a converter, whatever it is
                    error = f"{type(fault).__name__}: {fault}"
                n = len(pages) if error is None else 1
                numbers = list(range(1, n + 1)) if error is None else [None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(numbers, pa.int32()), pa.array(pages if error is None else [None], pa.string()), pa.array([error] * n, pa.string())],
                    ["path", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, text string, error string")


def joined_pages(pages: DataFrame) -> DataFrame:
    """``path, text, n_pages, error``: pages that hold text, in order, a blank line between them.

    A file with an error has a null text. Pages of one document meet in one row, as its text has to.
    """
    kept = F.when(F.col("text") != "", F.struct("page_no", "text"))
    found = pages.groupBy("path").agg(F.sort_array(F.collect_list(kept)).alias("p"), F.count("page_no").cast("int").alias("n_pages"), F.max("error").alias("error"))
    text = F.when(F.col("error").isNull(), F.array_join(F.transform("p", lambda p: p["text"]), PAGE_BREAK))
    return found.select("path", text.alias("text"), "n_pages", "error")


def read_converted(spark: SparkSession, directory: str, convert: Convert) -> DataFrame:
    """``doc_pos, path, text, n_pages, error`` of a folder: as ``read_corpus``, with binary documents converted.

    Text formats are read as they are. Where a converter fails or finds no text the stand-in takes its place.
    """
    order = fl.with_positions(fl.list_files(spark, directory)).select("path", "doc_pos")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select("path", "content")
    binary = raw.filter(fl.suffix(F.col("path")).isin(*fl.BINARY))
    converted = joined_pages(convert_pages(binary, convert)).withColumnRenamed("text", "_converted")
    rows = order.join(raw, "path", "left").join(converted, "path", "left")
    text = fl.file_text(F.col("path"), F.coalesce("content", F.lit("").cast("binary")), F.when(tx.strip("_converted") != "", F.col("_converted")))
    return rows.select("doc_pos", "path", text.alias("text"), "n_pages", "error")


def format_robustness(read: DataFrame) -> DataFrame:
    """``suffix, files, failures, success_pct`` per format of converted files, and their mean over the formats in ``robustness_pct``."""
    by = read.groupBy(fl.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("files"), F.count("error").alias("failures"))
    by = by.withColumn("success_pct", tx.pyround(F.lit(100.0) * (F.col("files") - F.col("failures")) / F.col("files"), 4))
    mean = by.groupBy(F.lit(1).alias("_all")).agg(tx.pyround(F.avg("success_pct"), 4).alias("robustness_pct"))
    return by.withColumn("_all", F.lit(1)).join(F.broadcast(mean), "_all").drop("_all")  # one row
