"""File corpora: listing, typing, decoding and ordering of input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import ranking
from docquarry.operators import segment as sg
from docquarry.session import cut_lineage

# MIME type per suffix; the first nine are the supported ones, in listing order.
MIME_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".csv": "text/csv",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
# Other suffixes whose MIME type is a supported one.
ALIASES = {
    ".markdown": "text/markdown",
    ".bat": "text/plain",
    ".c": "text/plain",
    ".h": "text/plain",
    ".ksh": "text/plain",
    ".pl": "text/plain",
    ".srt": "text/plain",
}
OTHER_MIME = "application/octet-stream"
BINARY = (".pdf", ".docx", ".pptx", ".xlsx")
LAST = 99


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, '' if none; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(sg.file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup({**MIME_TYPES, **ALIASES}, suffix(path)), F.lit(OTHER_MIME))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*MIME_TYPES, *ALIASES)


def listing_priority(path: Column) -> Column:
    order = {s: i for i, s in enumerate(MIME_TYPES)}
    return F.coalesce(_lookup(order, suffix(path)), F.lit(LAST))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 with undecodable ones left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    )


def fallback_text(path: Column, size: Column) -> Column:
    """Stand-in for a binary document no converter has read; '' for an empty file."""
    note = F.concat(F.lit("[Extracted from "), suffix(path), F.lit(" document] "), sg.file_name(path))
    return F.when(size == 0, "").otherwise(note)


def file_text(path: Column, content: Column, converted: Column | None = None) -> Column:
    """Text of a file: raw for text formats, else what a converter gave, else the stand-in."""
    binary = fallback_text(path, F.length(content))
    if converted is not None:
        binary = F.coalesce(F.nullif(converted, F.lit("")), binary)
    return F.when(suffix(path).isin(*BINARY), binary).otherwise(decode(content))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files of one folder, not below it, empty ones included. Contents are not read.

    The source lists every file but makes no row of an empty one; those are added from its listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "listed string")
    found = files.select("path", "length")
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("listed"), F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):///", "$1:/")
    names = listed.select(plain.alias("path"))
    empty = names.join(found.select("path"), "path", "left_anti").withColumn("length", F.lit(0).cast("bigint"))
    return found.unionByName(empty).filter(is_supported(F.col("path")))


def with_positions(files: DataFrame, path: str = "path", out: str = "doc_pos") -> DataFrame:
    """Corpus order: by format priority, then lower-cased name.

    A range-partitioned sort gives increasing ids that are written once, so they cannot change when
    a task is run again; exact ranks over them are dense.
    """
    name = F.lower(sg.file_name(F.col(path)))
    placed = files.orderBy(listing_priority(F.col(path)), name, path)
    placed = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()))
    ranked = ranking.exact_rank(placed, [], [], pos="_id", ties=(path,), out="_rank")
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_id", "_rank")


def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``doc_pos, path, text`` of a folder of files."""
    order = with_positions(list_files(spark, directory)).select("path", "doc_pos")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    content = F.coalesce("content", F.lit("").cast("binary"))
    return order.join(raw.select("path", "content"), "path", "left").select(
        "doc_pos", "path", file_text(F.col("path"), content).alias("text")
    )

