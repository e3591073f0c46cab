"""Documents to typed regions to one-chunk-per-region, without a shuffle.

A document is one row, so segmentation works inside the row: block openings are marked with a
character that cannot occur inside a line, the marked lines are joined and split again at the marks,
and the blocks are exploded. No exchange and no Python worker is involved, and the same
transformation runs unchanged on a stream.

Input: ``doc_pos BIGINT`` (corpus order), ``path STRING``, ``text STRING``, plus any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import unnest

NAMESPACE = "docquarry-v1"

# Both end a line, hence never appear within one.
_OPEN = "\x1d"
_AFTER_INDEX = "\x1e"

TEXT_TYPES = ("title", "body", "paragraph")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc-"), file_stem(path), F.lit("-"), F.substring(F.sha2(path, 256), 1, 12))


def region_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("-region-", doc, index.cast("string"))


def chunk_id(region: Column, index: Column) -> Column:
    return F.concat_ws("-chunk-", region, index.cast("string"))


def modality_of(region_type: Column) -> Column:
    return (
        F.when(region_type == "table", "table").when(region_type == "figure", "vision").otherwise("text")
    )


def _is_special(line: Column) -> Column:
    lowered = F.lower(line)
    return lowered.startswith("table:") | lowered.startswith("figure:")


def _block_type(first: Column) -> Column:
    lowered = F.lower(first)
    return (
        F.when(lowered.startswith("table:"), "table")
        .when(lowered.startswith("figure:"), "figure")
        .otherwise("body")
    )


def _region(kind: Column, body: Column, start: Column) -> Column:
    return F.struct(
        kind.alias("type"),
        body.alias("text"),
        start.cast("int").alias("start"),
        (start + F.length(body)).cast("int").alias("end"),
    )


def _regions_array(stripped: Column) -> Column:
    """Regions of one document from its stripped lines."""

    def mark(line: Column, i: Column) -> Column:
        opens = (
            _is_special(line) | (i == 1) | (F.get(stripped, i - 1) == "")
        )
        return (
            F.when((i == 0) | (line == ""), F.lit(None).cast("string"))
            .when(opens, F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_AFTER_INDEX), line))
            .otherwise(F.concat(F.lit("\n"), line))
        )

    marked = F.array_join(F.transform(stripped, mark), "")
    blocks = F.filter(F.split(marked, _OPEN), lambda b: b != "")
    body = F.transform(
        blocks,
        lambda b: _region(
            _block_type(F.element_at(F.split(b, _AFTER_INDEX, 2), 2)),
            F.element_at(F.split(b, _AFTER_INDEX, 2), 2),
            F.element_at(F.split(b, _AFTER_INDEX, 2), 1).cast("int"),
        ),
    )
    title = F.get(F.filter(stripped, lambda l: (l != "") & ~_is_special(l)), F.lit(0))
    titles = F.when(
        title.isNotNull(), F.array(_region(F.lit("title"), title, F.lit(0)))
    ).otherwise(F.array().cast("array<struct<type:string,text:string,start:int,end:int>>"))
    return F.concat(titles, body)


def with_regions(docs: DataFrame) -> DataFrame:
    """Add ``regions ARRAY<STRUCT<type,text,start,end>>`` to each document row."""
    return (
        docs.withColumn("_lines", F.transform(tx.lines(F.col("text")), tx.strip))
        .withColumn("regions", _regions_array(F.col("_lines")))
        .drop("_lines")
    )


def explode_regions(docs: DataFrame) -> DataFrame:
    """One row per region of documents that already hold a ``regions`` array."""
    keys = ["doc_pos", document_id(F.col("path")).alias("document_id"), "path"]
    return unnest(docs, keys, F.col("regions"), "_r", "region_idx").select(
        "doc_pos",
        "document_id",
        "path",
        "region_idx",
        region_id(F.col("document_id"), F.col("region_idx")).alias("region_id"),
        "_r.*",
        modality_of(F.col("_r.type")).alias("modality"),
        F.lit("rule").alias("layout_source"),
    )


def segment(docs: DataFrame) -> DataFrame:
    """Raw documents to region rows."""
    return explode_regions(with_regions(docs))


def document_titles(docs: DataFrame) -> DataFrame:
    """First non-blank title region, else the file stem; takes the output of ``with_regions``."""
    found = F.get(
        F.filter("regions", lambda r: (r["type"] == "title") & (tx.strip(r["text"]) != "")), F.lit(0)
    )["text"]
    return docs.select(
        "doc_pos",
        document_id(F.col("path")).alias("document_id"),
        F.coalesce(tx.strip(found), file_stem(F.col("path"))).alias("title"),
    )


def region_chunks(regions: DataFrame) -> DataFrame:
    """One chunk per region. The chunk index is the running chunk count, i.e. the region index."""
    return regions.select(
        chunk_id(F.col("region_id"), F.col("region_idx")).alias("chunk_id"),
        "document_id",
        "doc_pos",
        "region_idx",
        "region_id",
        "modality",
        "text",
        F.col("type").alias("region_type"),
        file_name(F.col("path")).alias("source_path"),
        F.lit(NAMESPACE).alias("namespace"),
        "layout_source",
    )


def modality_split(docs: DataFrame) -> DataFrame:
    """Per document with ``regions``, how many go to each path; counted inside the row."""
    found = F.transform("regions", lambda r: modality_of(r["type"]))
    return docs.select(
        document_id(F.col("path")).alias("document_id"),
        *[
            (F.size(found) - F.size(F.array_remove(found, m))).alias(f"{m}_regions")
            for m in ("text", "table", "vision")
        ],
    )


def caption_figures(regions: DataFrame, title: str = "doc_title") -> DataFrame:
    """Give each figure region a caption: its own text when descriptive, else one from metadata.

    Uses ``text, page_no, bbox`` and the title column; other region types pass through.
    """
    existing = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    box = F.col("bbox")
    generated = F.concat_ws(
        " ",
        F.lit("Figure"),
        F.when(F.col("page_no") >= 0, F.concat(F.lit("on page "), (F.col("page_no") + 1).cast("string"))),
        F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("from "), F.col(title))),
        F.when(
            box.isNotNull(),
            F.concat(
                F.lit("("),
                tx.pyround(box["x1"] - box["x0"], 1).cast("string"),
                F.lit("×"),
                tx.pyround(box["y1"] - box["y0"], 1).cast("string"),
                F.lit(" pts)"),
            ),
        ),
    )
    descriptive = (F.length(existing) > 8) & ~F.lower(existing).isin("figure", "image", "picture")
    caption = (
        F.when(descriptive, existing)
        .when(existing != "", F.trim(F.concat(existing, F.lit(" - "), generated), F.lit(" -")))
        .otherwise(generated)
    )
    return regions.withColumn("caption", F.when(F.col("type") == "figure", caption)).withColumn(
        "text", F.coalesce("caption", "text")
    )


def classify_layout_item(type_name: Column) -> Column:
    """Layout-model item class to region type; NULL for items that are dropped."""
    return (
        F.when(type_name == "SectionHeaderItem", "title")
        .when(type_name.isin("TextItem", "ListItem", "InlineGroup"), "body")
        .when(type_name == "TableItem", "table")
        .when(type_name.isin("PictureItem", "FigureItem"), "figure")
    )


def layout_items_to_regions(items: DataFrame) -> DataFrame:
    """Layout-model items to regions.

    Items: ``item_type, markdown, item_text, orig, provenance ARRAY<STRUCT<page_no, bbox>>`` plus
    document keys. Text preference is markdown, text, original; geometry is the first provenance
    entry; blank items are dropped unless they are tables.
    """
    first = F.get("provenance", F.lit(0))
    text = F.coalesce(
        F.when(F.col("markdown") != "", F.col("markdown")),
        F.when(F.col("item_text") != "", F.col("item_text")),
        F.col("orig"),
        F.lit(""),
    )
    return (
        items.withColumn("type", classify_layout_item(F.col("item_type")))
        .withColumn("text", text)
        .withColumn("page_no", F.coalesce(first["page_no"], F.lit(-1)))
        .withColumn("bbox", first["bbox"])
        .withColumn("layout_source", F.lit("layout"))
        .filter(F.col("type").isNotNull() & ((tx.strip(F.col("text")) != "") | (F.col("type") == "table")))
        .drop("item_type", "markdown", "item_text", "orig", "provenance")
    )


def page_char_counts(regions: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Characters extracted per known page."""
    return (
        regions.filter(F.col("page_no") >= 0)
        .groupBy(*keys, "page_no")
        .agg(F.sum(F.length("text")).alias("n_chars"))
    )


def scanned_pages(
    pages: DataFrame, counts: DataFrame, min_chars: int = 20, keys: tuple[str, ...] = ("document_id",)
) -> DataFrame:
    """Pages holding an image from which too little text came. Both sides join on (keys, page_no)."""
    return (
        pages.filter("has_image")
        .join(counts, [*keys, "page_no"], "left")
        .withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
        .filter(F.col("n_chars") < min_chars)
    )
