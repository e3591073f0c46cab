"""Where external models plug in: layout parsers, OCR, captioners, encoders, pair scorers, generators.

No model ships here. A caller gives ``load``, which builds the model once per Python worker, and
``apply``, which maps a batch of inputs to outputs. Arrow carries the batches. Without an adapter the
deterministic operators stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import rank as rk
from docquarry.operators import segment as sg

Load = Callable[[], Any]
Apply = Callable[[Any, list], list]


def batch_column(load: Load, apply: Apply, return_type: str):
    """A pandas UDF over one column that keeps its model for the life of the task."""

    @F.pandas_udf(return_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(apply(model, batch.tolist()))

    return run


def pair_column(load: Load, apply: Callable[[Any, list, list], list], return_type: str = "double"):
    """A pandas UDF over two columns, for pair scorers."""

    @F.pandas_udf(return_type)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for left, right in batches:
            yield pd.Series(apply(model, left.tolist(), right.tolist()))

    return run


def encode(records: DataFrame, load: Load, apply: Apply, text: str = "text") -> DataFrame:
    """Add ``embedding`` from a sentence encoder."""
    return records.withColumn("embedding", batch_column(load, apply, "array<float>")(F.col(text)))


def cross_encoder_scores(
    candidates: DataFrame, load: Load, apply: Callable[[Any, list, list], list]
) -> DataFrame:
    """Rerank scores of (query, text) pairs with the heading penalty. Uses ``modality, body_len``."""
    raw = pair_column(load, apply)(F.col("query"), F.col("text"))
    return candidates.withColumn("_raw", raw).withColumn(
        "rank_score", rk.model_score(F.col("_raw"), F.col("modality"), F.col("body_len"))
    ).drop("_raw")


def ocr_regions(scanned: DataFrame, load: Load, apply: Apply, image: str = "image") -> DataFrame:
    """Body regions from images of scanned pages; pages that read blank are dropped."""
    read = scanned.withColumn("text", tx.strip(batch_column(load, apply, "string")(F.col(image))))
    return read.filter(F.col("text") != "").select(
        "document_id",
        "page_no",
        F.lit("body").alias("type"),
        "text",
        F.lit("ocr").alias("layout_source"),
        F.lit("text").alias("modality"),
    )


def with_ocr(
    regions: DataFrame, pages: DataFrame, load: Load, apply: Apply, image: str = "image", min_chars: int = 20
) -> DataFrame:
    """Regions and, after them, what OCR reads on scanned pages: detect, read, append.

    ``pages`` (``document_id, page_no, has_image``, image, and ``path`` where not all are PDF files) holds
    the rendered pages. Only those from which fewer than ``min_chars`` characters came are read, and
    pages that read blank add nothing. Columns that OCR does not know are null.
    """
    if "path" in pages.columns:
        pages = pages.filter(F.lower("path").endswith(".pdf"))
    scanned = sg.scanned_pages(pages, sg.page_char_counts(regions), min_chars)
    return regions.unionByName(ocr_regions(scanned, load, apply, image), allowMissingColumns=True)


def parse_layout(files: DataFrame, load: Load, apply: Callable[[Any, str, bytes], list[dict]]) -> DataFrame:
    """Files to layout items, then regions. ``apply`` gives dicts of the item fields for one file."""
    items = (
        "path string, item_no int, item_type string, markdown string, item_text string, orig string, "
        "provenance array<struct<page_no:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        names = [part.split(" ")[0] for part in items.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [{"path": path, "item_no": i, **row} for i, row in enumerate(apply(model, path, content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return sg.layout_items_to_regions(files.select("path", "content").mapInPandas(run, items))


def caption(regions: DataFrame, load: Load, apply: Apply, image: str = "image") -> DataFrame:
    """Model captions for figures whose own text says little; the metadata caption covers the rest."""
    said = batch_column(load, apply, "string")(F.col(image))
    own = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    bare = (F.length(own) <= 8) | F.lower(own).isin("figure", "image", "picture")
    return regions.withColumn(
        "text", F.when((F.col("type") == "figure") & bare & F.col(image).isNotNull(), F.coalesce(said, own)).otherwise(F.col("text"))
    )


def generate(prompts: DataFrame, load: Load, apply: Apply, prompt: str = "prompt") -> DataFrame:
    """Add ``raw_answer`` from a text generator; NULL leaves the template answer in place."""
    return prompts.withColumn("raw_answer", batch_column(load, apply, "string")(F.col(prompt)))
