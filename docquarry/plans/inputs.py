"""Inputs the registered queries derive from the given tables, as DataFrames and as oracle CTEs.

Every derivation covers its whole table. The corpus decorates each line of each document by the
line's own length, so titles, headings, tables, figures and blank lines all occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import segment as sg
from docquarry.session import checkpoint_folder, spread

# Queries used by the batch retrieval operators: routing phrases and frequent corpus words.
QUERY_SET = [
    (1, "revenue growth of the company report"),
    (2, "average revenue by region table"),
    (3, "adoption bar chart figure"),
    (4, "the and that"),
    (5, "que los para cion"),
    (6, "total assets 2024 for item"),
    (7, "und der die nicht"),
    (8, "est les une dans"),
    (9, "item revenue 2024 sum"),
    (10, "trend in the figure by percent"),
]


# Tables whose rows are costly to process.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


_WRITTEN: dict[tuple, str] = {}


def written(spark: SparkSession, sf: str, name: str, write: Callable[[str], None], inputs: tuple[str, ...] = ("documents",)) -> str:
    """Folder of an index or table derived from ``inputs``: written by ``write(folder)`` once and read by all that need it.

    It stays in the checkpoint folder for the application, and is written anew when a file of its
    inputs has changed.
    """
    files = [spark.read.format("binaryFile").load(f"{sf}/{t}.parquet").select("path", "modificationTime", "length") for t in inputs]
    state = tuple(tuple(f.agg(F.count("*"), F.max("modificationTime"), F.sum("length"), F.sum(F.xxhash64("path").cast("decimal(38,0)"))).first()) for f in files)
    key = (spark.sparkContext.applicationId, sf, name, state)
    if key not in _WRITTEN:
        folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


_VALUE = """CASE length(w) % 4
        WHEN 0 THEN concat('(1,', lpad(cast(length(w) as {s}), 3, '0'), ')')
        WHEN 1 THEN concat('$', cast(length(w) as {s}), '.50')
        WHEN 2 THEN 'N/A'
        ELSE cast(length(w) as {s}) END"""

_LINE = """CASE length(l) % 6
    WHEN 0 THEN concat('Table: ', l, {nl}, '| item | revenue 2024 |', {nl}, '| --- | --- |', {rows}, {nl})
    WHEN 1 THEN concat('Figure: bar chart ', l)
    WHEN 2 THEN concat({nl}, l)
    WHEN 3 THEN concat({nl}, '# ', l)
    ELSE l END"""

_SPARK_ROWS = (
    "array_join(transform(filter(split(l, ' '), w -> w <> ''), w -> concat('\\n| ', replace(w, '|', '/'), ' | ', "
    + _VALUE.format(s="string")
    + ", ' |')), '')"
)
SPARK_DECORATED = (
    "array_join(transform(split(text, '\\n'), l -> " + _LINE.format(nl="'\\n'", rows=_SPARK_ROWS) + "), '\\n')"
)
_DUCK_ROWS = (
    "array_to_string(list_transform(list_filter(string_split(l, ' '), lambda w: w <> ''), "
    "lambda w: concat(chr(10), '| ', replace(w, '|', '/'), ' | ', " + _VALUE.format(s="varchar") + ", ' |')), '')"
)
DUCK_DECORATED = (
    "array_to_string(list_transform(string_split(text, chr(10)), lambda l: "
    + _LINE.format(nl="chr(10)", rows=_DUCK_ROWS)
    + "), chr(10))"
)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_pos, path, text``: the documents table as a file corpus."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_pos"),
        F.expr("concat('corpus/', source, '/', lpad(cast(doc_id as string), 12, '0'), '.txt')").alias("path"),
        F.expr(SPARK_DECORATED).alias("text"),
    )


def corpus_raw(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_pos, path, text`` with the texts as given."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_pos"),
        F.expr("concat('corpus/', source, '/', lpad(cast(doc_id as string), 12, '0'), '.txt')").alias("path"),
        "text",
    )


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return sg.with_regions(corpus(spark, sf))


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows with ``regions`` and ``doc_title``, still one row per document."""
    docs = parsed(spark, sf)
    first = F.get(F.filter("regions", lambda r: r["type"] == "title"), F.lit(0))["text"]
    return docs.withColumn("doc_title", F.coalesce(first, sg.file_stem(F.col("path"))))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return sg.explode_regions(parsed(spark, sf))


# --- oracle building blocks (DuckDB) -------------------------------------------------------------


def rnd(expr: str, digits: int) -> str:
    return f"(round_even(({expr})::DOUBLE * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE)"


STEM = "lpad(cast(doc_id as varchar), 12, '0')"
CORPUS = f"""corpus AS (
  SELECT doc_id AS doc_pos, 'corpus/' || source || '/' || {STEM} || '.txt' AS path,
         'doc-' || {STEM} || '-' || substr(sha256('corpus/' || source || '/' || {STEM} || '.txt'), 1, 12) AS document_id,
         {STEM} AS stem,
         {DUCK_DECORATED} AS text
  FROM documents)"""

REGIONS = (
    CORPUS
    + """,
line_rows AS (
  SELECT doc_pos, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10)) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM corpus),
line_flags AS (
  SELECT *, (lower(line) LIKE 'table:%' OR lower(line) LIKE 'figure:%') AS special,
         lag(line) OVER (PARTITION BY doc_pos ORDER BY i) AS before
  FROM line_rows),
blocks AS (
  SELECT *, sum(CASE WHEN special OR i = 1 OR before = '' THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_pos ORDER BY i) AS block
  FROM line_flags WHERE i > 0 AND line <> ''),
body_regions AS (
  SELECT doc_pos, block, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS text,
         arg_min(line, i) AS first
  FROM blocks GROUP BY doc_pos, block),
all_regions AS (
  SELECT doc_pos, 0 AS ord, 0 AS start, arg_min(line, i) AS text, 'title' AS type
  FROM line_flags WHERE line <> '' AND NOT special GROUP BY doc_pos
  UNION ALL
  SELECT doc_pos, 1, start, text,
         CASE WHEN lower(first) LIKE 'table:%' THEN 'table' WHEN lower(first) LIKE 'figure:%' THEN 'figure'
              ELSE 'body' END
  FROM body_regions),
regions AS (
  SELECT r.doc_pos, c.document_id, c.stem, c.path, r.type, r.text, r.start, r.start + length(r.text) AS "end",
         row_number() OVER (PARTITION BY r.doc_pos ORDER BY r.ord, r.start) - 1 AS region_idx,
         CASE r.type WHEN 'table' THEN 'table' WHEN 'figure' THEN 'vision' ELSE 'text' END AS modality
  FROM all_regions r JOIN corpus c USING (doc_pos)),
titles AS (
  SELECT c.doc_pos, c.document_id, coalesce(t.text, c.stem) AS title
  FROM corpus c LEFT JOIN (SELECT doc_pos, text FROM regions WHERE type = 'title') t USING (doc_pos))"""
)

QUERIES_CTE = "query_set(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERY_SET) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
