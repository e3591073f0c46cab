"""Benchmark suites, dataset adapters and passage relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import joins
from docquarry.session import cut_lineage

# The generated suite's templates, cycled in this order.
TEMPLATES = [
    ("FinQA", "table", "What is the net profit margin for fiscal quarter {}?", ["sample_doc_1", "sample_doc_2"], True),
    ("TAT-QA", "text", "What risk factors affect revenue stream {} in paragraph report?", ["sample_doc_2", "9781513563602"], False),
    ("DocVQA", "vision", "What is the peak bar value shown in infographic figure {}?", ["9781513563602", "sample_doc_1"], False),
    ("ChartQA", "vision", "Compare line chart trajectory between product {} and market baseline", ["sample_doc_1", "9781513563602"], False),
    ("WikiTable", "table", "Calculate average EBITDA growth rate across region {}", ["sample_doc_1", "sample_doc_2"], True),
]

ANCHOR_WORDS = 6


def extended_suite(items: DataFrame, id_col: str) -> DataFrame:
    """One generated question per item; ``id_col`` counts items from 0 and picks template and number."""
    n = F.col(id_col) + 1
    slot = (F.col(id_col) % len(TEMPLATES)).cast("int")
    templates = F.array(
        *[
            F.struct(
                F.lit(source).alias("source"),
                F.lit(modality).alias("modality"),
                F.lit(question).alias("question"),
                F.lit(",".join(relevant)).alias("relevant_ids"),
                F.lit(tabular).alias("is_tabular"),
            )
            for source, modality, question, relevant, tabular in TEMPLATES
        ]
    )
    number = F.col("_n").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    return items.select(n.alias("_n"), F.get(templates, slot).alias("t")).select(
        F.concat_ws("-", F.lower("t.source"), padded).alias("id"),
        "t.source",
        F.replace("t.question", F.lit("{}"), number).alias("question"),
        F.concat(F.lit("Sample Ground Truth Answer "), number).alias("answer"),
        "t.modality",
        "t.relevant_ids",
        "t.is_tabular",
    )


def extended_suite_sql(table: str, id_col: str) -> str:
    def pick(values):
        return "CASE n % 5 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    quoted = [("'" + t[0] + "'", "'" + t[1] + "'", "'" + t[2] + "'", "'" + ",".join(t[3]) + "'", str(t[4]).lower()) for t in TEMPLATES]
    cols = list(zip(*quoted))
    return f"""WITH i AS (SELECT {id_col} AS n, {id_col} + 1 AS k FROM {table})
SELECT lower({pick(cols[0])}) || '-' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INTEGER, '0') AS id, {pick(cols[0])} AS source,
  replace({pick(cols[2])}, '{{}}', k::VARCHAR) AS question, 'Sample Ground Truth Answer ' || k AS answer, {pick(cols[1])} AS modality,
  {pick(cols[3])} AS relevant_ids, {pick(cols[4])} AS is_tabular FROM i"""


def dataset_items(records: DataFrame, name: str, id_col: str, limit: int = 0) -> DataFrame:
    """Rows of a question dataset as benchmark items; the first of question, text and query is asked.

    ``limit`` takes the first records by ``id_col``, 0 takes all.
    """
    def first(*names: str):
        present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in records.columns]
        return F.coalesce(*present, F.lit("")) if present else F.lit("")

    rows = records.orderBy(id_col).limit(limit) if limit > 0 else records
    number = F.col(id_col).cast("string")
    return rows.select(
        F.concat(
            F.lit(name.replace("/", "_") + "-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))
        ).alias("id"),
        F.lit(name).alias("source"),
        first("question", "text", "query").alias("question"),
        first("answer", "label").alias("answer"),
        F.lit("text").alias("modality"),
        F.lit(False).alias("is_tabular"),
    )


def suite_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("query_count"),
        tx.pyround(F.avg("recall_at_5"), 3).alias("average_recall_at_5"),
        tx.pyround(F.avg("ndcg_at_5"), 3).alias("average_ndcg_at_5"),
    )


def _runs(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _holding_short(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Candidates for passages without inner words: ``query_id, doc_pos``.

    The longest piece of such a passage between spaces lies within one such piece of a text. Distinct
    pieces of the corpus are joined with it by their character runs, then lead to their documents.
    """
    longest = F.get(F.array_sort(F.transform(F.split("query", r"\s+"), lambda w: F.struct(-F.length(w), w.alias("w")))), F.lit(0))["w"]
    asked = short.select("query_id", longest.alias("_part")).filter("_part <> ''")
    asked = cut_lineage(asked.withColumn("_gram", F.substring("_part", 1, 3)))
    pieces = docs.select("doc_pos", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("_piece"))
    grams = F.flatten(
        F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_piece") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_piece"), i, n)))
    )
    known = pieces.select("_piece").distinct().withColumn("_gram", F.explode(F.array_distinct(grams)))
    held = known.join(joins.bounded(asked), "_gram").filter(F.contains("_piece", F.col("_part"))).select("query_id", "_piece").distinct()
    return pieces.join(held, "_piece").select("query_id", "doc_pos").distinct()


def containing_documents(docs: DataFrame, passages: DataFrame, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Documents that hold a passage word for word: ``query_id, doc_pos``. Blank passages are in none.

    Inside a passage every word but the first and last is a whole word of the text around it, so its
    inner words recur in a matching document as a run: all of them, or the first ``anchor``. Runs
    are joined by hash, which keeps passages and documents from being paired with one another, and the
    few pairs found are then compared in full. Passages of one or two words have no inner word and
    are sought by their longest piece.
    """
    inner = passages.select("query_id", "query", tx.words(F.col("query")).alias("_w")).select(
        "query_id", "query", F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))).alias("_in")
    )
    inner = cut_lineage(inner.withColumn("_n", F.least(F.size("_in"), F.lit(anchor))))
    sizes = sorted(r["_n"] for r in inner.select("_n").distinct().collect())  # at most anchor + 1
    found = []
    if any(sizes):
        anchors = inner.filter("_n > 0").select("query_id", F.xxhash64(F.array_join(F.slice("_in", F.lit(1), F.col("_n")), " ")).alias("_h"))
        words = docs.select("doc_pos", tx.words(F.col("text")).alias("_w"))
        runs = F.array_distinct(F.concat(*[_runs(F.col("_w"), n) for n in sizes if n]))
        hashes = unnest(words, ["doc_pos"], runs, "_h").drop("_pos")
        found.append(hashes.join(joins.bounded(anchors), "_h").select("query_id", "doc_pos").distinct())
    if 0 in sizes:
        found.append(_holding_short(docs.select("doc_pos", "text"), inner.filter("_n = 0").select("query_id", "query")))
    if not found:
        return docs.select(F.lit(None).cast(passages.schema["query_id"].dataType).alias("query_id"), "doc_pos").limit(0)
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # Candidates are written once: their number decides how they meet the texts.
    pairs = cut_lineage(pairs.join(passages.select("query_id", "query"), "query_id"))
    return (
        docs.select("doc_pos", "text")
        .join(pairs, "doc_pos")
        .filter(F.contains("text", F.col("query")))
        .select("query_id", "doc_pos")
    )
