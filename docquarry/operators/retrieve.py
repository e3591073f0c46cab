"""Keyword retrieval of text, table and figure regions for a batch of queries.

A batch is a bounded list held by the caller. It travels inside the plan as one literal array, so
scoring is a single narrow pass over the corpus with no join: each region row is matched with each
query of the batch. Longer lists are cut into batches. Hits keep ids and numbers only; texts are
fetched for the few rows that survive the final cut.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import RouterConfig
from docquarry.functions import text as tx
from docquarry.functions.rows import let, unnest
from docquarry.operators import ranking
from docquarry.operators import route as rt
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts

BATCH_QUERIES = 256

# Order of the ranked lists within one query's runs.
BATCH_TEXT, BATCH_TABLE, BATCH_SQL, BATCH_VISION = 0, 1, 2, 3

# Words that mark visual evidence.
CHART_WORDS = ("chart", "figure", "graph", "diagram", "plot")

Queries = list[tuple[int, str]]


def batches(queries: Queries, size: int = BATCH_QUERIES) -> Iterable[Queries]:
    for i in range(0, len(queries), size):
        yield queries[i : i + size]


def _string_array(values: list[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def query_literals(routed: list) -> Column:
    """Routed query rows as one literal array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(r["query_id"]).cast("bigint").alias("query_id"),
                F.lit(r["lowered"]).alias("lowered"),
                _string_array(r["terms"]).alias("terms"),
                _string_array(r["tokens"]).alias("tokens"),
                *[F.lit(r[f"use_{m}"]).alias(f"use_{m}") for m in rt.MODALITIES],
            )
            for r in routed
        ]
    )


def routed_queries(spark, queries: Queries, config: RouterConfig | None = None) -> DataFrame:
    """Batch as a small DataFrame with terms, distinct tokens and route columns."""
    base = spark.createDataFrame(queries, "query_id bigint, query string").select(
        "query_id",
        "query",
        F.lower("query").alias("lowered"),
        tx.words(F.lower("query")).alias("terms"),
        F.array_distinct(tx.words(F.lower("query"))).alias("tokens"),
    )
    return rt.with_routes(base, "query", config)


def matches(present: Column, terms: Column) -> Column:
    """How many query terms are among those present in the text; repeated terms count repeatedly."""
    return F.size(F.filter(terms, lambda t: F.array_contains(present, t)))


def keyword_score(region_type: Column, found: Column, n_terms: Column) -> Column:
    share = found / F.greatest(F.lit(1), n_terms)
    return tx.pyround(
        F.when(region_type == "table", share * F.lit(3.0))
        .when(region_type == "figure", share + F.lit(0.1))
        .when(region_type == "title", share * F.lit(1.0))
        .otherwise(share * F.lit(2.5)),
        3,
    )


def field_weight(region_type: Column) -> Column:
    return F.when(region_type == "table", 3.0).when(region_type == "title", 1.0).when(
        region_type != "figure", 2.5
    )


def jaccard(query_tokens: Column, text_tokens: Column) -> Column:
    """Jaccard of two token sets, 0 when either is empty."""
    common = F.size(F.array_intersect(query_tokens, text_tokens))
    union = F.size(query_tokens) + F.size(text_tokens) - common
    return F.when(
        (F.size(query_tokens) > 0) & (F.size(text_tokens) > 0), common / F.greatest(F.lit(1), union)
    ).otherwise(F.lit(0.0))


def body_length(text: Column) -> Column:
    """Length without a leading ``[Context: ...]`` breadcrumb."""
    after = F.element_at(F.split(text, r"\]", 2), -1)
    return F.when(text.contains("[Context:"), F.length(tx.strip(after))).otherwise(F.length(text))


def is_visual_text(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in CHART_WORDS])


def _hit(batch: int, modality: str, score: Column, number: Column) -> Column:
    return F.struct(
        F.lit(batch).alias("batch"),
        F.lit(modality).alias("modality"),
        score.cast("double").alias("score"),
        number.cast("bigint").alias("item_no"),
    )


def _table_faults(table: Column) -> Column:
    """Whether a table cannot be created or filled, and whether its label column is typed as a number."""
    return let(
        ts.infer_types(table["columns"], table["rows"]),
        lambda types: F.struct(
            ts.table_error(table["columns"], table["rows"], types).isNotNull().alias("broken"),
            (F.get(types, F.lit(0)) != ts.VARCHAR).alias("numeric_label"),
        ),
    )


def _score_batch(regions: DataFrame, routed: list, use_sql: bool) -> DataFrame:
    kind = F.col("type")
    table = tb.table_from_grid(tb.markdown_grid(F.col("text"))) if "table" not in regions.columns else F.col("table")
    table = ts.region_table(table, F.col("text"))
    base = regions.select(
        "doc_pos",
        "region_idx",
        "type",
        F.lower("text").alias("_low"),
        body_length(F.col("text")).alias("body_len"),
        F.when(kind == "table", table).alias("_table") if use_sql else F.lit(None).alias("_table"),
    )
    # Each distinct term is looked for once per region; the text itself ends here, so the rows that
    # meet the queries hold a few short arrays.
    vocabulary = _string_array(sorted({t for r in routed for t in r["tokens"]}))
    tokens = F.array_distinct(tx.words(F.col("_low")))
    base = base.select(
        "doc_pos",
        "region_idx",
        "type",
        "body_len",
        F.filter(vocabulary, lambda t: F.contains(F.col("_low"), t)).alias("_present"),
        let(
            tokens,
            lambda t: F.struct(
                F.size(t).alias("n"), F.array_intersect(vocabulary, t).alias("known")
            ),
        ).alias("_tok"),
        is_visual_text(F.col("_low")).alias("visual_text"),
        (
            F.transform("_table.columns", F.lower) if use_sql else F.lit(None).cast("array<string>")
        ).alias("_columns"),
        (_table_faults(F.col("_table")) if use_sql else F.lit(None)).alias("_faults"),
    )
    rows = base.withColumn("q", F.explode(query_literals(routed)))
    found = F.col("_found")
    keyword = keyword_score(kind, found, F.size("q.terms"))
    number = F.col("region_idx")
    use = {m: F.col(f"q.use_{m}") for m in rt.MODALITIES}
    text_hit = F.when(
        kind.isin("title", "body", "paragraph") & use["text"] & (found > 0),
        _hit(BATCH_TEXT, "text", keyword, number + 1),
    )
    table_hit = F.when(
        (kind == "table") & use["table"] & (found > 0), _hit(BATCH_TABLE, "table", keyword, number + 1)
    )
    vision_hit = F.when(
        (kind == "figure") & use["vision"] & (found > 0),
        _hit(BATCH_VISION, "vision", keyword, F.lit(None).cast("bigint")),
    )
    if use_sql:
        # a statement fails with its table, or when it filters by a label that is no text
        concept = F.exists(_string_array(ts.CONCEPTS), lambda c: F.contains(F.col("q.lowered"), c))
        failed = F.coalesce(F.col("_faults.broken") | (F.col("_faults.numeric_label") & concept), F.lit(False))
    else:
        failed = F.lit(False)
    sql_score = ts.match_score(F.col("q.lowered"), F.col("_columns"), failed)
    sql_hit = F.when(
        (kind == "table") & use["table"] & F.col("_columns").isNotNull(),
        _hit(BATCH_SQL, "table", sql_score, number),
    )
    hits = F.filter(F.array(text_hit, table_hit, sql_hit, vision_hit), lambda h: h.isNotNull())
    found_rows = rows.withColumn("_found", matches(F.col("_present"), F.col("q.terms")))
    kept = unnest(found_rows, ["q", "_tok", "doc_pos", "region_idx", "type", "body_len", "visual_text"], hits, "h")
    # Overlap is worked out for hits alone.
    common = F.size(F.array_intersect("q.tokens", "_tok.known"))
    union = F.size("q.tokens") + F.col("_tok.n") - common
    overlap = F.when(
        (F.size("q.tokens") > 0) & (F.col("_tok.n") > 0), common / F.greatest(F.lit(1), union)
    ).otherwise(F.lit(0.0))
    return kept.select(
        "q.query_id", "doc_pos", "region_idx", "type", "body_len", "visual_text", overlap.alias("jaccard"), "h.*"
    )


def region_hits(
    regions: DataFrame,
    queries: Queries,
    config: RouterConfig | None = None,
    use_sql: bool = True,
    route_all: bool = False,
) -> DataFrame:
    """All hits of all paths for a query list, one pass over the regions per batch of queries.

    ``route_all`` ignores the router and runs every path. Columns: ``query_id, doc_pos, region_idx,
    type, batch, modality, score, item_no, jaccard, body_len, visual_text``.
    """
    spark = regions.sparkSession
    passes = []
    for part in batches(queries):
        routed = [r.asDict() for r in routed_queries(spark, part, config).collect()]
        if route_all:
            for r in routed:
                r.update({f"use_{m}": True for m in rt.MODALITIES})
        passes.append(_score_batch(regions, routed, use_sql))
    return reduce(DataFrame.unionByName, passes)


def ranked_hits(hits: DataFrame) -> DataFrame:
    """Hits of one path in retrieval order: score descending, then corpus order. Reads ``hits`` twice."""
    return ranking.exact_rank(hits, ["query_id"], [("score", False)])


def overlap_top_k(units: DataFrame, queries: Queries, k: int = 10, pos: str = "doc_pos") -> DataFrame:
    """Share of distinct query words present in the unit's text, best ``k`` per query.

    The whole text counts. Units: ``pos, text``.
    """
    spark = units.sparkSession
    passes = []
    for part in batches(queries):
        rows = (
            spark.createDataFrame(part, "query_id bigint, query string")
            .select("query_id", F.array_distinct(tx.word_tokens(F.col("query"))).alias("tokens"))
            .collect()
        )
        literal = F.array(
            *[
                F.struct(
                    F.lit(r["query_id"]).cast("bigint").alias("query_id"), _string_array(r["tokens"]).alias("tokens")
                )
                for r in rows
            ]
        )
        vocabulary = _string_array(sorted({t for r in rows for t in r["tokens"]}))
        known = units.select(
            pos, F.array_intersect(vocabulary, tx.word_tokens(F.col("text"))).alias("_known")
        )
        scored = known.withColumn("q", F.explode(literal)).select(
            "q.query_id",
            pos,
            tx.pyround(
                F.size(F.array_intersect("q.tokens", "_known"))
                / F.greatest(F.lit(1), F.size("q.tokens")),
                4,
            ).alias("score"),
        )
        passes.append(scored.filter(F.col("score") > 0))
    found = reduce(DataFrame.unionByName, passes)
    return ranking.top_k(found, ["query_id"], [F.col("score").desc(), F.col(pos).asc()], k)
