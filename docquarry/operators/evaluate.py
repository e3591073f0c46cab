"""Retrieval, answer, table, latency and corpus-quality metrics.

A run holds at most ``depth`` results per query (it is a top-k cut), so per-query metrics are
computed on the query's own result array. What can grow, the relevant ids of a query, is only ever
joined, counted and reduced before anything is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import beside, unnest
from docquarry.operators import ranking
from docquarry.session import cut_lineage

K_VALUES = (5, 10, 20)

# Cost of context tokens, and of one query.
USD_PER_MILLION_TOKENS, USD_PER_QUERY = 0.15, 0.00005


def related(rel_id: Column, document_id: Column) -> Column:
    """Ids are relevant to each other when either contains the other."""
    return F.contains(document_id, rel_id) | F.contains(rel_id, document_id)


def judged_results(results: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """Results with ``first_rel``, ``rels`` and ``one_way``; unjudged ones have NULL ``first_rel``.

    Results: ``query_id, rank, document_id``; qrels: ``query_id, rel_id, rel_pos``. ``rels`` keeps
    the ``depth`` smallest positions (any order of the query's ids), all that crediting each id once over ``depth`` ranks can need.
    """
    pairs = results.select("query_id", "rank", "document_id").join(qrels, "query_id")
    matched = pairs.filter(related(F.col("rel_id"), F.col("document_id"))).select(
        "query_id", "rank", "rel_pos", F.contains("document_id", F.col("rel_id")).alias("_inside")
    )
    matched = cut_lineage(matched)
    flags = matched.groupBy("query_id", "rank").agg(
        F.min("rel_pos").alias("first_rel"), F.max("_inside").alias("one_way")
    )
    smallest = ranking.top_k(matched, ["query_id", "rank"], [F.col("rel_pos").asc()], depth, out="_i")
    lists = smallest.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list("rel_pos")).alias("rels"))
    return results.join(flags, ["query_id", "rank"], "left").join(lists, ["query_id", "rank"], "left")


def query_rows(
    queries: DataFrame, results: DataFrame, qrels: DataFrame | None = None, depth: int | None = None
) -> DataFrame:
    """One row per query: ``n_rel`` and ``run``, the judged results in rank order.

    Metrics that need no relevance take no ``qrels``, those that count no tokens no ``text`` in the
    results. ``depth`` is the run's last rank, read from the run unless given; a run that is deeper is refused.
    """
    deepest = results.agg(F.max("rank")).first()[0] or 1
    if depth is not None and deepest > depth:
        raise ValueError(f"the run is {deepest} results deep, more than {depth}")
    if qrels is None:
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("first_rel", "bigint"), ("one_way", "boolean"), ("rels", "array<bigint>"))]
        judged = results.select("*", *blank)
    else:
        judged = judged_results(results, qrels, deepest)
    n_tokens = F.size(tx.words(F.col("text"))) if "text" in results.columns else F.lit(None).cast("int")
    entry = F.struct(
        "rank",
        "document_id",
        "first_rel",
        F.coalesce("rels", F.array().cast("array<bigint>")).alias("rels"),
        F.coalesce("one_way", F.lit(False)).alias("one_way"),
        n_tokens.alias("n_tokens"),
    )
    runs = judged.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("run"))
    asked = queries.select("query_id").join(runs, "query_id", "left")
    if qrels is None:
        asked = asked.withColumn("n_rel", F.lit(0))
    else:
        counts = qrels.groupBy("query_id").agg(F.count("*").cast("int").alias("n_rel"))
        asked = asked.join(counts, "query_id", "left")
    return (
        asked.withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
        .withColumn("run", F.coalesce("run", F.array().cast(_run_type(runs))))
        .withColumn("credited", credited_ranks(F.col("run")))
    )


def _run_type(runs: DataFrame) -> str:
    return runs.schema["run"].dataType.simpleString()


def credited_ranks(run: Column) -> Column:
    """Ranks that credit a relevant id not credited before: each takes its first unseen one."""
    start = F.struct(F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<int>").alias("ranks"))

    def step(acc: Column, r: Column) -> Column:
        fresh = F.get(F.array_except(r["rels"], acc["seen"]), F.lit(0))
        return F.when(
            fresh.isNotNull(),
            F.struct(
                F.concat(acc["seen"], F.array(fresh)).alias("seen"),
                F.concat(acc["ranks"], F.array(r["rank"].cast("int"))).alias("ranks"),
            ),
        ).otherwise(acc)

    return F.aggregate(run, start, step, lambda acc: acc["ranks"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def _top(k: int) -> Column:
    return F.slice("run", 1, k)


def _hits(k: int) -> Column:
    return F.filter(_top(k), lambda r: r["first_rel"].isNotNull())


def recall_at(k: int) -> Column:
    distinct = F.size(F.array_distinct(F.transform(_hits(k), lambda r: r["first_rel"])))
    return tx.pyround(
        F.when(F.col("n_rel") > 0, F.least(F.lit(1.0), distinct / F.greatest(F.lit(1), "n_rel"))).otherwise(0.0), 4
    )


def precision_at(k: int) -> Column:
    return tx.pyround(_share(F.size(_hits(k)), F.size(_top(k))), 4)


def hit_rate_at(k: int) -> Column:
    return F.when(F.size(_hits(k)) > 0, 1.0).otherwise(0.0)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ndcg_at(k: int) -> Column:
    dcg = _sum(F.transform(F.filter("credited", lambda r: r <= k), _gain))
    ideal = _sum(F.transform(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k))), _gain))
    return F.when(
        (F.col("n_rel") > 0) & (F.size("run") > 0), tx.pyround(F.least(F.lit(1.0), dcg / ideal), 4)
    ).otherwise(0.0)


def map_at(k: int = 10) -> Column:
    kept = F.filter("credited", lambda r: r <= k)
    total = _sum(F.transform(kept, lambda r, i: (i + 1) / r))
    return F.when(F.col("n_rel") > 0, tx.pyround(total / F.greatest(F.lit(1), "n_rel"), 4)).otherwise(0.0)


def _gold() -> Column:
    return F.transform(F.filter("run", lambda r: r["first_rel"].isNotNull()), lambda r: r["rank"].cast("double"))


def mrr() -> Column:
    return tx.pyround(F.coalesce(F.lit(1.0) / F.get(_gold(), F.lit(0)), F.lit(0.0)), 4)


def avg_gold_rank() -> Column:
    return F.when(F.size(_gold()) > 0, tx.pyround(_sum(_gold()) / F.size(_gold()), 2))


def gold_rank_variance() -> Column:
    mean = _sum(_gold()) / F.size(_gold())
    spread = _sum(F.transform(_gold(), lambda r: (r - mean) * (r - mean)))
    return F.when(F.size(_gold()) > 0, tx.pyround(spread / F.size(_gold()), 2))


def duplicate_ratio(k: int = 10) -> Column:
    ids = F.transform(_top(k), lambda r: r["document_id"])
    return tx.pyround(_share(F.size(ids) - F.size(F.array_distinct(ids)), F.size(ids)), 4)


def context_tokens(k: int = 5) -> Column:
    return _sum(F.transform(_top(k), lambda r: r["n_tokens"].cast("double")))


def context_compression(k: int = 5) -> Column:
    kept = _sum(F.transform(F.filter(_top(k), lambda r: r["one_way"]), lambda r: r["n_tokens"].cast("double")))
    return tx.pyround(kept / F.greatest(F.lit(1.0), context_tokens(k)), 4)


def noise_ratio() -> Column:
    return tx.pyround(F.greatest(F.lit(0.0), F.lit(1.0) - precision_at(5)), 4)


def unique_evidence(k: int = 5) -> Column:
    ids = F.filter(F.transform(_top(k), lambda r: r["document_id"]), lambda d: d != "")
    return tx.pyround(_share(F.size(F.array_distinct(ids)), F.size(_top(k))), 4)


def cost_per_1k(tokens: Column) -> Column:
    per_query = (tokens / F.lit(1_000_000.0)) * F.lit(USD_PER_MILLION_TOKENS) + F.lit(USD_PER_QUERY)
    return tx.pyround(per_query * F.lit(1000.0), 5)


def retrieval_metrics(rows: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """All retrieval metrics per query from ``query_rows``."""
    out = [F.col("query_id"), F.size("run").alias("result_count")]
    for k in k_values:
        out += [
            recall_at(k).alias(f"recall_at_{k}"),
            precision_at(k).alias(f"precision_at_{k}"),
            hit_rate_at(k).alias(f"hit_rate_at_{k}"),
            ndcg_at(k).alias(f"ndcg_at_{k}"),
        ]
    return rows.select(
        *out,
        mrr().alias("mrr"),
        map_at(10).alias("map_at_10"),
        avg_gold_rank().alias("avg_gold_rank"),
        gold_rank_variance().alias("gold_rank_variance"),
        duplicate_ratio().alias("duplicate_rank_ratio"),
        context_compression().alias("context_compression_ratio"),
        noise_ratio().alias("noise_ratio"),
        unique_evidence().alias("unique_evidence_ratio"),
        context_tokens().alias("context_tokens"),
    )


def token_f1(pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Exact match and multiset token F1 per answer pair; tokens are counted by (pair, token)."""
    a, b = tx.strip(F.lower(pred)), tx.strip(F.lower(truth))
    base = pairs.select(*keys, F.when(a == b, 1.0).otherwise(0.0).alias("exact_match"), a.alias("_a"), b.alias("_b"))
    sides = base.select(
        *keys,
        "exact_match",
        tx.words(F.col("_a")).alias("_a"),
        tx.words(F.col("_b")).alias("_b"),
    ).withColumn("_na", F.size("_a")).withColumn("_nb", F.size("_b"))
    both = F.concat(
        F.transform("_a", lambda t: F.struct(t.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform("_b", lambda t: F.struct(t.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
    )
    per_token = (
        unnest(sides, keys, both, "x")
        .groupBy(*keys, "x.t")
        .agg(F.least(F.sum("x.a"), F.sum("x.b")).alias("same"))
    )
    same = per_token.groupBy(*keys).agg(F.sum("same").alias("same"))
    joined = sides.select(*keys, "exact_match", "_na", "_nb").join(same, keys, "left")
    precision, recall = F.col("same") / F.col("_na"), F.col("same") / F.col("_nb")
    f1 = F.when(F.col("same") > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
    return joined.select(*keys, "exact_match", tx.pyround(f1, 4).alias("token_f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists.

    One bit per token of ``a`` is held, and all of them step together for each token of ``b``, so memory
    is linear and time is the product of the lengths over the machine's word size.
    """
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for token in b:
        met = free & where.get(token, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def rouge_l(pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """``keys, lcs, rouge_l``: common subsequence of the lower-cased words over those of the truth, 0 if it has none.

    Null texts have no words. Whole texts count.
    """
    sides = pairs.select(F.struct(*keys).alias("at"), *[tx.words(F.coalesce(F.lower(c), F.lit(""))).alias(n) for c, n in ((pred, "a"), (truth, "b"))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lcs = [lcs_length(a.as_py(), b.as_py()) for a, b in zip(batch["a"], batch["b"])]
            size = pa.compute.list_value_length(batch["b"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["at"], pa.array(lcs, pa.int64()), size], ["at", "lcs", "size"])

    at = sides.schema["at"].dataType.simpleString()
    found = sides.mapInArrow(measured, f"at {at}, lcs long, size long")
    return found.select("at.*", "lcs", tx.pyround(F.col("lcs") / F.greatest("size", F.lit(1)), 4).alias("rouge_l"))


def table_scores(pred_cols: Column, pred_rows: Column, cols: Column, rows: Column) -> Column:
    """``STRUCT<teds_structural_similarity, content_accuracy, composite_score>`` of two nested tables."""
    overlap = F.size(F.array_intersect(F.array_distinct(pred_cols), F.array_distinct(cols))) / F.greatest(
        F.size(cols), F.lit(1)
    )
    missing = F.abs(F.size(pred_rows) - F.size(rows)) / F.greatest(F.size(rows), F.lit(1))
    teds = tx.pyround(F.lit(0.5) * overlap + F.lit(0.5) * F.greatest(F.lit(0.0), F.lit(1.0) - missing), 4)
    same = F.zip_with(
        rows,
        pred_rows,
        lambda g, p: F.size(
            F.filter(
                F.zip_with(g, p, lambda x, y: F.coalesce(tx.strip(x) == tx.strip(y), F.lit(False))), lambda ok: ok
            )
        ),
    )
    matching = F.aggregate(same, F.lit(0), lambda acc, n: acc + F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))
    accuracy = tx.pyround(matching / F.greatest(F.size(rows) * F.size(cols), F.lit(1)), 4)
    return F.struct(
        teds.alias("teds_structural_similarity"),
        accuracy.alias("content_accuracy"),
        tx.pyround(F.lit(0.5) * teds + F.lit(0.5) * accuracy, 4).alias("composite_score"),
    )


def summarize(metrics: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of null-skipping means, four digits; ``columns`` maps output to metric name."""
    return metrics.agg(*[tx.pyround(F.avg(src), 4).alias(out) for out, src in columns.items()])


# Summary names of the per-query metrics.
SUMMARY = {
    "average_recall_at_5": "recall_at_5",
    "average_recall_at_10": "recall_at_10",
    "average_precision_at_5": "precision_at_5",
    "average_hit_rate_at_5": "hit_rate_at_5",
    "average_ndcg_at_5": "ndcg_at_5",
    "average_ndcg_at_10": "ndcg_at_10",
    "mrr": "mrr",
    "map_at_10": "map_at_10",
    "avg_gold_rank": "avg_gold_rank",
    "gold_rank_variance": "gold_rank_variance",
    "duplicate_rank_ratio": "duplicate_rank_ratio",
    "context_compression_ratio": "context_compression_ratio",
    "noise_ratio": "noise_ratio",
    "unique_evidence_ratio": "unique_evidence_ratio",
}


def latency_percentiles(df: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Floor-index percentiles (the value at position ⌊n·p⌋ of the sorted list) and the mean.

    Latencies have two digits, so equal values are counted first. Counts are then summed per whole
    millisecond, which is all one task orders, and inside each millisecond.
    """
    value = tx.pyround(F.col(latency), 2)
    counts = df.filter(F.col(latency).isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("ms", F.floor("v"))
    coarse = counts.groupBy("ms").agg(F.sum("n").alias("m"))
    before = Window.orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    coarse = coarse.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn(
        "total", F.sum("m").over(everything)
    )
    inside = Window.partitionBy("ms").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(coarse, "ms")
    first = F.col("base") + F.col("ahead")

    def at(p: float) -> Column:
        index = F.least(F.floor(F.col("total") * F.lit(p)), F.col("total") - 1)
        return F.max(F.when((first <= index) & (index < first + F.col("n")), F.col("v")))

    return placed.agg(
        at(0.50).alias("latency_p50_ms"),
        at(0.90).alias("latency_p90_ms"),
        at(0.99).alias("latency_p99_ms"),
        tx.pyround(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 2).alias("mean_latency_ms"),
    )


def sla_check(summary: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Targets against a one-row summary: at most for latency, noise and hallucination, else at least."""
    known = [c for c in summary.columns if c in targets]
    spark = summary.sparkSession
    wanted = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "metric string, target double")
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in known)
    achieved = (
        summary.selectExpr(f"stack({len(known)}, {pairs}) as (metric, achieved)")
        if known
        else spark.createDataFrame([], "metric string, achieved double")
    )
    falling = F.col("metric").rlike("latency|noise|hallucination")
    passed = F.when(falling, F.col("achieved") <= F.col("target")).otherwise(F.col("achieved") >= F.col("target"))
    # Both sides hold one row per target metric.
    return (
        wanted.join(F.broadcast(achieved), "metric", "left")
        .withColumn("passed", F.coalesce(passed, F.lit(False)))
        .withColumn(
            "status",
            F.when(F.col("achieved").isNull(), "NOT_EVALUATED").when(F.col("passed"), "PASS").otherwise("FAIL"),
        )
    )


def all_targets_met(checked: DataFrame) -> DataFrame:
    return checked.agg(F.min("passed").alias("all_targets_met"))


def audit_artifacts(documents: DataFrame, regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One-row corpus audit; each input is read once and reduced to one row before they meet."""
    size = F.length(tx.strip(F.col("text")))
    lower = F.lower(F.coalesce("modality", F.lit("text")))
    chunk_row = chunks.agg(
        F.count("*").alias("total_chunks"),
        *[F.count(F.when(lower == m, 1)).alias(f"{m}_chunks") for m in ("text", "table", "vision")],
        tx.pyround(F.avg(size), 2).alias("average_chunk_char_length"),
        F.min(size).alias("min_chunk_length"),
        F.max(size).alias("max_chunk_length"),
        F.count(F.when(size == 0, 1)).alias("empty_chunks"),
    )
    region_row = regions.agg(
        F.count("*").alias("total_regions"),
        F.count(F.when(F.col("table_markdown").isNotNull() | F.col("table").isNotNull(), 1)).alias(
            "structured_tables_extracted"
        ),
        F.count(F.when(F.col("layout_source") == "ocr", 1)).alias("ocr_fallback_regions"),
    )
    doc_row = documents.agg(F.count("*").alias("total_documents"))
    quality = tx.pyround(F.lit(1.0) - F.col("empty_chunks") / F.greatest(F.lit(1), "total_chunks"), 4)
    verdict = (
        F.when(F.col("total_chunks") == 0, "EMPTY_CORPUS")
        .when(quality >= 0.95, "HEALTHY_ARTIFACTS")
        .otherwise("NEEDS_INGESTION_CLEANUP")
    )
    return (
        beside(chunk_row, region_row, doc_row)
        .withColumn("artifact_quality_score", quality)
        .withColumn("verdict", verdict)
    )


def ablation(runs: DataFrame, baseline: str = "full") -> DataFrame:
    """``suite, name, average_recall_at_5`` to the change against the suite's baseline run."""
    base = runs.filter(F.col("name") == baseline).select("suite", F.col("average_recall_at_5").alias("_base"))
    return (
        runs.filter(F.col("name") != baseline)
        .join(base, "suite", "left")
        .withColumn(
            "delta_vs_full",
            tx.pyround(F.col("average_recall_at_5") - F.coalesce("_base", F.lit(0.0)), 3),
        )
        .drop("_base")
    )


def chunk_statistics(chunks: DataFrame, groups: list[str]) -> DataFrame:
    """Chunk count, mean and variance of length, and share of repeated texts per group.

    All in one pass; digests combine by (group, digest) before they are counted.
    """
    n, length = F.count("*"), F.length("text").cast("double")
    texts = F.count_distinct(F.coalesce(F.sha2("text", 256), F.lit("")))
    return chunks.groupBy(*groups).agg(
        n.alias("n_chunks"),
        tx.pyround(F.avg(length), 2).alias("mean_length"),
        tx.pyround(F.var_pop(length), 2).alias("length_variance"),
        tx.pyround(F.lit(100.0) * (n - texts) / n, 4).alias("duplicate_pct"),
    )


def chunk_quality(chunks: DataFrame, groups: list[str], doc: str = "document_id", text: str = "text") -> DataFrame:
    """Per group: chunks, documents, chunks per document, exact median of words, and share of chunks that end within a sentence.

    A chunk ends a sentence if its last sign is a full stop, an exclamation or a question mark. The
    median keeps one count per distinct length.
    """
    body = tx.strip(F.coalesce(text, F.lit("")))
    n = F.count("*")
    return chunks.groupBy(*groups).agg(
        n.alias("n_chunks"),
        F.count_distinct(doc).alias("n_documents"),
        tx.pyround(n / F.count_distinct(doc), 4).alias("chunks_per_document"),
        F.percentile(F.size(tx.words(body)), F.lit(0.5)).alias("median_tokens"),
        tx.pyround(F.lit(100.0) * F.count_if(~body.rlike(r"[.!?]\z")) / n, 4).alias("sentence_split_pct"),
    )


def chunk_overlap(chunks: DataFrame, groups: list[str], doc: str = "document_id", order: str = "win", text: str = "text") -> DataFrame:
    """Per group: pairs of neighbouring chunks of a document, and the mean share of a chunk's distinct words that its next has too.

    Chunks of one document are put in order, so a task holds no more than a document's chunks.
    """
    words = F.array_distinct(tx.words(F.coalesce(text, F.lit(""))))
    rows = chunks.select(*groups, doc, order, words.alias("_a"))
    rows = rows.withColumn("_b", F.lead("_a").over(Window.partitionBy(doc).orderBy(order))).filter(F.col("_b").isNotNull())
    share = F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size("_a"), F.lit(1))
    return rows.groupBy(*groups).agg(F.count("*").alias("neighbours"), tx.pyround(F.lit(100.0) * F.avg(share), 4).alias("overlap_pct"))


def audit_rollup(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents, characters and empty texts per group, with subtotals and the total, in one pass.

    ``level`` is the grouping id: 0 for the groups, all bits set for the total. Keys of a subtotal are
    null; a null key of the data keeps its own rows of level 0.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    return docs.rollup(*keys).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("documents"),
        F.sum(size.cast("bigint")).alias("chars"),
        F.count_if(size == 0).alias("empty_documents"),
    )
