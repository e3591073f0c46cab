"""Registered queries over evaluation metrics, audits, benchmark suites and run exports.

The judged run is BM25 over all documents with every benchmark passage as a query; a document is
relevant when it holds the passage word for word.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import beside
from docquarry.operators import attribute as at
from docquarry.operators import benchmark as bm
from docquarry.operators import chunk as ck
from docquarry.operators import evaluate as ev
from docquarry.operators import export as ex
from docquarry.operators import joins
from docquarry.operators import segment as sg
from docquarry.operators import tables as tb
from docquarry.plans import answer_queries as aq
from docquarry.plans import ingest_queries as iq
from docquarry.plans import inputs as I
from docquarry.plans import retrieval_queries as rq
from docquarry.plans import table_queries as tq
from docquarry.session import checkpoint_folder, cut_lineage
from docquarry.sources import corpus as cp
from docquarry.sources.observed import ObservedRun


def _queries(spark, sf):
    return I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _docs(spark, sf):
    return I.corpus_raw(spark, sf).select("doc_pos", sg.document_id(F.col("path")).alias("document_id"), "text")


def _run(spark, sf):
    """The judged run, written once for all that judge it."""
    return spark.read.parquet(I.written(spark, sf, "judged-run", lambda p: rq.bm25_run(spark, sf, 20).write.parquet(p), ("documents", "benchmark")))


def _results(spark, sf, text=True):
    """Run rows with document ids, and texts where they are asked for; the run holds twenty rows per query. Written once."""

    def write(path):
        found = _docs(spark, sf).join(joins.bounded(_run(spark, sf)), "doc_pos")
        found.select("query_id", "rank", "document_id", "text").write.parquet(path)

    found = spark.read.parquet(I.written(spark, sf, "judged-results", write, ("documents", "benchmark")))
    return found if text else found.drop("text")


def _qrels(spark, sf):
    """Passages found in documents, by padded document number. Written once."""

    def write(path):
        pairs = bm.containing_documents(I.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pos"), "text"), _queries(spark, sf))
        pairs.select(
            "query_id",
            F.lpad(F.col("doc_pos").cast("string"), 12, "0").alias("rel_id"),
            F.col("doc_pos").alias("rel_pos"),
        ).write.parquet(path)

    return spark.read.parquet(I.written(spark, sf, "relevance", write, ("documents", "benchmark")))


def _rows(spark, sf, text=True):
    return ev.query_rows(_queries(spark, sf), _results(spark, sf, text), _qrels(spark, sf))


def eval_qrels(spark, sf):
    return _qrels(spark, sf)


def eval_recall_precision(spark, sf):
    m = ev.retrieval_metrics(_rows(spark, sf, text=False))
    return m.select("query_id", *[f"{n}_at_{k}" for k in ev.K_VALUES for n in ("recall", "precision", "hit_rate")])


def eval_ndcg(spark, sf):
    return _rows(spark, sf, text=False).select("query_id", *[ev.ndcg_at(k).alias(f"ndcg_at_{k}") for k in ev.K_VALUES])


def eval_mrr(spark, sf):
    return _rows(spark, sf, text=False).select("query_id", ev.mrr().alias("mrr"))


def eval_map(spark, sf):
    return _rows(spark, sf, text=False).select("query_id", ev.map_at(10).alias("map_at_10"))


def eval_gold_rank(spark, sf):
    return _rows(spark, sf, text=False).select(
        "query_id", ev.avg_gold_rank().alias("avg_gold_rank"), ev.gold_rank_variance().alias("gold_rank_variance")
    )


def _by_source(spark, sf):
    """The run with each document known only by its source, so ids repeat."""
    source = I.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pos"), "source")
    found = source.join(joins.bounded(_run(spark, sf)), "doc_pos")
    return cut_lineage(found.select("query_id", "rank", F.col("source").alias("document_id")))


def _source_rows(spark, sf):
    return ev.query_rows(_queries(spark, sf), _by_source(spark, sf))


def eval_dup_ratio(spark, sf):
    return _source_rows(spark, sf).select(
        "query_id", ev.duplicate_ratio().alias("duplicate_rank_ratio"), ev.unique_evidence().alias("unique_evidence_ratio")
    )


def eval_context_quality(spark, sf):
    return _rows(spark, sf).select(
        "query_id",
        ev.context_compression().alias("context_compression_ratio"),
        ev.noise_ratio().alias("noise_ratio"),
        ev.unique_evidence().alias("unique_evidence_ratio"),
    )


def eval_cost(spark, sf):
    rows = ev.query_rows(_queries(spark, sf), _results(spark, sf))
    return rows.select("query_id", ev.cost_per_1k(ev.context_tokens()).alias("est_cost_per_1k_queries_usd"))


def eval_faithfulness(spark, sf):
    out = at.attribute(aq._turns(spark, sf))
    return out.select(
        "conv_id",
        "turn",
        F.col("attribution_precision").alias("faithfulness"),
        tx.pyround(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("attribution_precision")), 4).alias("hallucination_rate"),
    )


def eval_token_f1(spark, sf):
    turns = I.table(spark, sf, "conversations")
    truth = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("pred")).join(truth, ["conv_id", "turn"])
    return ev.token_f1(pairs, ["conv_id", "turn"])


def eval_rouge_l(spark, sf):
    """Each turn as an answer, the turn after it as the truth."""
    turns = I.table(spark, sf, "conversations")
    truth = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("pred")).join(truth, ["conv_id", "turn"])
    return ev.rouge_l(pairs, ["conv_id", "turn"])


def eval_suite_summary(spark, sf):
    return ev.summarize(ev.retrieval_metrics(_rows(spark, sf)), ev.SUMMARY)


def _latency(spark, sf):
    return I.table(spark, sf, "events").select(F.col("value").alias("latency_ms"))


def eval_latency_percentiles(spark, sf):
    return ev.latency_percentiles(_latency(spark, sf))


# Service targets, and one metric nothing reports.
TARGETS = {
    "average_recall_at_5": 0.85,
    "average_ndcg_at_5": 0.8,
    "noise_ratio": 0.9,
    "latency_p90_ms": 1500.0,
    "attribution_precision": 0.9,
}


def _suite(spark, sf):
    quality = ev.summarize(
        ev.retrieval_metrics(_rows(spark, sf)),
        {"average_recall_at_5": "recall_at_5", "average_ndcg_at_5": "ndcg_at_5", "noise_ratio": "noise_ratio"},
    )
    return beside(quality, ev.latency_percentiles(_latency(spark, sf)).select("latency_p90_ms"))


def eval_sla_check(spark, sf):
    return ev.sla_check(_suite(spark, sf), TARGETS)


def eval_sla_verdict(spark, sf):
    return ev.all_targets_met(ev.sla_check(_suite(spark, sf), TARGETS))


def eval_table_teds(spark, sf):
    """Each document's grid against a copy that lost its last row and renamed its first column."""
    t = tq._as_table(spark, sf)
    n = F.size("rows")
    pred_rows = F.when(n % 2 == 0, F.slice("rows", F.lit(1), n - 1)).otherwise(F.col("rows"))
    pred_rows = F.transform(pred_rows, lambda r: F.transform(r, lambda c, i: F.when(i == 1, F.upper(c)).otherwise(F.concat(c, F.lit(" ")))))
    pred_cols = F.transform("columns", lambda c, i: F.when(i == 0, "renamed").otherwise(c))
    t = t.withColumn("s", ev.table_scores(pred_cols, pred_rows, F.col("columns"), F.col("rows")))
    return t.select("doc_id", "s.*")


def audit_artifact_quality(spark, sf):
    regions = tb.with_region_table(I.regions(spark, sf))
    chunks = sg.region_chunks(regions)
    return ev.audit_artifacts(I.corpus(spark, sf), regions, chunks)


def audit_counts(spark, sf):
    docs = I.parsed(spark, sf)
    return docs.agg(F.count("*").alias("document_count"), F.sum(F.size("regions")).alias("chunk_count"))


def audit_rollup(spark, sf):
    return ev.audit_rollup(I.table(spark, sf, "documents"), ["lang", "source"])


def audit_observed(spark, sf):
    """Rows and failures of an ingestion, as its own run counted them; its rates go to the metric sink."""
    run = ObservedRun(spark)
    docs = run.stage(I.corpus(spark, sf), "documents", F.col("text").isNull())
    regions = run.stage(sg.explode_regions(sg.with_regions(docs)), "regions")
    chunks = run.stage(sg.region_chunks(regions), "chunks", tx.strip(F.col("text")) == "")
    folder = f"{checkpoint_folder(spark)}/observed-{uuid.uuid4().hex}"
    run.run(lambda: chunks.write.parquet(f"{folder}/chunks"))
    cp.write_metrics(run.metrics(), f"{folder}/metrics")
    return spark.read.json(f"{folder}/metrics").select("stage", "rows", "failures")


def eval_ablation(spark, sf):
    """Recall at five of the run and of runs that lost their head."""
    results, qrels = _results(spark, sf, text=False), _qrels(spark, sf)
    qrels = cut_lineage(qrels)
    runs = None
    for name, lost in (("full", 0), ("no_first", 1), ("no_first_three", 3)):
        cut = results.filter(F.col("rank") > lost).withColumn("rank", F.col("rank") - lost)
        rows = ev.query_rows(_queries(spark, sf), cut, qrels)
        one = rows.select(ev.recall_at(5).alias("r")).agg(tx.pyround(F.avg("r"), 4).alias("average_recall_at_5"))
        one = one.select(F.lit("bm25").alias("suite"), F.lit(name).alias("name"), "average_recall_at_5")
        runs = one if runs is None else runs.unionByName(one)
    return ev.ablation(runs)


def bench_suite(spark, sf):
    m = ev.retrieval_metrics(_rows(spark, sf, text=False))
    return bm.suite_summary(m)


def bench_extended_suite(spark, sf):
    return bm.extended_suite(I.table(spark, sf, "benchmark"), "item_id")


def src_dataset_items(spark, sf):
    source = I.table(spark, sf, "labels").join(I.table(spark, sf, "documents"), "doc_id")
    rows = source.select("doc_id", F.lit(None).cast("string").alias("question"), "text", F.col("quality").alias("label"))
    return bm.dataset_items(rows, "given/labels", "doc_id")


def doc_chunk_stats(spark, sf):
    return ev.chunk_statistics(sg.region_chunks(I.regions(spark, sf)), ["modality"])


def _window_chunks(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return ck.token_windows(docs, size=64, overlap=16)


def doc_chunk_quality(spark, sf):
    return ev.chunk_quality(_window_chunks(spark, sf), ["lang"], "doc_id", "window_text")


def doc_chunk_overlap(spark, sf):
    return ev.chunk_overlap(_window_chunks(spark, sf), ["lang"], "doc_id", "win", "window_text")


def doc_dup_chunk_pct(spark, sf):
    docs = I.table(spark, sf, "documents")
    return ev.chunk_statistics(docs, ["lang"]).select("lang", "n_chunks", "duplicate_pct")


def export_triplets(spark, sf):
    return ex.retriever_triplets(_queries(spark, sf), _results(spark, sf), _qrels(spark, sf))


def export_reranker_pairs(spark, sf):
    return ex.reranker_pairs(_queries(spark, sf), _results(spark, sf), _qrels(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        eval_qrels,
        eval_recall_precision,
        eval_ndcg,
        eval_mrr,
        eval_map,
        eval_gold_rank,
        eval_dup_ratio,
        eval_context_quality,
        eval_cost,
        eval_faithfulness,
        eval_token_f1,
        eval_rouge_l,
        eval_suite_summary,
        eval_latency_percentiles,
        eval_sla_check,
        eval_sla_verdict,
        eval_table_teds,
        audit_artifact_quality,
        audit_counts,
        audit_rollup,
        audit_observed,
        eval_ablation,
        bench_suite,
        bench_extended_suite,
        src_dataset_items,
        doc_chunk_stats,
        doc_chunk_quality,
        doc_chunk_overlap,
        doc_dup_chunk_pct,
        export_triplets,
        export_reranker_pairs,
    )
}

# --- oracles -------------------------------------------------------------------------------------

RUN = (
    rq.BM25_RUN
    + f""",
ids AS (
  SELECT doc_id AS doc_pos, source, text, {I.STEM} AS stem,
    'doc-' || {I.STEM} || '-' || substr(sha256('corpus/' || source || '/' || {I.STEM} || '.txt'), 1, 12) AS document_id FROM documents),
qrels AS (
  SELECT query_id, stem AS rel_id, doc_pos AS rel_pos
  FROM passages JOIN ids ON contains(ids.text, passages.query)),
nrel AS (SELECT p.query_id, query, count(rel_id) AS n_rel FROM passages p LEFT JOIN qrels USING (query_id) GROUP BY ALL),
results AS (SELECT b.query_id, b.rank, i.document_id, i.source, i.stem, i.text FROM bm25 b JOIN ids i USING (doc_pos)),
judged AS (
  SELECT r.*, q.rel_id IS NOT NULL AS rel, len(list_filter(string_split_regex(r.text, '\\s+'), lambda w: w <> '')) AS n_tokens
  FROM results r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.rel_id = r.stem),
seen AS (SELECT *, sum(rel::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM judged)"""
)


def _at(k):
    return f"""count(*) FILTER (rel AND rank <= {k})"""


def _idcg(k):
    return f"(SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, {k}) + 1) t(i))"


PER_QUERY = (
    RUN
    + f""",
agg AS (
  SELECT n.query_id, any_value(query) AS query, any_value(n_rel) AS n_rel,
    {', '.join(f'{_at(k)} AS h{k}, count(*) FILTER (rank <= {k}) AS t{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= {k}), 0) AS d{k}' for k in (5, 10, 20))},
    min(rank) FILTER (rel) AS first_hit, avg(rank) FILTER (rel) AS gold, var_pop(rank) FILTER (rel) AS gold_var,
    coalesce(sum(hits / rank) FILTER (rel AND rank <= 10), 0) AS prec_sum,
    coalesce(sum(n_tokens) FILTER (rank <= 5), 0) AS ctx, coalesce(sum(n_tokens) FILTER (rank <= 5 AND rel), 0) AS rel_ctx,
    count(DISTINCT source) FILTER (rank <= 10) AS src10, count(DISTINCT source) FILTER (rank <= 5) AS src5,
    count(DISTINCT document_id) FILTER (rank <= 5) AS doc5
  FROM nrel n LEFT JOIN seen s USING (query_id) GROUP BY n.query_id),
m AS (
  SELECT query_id, ctx,
    {', '.join(
        f"CASE WHEN n_rel > 0 THEN {I.rnd(f'h{k} / n_rel::DOUBLE', 4)} ELSE 0 END AS recall_at_{k}, "
        f"{I.rnd(f'h{k} / greatest(1, t{k})::DOUBLE', 4)} AS precision_at_{k}, CASE WHEN h{k} > 0 THEN 1 ELSE 0 END::DOUBLE AS hit_rate_at_{k}, "
        f"CASE WHEN n_rel > 0 AND t20 > 0 THEN {I.rnd(f'least(1, d{k} / {_idcg(k)})', 4)} ELSE 0 END AS ndcg_at_{k}"
        for k in (5, 10, 20))},
    {I.rnd('coalesce(1 / first_hit::DOUBLE, 0)', 4)} AS mrr,
    CASE WHEN n_rel > 0 THEN {I.rnd('prec_sum / n_rel', 4)} ELSE 0 END AS map_at_10,
    {I.rnd('gold', 2)} AS avg_gold_rank, {I.rnd('gold_var', 2)} AS gold_rank_variance,
    {I.rnd('(t10 - src10) / greatest(1, t10)::DOUBLE', 4)} AS source_dup, {I.rnd('src5 / greatest(1, t5)::DOUBLE', 4)} AS source_unique,
    0::DOUBLE AS duplicate_rank_ratio,
    {I.rnd('rel_ctx / greatest(1, ctx)::DOUBLE', 4)} AS context_compression_ratio,
    {I.rnd('1 - ' + I.rnd('h5 / greatest(1, t5)::DOUBLE', 4), 4)} AS noise_ratio,
    {I.rnd('doc5 / greatest(1, t5)::DOUBLE', 4)} AS unique_evidence_ratio,
    {I.rnd('(ctx / 1000000::DOUBLE * 0.15::DOUBLE + 0.00005::DOUBLE) * 1000', 5)} AS est_cost_per_1k_queries_usd
  FROM agg)"""
)

LATENCY = f"""lat AS (SELECT {I.rnd('value', 2)} AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
pct AS (
  SELECT max(v) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1)) AS latency_p50_ms,
    max(v) FILTER (i = least(floor(n * 0.9::DOUBLE), n - 1)) AS latency_p90_ms,
    max(v) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS latency_p99_ms, {I.rnd('avg(v)', 2)} AS mean_latency_ms FROM lat)"""

_SLA = I.with_(PER_QUERY, LATENCY) + f""", summary AS (
  SELECT 'average_recall_at_5' AS metric, {I.rnd('avg(recall_at_5)', 4)} AS achieved FROM m
  UNION ALL SELECT 'average_ndcg_at_5', {I.rnd('avg(ndcg_at_5)', 4)} FROM m
  UNION ALL SELECT 'noise_ratio', {I.rnd('avg(noise_ratio)', 4)} FROM m
  UNION ALL SELECT 'latency_p90_ms', latency_p90_ms FROM pct),
targets(metric, target) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in TARGETS.items())}),
checked AS (
  SELECT t.metric, target, achieved, coalesce(CASE WHEN regexp_matches(t.metric, 'latency|noise|hallucination') THEN achieved <= target
    ELSE achieved >= target END, false) AS passed FROM targets t LEFT JOIN summary s ON s.metric = t.metric)
"""


def _m(*cols):
    return I.with_(PER_QUERY) + f"SELECT query_id, {', '.join(cols)} FROM m"


def _ablated(name, lost):
    return f"""SELECT '{name}' AS name, {I.rnd(f"avg(CASE WHEN n_rel > 0 THEN {I.rnd('h / n_rel::DOUBLE', 4)} ELSE 0 END)", 4)} AS r
  FROM (SELECT n.query_id, any_value(n_rel) AS n_rel, count(*) FILTER (rel AND rank > {lost} AND rank <= {5 + lost}) AS h
    FROM nrel n LEFT JOIN seen s USING (query_id) GROUP BY n.query_id)"""


ORACLES = {
    "eval_qrels": I.with_(RUN) + "SELECT query_id, rel_id, rel_pos FROM qrels",
    "eval_recall_precision": _m(*[f"{n}_at_{k}" for k in (5, 10, 20) for n in ("recall", "precision", "hit_rate")]),
    "eval_ndcg": _m("ndcg_at_5", "ndcg_at_10", "ndcg_at_20"),
    "eval_mrr": _m("mrr"),
    "eval_map": _m("map_at_10"),
    "eval_gold_rank": _m("avg_gold_rank", "gold_rank_variance"),
    "eval_dup_ratio": _m("source_dup AS duplicate_rank_ratio", "source_unique AS unique_evidence_ratio"),
    "eval_context_quality": _m("context_compression_ratio", "noise_ratio", "unique_evidence_ratio"),
    "eval_cost": _m("est_cost_per_1k_queries_usd"),
    "eval_faithfulness": I.with_(aq.CLAIMS)
    + f""", p AS (SELECT conv_id, turn, {I.rnd('count(*) FILTER (len(sup) > 0) / count(*)::DOUBLE', 3)} AS faithfulness FROM judged GROUP BY ALL)
SELECT *, {I.rnd('1 - faithfulness', 4)} AS hallucination_rate FROM p""",
    "eval_token_f1": f"""WITH pairs AS (
  SELECT a.conv_id, a.turn, trim(lower(a.text), ' ' || chr(10)) AS p, trim(lower(b.text), ' ' || chr(10)) AS t
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn),
w AS (SELECT *, {rq._WORDS.format(x='p')} AS pw, {rq._WORDS.format(x='t')} AS tw FROM pairs),
pc AS (SELECT conv_id, turn, k, count(*) AS c FROM (SELECT conv_id, turn, unnest(pw) AS k FROM w) GROUP BY ALL),
tc AS (SELECT conv_id, turn, k, count(*) AS c FROM (SELECT conv_id, turn, unnest(tw) AS k FROM w) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(pc.c, tc.c)) AS same FROM pc JOIN tc USING (conv_id, turn, k) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN p = t THEN 1 ELSE 0 END::DOUBLE AS exact_match,
  CASE WHEN same > 0 THEN {I.rnd('2 * (same / len(pw)::DOUBLE) * (same / len(tw)::DOUBLE) / (same / len(pw)::DOUBLE + same / len(tw)::DOUBLE)', 4)} ELSE 0 END AS token_f1
FROM w LEFT JOIN s USING (conv_id, turn)""",
    "eval_suite_summary": I.with_(PER_QUERY)
    + "SELECT " + ", ".join(f"{I.rnd(f'avg({src})', 4)} AS {out}" for out, src in ev.SUMMARY.items()) + " FROM m",
    "eval_latency_percentiles": I.with_(LATENCY) + "SELECT * FROM pct",
    "eval_sla_check": _SLA
    + "SELECT *, CASE WHEN achieved IS NULL THEN 'NOT_EVALUATED' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM checked",
    "eval_sla_verdict": _SLA + "SELECT bool_and(passed) AS all_targets_met FROM checked",
    "eval_table_teds": I.with_(tq.AS_TABLE)
    + f""", cells AS (
  SELECT doc_id, i, c, rows[i][c] AS v FROM (SELECT doc_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM tables_),
    LATERAL (SELECT unnest(range(1, len(rows[i]) + 1)) AS c)),
t AS (
  SELECT doc_id, len(cols) AS nc, len(rows) AS nr, len(rows) - CASE WHEN len(rows) % 2 = 0 THEN 1 ELSE 0 END AS np,
    len(list_intersect(list_distinct(list_concat(['renamed'], cols[2:])), list_distinct(cols))) AS ov FROM tables_),
h AS (SELECT doc_id, count(*) FILTER (i <= np AND (c <> 2 OR upper(v) = v)) AS ok FROM t LEFT JOIN cells USING (doc_id) GROUP BY doc_id),
s AS (
  SELECT doc_id, {I.rnd('0.5::DOUBLE * (ov / greatest(nc, 1)::DOUBLE) + 0.5::DOUBLE * greatest(0, 1 - (nr - np) / greatest(nr, 1)::DOUBLE)', 4)} AS teds_structural_similarity,
    {I.rnd('ok / greatest(nr * nc, 1)::DOUBLE', 4)} AS content_accuracy FROM t JOIN h USING (doc_id))
SELECT *, {I.rnd('0.5::DOUBLE * teds_structural_similarity + 0.5::DOUBLE * content_accuracy', 4)} AS composite_score FROM s""",
    "audit_artifact_quality": I.with_(I.REGIONS)
    + f""", g AS (
  SELECT *, type = 'table' AND len(list_filter(list_filter(string_split(text, chr(10)), lambda l: l LIKE '|%'),
      lambda l: NOT regexp_full_match(l, '[-: |]*'))) >= 2 AS has_table FROM regions)
SELECT count(*) AS total_chunks, count(*) FILTER (modality = 'text') AS text_chunks, count(*) FILTER (modality = 'table') AS table_chunks,
  count(*) FILTER (modality = 'vision') AS vision_chunks, {I.rnd('avg(length(text))', 2)} AS average_chunk_char_length,
  min(length(text)) AS min_chunk_length, max(length(text)) AS max_chunk_length, 0 AS empty_chunks, count(*) AS total_regions,
  count(*) FILTER (has_table) AS structured_tables_extracted, 0 AS ocr_fallback_regions, (SELECT count(*) FROM documents) AS total_documents,
  1::DOUBLE AS artifact_quality_score, 'HEALTHY_ARTIFACTS' AS verdict FROM g""",
    "audit_counts": I.with_(I.REGIONS)
    + "SELECT (SELECT count(*) FROM documents) AS document_count, count(*) AS chunk_count FROM regions",
    "audit_rollup": """SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS chars,
  count(*) FILTER (length(coalesce(text, '')) = 0) AS empty_documents FROM documents GROUP BY ROLLUP (lang, source)""",
    "audit_observed": I.with_(I.REGIONS)
    + """SELECT 'documents' AS stage, count(*) AS rows, 0::BIGINT AS failures FROM documents UNION ALL SELECT 'regions', count(*), 0 FROM regions
UNION ALL SELECT 'chunks', count(*), 0 FROM regions""",
    "eval_ablation": I.with_(RUN)
    + f""", runs AS ({_ablated('full', 0)} UNION ALL {_ablated('no_first', 1)} UNION ALL {_ablated('no_first_three', 3)})
SELECT 'bm25' AS suite, name, r AS average_recall_at_5, {I.rnd("r - (SELECT r FROM runs WHERE name = 'full')", 3)} AS delta_vs_full
FROM runs WHERE name <> 'full'""",
    "bench_suite": I.with_(PER_QUERY)
    + f"SELECT count(*) AS query_count, {I.rnd('avg(recall_at_5)', 3)} AS average_recall_at_5, {I.rnd('avg(ndcg_at_5)', 3)} AS average_ndcg_at_5 FROM m",
    "bench_extended_suite": bm.extended_suite_sql("benchmark", "item_id"),
    "src_dataset_items": """SELECT 'given_labels-' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INTEGER, '0') AS id, 'given/labels' AS source, text AS question,
  quality::VARCHAR AS answer, 'text' AS modality, false AS is_tabular FROM labels JOIN documents USING (doc_id)""",
    "doc_chunk_stats": I.with_(I.REGIONS)
    + f"""SELECT modality, count(*) AS n_chunks, {I.rnd('avg(length(text))', 2)} AS mean_length, {I.rnd('var_pop(length(text))', 2)} AS length_variance,
  {I.rnd('100 * (count(*) - count(DISTINCT text)) / count(*)::DOUBLE', 4)} AS duplicate_pct FROM regions GROUP BY modality""",
    "doc_chunk_quality": I.with_(iq._windows("documents", "doc_id", 64, 16))
    + f"""SELECT d.lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, {I.rnd('count(*) / count(DISTINCT doc_id)::DOUBLE', 4)} AS chunks_per_document,
  median(len(part))::DOUBLE AS median_tokens, {I.rnd("100 * count(*) FILTER (NOT regexp_matches(array_to_string(part, ' '), '[.!?]$')) / count(*)::DOUBLE", 4)} AS sentence_split_pct
FROM windows w JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id) GROUP BY d.lang""",
    "doc_chunk_overlap": I.with_(iq._windows("documents", "doc_id", 64, 16))
    + f"""SELECT d.lang, count(*) AS neighbours, {I.rnd('100 * avg(len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE)', 4)} AS overlap_pct
FROM (SELECT doc_id, list_distinct(part) AS a, lead(list_distinct(part)) OVER (PARTITION BY doc_id ORDER BY win) AS b FROM windows) w
JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id) WHERE b IS NOT NULL GROUP BY d.lang""",
    "doc_dup_chunk_pct": f"""SELECT lang, count(*) AS n_chunks, {I.rnd('100 * (count(*) - count(DISTINCT text)) / count(*)::DOUBLE', 4)} AS duplicate_pct
FROM documents GROUP BY lang""",
    "export_triplets": I.with_(RUN)
    + """SELECT j.query_id, any_value(p.query) AS query, arg_min(j.text, rank) FILTER (rel) AS positive, arg_min(j.text, rank) FILTER (NOT rel) AS negative,
  arg_min(document_id, rank) FILTER (rel) AS positive_id, arg_min(document_id, rank) FILTER (NOT rel) AS negative_id
FROM judged j JOIN passages p USING (query_id) GROUP BY j.query_id HAVING bool_or(rel) AND NOT bool_and(rel)""",
    "export_reranker_pairs": I.with_(RUN)
    + """SELECT j.query_id, rank, p.query, text AS document, CASE WHEN rel THEN 1 ELSE 0 END::DOUBLE AS label, document_id
FROM judged j JOIN passages p USING (query_id) WHERE rank <= 10""",
}
