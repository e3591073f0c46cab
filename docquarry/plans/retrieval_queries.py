"""Registered queries over routing, indexes, retrieval, fusion and reranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from docquarry import config as cf
from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import chunk as ck
from docquarry.operators import fuse as fu
from docquarry.operators import index as ix
from docquarry.operators import proximity as px
from docquarry.operators import rank as rk
from docquarry.operators import ranking
from docquarry.operators import retrieve as rv
from docquarry.operators import route as rt
from docquarry.operators import segment as sg
from docquarry.operators import sparse as sp
from docquarry.operators import store as st
from docquarry.operators import substring as ss
from docquarry.plans import hybrid as hy
from docquarry.plans import ingest_queries as iq
from docquarry.plans import inputs as I
from docquarry.plans.table_queries import PLANNED
from docquarry.session import cut_lineage

# --- routing -------------------------------------------------------------------------------------


def _asked(spark, sf):
    """Every conversation turn, led by a routing phrase that its length picks."""
    phrases = F.array(*[F.lit(q) for _, q in I.QUERY_SET])
    return I.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat_ws(" ", F.get(phrases, F.length("text") % len(I.QUERY_SET)), F.col("text")).alias("query"),
    )


def route_probabilities(spark, sf):
    out = rt.with_routes(_asked(spark, sf))
    return out.select("conv_id", "turn", "p_text", "p_table", "p_vision")


def route_flags(spark, sf):
    out = rt.with_routes(_asked(spark, sf))
    return out.select("conv_id", "turn", "use_text", "use_table", "use_vision")


def route_weights(spark, sf):
    out = rt.with_routes(_asked(spark, sf))
    return out.select("conv_id", "turn", "w_text", "w_table", "w_vision")


def _labeled(spark, sf):
    """Turns labelled by role: users ask for text, assistants for text and tables, others for figures."""
    turns = I.table(spark, sf, "conversations")
    labels = F.when(F.col("role") == "user", F.array(F.lit("text"))).when(
        F.col("role") == "assistant", F.array(F.lit("text"), F.lit("table"))
    ).otherwise(F.array(F.lit("vision")))
    return turns.select("conv_id", "turn", F.col("text").alias("query"), labels.alias("labels"))


def router_train(spark, sf):
    return rt.train(_labeled(spark, sf))


def router_infer(spark, sf):
    asked = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rt.infer(asked, rt.train(_labeled(spark, sf)))


# --- keyword retrieval ---------------------------------------------------------------------------


# Region types that a path looks at.
_PATH_TYPES = {
    rv.BATCH_TEXT: ("title", "body", "paragraph"),
    rv.BATCH_TABLE: ("table",),
    rv.BATCH_VISION: ("figure",),
}


# What a search may need beside the regions, and what writes it.
_PARTS = {"words": st.write_words, "tables": st.write_tables}


def region_store(spark, sf, *parts):
    """The corpus written once for all searches over regions; ``words`` and ``tables`` only when a query asks for them."""
    store = st.RegionStore(I.written(spark, sf, "region-store", lambda p: st.write_regions(I.regions(spark, sf), st.RegionStore(p))))
    for part in parts:
        I.written(spark, sf, f"region-store/{part}", lambda _, part=part: _PARTS[part](spark, store))  # into the store's folder
    return store


def _keyword_path(spark, sf, batch):
    """Ranked keyword hits of a path, from the index of the regions' words."""
    queries = spark.createDataFrame(I.QUERY_SET, "query_id bigint, query string")
    found = ss.found_terms(spark, region_store(spark, sf, "words").words, queries, _PATH_TYPES[batch])
    hits = found.select("query_id", "doc_pos", "region_idx", rv.keyword_score(F.col("type"), F.col("found"), F.col("n_terms")).alias("score"))
    ranked = rv.ranked_hits(cut_lineage(hits))
    return ranked.select("query_id", "rank", "doc_pos", "region_idx", "score", (F.col("region_idx") + 1).cast("bigint").alias("item_no"))


def ret_text_keyword(spark, sf):
    return _keyword_path(spark, sf, rv.BATCH_TEXT)


def ret_table_keyword(spark, sf):
    return _keyword_path(spark, sf, rv.BATCH_TABLE)


def ret_vision_keyword(spark, sf):
    return _keyword_path(spark, sf, rv.BATCH_VISION).drop("item_no")


def idx_word_grams(spark, sf):
    """Three-letter grams of the written word index with the number of words that hold them."""
    return spark.read.parquet(f"{region_store(spark, sf, 'words').words.path}/grams").groupBy("gram").agg(F.count("*").alias("words"))


def ret_table_sql(spark, sf):
    hits = st.table_hits(spark, region_store(spark, sf, "tables"), I.QUERY_SET, route_all=True)
    ranked = rv.ranked_hits(cut_lineage(hits))
    return ranked.select("query_id", "rank", "doc_pos", "region_idx", "score", "item_no")


def sql_table_store(spark, sf):
    """Written tables with the types and faults found at ingestion, and the fields of their typed records."""
    tables = region_store(spark, sf, "tables").tables(spark)
    rows = F.expr("cast(records as array<map<string, string>>)")
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(F.map_values(r), lambda v: v.isNotNull())))
    return tables.select("doc_pos", "region_idx", F.array_join("columns", "|").alias("columns"), F.array_join("types", "|").alias("types"),
                         F.coalesce("error", F.lit("")).alias("error"), F.size(rows).alias("records"), filled.alias("filled"))


def ret_keyword_overlap(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pos"), "text")
    return rv.overlap_top_k(docs, I.QUERY_SET, 10)


# --- indexes -------------------------------------------------------------------------------------


def _units(spark, sf):
    return I.regions(spark, sf).filter(F.col("modality") != "vision").select("modality", "doc_pos", "region_idx", "text")


def idx_bm25_build(spark, sf):
    tokens = ix.tokenised(_units(spark, sf), ["modality", "doc_pos", "region_idx"])
    return ix.postings(tokens, ["modality", "doc_pos", "region_idx"])


def idx_bm25_stats(spark, sf):
    tokens = ix.tokenised(_units(spark, sf), ["modality", "doc_pos", "region_idx"])
    stats = ix.collection_stats(tokens, ["modality"])
    return stats.select("modality", "n_units", tx.pyround(F.col("avgdl"), 6).alias("avgdl"))


def _stored_units(spark, sf):
    return region_store(spark, sf).regions(spark).filter(F.col("modality") != "vision").select("modality", "doc_pos", "region_idx", "text")


def unit_index(spark, sf):
    """Written index of the text and table regions, one collection per modality."""
    index = sp.SparseIndex("", ("doc_pos", "region_idx"), ("modality",))
    return replace(index, path=I.written(spark, sf, "region-postings", lambda p: sp.write_segment(_stored_units(spark, sf), replace(index, path=p))))


def document_index(spark, sf):
    """Written index of the whole documents."""
    index = sp.SparseIndex("", ("doc_pos",), ("modality",))
    units = I.corpus_raw(spark, sf).select(F.lit("text").alias("modality"), "doc_pos", "text")
    return replace(index, path=I.written(spark, sf, "document-postings", lambda p: sp.write_segment(units, replace(index, path=p))))


def idx_bm25_blocks(spark, sf):
    """Terms of the written index: their posting and document counts, read back from its blocks."""
    blocks = sp.read_blocks(spark, unit_index(spark, sf)).filter("bucket >= 0")
    tf = F.aggregate("docs", F.lit(0).cast("bigint"), lambda a, d: a + d["tf"])
    return blocks.groupBy("modality", "term").agg(F.sum("n").alias("df"), F.sum(tf).alias("tf"))


def ret_bm25_topk(spark, sf):
    queries = spark.createDataFrame(I.QUERY_SET, "query_id bigint, query string")
    return sp.search(spark, unit_index(spark, sf), queries, 10)


def bm25_run(spark, sf, k=20):
    """Benchmark passages as queries against whole documents: the run the evaluation queries judge.

    One batch is scored in a pass over the documents; the index is written where the batch is too long, or documents share an id.
    """
    queries = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = sp.scan(I.corpus_raw(spark, sf), queries, k)
    return sp.search(spark, document_index(spark, sf), queries, k).drop("modality") if found is None else found


def ret_bm25_passages(spark, sf):
    return bm25_run(spark, sf)


def idx_modality_counts(spark, sf):
    chunks = sg.region_chunks(I.regions(spark, sf))
    return chunks.groupBy("modality").agg(
        F.count("*").alias("chunks"), F.max(F.col("modality").isin("text", "table")).alias("sparse")
    )


def idx_domain_preset(spark, sf):
    """Document languages and sources as domains; only listed names differ from the default."""
    domain = F.when(F.col("lang") == "en", "Legal").when(F.col("lang") == "fr", "multilingual").otherwise(F.col("source"))
    return I.table(spark, sf, "documents").select("doc_id", ix.domain_model(domain).alias("model"))


def idx_encode_records(spark, sf):
    out = ix.encode_records(I.regions(spark, sf))
    return out.select("id", "document_id", "region_type", "modality", "text", F.size("vector").alias("dims"))


def emb_hash_vector(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", ix.hash_vector(F.col("text")).alias("v"))
    return unnest(docs, ["doc_id"], F.col("v"), "weight", "dim")


def idx_dense_norm(spark, sf):
    """Embeddings scaled by their label, brought back to unit length."""
    vectors = I.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("v")
    )
    unit = vectors.select("vec_id", ix.l2_normalized(F.col("v")).alias("v"))
    rows = unnest(unit, ["vec_id"], F.col("v"), "x", "dim")
    return rows.select("vec_id", "dim", tx.pyround(F.col("x"), 6).alias("x"))


def _dense_queries(spark, sf):
    """Every vector whose id is divisible by 20 asks for its neighbours among all."""
    asked = I.table(spark, sf, "embeddings").filter("vec_id % 20 = 0")
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def ret_dense_topk(spark, sf):
    return ix.dense_top_k(I.table(spark, sf, "embeddings"), _dense_queries(spark, sf), 10)


def ret_dense_centroids(spark, sf):
    """Neighbours of the mean vector of each label."""
    centroids = ix.label_centroids(I.table(spark, sf, "embeddings")).select(F.col("label").alias("query_id"), F.col("centroid").alias("qv"))
    return ix.dense_top_k(I.table(spark, sf, "embeddings"), cut_lineage(centroids), 10)


def _graph(spark, sf):
    return I.written(spark, sf, "neighbour-graph", lambda p: px.build_graph(I.table(spark, sf, "embeddings"), p), ("embeddings",))


def idx_dense_roundtrip(spark, sf):
    """The written neighbour graphs read back: every vector is in one node, of unit length."""
    back = spark.read.parquet(_graph(spark, sf))
    return back.select(F.explode("ids").alias("vec_id"), F.size("v").alias("dims"), tx.pyround(ix.dot(F.col("v"), F.col("v")), 6).alias("length"))


def _walked(spark, sf):
    """Hits of the graph search, and how much of the exact search's each query found."""
    asked = _dense_queries(spark, sf)
    found = cut_lineage(px.search_graph(spark, _graph(spark, sf), asked, 10))
    return found, px.recall(found, ix.dense_top_k(I.table(spark, sf, "embeddings"), asked, 10))


def ret_dense_graph(spark, sf):
    """Hits of the graph search with the query's recall and the share of the vectors that it was held against."""
    found, recall = _walked(spark, sf)
    total = I.table(spark, sf, "embeddings").count()
    return found.join(recall, "query_id").select(
        "query_id", "rank", "vec_id", "score", "recall", tx.pyround(F.col("scored") / F.lit(total), 4).alias("scored_share"))


# Least share of the exact top ten that the approximate search has to find, over all queries.
RECALL = 0.9


def ret_dense_lsh(spark, sf):
    """Approximate search beside the exact one: rows per query, and whether the mean recall is enough."""
    found, recall = _walked(spark, sf)
    enough = (recall.agg(F.avg("recall")).first()[0] or 0.0) >= RECALL
    return found.groupBy("query_id").agg(F.count("*").alias("n_results"), F.lit(enough).alias("recall_met"))


# --- fusion --------------------------------------------------------------------------------------


def _told_apart(spark, sf):
    """Whether every document has an id of its own."""
    n = I.table(spark, sf, "documents").groupBy("doc_id").count()
    return n.filter("count > 1 OR doc_id IS NULL").isEmpty()


def _hits(spark, sf, config=None, use_sql=True):
    """Hits of the query set by one pass over the written regions.

    The word index and the typed tables pay off for many batches; for this one they cost more than the pass.
    They are asked where documents share an id, whose regions are one unit there.
    """
    if not _told_apart(spark, sf):
        return st.hits(spark, region_store(spark, sf, "words", *["tables"] * use_sql), I.QUERY_SET, config and config.router, use_sql)
    return rv.region_hits(region_store(spark, sf).regions(spark), I.QUERY_SET, config and config.router, use_sql)


def _written_hits(spark, sf):
    """The hits of the query set, written once for the queries that fuse them."""
    return spark.read.parquet(I.written(spark, sf, "region-hits", lambda p: _hits(spark, sf).write.parquet(p)))


def fuse_normalize(spark, sf):
    out = fu.normalize(_written_hits(spark, sf), ["query_id", "batch"], few_groups=True)
    return out.select("query_id", "batch", "doc_pos", "region_idx", "score", "nscore")


def _runs(spark, sf, keep=None):
    hits = _written_hits(spark, sf)
    if keep:
        hits = hits.filter(keep)
    ranked = fu.rank_runs(fu.normalize(hits, ["query_id", "batch"], few_groups=True))
    doc = F.col("doc_pos").cast("string")
    return ranked.withColumn("weight", fu.default_weight(F.col("modality"))).withColumn("item_id", hy._item_id(doc))


def fuse_batches(spark, sf):
    """Ranks of the concatenated, normalised batches within each modality's run."""
    return _runs(spark, sf).select("query_id", "modality", "batch", "doc_pos", "region_idx", "nscore", "rank")


def fuse_rrf(spark, sf):
    fused = fu.fuse_rrf(_runs(spark, sf), ["region_idx"])
    return fused.select("query_id", "item_id", "region_idx", "rrf_score", "score", "fused_modalities")


def fuse_late(spark, sf):
    """One flat list of keyword hits grouped by modality, raw scores, default weights."""
    hits = _written_hits(spark, sf).filter(F.col("batch") != rv.BATCH_SQL)
    ranked = fu.rank_runs(hits, [("score", False)])
    doc = F.col("doc_pos").cast("string")
    ranked = ranked.withColumn("weight", fu.default_weight(F.col("modality"))).withColumn("item_id", hy._item_id(doc))
    fused = fu.fuse_rrf(ranked, ["region_idx"])
    return fused.select("query_id", "item_id", "rrf_score", "score")


def _region_evidence(spark, sf):
    return I.regions(spark, sf).select(
        "document_id",
        "region_idx",
        "modality",
        "text",
        F.expr("cast(start div 5 as int)").alias("page_no"),
        F.when(F.col("start") % 7 == 0, "scatter_plot").alias("figure_type"),
    )


def chart_linearize(spark, sf):
    out = fu.chart_evidence(_region_evidence(spark, sf), F.lit("q"))
    return out.select("document_id", "region_idx", "modality", "chart_type", "linearized", "reasoning")


def chart_type(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", fu.chart_type(F.col("text")).alias("chart_type"))


def hyb_union_all(spark, sf):
    """Fused evidence plus its chart copies: a bag union that keeps duplicates."""
    base = _region_evidence(spark, sf)
    both = base.select("document_id", "region_idx", "modality").unionByName(
        fu.chart_evidence(base).select("document_id", "region_idx", "modality")
    )
    return both.groupBy("document_id", "modality").agg(F.count("*").alias("n"))


def hyb_parent_expand(spark, sf):
    """Section chunks with their group text as parent."""
    chunks = ck.section_chunks(I.titled(spark, sf), size=48, overlap=12)
    out = fu.expand_parent(chunks.select("chunk_id", "text", "parent_text"))
    return out.select("chunk_id", F.length("text").alias("n"), F.length("child_text").alias("child_n"))


def _pair_scores(spark, sf):
    """Each turn of a conversation against the turn before it."""
    turns = I.table(spark, sf, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    pairs = turns.join(asked, ["conv_id", "turn"])
    modality = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "table").otherwise("vision")
    text = F.when(F.length("text") % 2 == 0, F.concat(F.lit("[Context: a > b] "), F.col("text"))).otherwise(F.substring_index("text", ".", 1))
    pairs = pairs.withColumn("modality", modality).withColumn("text", text)
    overlap = rv.jaccard(
        F.array_distinct(tx.words(F.lower("query"))), F.array_distinct(tx.words(F.lower("text")))
    )
    return pairs.withColumn("jaccard", overlap).withColumn("body_len", rv.body_length(F.col("text")))


def rank_fallback(spark, sf):
    pairs = _pair_scores(spark, sf)
    score = rk.rank_score((F.col("turn") / 4).cast("double"), F.col("jaccard"), F.col("modality"), F.col("body_len"))
    return pairs.select("conv_id", "turn", "modality", tx.pyround(F.col("jaccard"), 6).alias("jaccard"), score.alias("rank_score"))


def rank_topk(spark, sf):
    """The three best-ranked turns per conversation role."""
    pairs = _pair_scores(spark, sf).withColumn(
        "rank_score", rk.rank_score(F.lit(1.0), F.col("jaccard"), F.col("modality"), F.col("body_len"))
    )
    order = [F.col("rank_score").desc(), F.col("conv_id").asc(), F.col("turn").asc()]
    return ranking.top_k(pairs, ["modality"], order, 3).select("modality", "rank", "conv_id", "turn", "rank_score")


def hybrid_retrieve(spark, sf):
    out = hy.hybrid_retrieve(region_store(spark, sf).regions(spark), I.QUERY_SET, hits=_written_hits(spark, sf))
    return out.select("query_id", "rank", "document_id", "item_id", "region_idx", "modality", "score", "rrf_score", "rank_score", "text")


def query_service(spark, sf):
    config = cf.EngineConfig.load_preset("quality_max")
    out = hy.query_service(region_store(spark, sf).regions(spark), I.QUERY_SET, config, cut_lineage(_hits(spark, sf, config, use_sql=False)))
    return out.select("query_id", "rank", "document_id", "region_idx", "modality", "score", "rank_score")


QUERIES = {
    f.__name__: f
    for f in (
        route_probabilities,
        route_flags,
        route_weights,
        router_train,
        router_infer,
        ret_text_keyword,
        ret_table_keyword,
        ret_vision_keyword,
        idx_word_grams,
        ret_table_sql,
        sql_table_store,
        ret_keyword_overlap,
        idx_bm25_build,
        idx_bm25_stats,
        idx_bm25_blocks,
        ret_bm25_topk,
        ret_bm25_passages,
        idx_modality_counts,
        idx_domain_preset,
        idx_encode_records,
        emb_hash_vector,
        idx_dense_norm,
        ret_dense_topk,
        ret_dense_centroids,
        idx_dense_roundtrip,
        ret_dense_graph,
        ret_dense_lsh,
        fuse_normalize,
        fuse_batches,
        fuse_rrf,
        fuse_late,
        chart_linearize,
        chart_type,
        hyb_union_all,
        hyb_parent_expand,
        rank_fallback,
        rank_topk,
        hybrid_retrieve,
        query_service,
    )
}

# --- oracles -------------------------------------------------------------------------------------


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _prob(q, words, floor):
    n = f"len(list_filter({_list(words)}, lambda k: contains(lower({q}), k)))"
    return I.rnd(f"CASE WHEN {n} = 0 THEN {floor} ELSE 1 / (1 + exp(-1.2::DOUBLE * {n})) END", 3)


def _routes(source, keys):
    return f"""probs AS (
  SELECT {keys}, query, {_prob('query', cf.TEXT_KEYWORDS, 0.5)} AS p_text, {_prob('query', cf.TABLE_KEYWORDS, 0.1)} AS p_table,
         {_prob('query', cf.VISION_KEYWORDS, 0.1)} AS p_vision FROM {source}),
routes AS (
  SELECT *, p_text >= 0.35 AS use_text, p_table >= 0.35 AS use_table, p_vision >= 0.35 AS use_vision,
    {I.rnd('p_text / (p_text + p_table + p_vision)', 3)} AS w_text, {I.rnd('p_table / (p_text + p_table + p_vision)', 3)} AS w_table,
    {I.rnd('p_vision / (p_text + p_table + p_vision)', 3)} AS w_vision FROM probs)"""


ASKED = f"""asked AS (
  SELECT conv_id, turn, {_list(q for _, q in I.QUERY_SET)}[length(text) % {len(I.QUERY_SET)} + 1] || ' ' || text AS query
  FROM conversations)"""

_WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
TRAIN = f"""labeled AS (
  SELECT text, CASE role WHEN 'user' THEN ['text'] WHEN 'assistant' THEN ['text', 'table'] ELSE ['vision'] END AS labels
  FROM conversations),
vocab AS (
  SELECT token, modality, {I.rnd('sum(CASE WHEN list_contains(labels, modality) THEN 1.0 ELSE 0.1 END)', 2)} AS weight
  FROM (SELECT labels, unnest({_WORDS.format(x='lower(text)')}) AS token FROM labeled),
       (VALUES ('text'), ('table'), ('vision')) m(modality) GROUP BY ALL)"""

HITS = (
    PLANNED
    + ",\n"
    + _routes("query_set", "query_id")
    + f""",
asked AS (
  SELECT *, {_WORDS.format(x='lower(query)')} AS terms, list_distinct({_WORDS.format(x='lower(query)')}) AS tokens FROM routes),
words AS (
  SELECT doc_pos, region_idx, type, text, lower(text) AS low, list_distinct({_WORDS.format(x='lower(text)')}) AS toks,
         (regexp_matches(lower(text), 'chart|figure|graph|diagram|plot')) AS visual_text FROM regions),
found AS (
  SELECT r.*, a.*, len(list_filter(terms, lambda t: contains(low, t))) AS found, len(terms) AS n FROM words r, asked a),
scored AS (
  SELECT *, {I.rnd("CASE type WHEN 'table' THEN found / n::DOUBLE * 3 WHEN 'figure' THEN found / n::DOUBLE + 0.1::DOUBLE WHEN 'title' THEN found / n::DOUBLE ELSE found / n::DOUBLE * 2.5 END", 3)} AS s
  FROM found),
sql_hits AS (
  SELECT c.query_id, r.doc_pos, c.region_idx,
    CASE WHEN len(list_filter(cols, lambda c: contains(q, lower(c)))) > 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS score
  FROM chosen c JOIN (SELECT DISTINCT doc_pos, document_id FROM corpus) r USING (document_id)),
every_hit AS (
  SELECT query_id, CASE type WHEN 'table' THEN 1 WHEN 'figure' THEN 3 ELSE 0 END AS batch, doc_pos, region_idx, s AS score,
         CASE WHEN type <> 'figure' THEN region_idx + 1 END AS item_no FROM scored WHERE found > 0
  UNION ALL SELECT query_id, 2, doc_pos, region_idx, score, region_idx FROM sql_hits),
hits AS (
  SELECT h.*, CASE batch WHEN 0 THEN 'text' WHEN 3 THEN 'vision' ELSE 'table' END AS modality
  FROM every_hit h JOIN routes r USING (query_id)
  WHERE CASE batch WHEN 0 THEN use_text WHEN 3 THEN use_vision ELSE use_table END),
normed AS (
  SELECT *, {I.rnd('score / max(score) OVER (PARTITION BY query_id, batch)', 2)} AS nscore FROM hits)"""
)


def _fused(order, source, sql=True, weights="default"):
    weight = (
        "CASE modality WHEN 'text' THEN 0.45 WHEN 'table' THEN 0.35 ELSE 0.20 END::DOUBLE"
        if weights == "default"
        else "CASE modality WHEN 'text' THEN w_text WHEN 'table' THEN w_table ELSE w_vision END"
    )
    where = "" if sql else "WHERE batch <> 2"
    return f"""
runs AS (
  SELECT s.*, row_number() OVER (PARTITION BY query_id, modality ORDER BY {order}, doc_pos, region_idx) AS rank
  FROM {source} s {where}),
ided AS (
  SELECT r.*, {weight} AS weight, CASE WHEN item_no IS NULL THEN doc_pos || '-vision-' || rank
    ELSE doc_pos || CASE modality WHEN 'text' THEN '-region-' ELSE '-table-' END || item_no END AS item_id
  FROM runs r JOIN routes USING (query_id)),
fused AS (
  SELECT query_id, item_id, modality, sum(weight / (60 + rank)) AS rrf, arg_max(doc_pos, rank) AS doc_pos,
         arg_max(region_idx, rank) AS region_idx, min(rank) AS first_rank
  FROM ided GROUP BY ALL),
out_ AS (
  SELECT *, {I.rnd('rrf', 5)} AS rrf_score, {I.rnd('rrf * 100', 3)} AS score,
         CASE modality WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END AS run FROM fused)"""


def _reranked(k, chart=True):
    copies = (
        """SELECT *, false AS from_chart FROM joined UNION ALL
  SELECT * REPLACE ('vision' AS modality), true FROM joined WHERE modality = 'vision' OR visual_text"""
        if chart
        else "SELECT *, false AS from_chart FROM joined"
    )
    return f"""
joined AS (
  SELECT o.*, w.text, w.visual_text, w.toks, a.tokens, len(list_intersect(w.toks, a.tokens)) AS common
  FROM out_ o JOIN words w ON w.doc_pos = o.doc_pos AND w.region_idx = o.region_idx JOIN asked a ON a.query_id = o.query_id),
cands AS ({copies}),
ranked AS (
  SELECT *, {I.rnd("(score * 0.7::DOUBLE + CASE WHEN len(toks) > 0 THEN common / (len(toks) + len(tokens) - common)::DOUBLE ELSE 0 END * 100 * 0.3::DOUBLE * CASE modality WHEN 'table' THEN 1.3::DOUBLE WHEN 'vision' THEN 1.1::DOUBLE ELSE 1 END) * CASE WHEN modality = 'text' AND length(text) < 45 THEN 0.5::DOUBLE ELSE 1 END", 3)} AS rank_score
  FROM cands),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, from_chart, score DESC, run, first_rank) AS rank FROM ranked
  QUALIFY rank <= {k})"""


def _path(cond):
    return (
        I.with_(HITS)
        + f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_pos, region_idx) AS rank,
  doc_pos, region_idx, score, item_no FROM every_hit WHERE {cond}"""
    )


_STOP = _list(ix.STOPWORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({stop}, t))"


def tokens_sql(x):
    return _TOKENS.format(x=x, stop=_STOP)


def bm25_sql(units, keys, groups, queries, k):
    """BM25 CTEs over ``units`` (keys, groups, text) and ``queries`` (query_id, query); result in ``bm25``."""
    g, u = ", ".join(groups), ", ".join(keys)
    return f"""toks AS (SELECT {g}, {u}, {tokens_sql('text')} AS toks FROM {units}),
stats AS (SELECT {g}, count(*) AS n_units, avg(len(toks)) AS avgdl FROM toks GROUP BY {g}),
tf AS (
  SELECT {g}, {u}, dl, term, count(*) AS tf FROM (SELECT {g}, {u}, len(toks) AS dl, unnest(toks) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT {g}, term, count(*) AS df FROM tf GROUP BY ALL),
qterms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM {queries}) GROUP BY ALL),
bm AS (
  SELECT {g}, {u}, query_id, {I.rnd("sum(qtf * ln((n_units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))", 4)} AS score
  FROM tf JOIN dfs USING ({g}, term) JOIN stats USING ({g}) JOIN qterms USING (term) GROUP BY {g}, {u}, query_id),
bm25 AS (
  SELECT *, row_number() OVER (PARTITION BY {g}, query_id ORDER BY score DESC, {u}) AS rank FROM bm WHERE score > 0
  QUALIFY rank <= {k})"""


UNITS = "units AS (SELECT modality, doc_pos, region_idx, text FROM regions WHERE modality <> 'vision')"
PASSAGES = """raw_docs AS (SELECT 'text' AS modality, doc_id AS doc_pos, text FROM documents),
passages AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
BM25_RUN = PASSAGES + ",\n" + bm25_sql("raw_docs", ["doc_pos"], ["modality"], "passages", 20)

CENTROIDS = """means AS (
  SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
  GROUP BY ALL),
cents AS (SELECT label, list(x ORDER BY dim) AS c FROM means GROUP BY label)"""

_EVIDENCE = I.REGIONS + """,
evid AS (
  SELECT document_id, region_idx, modality, text, start // 5 AS page_no,
         CASE WHEN start % 7 = 0 THEN 'scatter_plot' END AS figure_type, lower(text) AS low FROM regions),
charts AS (
  SELECT *, coalesce(figure_type, CASE WHEN contains(low, 'bar') THEN 'bar_chart' WHEN regexp_matches(low, 'line|trend') THEN 'line_chart'
    WHEN contains(low, 'pie') THEN 'pie_chart' WHEN contains(low, 'scatter') THEN 'scatter_plot'
    WHEN contains(low, 'diagram') THEN 'diagram' ELSE 'chart' END) AS chart_type,
    CASE WHEN page_no = 0 THEN 'N/A' ELSE page_no::VARCHAR END AS page
  FROM evid WHERE modality = 'vision' OR regexp_matches(low, 'chart|figure|graph|diagram|plot'))"""

PAIRS = f"""pairs AS (
  SELECT b.conv_id, b.turn, a.text AS query, CASE b.role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'table' ELSE 'vision' END AS modality,
    CASE WHEN length(b.text) % 2 = 0 THEN '[Context: a > b] ' || b.text ELSE string_split(b.text, '.')[1] END AS text, b.text AS raw
  FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
sets AS (
  SELECT *, list_distinct({_WORDS.format(x='lower(query)')}) AS qs, list_distinct({_WORDS.format(x='lower(text)')}) AS ts,
    CASE WHEN length(raw) % 2 = 0 THEN length(trim(raw, ' ' || chr(10))) ELSE length(text) END AS body_len FROM pairs),
jac AS (
  SELECT *, CASE WHEN len(qs) > 0 AND len(ts) > 0 THEN len(list_intersect(qs, ts)) / (len(qs) + len(ts) - len(list_intersect(qs, ts)))::DOUBLE
    ELSE 0 END AS j FROM sets)"""


def _pair_rank(score):
    return I.rnd(
        f"({score} * 0.7::DOUBLE + j * 100 * 0.3::DOUBLE * CASE modality WHEN 'table' THEN 1.3::DOUBLE WHEN 'vision' THEN 1.1::DOUBLE ELSE 1 END)"
        " * CASE WHEN modality = 'text' AND body_len < 45 THEN 0.5::DOUBLE ELSE 1 END",
        3,
    )


ORACLES = {
    "route_probabilities": I.with_(ASKED, _routes("asked", "conv_id, turn"))
    + "SELECT conv_id, turn, p_text, p_table, p_vision FROM routes",
    "route_flags": I.with_(ASKED, _routes("asked", "conv_id, turn"))
    + "SELECT conv_id, turn, use_text, use_table, use_vision FROM routes",
    "route_weights": I.with_(ASKED, _routes("asked", "conv_id, turn"))
    + "SELECT conv_id, turn, w_text, w_table, w_vision FROM routes",
    "router_train": I.with_(TRAIN) + "SELECT token, modality, weight FROM vocab",
    "router_infer": I.with_(TRAIN)
    + f""", toks AS (
  SELECT item_id, unnest({_WORDS.format(x='lower(text)')}) AS token FROM benchmark),
per AS (
  SELECT item_id, count(DISTINCT i) AS n, coalesce(sum(weight) FILTER (modality = 'text'), 0) AS a,
    coalesce(sum(weight) FILTER (modality = 'table'), 0) AS b, coalesce(sum(weight) FILTER (modality = 'vision'), 0) AS c
  FROM (SELECT *, row_number() OVER () AS i FROM toks) LEFT JOIN vocab USING (token) GROUP BY item_id)
SELECT item_id AS query_id, {I.rnd('least(1, a / greatest(1, n * 2))', 3)} AS p_text,
  {I.rnd('least(1, b / greatest(1, n * 2))', 3)} AS p_table, {I.rnd('least(1, c / greatest(1, n * 2))', 3)} AS p_vision FROM per""",
    "ret_text_keyword": _path("batch = 0"),
    "ret_table_keyword": _path("batch = 1"),
    "ret_vision_keyword": _path("batch = 3").replace("score, item_no FROM every_hit", "score FROM every_hit"),
    "idx_word_grams": I.with_(I.REGIONS)
    + f""", words AS (SELECT DISTINCT unnest({_WORDS.format(x='lower(text)')}) AS word FROM regions)
SELECT gram, count(*) AS words
FROM (SELECT DISTINCT word, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS gram FROM words) GROUP BY gram""",
    "ret_table_sql": _path("batch = 2"),
    "sql_table_store": I.with_(PLANNED)
    + """, filled AS (
  SELECT c.document_id, c.region_idx, count(*) FILTER (sql_type = 'VARCHAR' OR c.v NOT IN ('', '-', '—', 'N/A', 'null', 'None', 'nan')) AS filled
  FROM col_cells c JOIN col_types USING (document_id, region_idx, col_no) GROUP BY ALL)
SELECT r.doc_pos, t.region_idx, array_to_string(cols, '|') AS columns, array_to_string(types, '|') AS types, '' AS error, len(rows) AS records, filled
FROM typed t JOIN filled USING (document_id, region_idx) JOIN (SELECT DISTINCT doc_pos, document_id FROM corpus) r USING (document_id)""",
    "ret_keyword_overlap": I.with_(I.QUERIES_CTE)
    + f""", q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS qt FROM query_set),
s AS (
  SELECT query_id, doc_id AS doc_pos, {I.rnd("len(list_intersect(qt, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) / greatest(1, len(qt))::DOUBLE", 4)} AS score
  FROM documents, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_pos) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "idx_bm25_build": I.with_(I.REGIONS, UNITS)
    + f""", toks AS (SELECT modality, doc_pos, region_idx, {tokens_sql('text')} AS toks FROM units)
SELECT modality, doc_pos, region_idx, dl, term, count(*) AS tf
FROM (SELECT modality, doc_pos, region_idx, len(toks) AS dl, unnest(toks) AS term FROM toks) GROUP BY ALL""",
    "idx_bm25_stats": I.with_(I.REGIONS, UNITS)
    + f"""SELECT modality, count(*) AS n_units, {I.rnd(f"avg(len({tokens_sql('text')}))", 6)} AS avgdl FROM units GROUP BY modality""",
    "idx_bm25_blocks": I.with_(I.REGIONS, UNITS)
    + f""", toks AS (SELECT modality, doc_pos, region_idx, {tokens_sql('text')} AS toks FROM units)
SELECT modality, term, count(DISTINCT (doc_pos, region_idx)) AS df, count(*) AS tf
FROM (SELECT modality, doc_pos, region_idx, unnest(toks) AS term FROM toks) GROUP BY ALL""",
    "ret_bm25_topk": I.with_(I.REGIONS, UNITS, I.QUERIES_CTE, bm25_sql("units", ["doc_pos", "region_idx"], ["modality"], "query_set", 10))
    + "SELECT modality, query_id, doc_pos, region_idx, score, rank FROM bm25",
    "ret_bm25_passages": I.with_(BM25_RUN) + "SELECT query_id, doc_pos, score, rank FROM bm25",
    "idx_modality_counts": I.with_(I.REGIONS)
    + "SELECT modality, count(*) AS chunks, modality IN ('text', 'table') AS sparse FROM regions GROUP BY modality",
    "idx_domain_preset": """SELECT doc_id, CASE lang WHEN 'en' THEN 'law-ai/InLegalBERT'
  WHEN 'fr' THEN 'sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2'
  ELSE 'sentence-transformers/all-MiniLM-L6-v2' END AS model FROM documents""",
    "idx_encode_records": I.with_(I.REGIONS)
    + f"""SELECT document_id || '-' || type || '-' || (row_number() OVER (PARTITION BY modality ORDER BY doc_pos, region_idx) - 1) AS id,
  document_id, type AS region_type, modality, text, len(list_distinct({_WORDS.format(x='lower(text)')})) AS dims FROM regions""",
    "emb_hash_vector": f"""WITH v AS (
  SELECT doc_id, list_sort(list_distinct({_WORDS.format(x='lower(text)')})) AS ts FROM documents)
SELECT doc_id, generate_subscripts(ts, 1) - 1 AS dim,
  unnest(list_transform(ts, lambda t: {I.rnd("('0x' || substr(sha256(t), 1, 8))::UBIGINT / 16777215::DOUBLE", 4)})) AS weight FROM v""",
    "idx_dense_norm": f"""WITH e AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE * (label + 2) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id, dim, {I.rnd('x / sqrt(sum(x * x) OVER (PARTITION BY vec_id))', 6)} AS x FROM e""",
    "ret_dense_topk": f"""WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, {I.rnd('list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])', 4)} AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "ret_dense_centroids": I.with_(CENTROIDS)
    + f""", s AS (
  SELECT label AS query_id, vec_id, {I.rnd('list_dot_product(c, e.embedding::DOUBLE[]) / sqrt(list_dot_product(c, c))', 4)} AS score
  FROM cents c, (SELECT vec_id, embedding FROM embeddings) e)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "idx_dense_roundtrip": "SELECT vec_id, len(embedding) AS dims, 1.0::DOUBLE AS length FROM embeddings",
    "ret_dense_lsh": "SELECT vec_id AS query_id, 10::BIGINT AS n_results, true AS recall_met FROM embeddings WHERE vec_id % 20 = 0",
    "fuse_normalize": I.with_(HITS) + "SELECT query_id, batch, doc_pos, region_idx, score, nscore FROM normed",
    "fuse_batches": I.with_(HITS)
    + """SELECT query_id, modality, batch, doc_pos, region_idx, nscore, row_number() OVER (PARTITION BY query_id, modality
 ORDER BY nscore DESC, batch, score DESC, doc_pos, region_idx) AS rank FROM normed""",
    "fuse_rrf": I.with_(HITS, _fused("nscore DESC, batch, score DESC", "normed"))
    + "SELECT query_id, item_id, region_idx, rrf_score, score, modality AS fused_modalities FROM out_",
    "fuse_late": I.with_(HITS, _fused("score DESC", "normed", sql=False))
    + "SELECT query_id, item_id, rrf_score, score FROM out_",
    "chart_linearize": I.with_(_EVIDENCE)
    + """SELECT document_id, region_idx, 'vision' AS modality, chart_type, '[' || upper(chart_type) || ' - Page ' || page || '] ' || text AS linearized,
  'Extracted visual chart evidence matching ''q'' (Type: ' || chart_type || ', Page: ' || page || ')' AS reasoning FROM charts""",
    "chart_type": """SELECT doc_id, CASE WHEN lower(text) LIKE '%bar%' THEN 'bar_chart' WHEN lower(text) LIKE '%line%' OR lower(text) LIKE '%trend%'
  THEN 'line_chart' WHEN lower(text) LIKE '%pie%' THEN 'pie_chart' WHEN lower(text) LIKE '%scatter%' THEN 'scatter_plot'
  WHEN lower(text) LIKE '%diagram%' THEN 'diagram' ELSE 'chart' END AS chart_type FROM documents""",
    "hyb_union_all": I.with_(_EVIDENCE)
    + """SELECT document_id, modality, count(*) AS n FROM (SELECT document_id, modality FROM evid
 UNION ALL SELECT document_id, 'vision' FROM charts) GROUP BY ALL""",
    "hyb_parent_expand": I.with_(iq.SECTIONS, iq._windows("sections", "document_id", 48, 12))
    + """, c AS (
  SELECT document_id || '-' || type || '-' || (grp + 1) || '-' || (win + 1) AS chunk_id, length(text) AS parent_n,
    length('Metadata Header: ' || section || chr(10) || array_to_string(part, ' ')) AS own_n FROM windows)
SELECT chunk_id, greatest(parent_n, own_n) AS n, CASE WHEN parent_n > own_n THEN own_n END AS child_n FROM c""",
    "rank_fallback": I.with_(PAIRS)
    + f"SELECT conv_id, turn, modality, {I.rnd('j', 6)} AS jaccard, {_pair_rank('turn / 4::DOUBLE')} AS rank_score FROM jac",
    "rank_topk": I.with_(PAIRS)
    + f""", r AS (SELECT conv_id, turn, modality, {_pair_rank('1')} AS rank_score FROM jac)
SELECT modality, row_number() OVER (PARTITION BY modality ORDER BY rank_score DESC, conv_id, turn) AS rank, conv_id, turn, rank_score
FROM r QUALIFY rank <= 3""",
    "hybrid_retrieve": I.with_(HITS, _fused("nscore DESC, batch, score DESC", "normed", weights="routed"), _reranked(5))
    + """SELECT b.query_id, b.rank, c.document_id, c.document_id || regexp_replace(b.item_id, '^\\d+', '') AS item_id, b.region_idx, b.modality,
  b.score, b.rrf_score, b.rank_score, b.text FROM best b JOIN corpus c USING (doc_pos)""",
    "query_service": I.with_(HITS, _fused("nscore DESC, batch, score DESC", "normed", sql=False), _reranked(10, chart=False))
    + """SELECT b.query_id, b.rank, c.document_id, b.region_idx, b.modality, b.score, b.rank_score
FROM best b JOIN corpus c USING (doc_pos)""",
}
