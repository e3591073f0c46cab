"""BM25 tokens and weights, exact dense search, hash embeddings and index records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import ranking
from docquarry.session import cut_lineage

BM25_K1, BM25_B = 1.5, 0.75
MIN_TOKEN = 2

# The English stopwords left out of the sparse index.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()

# Encoder model per domain.
DOMAIN_MODELS = {
    "general": "sentence-transformers/all-MiniLM-L6-v2",
    "biomedical": "pritamdeka/S-PubMedBert-MS-MARCO",
    "medical": "pritamdeka/S-PubMedBert-MS-MARCO",
    "legal": "law-ai/InLegalBERT",
    "financial": "ProsusAI/finbert",
    "finance": "ProsusAI/finbert",
    "code": "flax-sentence-embeddings/st-codesearch-distilroberta-base",
    "technical": "flax-sentence-embeddings/st-codesearch-distilroberta-base",
    "multilingual": "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2",
}


def domain_model(domain: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DOMAIN_MODELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(domain)), F.lit(DOMAIN_MODELS["general"]))


def index_tokens(text: Column) -> Column:
    """Lower-cased words of two characters and more that are no stopwords."""
    return F.filter(tx.word_tokens(text, MIN_TOKEN), lambda t: ~t.isin(STOPWORDS))


def tokenised(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Units with their index tokens and length ``dl``."""
    out = units.select(*keys, index_tokens(F.col(text)).alias("tokens"))
    return out.withColumn("dl", F.size("tokens"))


def postings(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dl, term, tf``. Counting combines within each map task, where a unit's tokens all are."""
    rows = unnest(tokens, [*keys, "dl"], F.col("tokens"), "term").drop("_pos")
    return rows.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def collection_stats(tokens: DataFrame, groups: list[str]) -> DataFrame:
    """Unit count and mean length per index, empty units included."""
    return tokens.groupBy(*groups).agg(F.count("*").alias("n_units"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, query`` to ``query_id, term, qtf``."""
    rows = unnest(queries, ["query_id"], index_tokens(F.col("query")), "term").drop("_pos")
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def idf(n_units: Column, df: Column) -> Column:
    return F.log((n_units - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_part(tf: Column, dl: Column, avgdl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return tf * F.lit(k1 + 1.0) / (tf + norm)


# --- dense ---------------------------------------------------------------------------------------


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalized(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


# Query vectors scored together against one row, and rows of a tile that meets a block of them in one task.
QUERY_BLOCK, TILE_ROWS, QUERY_SLICE = 4096, 1 << 13, 64


def _met(vectors: DataFrame, asked: DataFrame, id_col: str, vector: str, block: int, tile_rows: int, n_rows: int, n_asked: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with the keys of the blocks and tiles in which they meet: every pair meets once."""
    n_blocks, n_tiles = max(1, -(-n_asked // block)), max(1, -(-n_rows // tile_rows))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    tile = F.pmod(F.xxhash64(id_col, vector), F.lit(n_tiles)).cast("bigint").alias("_tile")
    rows = vectors.select(F.col(id_col).alias("_id"), tile, as_doubles(F.col(vector)).alias("_v"), each(n_blocks).alias("_block"))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("bigint"))
    return rows, asked.withColumn("_tile", each(n_tiles))


def _all_scores(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, _id, score`` of all pairs that meet, by expressions; vectors may be of any kind."""
    packed = asked.groupBy("_block", "_tile").agg(F.collect_list(F.struct("query_id", "qv")).alias("_q"))
    scores = F.transform("_q", lambda q: F.struct(q["query_id"].alias("query_id"), tx.pyround(dot(q["qv"], F.col("_v")), 4).alias("score")))
    return rows.join(packed, ["_block", "_tile"]).select("_id", F.inline(scores)).select("query_id", "_id", "score")


def _best_scores(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, _id, score`` of the best ``k`` rows of each tile per query, for finite vectors of one length.

    A product of matrices picks the rows that can be among them, copies and ties included; only those
    are summed entry by entry, as ``dot`` does, and rounded.
    """

    def best(tile: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = [queries.schema.field("query_id").type, tile.schema.field("_id").type, pa.float64()]
        names = ["query_id", "_id", "score"]
        if not tile.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        # rows in order of their ids, so that a stable sort by score leaves ties in that order
        ids = tile["_id"].combine_chunks()
        order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start")
        ids, v = ids.take(order), tile["_v"].combine_chunks().flatten().to_numpy().reshape(tile.num_rows, -1)[order.to_numpy()]
        q = queries["qv"].combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
        longest = np.sqrt((v * v).sum(axis=1).max())
        at_q, at_v, scores = [], [], []
        for start in range(0, len(q), QUERY_SLICE):
            some = q[start : start + QUERY_SLICE]
            raw = some @ v.T
            least = np.partition(raw, len(v) - k, axis=1)[:, len(v) - k] if 0 < k < len(v) else np.full(len(some), -np.inf)
            slack = 2e-4 + 1e-9 * longest * np.sqrt((some * some).sum(axis=1))
            i, j = np.nonzero(raw >= (least - slack)[:, None])
            exact = np.zeros(len(i))
            for d in range(v.shape[1]):
                exact += some[i, d] * v[j, d]
            exact = np.rint(exact * 10000.0) / 10000.0
            ranked = np.lexsort((j, -exact, i))
            i, j, exact = i[ranked], j[ranked], exact[ranked]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < (k if k > 0 else len(v))
            at_q.append(start + i[kept])
            at_v.append(j[kept])
            scores.append(exact[kept])
        found = [queries["query_id"].combine_chunks().take(pa.array(np.concatenate(at_q))), ids.take(pa.array(np.concatenate(at_v))), pa.array(np.concatenate(scores))]
        return pa.table([f.cast(t) for f, t in zip(found, kinds)], names=names)

    kinds = ", ".join(f"{n} {t}" for n, t in (("query_id", dict(asked.dtypes)["query_id"]), ("_id", dict(rows.dtypes)["_id"]), ("score", "double")))
    keys = ["_block", "_tile"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, kinds)


def dense_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact inner-product search for any number of query vectors (``query_id, qv``).

    Queries are dealt into blocks of about ``block`` and rows into tiles of about ``TILE_ROWS``; a block
    meets a tile as one key, so neither many rows nor many queries gather in a task. Finite vectors of
    the greatest length meet as matrices, and each task passes on ``k`` rows per query; pairs with any
    other vector are scored by expressions.
    """

    def plain(column: str) -> Column:
        finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100))
        return F.coalesce((F.size(column) == dims) & finite, F.lit(False))

    asked = cut_lineage(queries.select("query_id", as_doubles(F.col("qv")).alias("qv")))
    dims = max(asked.agg(F.max(F.size("qv"))).first()[0] or 0, 1)
    n_asked, odd_asked = asked.agg(F.count("*"), F.count_if(~plain("qv"))).first()
    rows = vectors.withColumn(vector, as_doubles(F.col(vector)))
    n_rows, odd_rows = rows.agg(F.count("*"), F.count_if(~plain(vector))).first()
    met = _met(rows.filter(plain(vector)), asked.filter(plain("qv")), id_col, vector, block, TILE_ROWS, n_rows - odd_rows, n_asked - odd_asked)
    found = _best_scores(*met, k)
    if odd_rows:
        found = found.unionByName(_all_scores(*_met(rows.filter(~plain(vector)), asked, id_col, vector, QUERY_SLICE, TILE_ROWS, odd_rows, n_asked)))
    if odd_asked:
        found = found.unionByName(_all_scores(*_met(rows.filter(plain(vector)), asked.filter(~plain("qv")), id_col, vector, QUERY_SLICE, TILE_ROWS, n_rows, odd_asked)))
    return ranking.top_k(found.withColumnRenamed("_id", id_col), ["query_id"], [F.col("score").desc(), F.col(id_col).asc()], k)


def label_centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Unit mean vector per label. Means combine per (label, dimension) before the shuffle."""
    dims = unnest(vectors, [label], as_doubles(F.col(vector)), "x", "dim")
    means = dims.groupBy(label, "dim").agg(F.avg("x").alias("x"))
    # One entry per dimension of the vector, so each group is as wide as one vector.
    packed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_d"))
    return packed.select(label, l2_normalized(F.transform("_d", lambda d: d["x"])).alias("centroid"))


def hash_vector(text: Column) -> Column:
    """One weight per distinct lower-cased token in order; lengths differ, so it is no metric space."""
    return F.transform(
        F.array_sort(F.array_distinct(tx.words(F.lower(text)))),
        lambda t: tx.pyround(
            F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("double") / F.lit(16777215.0), 4
        ),
    )


def encode_records(regions: DataFrame) -> DataFrame:
    """Index records per path with corpus-wide running numbers.

    Text takes titles and bodies, table prefers its Markdown, vision its caption, then its text, then
    the document's title; ``table_markdown``, ``caption`` and ``doc_title`` are optional columns. The
    running number is an exact distributed rank.
    """
    kind = F.col("type")
    columns = regions.columns

    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in columns else F.lit(None).cast("string")

    named = F.concat(F.lit("Figure from "), F.coalesce(optional("doc_title"), F.lit("")))
    text = (
        F.when(kind == "table", F.coalesce(optional("table_markdown"), F.col("text"), F.lit("")))
        .when(kind == "figure", F.coalesce(optional("caption"), F.nullif(F.col("text"), F.lit("")), named))
        .otherwise(F.col("text"))
    )
    base = regions.filter(kind.isin("title", "body", "table", "figure")).select(
        "doc_pos", "region_idx", "document_id", "type", "modality", text.alias("text")
    )
    numbered = ranking.exact_rank(base, ["modality"], [], out="_n")
    return numbered.select(
        F.concat_ws("-", "document_id", "type", (F.col("_n") - 1).cast("string")).alias("id"),
        "document_id",
        F.col("type").alias("region_type"),
        "modality",
        "text",
        hash_vector(F.col("text")).alias("vector"),
    )
