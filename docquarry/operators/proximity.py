"""Approximate inner-product search over layered neighbour graphs.

Unit vectors are dealt by hash into shards of a bounded number of rows. Within a shard, equal vectors
are one node; each node reaches a random level, and each level links a node with up to ``m`` others (twice
as many on the ground level): of its ``ef_build`` nearest, those that are nearer to the node than to any
link chosen before, plus links that others chose to it. A search enters a shard at its top node, walks
down greedily and then explores the ground level best first, keeping ``ef`` candidates; the shards'
results are merged. Every row is indexed, and nothing but results leaves a shard.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import index as ix
from docquarry.operators import ranking
from docquarry.session import cut_lineage

# Rows of a shard, links of a node per level, candidates of a build and of a search.
SHARD_ROWS, M, EF_BUILD, EF = 20_000, 8, 64, 20
# Queries that meet one copy of a shard, rows of a block of products.
QUERY_BLOCK, PRODUCT_ROWS = 4096, 1024
SEED = 7


def levels(n: int, m: int, rng: np.random.Generator) -> np.ndarray:
    """Random levels, each about ``1 / m`` as frequent as the one below."""
    return np.floor(-np.log(1.0 - rng.random(n)) / math.log(max(m, 2))).astype(int)


def diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> list[int]:
    """Of candidates in falling similarity, those that are nearer to the node than to any chosen before."""
    between = vectors[near] @ vectors[near].T
    kept: list[int] = []
    for i in range(len(near)):
        if len(kept) == most:
            break
        if not kept or sims[i] > between[i, kept].max():
            kept.append(i)
    return [int(near[i]) for i in kept]


def link(vectors: np.ndarray, m: int, ef_build: int) -> list[list[int]]:
    """Links of one level: diverse near neighbours, and back. Products are made in blocks of rows."""
    n = len(vectors)
    most = min(ef_build, n - 1)
    links: list[list[int]] = [[] for _ in range(n)]
    if most < 1:
        return links
    for at in range(0, n, PRODUCT_ROWS):
        sims = vectors[at : at + PRODUCT_ROWS] @ vectors.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -np.inf
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        for i in rows:
            links[at + i] = diverse(near[i], sims[i, near[i]], vectors, m)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, chosen in enumerate(links):
        for j in chosen:
            back[j].append(i)
    for i in range(n):
        both = np.array(sorted({*links[i], *back[i]}), int)
        if len(both) > m:
            sims = vectors[both] @ vectors[i]
            order = np.argsort(-sims, kind="stable")
            picked = diverse(both[order], sims[order], vectors, m)
            # Room that is left goes to the nearest of the rest.
            links[i] = [*picked, *[int(j) for j in both[order] if int(j) not in picked]][:m]
        else:
            links[i] = both.tolist()
    return links


class Graph:
    """One shard: unit vectors of distinct nodes, and links by level."""

    def __init__(self, vectors: np.ndarray, level: np.ndarray, links: list[list[list[int]]]):
        self.vectors, self.level, self.links = vectors, level, links
        self.entry = int(level.argmax()) if len(level) else -1

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, ef_build: int = EF_BUILD, seed: int = SEED) -> Graph:
        level = levels(len(vectors), m, np.random.default_rng(seed))
        links: list[list[list[int]]] = [[] for _ in vectors]
        for at in range(int(level.max(initial=0)) + 1):
            here = np.flatnonzero(level >= at)
            for i, chosen in zip(here, link(vectors[here], 2 * m if at == 0 else m, ef_build)):
                links[i].append(here[chosen].tolist())
        return cls(vectors, level, links)

    def walk(self, query: np.ndarray, ef: int) -> tuple[list[tuple[float, int]], int]:
        """Nodes found as (similarity, node) from the best down, and how many vectors were scored."""
        at, best, scored = self.entry, float(self.vectors[self.entry] @ query), 1
        for level in range(int(self.level[at]), 0, -1):
            while self.links[at][level]:
                near = self.links[at][level]
                sims = self.vectors[near] @ query
                scored += len(near)
                i = int(sims.argmax())
                if sims[i] <= best:
                    break
                at, best = near[i], float(sims[i])
        seen, found, open_ = {at}, [(best, at)], [(-best, at)]
        while open_:
            sim, node = heapq.heappop(open_)
            if len(found) >= ef and -sim < found[0][0]:
                break
            fresh = [j for j in self.links[node][0] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            scored += len(fresh)
            for s, j in zip((self.vectors[fresh] @ query).tolist(), fresh):
                if len(found) < ef or s > found[0][0]:
                    heapq.heappush(open_, (-s, j))
                    heapq.heappush(found, (s, j))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted(found, key=lambda x: (-x[0], x[1])), scored


def _dealt(vectors: DataFrame, id_col: str, vector: str, shard_rows: int) -> DataFrame:
    """``dims, shard, id, v``: unit vectors dealt into shards; rows without a usable vector are left out."""
    entries = ix.as_doubles(F.col(vector))
    usable = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    good = vectors.filter(F.coalesce((F.size(vector) > 0) & usable, F.lit(False)))
    unit = good.select(F.col(id_col).alias("id"), ix.l2_normalized(entries).alias("v"))
    shards = max(1, math.ceil(good.count() / shard_rows))
    return unit.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("id", "v"), shards).cast("int").alias("shard"), "id", "v")


def build_graph(
    vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, m: int = M, ef_build: int = EF_BUILD,
) -> None:
    """Write the graphs of all shards to ``path``: one row per node, with the ids of its equal vectors.

    A shard has about ``shard_rows`` rows, a bound for the memory of a task and for the products behind
    its links. Null, empty or non-finite vectors are left out; vectors of other lengths have shards of their own.
    """

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        width = rows["dims"][0].as_py()
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        distinct, of = np.unique(v, axis=0, return_inverse=True)
        ids = rows["id"].combine_chunks()
        order = np.lexsort((pa.compute.rank(ids).to_numpy(), of.ravel()))
        bounds = np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1))
        graph = Graph.build(distinct, m, ef_build)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.take(pa.array(order)))
        flat = pa.ListArray.from_arrays(pa.array(range(0, distinct.size + 1, width), pa.int32()), pa.array(distinct.ravel()))
        n = len(distinct)
        links = pa.array(graph.links, pa.list_(pa.list_(pa.int32())))
        return pa.table({
            "dims": pa.array([width] * n, pa.int32()), "shard": pa.array([rows["shard"][0].as_py()] * n, pa.int32()), "node": pa.array(range(n), pa.int32()),
            "level": pa.array(graph.level, pa.int32()), "ids": lists, "v": flat, "links": links})

    dealt = _dealt(vectors, id_col, vector, shard_rows)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"dims int, shard int, node int, level int, ids array<{kind}>, v array<double>, links array<array<int>>"
    dealt.groupBy("dims", "shard").applyInArrow(shard, schema).write.mode("overwrite").parquet(path)


def search_graph(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, ef: int = EF, id_col: str = "vec_id") -> DataFrame:
    """About the best ``k`` rows of the index per query (``query_id, qv``): ``query_id, id_col, score, rank, scored``.

    ``score`` is the inner product with the unit vector, four digits; ties go by id. ``scored`` counts the
    vectors that the query was multiplied with in all shards. Every shard is walked for every query of
    its length, a block of queries at a time.
    """
    graph = spark.read.parquet(path)
    asked = cut_lineage(queries.select("query_id", ix.as_doubles(F.col("qv")).alias("qv")).filter(F.size("qv") > 0))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), blocks).cast("int")
    shards = spark.read.parquet(path).select("dims", "shard").distinct()
    asked = asked.select(F.size("qv").alias("dims"), block.alias("block"), "query_id", "qv").join(shards, "dims")
    key = ["dims", "shard", "block"]
    copies = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def walk(nodes: pa.Table, block_queries: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "id", "raw", "scored"], [block_queries.schema.field("query_id").type, nodes.schema.field("ids").type.value_type]
        rows: list[list] = [[], [], [], []]
        if nodes.num_rows and block_queries.num_rows:
            nodes = nodes.sort_by("node").combine_chunks()
            width = nodes["dims"][0].as_py()
            v = nodes["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            shard, ids = Graph(v, nodes["level"].to_numpy(), nodes["links"].to_pylist()), nodes["ids"]
            q = block_queries["qv"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            for name, vector in zip(block_queries["query_id"].to_pylist(), q):
                found, scored = shard.walk(vector, max(ef, k))
                for sim, node in found:
                    for i in ids[node].as_py()[:k]:
                        for column, value in zip(rows, (name, i, sim, scored)):
                            column.append(value)
                        scored = 0  # counted once
        return pa.table([pa.array(c, t) for c, t in zip(rows, [*kinds, pa.float64(), pa.int64()])], names=names)

    query_kind = queries.schema["query_id"].dataType.simpleString()
    kind = graph.schema["ids"].dataType.elementType.simpleString()
    pairs = copies.groupBy(*key).cogroup(asked.groupBy(*key))
    found = cut_lineage(pairs.applyInArrow(walk, f"query_id {query_kind}, id {kind}, raw double, scored long"))
    totals = found.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    hits = found.select("query_id", F.col("id").alias(id_col), tx.pyround(F.col("raw"), 4).alias("score"))
    best = ranking.top_k(hits, ["query_id"], [F.col("score").desc(), F.col(id_col).asc()], k)
    return best.join(totals, "query_id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: share of the exact search's rows that ``found`` matches in score, rank by rank or better.

    Rows of equal score are worth the same, so copies of a vector may stand for each other.
    """
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(least, "query_id", "right").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("least")).alias("good"), F.max("n").alias("n"))
    return good.select("query_id", (F.least("good", "n") / F.col("n")).alias("recall"))
