"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c or more are at most 2 (1 - c) apart in squared distance. Vectors are rotated
by a seeded orthogonal matrix and split into blocks of few dimensions; each block gets the share of
that distance that its dimensions are of all. If every block were above its share the sum would be
above the whole, so a near pair is within the share of at least one block. Each block is joined by
range over a grid, and the union of what is found is verified by the exact cosine. A pair is counted
in the first block that finds it, so no pair list is shuffled to remove repeats.

Where the cells of the grids hold so many rows that their comparison costs more than that of all
pairs, the whole vector is the one block and all its rows are the one cell. Either way tiles of rows
meet in passes of bounded size, each of which frees its shuffle files before the next.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import freed_shuffles, key_runs, saved
from docquarry.llm.graph import components
from docquarry.operators.joins import bounded
from docquarry.session import checkpoint_folder

BLOCK_DIMS = 8
SEED = 17
# Rows of a cell's tile; larger cells are compared tile by tile, each pair of tiles a group of its own.
TILE = 16_384
# Width of a grid cell in radii: wider cells repeat fewer rows and compare more.
CELL_RADII = 3.0
# A rounding error below this keeps no pair from its blocks; the exact check decides.
SLACK = 1e-9
# Rows compared at once, and the margin of single precision.
ROWS, COLUMNS, COARSE = 128, 2048, 1e-5
# What a moved row and a compared pair cost beside its coordinates, in compared coordinates.
ROW_COST, PAIR_COST = 150_000, 16
# Tiles of a table that is one cell, so that it has pairs of tiles for many tasks, and rows below which there are fewer.
WHOLE_TILES, WHOLE_ROWS = 8, 1024
# Rows that a pass moves: so many times the rows of the table, or so many at least.
PASS_TIMES, PASS_ROWS = 2, 1 << 19
# Spreads cell numbers over slices alike in Python and in Spark.
PRIME = 1_000_003


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, block_dims: int = BLOCK_DIMS) -> list[int]:
    """Where each block of about equal width begins, and the end."""
    n = math.ceil(dim / block_dims)
    return [round(i * dim / n) for i in range(n + 1)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Double-precision unit vectors, scaled first so that no square overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotated(units: np.ndarray) -> np.ndarray:
    """Rotated vectors; each row's value does not depend on the rows beside it."""
    return np.einsum("ij,kj->ik", units, rotation(units.shape[1]))


def is_valid(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(points: np.ndarray, radius: float, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell number and whether it is the row's own cell, for each cell that a row has to be in.

    A row is in its own cell and in those of the cells its radius reaches that come later in order:
    two rows within the radius then meet in just one cell, the later of their own.
    """
    side = int(2 ** (62 / coords))  # cells of a coordinate that a 64-bit number has room for
    width = max(CELL_RADII * radius, 4 / side)
    x, reach = points[:, :coords] / width, radius / width + SLACK
    own = np.floor(x).astype(np.int64)
    low, high = np.floor(x - reach).astype(np.int64), np.floor(x + reach).astype(np.int64)
    rows, offsets, order = np.arange(len(x)), np.zeros((len(x), 0), np.int64), np.zeros(len(x), np.int64)
    for c in range(coords):  # order: sign of the first coordinate that differs from the own cell's
        parts = []
        for delta in (-1, 0, 1):
            at = own[rows, c] + delta
            keep = (at >= low[rows, c]) & (at <= high[rows, c])
            sign = np.where(order == 0, delta, order)
            keep &= sign >= 0
            parts.append((rows[keep], np.column_stack([offsets[keep], np.full(keep.sum(), delta)]), sign[keep]))
        rows, offsets, order = (np.concatenate([p[i] for p in parts]) for i in range(3))
    cell = np.zeros(len(rows), np.int64)
    for c in range(coords):
        cell = cell * side + own[rows, c] + offsets[:, c] + side // 2
    return rows, cell, order == 0


def _found(mine: np.ndarray, others: np.ndarray, block: int, budget: np.ndarray, bounds: list[int], threshold: float, own: np.ndarray, theirs: np.ndarray, same: bool):
    """Verified near pairs of ``mine`` and ``others`` that this block is the first to find, some rows at a time."""
    lo, hi = bounds[block], bounds[block + 1]
    a, b = mine[:, lo:hi], others[:, lo:hi]
    # 2 a.b - b.b in one product; a coarse sieve in single precision, whose error the margin covers
    margin = COARSE * max(1.0, (hi - lo) / 16)
    floor = (np.einsum("ij,ij->i", a, a) - budget[block] - margin).astype(np.float32)[:, None]
    left = np.column_stack([a, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([2 * b, -np.einsum("ij,ij->i", b, b)]).astype(np.float32).T
    for at, to in ((r, c) for r in range(0, len(a), ROWS) for c in range(0, len(b), COLUMNS)):
        if same and to + COLUMNS <= at:
            continue
        near = left[at : at + ROWS] @ right[:, to : to + COLUMNS] >= floor[at : at + ROWS]
        if not near.any():
            continue
        i, j = np.nonzero(near)
        i, j = i + at, j + to
        if same:
            i, j = i[j > i], j[j > i]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            away = np.add.reduceat((mine[p] - others[q]) ** 2, bounds[:-1], axis=1) <= budget
            first = away[:, block] & ~away[:, :block].any(axis=1)
            p, q = p[first], q[first]
            close = np.einsum("ij,ij->i", own[p], theirs[q]) >= threshold
            yield p[close], q[close]


class _Forest:
    """Labels of the rows of a group, merged along links; remembers the links that merged."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else []
        for row, ends in zip(p[starts].tolist(), np.split(q, starts[1:]) if len(p) else []):
            other = self.label[ends] != self.label[row]
            if other.any():
                found, at = np.unique(self.label[ends[other]], return_index=True)
                self.links.extend((row, int(x)) for x in ends[other][at])
                self.label[np.isin(self.label, found)] = self.label[row]


def _passes(sizes: DataFrame, limit: int) -> list[tuple[dict[int, tuple[int, int]], int, int]]:
    """What each pass joins, so that it moves about ``limit`` rows of tiles: ``{block: (slices, slice)}, times, time``.

    Blocks whose cells have more rows are cut into slices of cells, and slices whose tiles still repeat
    more rows are gone through ``times`` times, for other pairs of tiles each time. Small blocks share a pass.
    """
    rows = sizes.groupBy("block").agg(F.sum("rows").alias("rows")).collect()  # one row per block of dimensions
    if not rows:
        return []
    slices = [1] * (max(r["block"] for r in rows) + 1)
    for r in rows:
        slices[r["block"]] = math.ceil(r["rows"] / limit)
    cut = F.get(F.array(*[F.lit(n) for n in slices]), F.col("block"))
    parts = sizes.groupBy("block", F.pmod(F.col("cell") % PRIME, cut).cast("int").alias("slice")).agg(F.sum(F.col("rows") * F.col("tiles")).alias("moved"))
    out, some, held = [], {}, 0
    for block, part, moved in sorted(tuple(r) for r in parts.collect()):
        if slices[block] > 1 or moved > limit:
            times = math.ceil(moved / limit)
            out.extend(({block: (slices[block], part)}, times, time) for time in range(times))
            continue
        if some and held + moved > limit:
            out.append((some, 1, 0))
            some, held = {}, 0
        some, held = some | {block: (1, 0)}, held + moved
    return [*out, (some, 1, 0)] if some else out


def near_links(classes: DataFrame, threshold: float, tile: int = TILE, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """Links between distinct vectors ``node, n, vector``: rows ``node, other, links``, written pass by pass.

    Rows with ``other`` are enough links to connect all near pairs; the others add ``n`` of the
    vectors that ``node`` is linked with to its count.
    """
    spark = classes.sparkSession
    total = classes.count()
    coords = max(1, min(block_dims, math.ceil(math.log(max(total, 1) / tile + 1, 2.2))))
    reach = 2 * (1 - threshold)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def deal(batches: Iterator[pa.RecordBatch], picked: dict[int, tuple[int, int]] | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch["vector"]).to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                units = unit(part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                bounds = block_bounds(dim, block_dims)
                for block, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    if picked is not None and block not in picked:
                        continue
                    x = np.einsum("ij,kj->ik", units, rotation(dim)[lo:hi])
                    rows, cell, own = _cells(x, math.sqrt((reach + SLACK) * (hi - lo) / dim), min(coords, hi - lo))
                    slices, at = picked[block] if picked is not None else (1, 0)
                    if slices > 1:
                        mine = cell % PRIME % slices == at
                        rows, cell, own = rows[mine], cell[mine], own[mine]
                    whole, n = part.take(pa.array(rows)), len(rows)
                    for at in range(0, n, 10_000):
                        some = whole.slice(at, 10_000)
                        size = some.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, dim, np.int32)), pa.array(np.full(size, block, np.int32)), pa.array(cell[at : at + size]),
                             pa.array(own[at : at + size]), some["node"], some["n"], some["vector"]],
                            ["dim", "block", "cell", "own", "node", "n", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    cell = ["dim", "block", "cell"]
    narrow = classes.mapInArrow(lambda it: (b.select([*cell, "own"]) for b in deal(it)), "dim int, block int, cell long, own boolean")
    sizes = narrow.groupBy(*cell).agg(F.count("*").alias("rows"), F.count_if("own").alias("homes")).filter("rows > 1 AND homes > 0")
    sizes = saved(sizes.withColumn("tiles", F.ceil(F.col("rows") / tile).cast("int")))
    one = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("rows")).filter("rows > 1")
    tiles = F.greatest(F.ceil(F.col("rows") / tile), F.least(F.lit(WHOLE_TILES), F.ceil(F.col("rows") / WHOLE_ROWS))).cast("int")
    one = saved(one.select("dim", F.lit(0).alias("block"), F.lit(0).cast("long").alias("cell"), "rows", F.col("rows").alias("homes"), tiles.alias("tiles")))

    def cost(table: DataFrame, width) -> float:
        pairs = F.col("homes").cast("double") * (F.col("rows") - F.col("homes") / 2)
        moved = F.col("rows").cast("double") * F.col("tiles")
        return table.agg(F.sum(pairs * (width + F.lit(PAIR_COST)) + moved * ROW_COST)).first()[0] or 0.0

    whole_rows = cost(one, F.col("dim")) < cost(sizes, F.lit(block_dims))

    def budgets(dim: int) -> tuple[list[int], np.ndarray]:
        bounds = block_bounds(dim, dim if whole_rows else block_dims)
        return bounds, (reach + SLACK) * np.diff(bounds) / dim

    def dealt(picked: dict[int, tuple[int, int]]) -> DataFrame:
        if whole_rows:
            return classes.select(F.size("vector").alias("dim"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("own"), "node", "n", "vector")
        return classes.mapInArrow(lambda it: deal(it, picked), f"dim int, block int, cell long, own boolean, node long, n long, vector {kind}")

    sizes = one if whole_rows else sizes
    meet = F.expr("transform(sequence(0, tiles - 1), i -> struct(least(i, tile) AS a, greatest(i, tile) AS b))")
    group = [*cell, "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, group):
            keys = [whole[c].to_numpy() for c in group]
            new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            at = [*np.flatnonzero(new).tolist(), whole.num_rows]
            home, tiles, node, n = (whole[c].to_numpy() for c in ("own", "tile", "node", "n"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            vectors = whole["vector"].combine_chunks()
            for i, j in zip(at, at[1:]):
                if j - i < 2 or not home[i:j].any():
                    continue
                dim, block, a, b = (int(keys[k][i]) for k in (0, 1, 3, 4))
                units = unit(vectors[i:j].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                turned, (bounds, budget) = rotated(units), budgets(dim)
                own, tile_of = home[i:j], tiles[i:j]
                forest, links = _Forest(j - i), np.zeros(j - i, np.int64)
                left, right = tile_of == a, tile_of == b
                # two rows meet where one of them at least is at home
                pairs = [(left & own, None), (left & own, left & ~own)] if a == b else [(left & own, right), (left & ~own, right & own)]
                for first, second in pairs:
                    p_at = np.flatnonzero(first)
                    q_at = p_at if second is None else np.flatnonzero(second)
                    if not len(p_at) or not len(q_at):
                        continue
                    for p, q in _found(turned[p_at], turned[q_at], block, budget, bounds, threshold, units[p_at], units[q_at], second is None):
                        p, q = p_at[p], q_at[q]
                        links += np.bincount(p, n[i:j][q], j - i).astype(np.int64) + np.bincount(q, n[i:j][p], j - i).astype(np.int64)
                        forest.add(p, q)
                seen = np.flatnonzero(links)
                out.append((node[i:j][seen], np.full(len(seen), -1), links[seen]))
                if forest.links:
                    p, q = np.array(forest.links).T
                    out.append((node[i:j][p], node[i:j][q], np.zeros(len(p), np.int64)))
            if out:
                a, b, c = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(c)], ["node", "other", "links"])

    schema = "node long, other long, links long"
    path = f"{checkpoint_folder(spark)}/links-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for picked, times, time in _passes(sizes, max(PASS_TIMES * total, PASS_ROWS)):
        held = sizes.filter(F.col("block").isin(list(picked))).select(*cell, "tiles")
        rows = dealt(picked).join(bounded(held), cell).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        rows = rows.select(*cell, "own", "node", "n", "vector", "tile", F.inline(meet))
        if times > 1:
            rows = rows.filter(F.pmod(F.xxhash64(*group), F.lit(times)) == time)
        rows = rows.repartition(*group).sortWithinPartitions(*group)
        with freed_shuffles(spark):
            rows.mapInArrow(compare, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id", tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: other rows of cosine ``threshold`` or more, and the smallest id reachable.

    Equal vectors are compared once and counted as often as they occur. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing, as do vectors of unequal length.
    Rows without an id are linked and counted, but name no component unless alone in it (null) and
    are not kept. An empty table gives no rows.
    """
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    hashes = [F.xxhash64("vector"), F.xxhash64(F.lit(SEED), "vector")]
    rows = rows.withColumn("valid", is_valid(F.col("vector"))).select("*", *[F.when(F.col("valid"), h).alias(f"h{i}") for i, h in enumerate(hashes)])
    grouped = rows.filter("valid").groupBy("h0", "h1").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("vector").alias("vector"))
    classes = saved(grouped.withColumn("node", F.monotonically_increasing_id()))
    found = near_links(classes.select("node", "n", "vector"), threshold, tile)
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL"), "node", "other").withColumnRenamed("component", "root")
    named = classes.select("node", "h0", "h1", "n", "first").join(roots, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "valid", "h0", "h1").join(named, ["h0", "h1"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
