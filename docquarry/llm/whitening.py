"""Whiten embeddings by their principal components.

Entries become integers, their sums are exact, and every row is centred before anything is multiplied.
The centred scatter (dimensions squared, whatever the number of rows) is factored by a Cholesky
decomposition that takes the largest remaining diagonal first. One-sided Jacobi rotations then make the
columns of the triangular factor orthogonal: their squared norms are the eigenvalues, the columns over
their norms the components.

Rows that count: vectors without a null or non-finite entry, of the length that most such vectors have
(ties: the longer one); all other rows, empty vectors among them, are left out. Keys may be null or
repeated, each row is answered. Entries are held within 2**53 after scaling. A component whose variance
is zero to working precision cannot be whitened and is left out, so equal vectors, or a single one, give
no rows. Columns beside the key and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import saved

SCALE, SHIFT, HELD = 1024.0, 100_000, 2.0**53
COMPONENTS = 8
# Entries of a slice of an Arrow batch that is worked on at once.
SLICE = 1 << 20
LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit found: row count, sums by dimension, trace, and components as columns with their variances."""

    n: int
    sums: tuple[int, ...]
    trace: float
    components: np.ndarray
    variances: np.ndarray


def finite(vector: Column) -> Column:
    """Vectors with at least one entry and without null, NaN or infinite ones."""
    inf = F.lit(math.inf)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)), F.lit(False))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches whose vectors have one length, with the scaled integers as a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = len(batch["vector"][0])
        step = max(1, SLICE // width)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            entries = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.clip(np.floor(SCALE * entries), -HELD, HELD).astype(np.int64) + SHIFT
            yield part, x.reshape(-1, width)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pos, n, total`` of each slice."""
    for _, x in _slices(batches):
        small = np.abs(x).max() < 2**62 // len(x)
        sums = (x if small else x.astype(object)).sum(axis=0).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([len(x)] * len(sums), pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))],
            ["pos", "n", "total"])


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums``, exact: of 64 bits where that holds it, else of Python integers."""
    if int(np.abs(x).max()) * n + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if d.dtype != object and int(np.abs(d).max()) < math.isqrt(LONG // d.shape[1]):
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def _centred(d: np.ndarray, n: int) -> np.ndarray:
    return (d / n).astype(float)


def scatter_rows(vectors: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of the outer product of the centred row with itself.

    Each task adds up its own rows and passes on one matrix; the matrices are added entry by entry on Spark.
    """
    width = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((width, width))
        for _, x in _slices(batches):
            y = _centred(_deviations(x, n, sums), n)
            scatter += y.T @ y
        lines = pa.FixedSizeListArray.from_arrays(pa.array(scatter.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), lines], ["i", "line"])

    parts = vectors.mapInArrow(partial, "i int, line array<double>")
    summed = parts.select("i", F.posexplode("line").alias("j", "v")).filter("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    scatter = np.zeros((width, width))
    for i, j, v in summed.collect():  # dimensions squared
        scatter[i, j] = scatter[j, i] = v
    return scatter


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Lower-trapezoidal factor (rows in the order of ``a``) with ``factor @ factor.T == a``, largest diagonals first.

    It has as many columns as ``a`` has rank to working precision.
    """
    rest, size = np.array(a, float), len(a)
    least = size * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(size):
        k = int(rest.diagonal().argmax())
        if rest[k, k] <= least:
            break
        column = rest[:, k] / math.sqrt(rest[k, k])
        rest -= np.outer(column, column)
        rest[k, :] = rest[:, k] = 0.0
        columns.append(column)
    return np.column_stack(columns) if columns else np.zeros((size, 0))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal unit columns and squared norms of ``factor`` rotated from the right, by falling norm.

    A round rotates disjoint pairs of columns; the rounds of a sweep meet every pair once.
    """
    g = np.array(factor, float)
    m = g.shape[1]
    order = np.arange(m + m % 2)  # an odd column sits out in turn
    small = np.finfo(float).eps * math.sqrt(max(len(g), 1))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (p < m) & (q < m)
            p, q = p[real], q[real]
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, off.max(initial=0.0))
            turn = off > small
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a, b = a[:, turn], b[:, turn]
            g[:, p[turn]], g[:, q[turn]] = c * a - c * t * b, c * t * a + c * b
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if worst <= small:
            break
    norms = (g * g).sum(0)
    ranks = np.argsort(-norms, kind="stable")
    return g[:, ranks] / np.sqrt(norms[ranks]), norms[ranks]


def usable(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """``key, vector, width`` of the rows with finite vectors."""
    return rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(finite(F.col("vector"))).withColumn("width", F.size("vector"))


def fit(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> Whitening:
    """Learn the whitening from all usable rows; driver memory grows with the dimensions squared only."""
    good = usable(rows, vector, key)
    widths = good.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return Whitening(0, (), 0.0, np.zeros((0, 0)), np.zeros(0))
    vectors = good.filter(F.col("width") == widths["width"]).select("vector")
    totals = vectors.mapInArrow(_totals, "pos int, n long, total decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums = {r["pos"]: r for r in totals.collect()}  # one row per dimension
    n, sums = sums[0]["n"], tuple(int(sums[i]["total"]) for i in range(len(sums)))
    covariance = scatter_rows(vectors, n, sums) / n
    axes, variances = jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, float(covariance.trace()), axes[:, :components], variances[:components])


def whiten(rows: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, deviation, deviation_exact, whitened`` (array by component) of the rows that the fit used.

    ``deviation_exact`` is the decimal text of the exact sum; ``deviation`` is null where it does not fit a long.
    """
    n, sums = model.n, model.sums
    project = model.components / np.sqrt(model.variances)

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches):
            d = _deviations(x, n, sums)
            squares = _squares(d)
            white = np.ascontiguousarray(_centred(d, n) @ project)
            lists = pa.ListArray.from_arrays(pa.array(range(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part["key"], pa.array([v if v <= LONG else None for v in squares], pa.int64()), pa.array(map(str, squares), pa.string()), lists],
                ["key", "deviation", "deviation_exact", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation long, deviation_exact string, whitened array<double>"
    if not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    good = usable(rows, vector, key).filter(F.col("width") == len(sums)).select("key", "vector")
    return good.mapInArrow(project_rows, schema)


def identity_error(white: DataFrame, size: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over all rows."""
    if not size:
        return 0.0
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    mean = [F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(size)]
    means = white.agg(*mean).first()
    if means["m0"] is None:
        return 0.0
    at = [F.col("whitened")[i] - F.lit(means[f"m{i}"]) for i in range(size)]
    found = white.agg(*[F.avg(at[i] * at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_components(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling variance.

    ``key, component, n, deviation, whitened, explained, identity_error, deviation_exact``; whitened rows
    are written once, before their covariance is held against the identity.
    """
    model = fit(rows, components, vector, key)
    white = saved(whiten(rows, model, vector, key))
    error = identity_error(white, len(model.variances))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.variances]).cast("array<double>")
    return white.select("key", "deviation", "deviation_exact", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("key").alias(key), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
