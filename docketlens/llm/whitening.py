"""Whitening of embeddings: principal components by FEAST contour integration.

Vectors are put on an integer grid, so that counts, sums and deviations are exact
and equal vectors are equal bytes.  The components are fitted on the distinct grid
vectors: tasks add up counts, sums and centred products, and only the d x d
covariance reaches the driver.

FEAST then finds the largest eigenvalues: a circle is laid around an interval of
the eigenvalue axis, the resolvent is integrated along it by Gauss-Legendre
quadrature (each node is a complex shifted solve and runs as a task of its own),
which projects a random block onto the eigenvectors inside, and Rayleigh-Ritz
extracts them.  The numbers of eigenvalues below both ends follow from the inertia
of shifted covariances (Sylvester's law); an interval counts as solved only when
it holds as many components, else it is solved again with a larger block.

Defined cases: rows whose vector is null or holds null, non-finite or too large
entries (beyond a long on the grid) are dropped, as are rows of another length than the
commonest (ties: the longest); empty vectors have no components.  Null and repeated
ids are kept.  Components whose eigenvalue is no more than rounding (1e-13 of the
trace) are left out, so equal vectors give no rows; so does an empty table.
Components of equal eigenvalues are any orthonormal basis of their space, the same
for all rows.  A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Grid steps per unit.
GRID = 256
#: Eigenvalues below this share of the trace are rounding.
NOISE = 1e-13
#: Quadrature nodes on the upper half of a circle.
NODES = 8
#: Intervals with more eigenvalues are split where they can be.
CROWD = 16
_LONG = 1 << 63
_DRAW = 20_250_311


# -- the grid ---------------------------------------------------------------

def grid_vectors(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, grid vectors) of the valid rows, one entry for each length."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy()
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * GRID)
    begins = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = []
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat[begins[rows][:, None] + np.arange(size)]
        good = (np.abs(values) < float(_LONG)).all(axis=1)  # false for nan as well
        out.append((rows[good], values[good].astype(np.int64)))
    return out


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integer width that holds it; equal rows are equal bytes."""
    top = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    widths = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    out = [b""] * len(x)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        for i, part in zip(rows.tolist(), x[rows].astype(f"<i{w}"), strict=True):
            out[i] = bytes((w,)) + part.tobytes()
    return out


def from_bytes(cells: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(cells), dims), np.int64)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, f"<i{cell[0]}", offset=1)
    return out


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dims, x): the distinct grid vectors."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in grid_vectors(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(to_bytes(x), pa.binary())], ["dims", "x"])

    return vectors.select(F.col(column)).mapInArrow(put, "dims int, x binary").distinct()


# -- moments ----------------------------------------------------------------

def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where they hold it, Python integers beyond."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most * n < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _summed(fit: DataFrame, dims: int, cells: str, of_batch) -> dict[int, object]:
    """Totals by cell number of what ``of_batch`` gives for the grid vectors of a batch.

    Tasks hold one running total; their totals are summed by Spark.
    """
    whole = "decimal" in cells

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(from_bytes(batch.column(0).to_pylist(), dims))
                total = own if total is None else total + own
        if total is not None:
            kind = pa.decimal128(38, 0) if whole else pa.float64()
            from decimal import Decimal
            values = [Decimal(int(v)) for v in total] if whole else total
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(values, kind)],
                                             ["cell", "value"])

    rows = fit.filter(F.col("dims") == dims).select("x").mapInArrow(add, f"cell int, value {cells}")
    return {r["cell"]: r["value"] for r in rows.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def exact_sums(fit: DataFrame, dims: int) -> list[int]:
    """Per-dimension sums over the fit list."""
    def of_batch(x: np.ndarray) -> np.ndarray:
        safe = max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < 1 << 62
        return (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))

    found = _summed(fit, dims, "decimal(38,0)", of_batch)
    return [int(found[i]) for i in range(dims)] if found else [0] * dims


def covariance(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance over the fit list, divisor n; the exact deviation is centred before it is multiplied."""
    upper = np.triu_indices(dims)

    def of_batch(x: np.ndarray) -> np.ndarray:
        y = (deviations(x, n, sums) / n).astype(np.float64)
        return (y.T @ y)[upper]

    found = _summed(fit, dims, "double", of_batch)
    v = np.zeros((dims, dims))
    v[upper] = [found[i] / n for i in range(len(upper[0]))]
    return np.triu(v) + np.triu(v, 1).T


# -- eigenvalues ------------------------------------------------------------

def inertia_below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie below ``shift``: negative pivots of a symmetric elimination.

    Pivots are single or pairs, chosen by largest entry (Bunch and Parlett), which
    keeps the elimination stable for indefinite matrices.
    """
    a, below = v - shift * np.eye(len(v)), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        single = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[single] == 0 and off[i, j] == 0:
            break  # what is left is zero: eigenvalues equal to the shift
        if diagonal[single] >= 0.6404 * off[i, j]:  # (1 + sqrt(17)) / 8
            pivot = [single]
            below += int(a[single, single] < 0)
        else:
            pivot = [i, j]
            below += int((np.linalg.eigvalsh(a[np.ix_(pivot, pivot)]) < 0).sum())
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        b = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - b @ np.linalg.solve(a[np.ix_(pivot, pivot)], b.T)
        a = (a + a.T) / 2
    return below


def top_intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), highest first, together holding at least the ``k`` largest.

    Bisection by inertia finds a low end with few more than ``k`` above it; an
    interval with many is halved while its halves are wide against rounding.
    """
    d, size = len(v), float(np.abs(v).sum(axis=1).max())
    high, low, least = size * 1.01, -size * 0.01, 0.0
    above = {low: d, high: 0}
    a, b = low, high  # more than k above a, fewer above b
    for _ in range(40):
        if above[a] == k:
            break
        least = (a + b) / 2
        above[least] = d - inertia_below(v, least)
        a, b = (least, b) if above[least] >= k else (a, least)
    # Of the ends that were tried, one with as few: the lowest, away from the eigenvalues above it.
    few = [(s, c) for s, c in above.items() if c >= k]
    low = min(s for s, c in few if c == min(c for _, c in few))
    todo, out = [(low, high)], []
    while todo:
        a, b = todo.pop()
        inside = above[a] - above[b]
        middle = (a + b) / 2
        if inside > CROWD and b - a > 1e-6 * size:
            above[middle] = d - inertia_below(v, middle)
            todo += [(a, middle), (middle, b)]
        elif inside:
            out.append((a, b, inside))
    return out


def contour_nodes(low: float, high: float, nodes: int = NODES) -> list[tuple[complex, complex]]:
    """Shifts and weights on the upper half of the circle over [low, high] (the lower half is conjugate)."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 - at))
    radius = (high - low) / 2
    return list(zip(((low + high) / 2 + radius * turn).tolist(), (weight / 2 * radius * turn).tolist(), strict=True))


def project(spark: SparkSession, v: np.ndarray, block: np.ndarray, nodes: list[tuple[complex, complex]]) -> np.ndarray:
    """The block's part inside the contour: one complex shifted solve per task, added in node order."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shift, weight = nodes[i]
                part = (weight * np.linalg.solve(shift * np.eye(len(v)) - v, block.astype(complex))).real
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["node", "part"])

    parts = spark.range(0, len(nodes), 1, len(nodes)).mapInArrow(solve, "node long, part binary").collect()
    return sum(np.frombuffer(r["part"]).reshape(block.shape) for r in sorted(parts, key=lambda r: r["node"]))


def solve_interval(spark: SparkSession, v: np.ndarray, low: float, high: float, inside: int,
                   rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of ``v`` in [low, high], as many as inertia counts there."""
    d, size = len(v), float(np.abs(v).sum(axis=1).max())
    width, nodes = min(d, inside + max(4, inside // 2)), contour_nodes(low, high)
    while True:
        block, best = np.random.default_rng(_DRAW).standard_normal((d, width)), np.inf
        for _ in range(rounds):
            # A block as wide as the space needs no projection: Rayleigh-Ritz is exact then.
            part = project(spark, v, block, nodes) if width < d else block
            q, triangle = np.linalg.qr(part)
            values, turn = np.linalg.eigh(q.T @ v @ q)
            block = q @ turn
            mine = (values >= low) & (values < high)
            error = np.abs(v @ block[:, mine] - block[:, mine] * values[mine]).max(initial=0)
            if mine.sum() == inside and (error <= 4e-16 * size or error > best / 4):
                return values[mine], block[:, mine]
            best = min(best, error) if mine.sum() == inside else np.inf
            if width == d:
                # Rounding at an end of the interval: the nearest ones to it are meant.
                order = np.argsort(np.abs(values - (low + high) / 2), kind="stable")[:inside]
                return values[order], block[:, order]
        width = min(d, 2 * width)


def components(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding, falling, and their vectors as columns."""
    k, trace = min(k, len(v)), float(np.trace(v))
    if k <= 0 or not trace > 0:
        return np.empty(0), np.empty((len(v), 0))
    found = [solve_interval(spark, v, *interval) for interval in top_intervals(v, k)]
    values, vectors = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > NOISE * trace]
    vectors, _ = np.linalg.qr(vectors[:, order]) if len(order) else (vectors[:, order], None)
    return values[order], vectors


# -- whitening --------------------------------------------------------------

@dataclass
class Whitening:
    """What all rows share: a few vectors of d entries."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray   # falling eigenvalues
    vectors: np.ndarray  # unit columns
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, difference: np.ndarray) -> np.ndarray:
        return (difference / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, k: int = 4, column: str = "embedding") -> Whitening | None:
    """Components of the distinct grid vectors; None where there is no valid vector."""
    spark = vectors.sparkSession
    known = staged(fit_list(vectors, column), "grid")
    lengths = known.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return None
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    sums = exact_sums(known, dims)
    v = covariance(known, dims, n, sums)
    values, columns = components(spark, v, k)
    model = Whitening(dims, n, sums, values, columns, values / np.trace(v) if len(values) else values)
    if len(values):
        m = len(values)

        def of_batch(x: np.ndarray) -> np.ndarray:
            w = model.whiten(deviations(x, n, sums))
            return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

        found = _summed(known, dims, "double", of_batch)
        flat = np.array([found[i] for i in range(m + m * m)]) / n
        measured = flat[m:].reshape(m, m) - np.outer(flat[:m], flat[:m])
        model.identity_error = float(np.abs(measured - np.eye(m)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None or not len(model.values):
            return
        m = len(model.values)
        for batch in batches:
            for at, x in grid_vectors(batch.column(1)):
                if x.shape[1] != model.dims or not len(x):
                    continue
                difference = deviations(x, model.n, model.sums)
                most = max(int(difference.max()), -int(difference.min()))
                if most * most * model.dims < _LONG:
                    squares = (difference.astype(np.int64) ** 2).sum(axis=1).tolist()
                else:
                    squares = [s if s < _LONG else None for s in (difference.astype(object) ** 2).sum(axis=1).tolist()]
                count = len(x) * m
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, model.n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m))),
                    pa.array(model.whiten(difference).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(count, model.identity_error))], names)

    return rows.mapInArrow(put, schema)
