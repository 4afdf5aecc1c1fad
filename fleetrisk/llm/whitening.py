"""Embedding whitening: exact distributed covariance, leading eigenvectors, broadcast projection.

Vectors are put on a grid of longs, and the fit list holds each distinct one once.
Two passes over it: sums give the mean, then tasks multiply entries less the rounded
mean and add the products up as integers. So the covariance is exact up to its one
final rounding, whatever the order of addition and however often a task runs again.
The matrix (dimensions squared) goes to the driver: Householder reflections make it tridiagonal, Sturm
counts bisect its leading eigenvalues, inverse iteration with reorthogonalisation inside clusters
gives the vectors. The projection is broadcast, and every row is projected where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import prepare, stored

COMPONENTS = 16
#: the grid: floor(GRID_SCALE * c) + GRID_SHIFT, held to +-GRID_LIMIT, within which doubles are exact
GRID_SCALE, GRID_SHIFT, GRID_LIMIT = 64.0, 1_000_000, 1 << 53
#: products of limbs of so many bits, summed over so many rows, are exact in a double
LIMB_BITS, LIMB_ROWS = 18, 1 << 17
#: eigenvalues nearer than this share of the largest are one cluster
CLUSTER_GAP = 1e-3
EPS = np.finfo(float).eps

SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def grid(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(usable row numbers, [(row numbers, grid vectors)] by length); only length ``dims`` where given.

    Usable: not null, not empty, without null or non-finite entries.
    """
    column = column.cast(pa.large_list(pa.float64()))
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    child = column.values
    values = np.asarray(child.to_numpy(zero_copy_only=False), float)  # a null entry becomes NaN
    sizes = np.diff(starts)
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = np.flatnonzero((sizes > 0) & (bad[starts[:-1] + sizes] == bad[starts[:-1]]))
    groups = []
    for size in np.unique(sizes[good]) if dims is None else [dims]:
        rows = good[sizes[good] == size]
        x = values[starts[rows][:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(GRID_SCALE * x) + GRID_SHIFT, -GRID_LIMIT, GRID_LIMIT)
        groups.append((rows, x.astype(np.int64)))
    return good, groups


def fit_list(embeddings: DataFrame, column: str) -> DataFrame:
    """(dims, x): each distinct grid vector once, packed."""
    def run(batches):
        for batch in batches:
            for _, x in grid(batch.column(0))[1]:
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), packed.cast(pa.binary())], names=["dims", "x"])

    return embeddings.select(column).mapInArrow(run, "dims int, x binary").distinct()


def unpacked(batch: pa.RecordBatch, dims: int, column: int = 0) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.int64).reshape(-1, dims)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums as Python integers."""
    return (x >> 26).sum(0).astype(object) * (1 << 26) + (x & (1 << 26) - 1).sum(0).astype(object)


def gram(z: np.ndarray) -> np.ndarray:
    """Exact sums of products as Python integers: doubles multiply limbs that cannot round."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), LIMB_ROWS):
        rest, limbs = z[at:at + LIMB_ROWS], []
        while not limbs or rest.any():
            low = ((rest + (1 << LIMB_BITS - 1)) & (1 << LIMB_BITS) - 1) - (1 << LIMB_BITS - 1)  # signed limb
            limbs.append(low.astype(float))
            rest = (rest - low) >> LIMB_BITS
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB_BITS * (i + j))
    return total


def _summed(fit: DataFrame, partial, cells: str, kind: str) -> dict[tuple, object]:
    """{cell: sum} of what ``partial`` yields for each partition; a few cells a partition are added up by Spark."""
    keys = [c.split()[0] for c in cells.split(", ")]
    found = fit.mapInArrow(partial, f"{cells}, value {kind}").groupBy(*keys).agg(F.sum("value").alias("value"))
    return {tuple(r[k] for k in keys): r["value"] for r in found.collect()}


def _decimals(values) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(diagonal, off-diagonal, reflectors) by Householder reflections."""
    a, reflectors, d = a.copy(), [], len(a)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:
            off[k] = v[0]
            reflectors.append(None)
            continue
        off[k] = -np.copysign(size, v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    if d > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each of ``x``."""
    q = diagonal[0] - x
    found = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - x - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each by bisection on Sturm counts."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    tiny = max(EPS * EPS * norm, np.finfo(float).tiny)
    target = d - 1 - np.arange(count)  # so many eigenvalues are smaller
    low, high = np.full(count, low - EPS * norm), np.full(count, high + EPS * norm)
    for _ in range(128):
        middle = (low + high) / 2
        below = count_below(diagonal, off, middle, tiny) <= target
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if np.all(high - low <= 2 * EPS * np.maximum(np.abs(high), EPS * norm)):
            break
    return (low + high) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - shift) y = right by elimination with row exchanges."""
    d = len(diagonal)
    main, up, up2, right = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for k in range(d - 1):
        below, below_main, below_up = off[k], main[k + 1], up[k + 1]
        if abs(below) > abs(main[k]):
            factor = main[k] / below
            main[k], main[k + 1] = below, up[k] - factor * below_main
            up[k], up[k + 1], up2[k] = below_main, -factor * below_up, below_up
            right[k], right[k + 1] = right[k + 1], right[k] - factor * right[k + 1]
        else:
            factor = below / (main[k] if abs(main[k]) >= tiny else tiny)
            main[k + 1] = below_main - factor * up[k]
            right[k + 1] -= factor * right[k]
    main = np.where(np.abs(main) < tiny, tiny, main)
    y = np.zeros(d)
    for k in range(d - 1, -1, -1):
        y[k] = (right[k] - (up[k] * y[k + 1] if k + 1 < d else 0) - (up2[k] * y[k + 2] if k + 2 < d else 0)) / main[k]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns; clusters are reorthogonalised in each step."""
    d, norm = len(diagonal), float(np.abs(diagonal).max() + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    tiny, vectors, cluster, shift = EPS * norm, [], 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER_GAP * norm:
            cluster, shift = k, np.inf
        shift = min(value, shift - 2 * EPS * norm)  # shifts of one cluster differ
        y = np.random.default_rng(k).standard_normal(d)
        for _ in range(5):
            y = solve_shifted(diagonal, off, shift, y / np.linalg.norm(y), tiny)
            y /= np.abs(y).max()
            for _ in range(2):
                for before in vectors[cluster:]:
                    y = y - (before @ y) * before
        vectors.append(y / np.linalg.norm(y))
    return np.array(vectors).T


def leading_pairs(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    scale = np.abs(v).max() or 1.0
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_values(diagonal, off, count)
    vectors = leading_vectors(diagonal, off, values)
    for k, reflector in reversed(list(enumerate(reflectors))):
        if reflector is not None:
            vectors[k + 1:] -= 2 * np.outer(reflector, reflector @ vectors[k + 1:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    """A fitted transformation: what ``transform`` broadcasts."""

    dims: int
    n: int
    sums: list[int]
    middle: np.ndarray  # rounded means, subtracted first
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def rest(self) -> list[int]:
        """Sums of the entries less ``middle``."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]

    @property
    def scaled(self) -> np.ndarray:
        """Columns that project on the components over the root of their eigenvalues; NaN where there is no variance."""
        least = self.dims * EPS * max(float(np.max(self.values, initial=0.0)), 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.values > least, self.vectors / np.sqrt(self.values), np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle).astype(float) - np.array([r / self.n for r in self.rest])
        return centred @ self.scaled

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n * x - sum) squared, exact; null beyond 38 digits."""
        z = x - self.middle
        if (self.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * self.dims < 1 << 62:
            y = self.n * z - np.array(self.rest, np.int64)
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
        y = self.n * z.astype(object) - np.array(self.rest, object)
        from decimal import Decimal

        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (y * y).sum(1).tolist()], pa.decimal128(38, 0))


def fit(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """Fit on each distinct grid vector once; None where no row is usable.

    Vectors of another length than most distinct ones have (of equally many: the
    shortest) are left out here and by ``transform``.
    """
    prepare(embeddings.sparkSession)
    every = stored(fit_list(embeddings, column), "whitening")
    common = every.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return None
    dims, n = common["dims"], common["count"]
    own = every.where(F.col("dims") == dims).select("x")

    def sums(batches):
        total = np.zeros(dims, object)
        for batch in batches:
            total += column_sums(unpacked(batch, dims))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), _decimals(total)], names=["i", "value"])

    found = _summed(own, sums, "i int", "decimal(38,0)")
    totals = [int(found[i,]) for i in range(dims)]
    middle = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)

    def products(batches):
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += gram(unpacked(batch, dims) - middle)
        for i in range(dims):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (dims - i), pa.int32()), pa.array(range(i, dims), pa.int32()), _decimals(total[i, i:])], names=["i", "j", "value"])

    found = _summed(own, products, "i int, j int", "decimal(38,0)")
    exact = np.zeros((dims, dims), object)
    for (i, j), value in found.items():
        exact[i, j] = exact[j, i] = int(value)
    rest = np.array([s - n * int(m) for s, m in zip(totals, middle)], object)
    exact = n * exact - np.outer(rest, rest)
    v = (exact / (n * n)).astype(float)
    values, vectors = leading_pairs(v, min(components, dims))
    model = Whitening(dims, n, totals, middle, values, vectors, int(np.trace(exact)) / (n * n))
    model.identity_error = identity_error(own, model)
    return model


def identity_error(own: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, as measured."""
    dims, count = model.dims, len(model.values)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def products(batches):
        total = np.zeros((count, count))
        for batch in batches:
            y = shared.value.project(unpacked(batch, dims))
            total += y.T @ y
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    found = _summed(own, products, "i int, j int", "double")
    errors = [abs(value / model.n - (i == j)) for (i, j), value in found.items() if not np.isnan(value)]
    return max(errors, default=0.0)


def transform(embeddings: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """One row of SCHEMA for each usable row (vec_id and ``column``; others are ignored) and component.

    Rows whose vector is null, empty, of another length than the model's, or holds null or
    non-finite entries give no rows; repeated rows and null ids are rows like any other. Entries
    beyond the grid's limit are held to it. A component without variance has null for
    whitened, and explained is null where there is none at all. No usable row: no rows.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m, k = shared.value, len(shared.value.values)
        explained = m.values / m.trace if m.trace else np.full(k, np.nan)
        for batch in batches:
            rows, x = grid(batch.column(1), m.dims)[1][0]
            if not len(rows):
                continue
            ids, repeat = batch.column(0).take(pa.array(rows)), pa.array(np.repeat(np.arange(len(rows)), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * k, m.n)),
                m.deviations(x).take(repeat), pa.array(m.project(x).ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(rows)), from_pandas=True), pa.array(np.full(len(rows) * k, m.identity_error))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return embeddings.select(F.col("vec_id").cast("long"), column).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: deviation as a long (null beyond it)."""
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
