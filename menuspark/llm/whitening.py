"""PCA whitening of embeddings by block Jacobi-Davidson, matrix-free.

The covariance V of the vectors is never formed: all that is asked of the cluster are products V @ W with a few dozen columns W,
each one pass over the vectors. A task centres its rows, multiplies twice and gives one partial sum; partial sums meet in a
handful of tasks, so the driver gets a handful of (dimensions x columns) arrays, whatever the number of rows.

The search subspace begins with random columns. Each round takes Ritz pairs from it (Rayleigh-Ritz), locks those whose residual is at the
level of double precision, and widens it by solving the correction equations (I - QQ')(V - t I)(I - QQ') z = -r of all open
pairs at once: the inner MINRES runs on all columns together, so that a step of all of them is one pass. Q holds the locked and
the open vectors. When the subspace is full it restarts from its best Ritz vectors.

Defined results: a row is left out where its vector is null or holds a null or non-finite entry, or an entry beyond +-2**40, or has
another length than most vectors (of equally frequent lengths the longest counts). Rows that repeat count as often as they occur, and
a null id is kept. No row, or no dimension: no result. A component whose variance is zero to double precision (fewer distinct rows than dimensions,
constant dimensions) has ``whitened`` null, and the identity error is over the others. ``deviation`` is null where it doesn't fit a long.
Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Columns searched beside the wanted ones, inner steps of a round, subspace columns as a multiple of the block.
GUARD, INNER_STEPS, SUBSPACE = 8, 6, 4
LARGEST_ENTRY, ROWS, SEED = float(1 << 40), 4096, 12
_LONG = 1 << 63


def to_long_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows with a usable vector, x = floor(64 c) + 1000000 for each entry c as a double."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST_ENTRY)), F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    vectors = staged(rows.select("id", x.alias("x")), "vectors")
    common = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return vectors.filter(F.size("x") == (common["d"] if common else 0))


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Passes:
    """Sums over all vectors, each one pass: ``of`` maps a matrix of rows to an array whose sum over the table is wanted."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors.select("x")
        self.meet = max(1, math.isqrt(vectors.rdd.getNumPartitions() - 1))
        self.count = 0

    def sum(self, of: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in slices(batches, ROWS):
                if batch.num_rows:
                    one = of(_rows(batch, 0))
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(dtype).tobytes()], pa.binary())], names=["s"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total = np.frombuffer(raw, dtype) + (0 if total is None else total)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        self.count += 1
        some = self.vectors.mapInArrow(partial, "s binary").repartition(self.meet).mapInArrow(meet, "s binary").collect()
        return np.sum([np.frombuffer(r["s"], dtype) for r in some], axis=0, dtype=dtype)


@dataclass
class Whitening:
    """The fit: n, the exact sums S, unit eigenvectors (a column each) and their eigenvalues by falling size, and trace(V)."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def usable(self) -> np.ndarray:
        """Which components have a variance above double precision's noise."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > top * np.finfo(float).eps * 64 * len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; zero in components that aren't usable."""
        scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1)), 0)
        return (x - self.sums / self.n) @ self.components * scale


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """MINRES from zero on each column of b at once, for a symmetric operator that maps columns to columns."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    safe = lambda y: np.where(y > 0, y, 1)
    v_old, v = np.zeros_like(b), b / safe(beta)
    d_old, d_older = np.zeros_like(b), np.zeros_like(b)
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    left, beta_v = beta.copy(), np.zeros_like(beta)
    open_ = beta > 0
    for _ in range(steps):
        w = product(v) - beta_v * v_old
        alpha = np.sum(v * w, axis=0)
        w = w - alpha * v
        beta_w = np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix, after the two rotations before it.
        far = s_old * beta_v
        near = c_old * beta_v
        near, now = c * near + s * alpha, c * alpha - s * near
        length = np.hypot(now, beta_w)
        open_ = open_ & (length > 0)
        c_old, s_old, c, s = c, s, now / safe(length), beta_w / safe(length)
        d = (v - far * d_older - near * d_old) / safe(length)
        x = x + np.where(open_, c * left, 0) * d
        left = -s * left
        open_ = open_ & (beta_w > 1e-14 * (np.abs(alpha) + beta_v + beta_w))
        d_older, d_old = d_old, d
        v_old, v, beta_v = v, w / safe(beta_w), beta_w
        if not open_.any():
            break
    return x


def _orthonormal(z: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of z made orthonormal to each other and to the columns of ``against``; those that vanish are left out."""
    for _ in range(2):
        z = z - against @ (against.T @ z)
        z = z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
        q, r = np.linalg.qr(z)
        z = q[:, np.abs(np.diag(r)) > 1e-8]
    return z


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, *, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of a symmetric positive semi-definite operator on d dimensions, their unit eigenvectors as columns,
    and the largest residual. Block Jacobi-Davidson with locking."""
    rng, block = np.random.default_rng(SEED), min(d, wanted + GUARD)
    most = min(d, SUBSPACE * block)
    locked, locked_values = np.zeros((d, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((d, block)), locked)
    image, worst, before = product(basis), 0.0, math.inf
    for _ in range(rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        vectors, moved = basis @ turn, image @ turn
        residuals = moved - vectors * values
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        top = max(values[0] if len(values) else 0, locked_values[0] if len(locked_values) else 0)
        floor = max(64 * np.finfo(float).eps * math.sqrt(d) * top, 1e-300)
        need = wanted - len(locked_values)
        done = 0
        while done < min(need, len(values)) and sizes[done] <= floor:
            done += 1
        # A complete subspace can't be widened: what is left of the residuals is rounding.
        complete = basis.shape[1] + locked.shape[1] >= d
        if complete and (sizes[:need].max(initial=0) >= before / 2 or done >= min(need, len(values))):
            done = min(need, len(values))
        worst = max(worst, sizes[:done].max(initial=0))
        locked, locked_values = np.hstack([locked, vectors[:, :done]]), np.concatenate([locked_values, values[:done]])
        if len(locked_values) >= wanted or done == len(values):
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order], float(worst)
        vectors, moved, values, residuals = vectors[:, done:], moved[:, done:], values[done:], residuals[:, done:]
        if complete:  # once more from the Ritz vectors, with fresh products
            before = sizes[:need].max(initial=0)
            basis = _orthonormal(vectors, locked)
            image = product(basis)
            continue
        if vectors.shape[1] + block > most:
            vectors, moved, values, residuals = vectors[:, :block], moved[:, :block], values[:block], residuals[:, :block]
        open_ = min(block, vectors.shape[1], d - locked.shape[1] - vectors.shape[1])
        shift, space = values[:open_], np.hstack([locked, vectors[:, :open_]])

        def corrected(z: np.ndarray, shift=shift, space=space) -> np.ndarray:
            z = z - space @ (space.T @ z)
            z = product(z) - z * shift
            return z - space @ (space.T @ z)

        z = minres(corrected, -residuals[:, :open_], INNER_STEPS)
        fresh = _orthonormal(z, np.hstack([locked, vectors]))
        if fresh.shape[1] < open_:
            fresh = np.hstack([fresh, _orthonormal(rng.standard_normal((d, open_ - fresh.shape[1])), np.hstack([locked, vectors, fresh]))])
        basis, image = np.hstack([vectors, fresh]), np.hstack([moved, product(fresh)])
    raise RuntimeError(f"{wanted - len(locked_values)} of {wanted} components have residuals above double precision after {rounds} rounds")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``to_long_vectors``; None if there is none, or no dimension."""
    passes = Passes(vectors)
    first = passes.sum(lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=np.int64)]), np.int64)
    if first.size < 2:
        return None
    n, sums = int(first[0]), first[1:]
    mean, d = sums / n, first.size - 1
    trace = float(passes.sum(lambda x: np.array([np.square(x - mean).sum()]))[0]) / n

    def product(w: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ w)).ravel()

        return passes.sum(of).reshape(d, -1) / n

    values, found, residual = leading(product, d, min(components, d))
    return Whitening(n, sums, found, np.maximum(values, 0), trace, residual, passes.count)


def identity_error(vectors: DataFrame, made: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the usable components."""
    use = made.usable

    def of(x: np.ndarray) -> np.ndarray:
        y = made.project(x)[:, use]
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    if not use.any():
        return 0.0
    got, k = Passes(vectors).sum(of) / made.n, int(use.sum())
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)**2 of each row, exactly."""
    rough = (np.square(np.abs(x * float(n) - sums.astype(float)) + 1).sum(axis=1)).max(initial=0)
    if rough < _LONG / 4 and n * float(np.abs(x).max(initial=0)) < _LONG / 4:
        return np.square(n * x - sums).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [e if e < _LONG else None for e in exact]


def whiten(vectors: DataFrame, made: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of each row, one entry a component."""
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), *T.StructType.fromDDL("deviation long, whitened array<double>").fields])
    id_type, use = to_arrow_type(vectors.schema["id"].dataType), made.usable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _rows(batch, 1)
            y, k = made.project(x), len(use)
            flat = pa.array(y.ravel(), mask=np.tile(~use, len(y)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) * k + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(_deviations(x, made.n, made.sums), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return vectors.select("id", "x").mapInArrow(run, schema)


def whitened_components(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = to_long_vectors(df, id_col, vector_col)
    made = fit(vectors, components)
    out = "id, component, n, deviation, whitened, explained, identity_error".split(", ")
    if made is None:
        empty = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
        return df.sparkSession.createDataFrame([], empty)
    explained = F.array(*[F.lit(float(e / made.trace) if made.trace else 0.0) for e in made.values])
    rows = whiten(vectors, made).select("id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select("id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("pos") + 1).alias("explained"), F.lit(identity_error(vectors, made)).alias("identity_error")).select(*out)
