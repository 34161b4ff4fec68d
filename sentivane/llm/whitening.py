"""Whitening of embeddings with eigenvectors found by block Jacobi-Davidson.

The covariance is never formed.  A product with a block of vectors is one distributed pass: every
task centres its rows, multiplies them with the block and back, and emits one small partial sum per
entry; Spark adds these.  On the driver there are only blocks of `dimension` x `space` numbers.

Outer iteration: Rayleigh-Ritz in the search space, residuals of the wanted pairs, locking of those
that have converged, and for every other wanted pair a correction t that solves

    (I - Q Q') (V - theta I) (I - Q Q') t = -r,    Q: locked vectors and all wanted Ritz vectors

by a few MINRES steps.  The corrections of all pairs advance together, so that a step is one pass
however many pairs are open.  The space restarts from its best Ritz vectors when it is full.  A pair
has converged when its residual is at most `TOLERANCE` times the largest eigenvalue.

Entries become whole numbers first (`whole_numbers`), so sums and centring are exact: an entry of
n x - S is computed in 64-bit integers and only then divided by n.

Dropped: null vectors, vectors with a null, NaN or infinite entry or one beyond 2^30 / 1024, and
vectors that have not the commonest length (ties: the longest).  Repeated rows count as often as
they are there; null ids stay null.  Equal eigenvalues may give any basis of their space.
Components without variance (below `RANK` times the largest) are left out, so that a table of equal
vectors, and an empty one, give no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.session import small_table, stage

COMPONENTS = 8
# Vectors carried beside the wanted ones, MINRES steps per correction, size of the search space.
GUARD, INNER, SPACE = 4, 4, 64
MAX_OUTER = 500
TOLERANCE = 128 * float(np.finfo(float).eps)
RANK = 1e-12
LIMIT = 1 << 30
_SHIFT = 20


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, x array<bigint>): floor(scale * c) + offset of every entry of the valid vectors."""
    v = F.col("v")
    number = lambda c: F.lit(float(scale)) * c.cast("double")
    fine = lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(number(c)) < F.lit(float(LIMIT))), F.lit(False))
    valid = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")) \
        .filter(v.isNotNull() & (F.size(v) > 0)).filter(F.forall(v, fine))
    return valid.select("vec_id", F.transform(
        v, lambda c: F.floor(number(c)).cast("bigint") + F.lit(offset)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Centred:
    """The fit list: rows of whole numbers on disk, their number and their exact sums."""

    rows: DataFrame  # (vec_id, x)
    n: int
    sums: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def summed(self, per_rows, size: int) -> np.ndarray:
        """Sum over all rows of what `per_rows` makes of a batch of centred rows, entry by entry."""
        n, sums = self.n, self.sums

        def run(batches):
            total = np.zeros(size, np.longdouble)
            for b in batches:
                if b.num_rows:
                    total += per_rows((_matrix(b.column(0)) * n - sums) / n).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(total.astype(float))],
                ["at", "value"])

        # `size` rows, a few vectors of the embedding's dimension
        got = self.rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(
            F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[got["at"].to_numpy()] = got["value"].to_numpy()
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self.summed(lambda c: c.T @ (c @ block), block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.square(c).sum(keepdims=True), 1)[0]) / self.n


def centred(vectors: DataFrame) -> Centred | None:
    """Write the vectors once, with exact sums; None if there are none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d = common["d"]
    rows = stage(vectors.filter(F.size("x") == d), "vectors")
    got = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum("v").alias("s")).orderBy("at").toArrow()  # one row per dimension
    return Centred(rows, common["n"], got["s"].to_numpy())


def _without(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The part of a block that is orthogonal to the columns of q."""
    for _ in range(2):
        block = block - q @ (q.T @ block)
    return block


def _new_directions(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that widen q by the block; directions that q already holds go."""
    size = np.linalg.norm(block, axis=0)
    block = _without(q, block[:, size > 0] / size[size > 0])
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = _without(q, u[:, s > 1e-8])
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _corrections(product, q, theta, residual, steps):
    """MINRES on the projected correction equations of all pairs at once; one pass per step."""
    d, m = residual.shape
    v = _without(q, -residual)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.divide(v, beta, out=np.zeros_like(v), where=live)
    x, old_v = np.zeros((d, m)), np.zeros((d, m))
    w, old_w = np.zeros((d, m)), np.zeros((d, m))
    c, old_c, s, old_s = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    eta, old_beta = beta.copy(), np.zeros(m)
    for _ in range(steps):
        z = _without(q, product(v) - v * theta)
        alpha = (v * z).sum(0)
        z = _without(q, z - v * alpha - old_v * old_beta)
        new_beta = np.linalg.norm(z, axis=0)
        # the last column of the tridiagonal matrix, turned by the two rotations before it
        r1 = np.hypot(c * alpha - old_c * s * old_beta, new_beta)
        r0 = c * alpha - old_c * s * old_beta
        r2 = s * alpha + old_c * c * old_beta
        r3 = old_s * old_beta
        live &= r1 > 0
        safe = np.where(live, r1, 1.0)
        new_c, new_s = r0 / safe, new_beta / safe
        new_w = np.where(live, (v - old_w * r3 - w * r2) / safe, 0.0)
        x += np.where(live, new_c * eta * new_w, 0.0)
        eta = -new_s * eta
        live &= new_beta > 1e-14 * np.abs(theta)
        if not live.any():
            break
        old_v, v = v, np.divide(z, new_beta, out=np.zeros_like(z), where=live)
        old_w, w, old_beta = w, new_w, new_beta
        old_c, c, old_s, s = c, new_c, s, new_s
    return x


def eigenpairs(product, d: int, wanted: int = COMPONENTS, inner: int = INNER, space: int = SPACE,
               tolerance: float = TOLERANCE, seed: int = 7):
    """The greatest eigenvalues, falling, and their unit vectors, of a symmetric semidefinite map.

    `product` applies the map to a block of columns.  The entry of greatest magnitude is positive.
    """
    wanted = min(wanted, d)
    keep = min(d, wanted + GUARD)
    space = min(d, max(space, 3 * keep))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, keep)))[0]
    image = product(basis)
    locked, locked_image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(MAX_OUTER):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        open_ = wanted - locked.shape[1]
        residual = ritz_image[:, :open_] - ritz[:, :open_] * theta[:open_]
        residual = _without(locked, residual)
        top = max([theta[0], *(locked * locked_image).sum(0)], default=0.0)
        done = np.linalg.norm(residual, axis=0) <= tolerance * max(top, 0.0)
        if basis.shape[1] + locked.shape[1] == d:
            done[:] = True  # the space is everything: the pairs are exact but for rounding
        # lock from the top only, so that no greater value can be passed over
        good = int(np.argmin(done)) if not done.all() else len(done)
        locked = np.concatenate([locked, ritz[:, :good]], 1)
        locked_image = np.concatenate([locked_image, ritz_image[:, :good]], 1)
        if good == open_:
            break
        rest = slice(good, None)
        basis, image = ritz[:, rest], ritz_image[:, rest]
        if basis.shape[1] + open_ - good > space:
            basis, image = basis[:, :keep], image[:, :keep]
        q = np.concatenate([locked, ritz[:, good:open_]], 1)
        t = _corrections(product, q, theta[good:open_], residual[:, good:], inner)
        # a correction that ended in nothing is replaced by its residual
        t = np.where(np.linalg.norm(t, axis=0) > 0, t, residual[:, good:])
        new = _new_directions(np.concatenate([locked, basis], 1), t)
        if not new.shape[1]:
            new = _new_directions(np.concatenate([locked, basis], 1),
                                  np.random.default_rng(seed + 1).normal(size=(d, 1)))
        basis = np.concatenate([basis, new], 1)
        image = np.concatenate([image, product(new)], 1)
    else:
        raise RuntimeError(f"no convergence in {MAX_OUTER} iterations")
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    small = locked.T @ image
    values, y = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (locked @ y)[:, ::-1]
    at = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[at, np.arange(len(at))])


@dataclass(frozen=True)
class Model:
    data: Centred
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def identity_error(self) -> float:
        """Greatest absolute entry of the whitened rows' covariance less the identity."""
        p, k, n = self.projection, len(self.values), self.data.n

        def sums(c):
            w = c @ p
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        got = self.data.summed(sums, k + k * k)
        mean, square = got[:k] / n, got[k:].reshape(k, k) / n
        return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """Components with variance, from the first on; None where there are none."""
    data = centred(vectors)
    trace = data.trace() if data else 0.0
    if not trace > 0:
        return None
    values, vectors_ = eigenpairs(data.product, data.dimension, components)
    keep = values > RANK * values[0]
    return Model(data, values[keep], vectors_[:, keep], trace)


def exact_deviation(whole: np.ndarray) -> list[int]:
    """Sum of squares of every row of 64-bit integers, beyond 64 bits where needed."""
    high = whole >> _SHIFT
    low = whole - (high << _SHIFT)
    parts = [(a * b).sum(1).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 2 * _SHIFT) + (b << _SHIFT + 1) + c for a, b, c in zip(*parts)]


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, " \
         "explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component.

    `deviation` is null where it doesn't fit 64 bits; `deviation_exact` always holds it.
    """
    model = fit(vectors, components)
    if model is None:
        return small_table(vectors.sparkSession, [], SCHEMA)
    n, sums, p = model.data.n, model.data.sums, model.projection
    k, share, error = len(model.values), model.values / model.trace, model.identity_error()

    def run(batches):
        for b in batches:
            whole = _matrix(b.column(1)) * n - sums
            deviation = exact_deviation(whole)
            m = b.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(each),
                pa.array((whole / n @ p).ravel()), pa.array(np.tile(share, m)),
                pa.array(np.full(m * k, error)),
                pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(each),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained",
                "identity_error", "deviation_exact"])

    return model.data.rows.mapInArrow(run, SCHEMA)
