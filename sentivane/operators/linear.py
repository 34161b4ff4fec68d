"""Many regularised linear models fitted together: one distributed pass per step for all of them.

Every problem minimises |w|^2 / 2 + C * (sum of losses over its rows), the intercept free of
penalty: squared hinge of one class against the rest, softmax over all classes, or half the squared
error of a number.  Problems differ in class, left-out fold, C and loss; they share the rows.

Rows are sparse and packed once into blocks.  A pass sends the trial weights of all open problems to
the blocks and brings back one loss and one gradient each, summed by Spark; the driver holds
`problems` x `terms` numbers, however many rows there are.  Steps are L-BFGS scaled
by the top eigenpairs of the rows, which a few passes find for all problems; each problem has its own history and
step length; finished problems leave the passes.
With several C, a problem starts from the solution of the next smaller one (`after`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A block ends at so many rows, or entries (a longer row is a block of its own).
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1 << 18
HISTORY = 20
# Eigenpairs of the rows' products that steps are scaled by, and the passes that find them.
RANK, ROUNDS = 12, 2
ARMIJO = 1e-4


@dataclass(frozen=True)
class Problem:
    loss: str  # hinge, softmax or squares
    c: float
    classes: int = 1  # columns of weights
    positive: int = 0  # hinge: the class against the rest
    without_fold: int = -1  # rows of this fold are left out
    after: int | None = None  # problem whose solution is the start


def packed(rows: DataFrame, features: str = "features", target: str = "label",
           fold: str | None = None) -> DataFrame:
    """Blocks of sparse rows, each one table row of flat arrays."""
    v = F.unwrap_udt(features)
    dense = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    flat = rows.select(
        F.when(v["type"] == 0, v["indices"]).otherwise(dense).alias("term"),
        v["values"].alias("value"), F.col(target).cast("double").alias("target"),
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def pack(batches):
        for whole in batches:
            entries = np.diff(whole.column(0).offsets.to_numpy())
            for at, end in _block_bounds(entries):
                b = whole.slice(at, end - at)
                size = np.diff(b.column(0).offsets.to_numpy())
                row = np.repeat(np.arange(b.num_rows, dtype=np.int32), size)
                term = b.column(0).flatten().to_numpy().astype(np.int32)
                value = b.column(1).flatten().to_numpy()
                by_term = np.argsort(term, kind="stable").astype(np.int32)
                parts = [row, term, value, by_term, b.column(2).to_numpy(),
                         b.column(3).to_numpy().astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes()], pa.binary()) for p in parts], _PARTS)

    return flat.mapInArrow(pack, ", ".join(f"{p} binary" for p in _PARTS))


def _block_bounds(entries: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the rows of every block, given the entries of each row."""
    bounds, first, total = [], 0, 0
    for k, n in enumerate(entries.tolist()):
        if k > first and (k - first == BLOCK_ROWS or total + n > BLOCK_ENTRIES):
            bounds.append((first, k))
            first, total = k, 0
        total += n
    return [*bounds, (first, len(entries))] if len(entries) else []


_PARTS = ["row", "term", "value", "by_term", "target", "fold"]
_TYPES = [np.int32, np.int32, np.float64, np.int32, np.float64, np.int32]


class Block:
    """The rows of one block; products with a matrix of weights from both sides."""

    def __init__(self, record: dict):
        for name, kind in zip(_PARTS, _TYPES):
            setattr(self, name, np.frombuffer(record[name], kind))
        self.first = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.filled = self.row[self.first]
        by = self.term[self.by_term]
        self.term_first = np.flatnonzero(np.diff(by, prepend=-1))
        self.terms = by[self.term_first]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Rows times weights; the last row of the weights is the intercept."""
        out = np.tile(weights[-1], (len(self.target), 1))
        if len(self.first):
            out[self.filled] += np.add.reduceat(
                self.value[:, None] * weights[self.term], self.first)
        return out

    def add_gradient(self, total: np.ndarray, slopes: np.ndarray) -> None:
        if len(self.first):
            each = (self.value[:, None] * slopes[self.row])[self.by_term]
            total[self.terms] += np.add.reduceat(each, self.term_first)
        total[-1] += slopes.sum(0)

    def losses(self, problem: Problem, margin: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of losses and their slopes at the margins."""
        used = self.fold != problem.without_fold
        if problem.loss == "squares":
            gap = np.where(used, margin[:, 0] - self.target, 0.0)
            return 0.5 * float(gap @ gap), gap[:, None]
        if problem.loss == "hinge":
            sign = np.where(self.target == problem.positive, 1.0, -1.0)
            gap = np.where(used, np.maximum(0.0, 1.0 - sign * margin[:, 0]), 0.0)
            return float(gap @ gap), (-2.0 * sign * gap)[:, None]
        high = margin.max(1, keepdims=True)
        power = np.exp(margin - high)
        whole = power.sum(1, keepdims=True)
        at = np.arange(len(margin)), self.target.astype(int)
        loss = high[:, 0] + np.log(whole[:, 0]) - margin[at]
        slopes = power / whole
        slopes[at] -= 1.0
        return float(loss[used].sum()), slopes * used[:, None]


def blocks_of(batches):
    """The blocks of Arrow batches one at a time: a worker holds one beside the batch."""
    for b in batches:
        for k in range(b.num_rows):
            yield Block({name: b.column(name)[k].as_py() for name in _PARTS})


def evaluator(blocks: DataFrame, terms: int) -> Callable:
    """f([(problem, weights)]) -> [(sum of losses, gradient of it)], in one pass."""

    def evaluate(trials: list[tuple[Problem, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        problems = [p for p, _ in trials]
        weights = np.concatenate([w for _, w in trials], 1)
        ends = np.cumsum([p.classes for p in problems])

        def run(batches):
            total, loss = np.zeros((terms + 1, weights.shape[1])), np.zeros(len(problems))
            for block in blocks_of(batches):
                margin = block.margins(weights)
                slopes = np.empty_like(margin)
                for k, (p, end) in enumerate(zip(problems, ends)):
                    part = slice(end - p.classes, end)
                    value, slopes[:, part] = block.losses(p, margin[:, part])
                    loss[k] += value
                block.add_gradient(total, slopes)
            flat = [np.append(total[:, e - p.classes:e].ravel(), v)
                    for p, e, v in zip(problems, ends, loss)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.list_(pa.float64()))],
                ["k", "sums"])

        got = summed(blocks.mapInArrow(run, "k int, sums array<double>"), len(problems))
        return [(float(v[-1]), v[:-1].reshape(terms + 1, p.classes))
                for p, v in zip(problems, got)]

    return evaluate


class _Descent:
    """L-BFGS of one problem, a trial point at a time."""

    def __init__(self, problem: Problem, start: np.ndarray, inverse: Callable, limit: float):
        self.problem, self.trial, self.limit = problem, start, limit
        self.inverse = inverse
        self.point = self.value = self.slope = None
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.steps, self.done = 0, False

    def take(self, losses: float, gradient: np.ndarray) -> None:
        """The sums at the trial point: accept it and choose the next, or shorten the step."""
        c, w = self.problem.c, self.trial
        value = c * losses + 0.5 * float(np.square(w[:-1]).sum())
        gradient = c * gradient
        gradient[:-1] += w[:-1]
        if self.point is not None:
            fall = float((self.slope * self.direction).sum())
            if value > self.value + ARMIJO * self.length * fall and self.length > 1e-10:
                # the least point of the parabola through both values and the first slope
                bend = value - self.value - self.length * fall
                better = -0.5 * fall * self.length ** 2 / bend
                self.length = min(0.5 * self.length, max(0.1 * self.length, better))
                self.trial = self.point + self.length * self.direction
                return
            s, y = w - self.point, gradient - self.slope
            product = float((s * y).sum())
            if product > 1e-12 * float(np.square(y).sum()):
                self.pairs = [*self.pairs[-HISTORY + 1:], (s, y, product)]
            self.done = value >= self.value  # nothing left but rounding
        self.point, self.value, self.slope = w, value, gradient
        self.steps += 1
        if self.done or float(np.abs(gradient).max()) <= self.limit:
            self.done = True
            return
        self.direction, self.length = -self._newton(gradient), 1.0
        self.trial = self.point + self.direction

    def _newton(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the approximate inverse Hessian."""
        q, factors = gradient.copy(), []
        for s, y, product in reversed(self.pairs):
            a = float((s * q).sum()) / product
            q -= a * y
            factors.append(a)
        scale = 1.0
        if self.pairs:
            _, y, product = self.pairs[-1]
            scale = product / float((y * self.inverse(y)).sum())
        q = scale * self.inverse(q)
        for (s, y, product), a in zip(self.pairs, reversed(factors)):
            q += s * (a - float((y * q).sum()) / product)
        return q


@dataclass(frozen=True)
class Curvature:
    """What bends the losses: the number of rows and the top eigenpairs of X'X, X with a column of ones."""

    rows: float
    values: np.ndarray
    vectors: np.ndarray

    def inverse(self, bend: float) -> Callable[[np.ndarray], np.ndarray]:
        """The inverse of I + bend * X'X as far as the eigenpairs tell; the rest as the last of them."""
        rest = self.values[-1] if len(self.values) else 0.0
        level = 1.0 + 0.5 * bend * rest
        more = np.maximum(bend * self.values + 1.0 - level, 0.0)
        shrink = (more / (level + more))[:, None]
        return lambda q: (q - self.vectors @ (shrink * (self.vectors.T @ q))) / level


def curvature(blocks: DataFrame, terms: int, rank: int = RANK, rounds: int = ROUNDS,
              product: Callable | None = None) -> Curvature:
    """Top eigenpairs by subspace iteration, one pass a round."""

    def distributed(space: np.ndarray) -> np.ndarray:
        def run(batches):
            total, n = np.zeros(space.shape), 0
            for block in blocks_of(batches):
                block.add_gradient(total, block.margins(space))
                n += len(block.target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(space.shape[1]), pa.int32()),
                 pa.array(list(total.T), pa.list_(pa.float64()))], ["k", "sums"])

        return summed(blocks.mapInArrow(run, "k int, sums array<double>"), space.shape[1]).T

    product = product or distributed
    rank = min(rank, terms + 1)
    space = np.random.default_rng(7).normal(size=(terms + 1, rank))
    # the column of ones counts the rows: its own product holds their number
    space[:, 0] = 0.0
    space[-1, 0] = 1.0
    image = product(space)
    rows = float(image[-1, 0])
    for _ in range(rounds):
        space = np.linalg.qr(image)[0]
        image = product(space)
    small = space.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return Curvature(rows, np.maximum(values[::-1], 0.0), space @ turn[:, ::-1])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Rows (k, sums) added up by k; `size` vectors come back."""
    got = parts.groupBy("k").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).select(
        "k", vector_to_array("sums").alias("sums")).toArrow()
    if not got.num_rows:
        raise ValueError("no rows to fit")
    out = [None] * size
    for k, sums in zip(got["k"].to_pylist(), got["sums"].combine_chunks()):
        out[k] = sums.values.to_numpy()
    return np.array(out) if len({len(x) for x in out}) == 1 else out


# Bound of the second derivative of each loss.
_BEND = {"hinge": 2.0, "softmax": 0.25, "squares": 1.0}


def solve(blocks: DataFrame, terms: int, problems: Sequence[Problem], max_iter: int,
          tolerance: float, evaluate: Callable | None = None,
          bends: Curvature | None = None) -> list[np.ndarray]:
    """(terms + 1) x classes weights of every problem, the intercept last.

    A problem is solved when no entry of its mean gradient exceeds the tolerance.
    """
    if evaluate is None:
        bends, evaluate = curvature(blocks, terms), evaluator(blocks, terms)

    def begin(k: int, start: np.ndarray | None = None) -> _Descent:
        p = problems[k]
        first = np.zeros((terms + 1, p.classes)) if start is None else start
        return _Descent(p, first, bends.inverse(_BEND[p.loss] * p.c), tolerance * p.c * bends.rows)

    open_ = {k: begin(k) for k, p in enumerate(problems) if p.after is None}
    solved: dict[int, np.ndarray] = {}
    while open_:
        got = evaluate([(d.problem, d.trial) for d in open_.values()])
        for (k, d), (loss, gradient) in zip(list(open_.items()), got):
            d.take(loss, gradient)
            if d.done or d.steps > max_iter:
                solved[k] = d.point
                del open_[k]
                open_.update((j, begin(j, d.point)) for j, p in enumerate(problems)
                             if p.after == k)
    return [solved[k] for k in range(len(problems))]
