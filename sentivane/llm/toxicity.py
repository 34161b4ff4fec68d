"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight per word is shared by all thresholds: P(grade >= k) = sigmoid(x w - theta_k) with rising
thetas.  The expected severity is the sum of these probabilities.

Labels say toxic or not.  A labelled toxic text gets its grade from how many words it has that the
sample's toxic side uses and its clean side (nearly) never does: thirds of that count over the toxic
texts give grades 1, 2 and 3; clean texts have grade 0.

The model is fitted on at most `SAMPLE_ROWS` labelled rows, half of each class as far as there are
any, chosen by the hash of their id; everything is scored.  Features are all words and
beginnings of words that `MIN_TEXTS` of these rows have and whose chi-squared with the class is at least `SURE`, whatever their number.  The fit (L-BFGS) ends when no entry of the mean gradient exceeds `TOLERANCE`.
Null and empty texts have no features and get the severity of the thresholds alone.  Rows are scored
one by one: repeated rows have equal severities, and equal severities equal grades, so there are no
ties to break; a labelled id that occurs in several rows teaches with each.  Without labels of both
classes nothing can be learned: severity 0, not toxic.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.llm.texts import LOWER, by_batches, narrow, raw
from sentivane.session import stage

SAMPLE_ROWS = 4_000
MIN_TEXTS = 3
TOLERANCE, MAX_STEPS = 1e-5, 1_000
SURE = 10.0
# Bytes of a word's beginning that count as a feature too: forms of a word share it.
STEM = 5
GRADES = 3
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_CLEAR = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))
TABLE = LOWER.translate(_CLEAR)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII punctuation, and the beginnings of longer ones."""
    words = text.translate(TABLE).split()
    return words + [w[:STEM] + b"*" for w in words if len(w) > STEM]


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    theta: tuple[float, ...]

    def score(self, text: bytes) -> tuple[float, int, bool]:
        """Expected severity, grade, toxic."""
        if not self.theta:
            return 0.0, 0, False
        seen = Counter(filter(self.weights.__contains__, tokens(text)))
        s = sum(self.weights[w] * float(np.log1p(c)) for w, c in sorted(seen.items()))
        p = [1.0 / (1.0 + float(np.exp(min(50.0, t - s)))) for t in self.theta]
        return sum(p), sum(x >= 0.5 for x in p), p[0] >= 0.5


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, text, toxic) of at most `rows` labelled documents."""
    picked = [
        labels.filter(F.col("toxic") == side).select(
            F.col("doc_id").cast("bigint").alias("id"), F.lit(side).alias("toxic"))
        .dropna().orderBy(F.xxhash64("id"), "id").limit(rows // 2)
        for side in (0, 1)
    ]
    ids = picked[0].union(picked[1]).dropDuplicates(["id"])
    # at most `rows` ids of a few bytes
    return narrow(docs, "doc_id", "text").join(F.broadcast(ids), "id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, min_texts: int = MIN_TEXTS,
        grades: int = GRADES, l2: float = 0.3, tolerance: float = TOLERANCE) -> Model:
    def count(batches):
        for b in batches:
            bags = [Counter(tokens(t)) for t in raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("toxic"),
                 pa.array([list(c) for c in bags], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in bags], pa.list_(pa.int32()))],
                ["id", "toxic", "words", "counts"])

    bags = stage(by_batches(
        sample(docs, labels, rows).select("id", "toxic", "text"), count,
        "id bigint, toxic int, words array<binary>, counts array<int>"), "bags")
    # words that several texts of the bounded sample have
    used = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("y")).filter(
        F.col("x") + F.col("y") >= min_texts).orderBy("word").toArrow()
    sides = dict(bags.groupBy("toxic").count().collect())
    if len(sides) < 2:
        return Model({}, ())
    a, c = sides[1], sides[0]
    x, y = used["x"].to_numpy().astype(float), used["y"].to_numpy().astype(float)
    both, size = x + y, a + c
    evidence = size * (x * c - y * a) ** 2 / (both * np.maximum(size - both, 1) * a * c)
    sure = np.flatnonzero(evidence >= SURE)
    words, with_toxic, with_clean = used["word"].take(pa.array(sure)).to_pylist(), x[sure], y[sure]
    index = {w: i for i, w in enumerate(words)}

    def number(batches):
        for b in batches:
            known = [[(index[w], n) for w, n in zip(ws, ns) if w in index]
                     for ws, ns in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([[i for i, _ in k] for k in known], pa.list_(pa.int32())),
                 pa.array([[n for _, n in k] for k in known], pa.list_(pa.int32()))],
                ["id", "toxic", "at", "n"])

    # at most `rows` rows of numbers
    got = by_batches(bags, number, "id bigint, toxic int, at array<int>, n array<int>").toArrow()
    keys = [got["id"].to_numpy(), got["toxic"].to_numpy()]
    order = np.lexsort([[hash(tuple(v)) for v in got["at"].to_pylist()], keys[1], keys[0]])
    got = got.take(pa.array(order))
    toxic = got["toxic"].to_numpy().astype(bool)
    at, n = got["at"].combine_chunks(), got["n"].combine_chunks()
    row = np.repeat(np.arange(len(toxic)), np.diff(at.offsets.to_numpy()))
    col, times = at.flatten().to_numpy(), n.flatten().to_numpy()
    marks = (with_toxic >= 3) & (with_clean * 20 <= with_toxic * (c / a))
    hits = np.bincount(row, times * marks[col], len(toxic))
    cuts = np.quantile(hits[toxic], np.arange(1, grades) / grades)
    y = np.where(toxic, 1 + (hits[:, None] > cuts).sum(1), 0)
    w, theta = _ordinal(row, col, np.log1p(times), y, len(words), grades, l2, tolerance)
    return Model(dict(zip(words, w.tolist())), tuple(theta.tolist()))


def _ordinal(row, col, val, y, n_words, grades, l2, tolerance):
    """Weights and thresholds of the greatest penalised likelihood."""
    n = len(y)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    rows = np.arange(n)
    # both classes weigh the same, however many of each the sample has
    each = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y == 0).sum()))

    def thetas(p):
        return np.cumsum(np.concatenate([p[n_words:n_words + 1], np.exp(p[n_words + 1:])]))

    def loss(p):
        """Mean penalised loss and its gradient."""
        w = p[:n_words]
        s = np.bincount(row, val * w[col], n)
        above = np.concatenate(
            [np.ones((n, 1)), sig(s[:, None] - thetas(p)), np.zeros((n, 1))], 1)
        hi, lo = above[rows, y], above[rows, y + 1]
        prob = np.maximum(hi - lo, 1e-12)
        slope = each * (1 - hi - lo)
        by = np.zeros((n, grades + 2))
        by[rows, y] -= each * hi * (1 - hi) / prob
        by[rows, y + 1] += each * lo * (1 - lo) / prob
        by = by[:, 1:-1].sum(0)
        gaps = np.array([by[k:].sum() for k in range(grades)])
        # the gaps have a faint penalty too, so that grades without rows keep finite thresholds
        free = p[n_words + 1:]
        gradient = np.concatenate([
            l2 * w - np.bincount(col, val * slope[row], n_words), -gaps[:1],
            1e-3 * free - gaps[1:] * np.exp(free)])
        value = -(each * np.log(prob)).sum() + 0.5 * l2 * (w @ w) + 5e-4 * (free @ free)
        return value / n, gradient / n

    p = _least(loss, np.zeros(n_words + grades), tolerance)
    return p[:n_words], thetas(p)


def _least(loss, p, tolerance, history=20):
    """L-BFGS with halved steps."""
    value, gradient = loss(p)
    pairs = []
    for _ in range(MAX_STEPS):
        if np.abs(gradient).max() <= tolerance:
            break
        q, factors = gradient.copy(), []
        for s, y, r in reversed(pairs):
            factors.append((s @ q) / r)
            q -= factors[-1] * y
        q *= pairs[-1][2] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / np.abs(gradient).max()
        for (s, y, r), f in zip(pairs, reversed(factors)):
            q += s * (f - (y @ q) / r)
        length, fall = 1.0, gradient @ q
        while True:
            there = p - length * q
            new, slope = loss(there)
            if new <= value - 1e-4 * length * fall or length < 1e-8:
                break
            length /= 2
        if new >= value:  # nothing left but rounding
            break
        s, y = there - p, slope - gradient
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - history:], (s, y, s @ y)]
        p, value, gradient = there, new, slope
    return p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row."""

    def run(batches):
        for b in batches:
            out = [model.score(t) for t in raw(b.column(1))]
            s, g, t = list(zip(*out)) or ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array(g, pa.int32()),
                 pa.array(t, pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return by_batches(narrow(docs, id_col, text_col), run,
                      "doc_id bigint, severity double, grade int, toxic boolean")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not model.score(t)[2] for t in raw(b.column(at))], pa.bool_()))

    return by_batches(docs, run, docs.schema)
