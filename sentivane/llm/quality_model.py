"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a row of transformed statistics (`STATISTICS`): logarithms of sizes, logarithms of
floored shares.  Each class has its mean and covariance; the covariance is shrunk towards its mean variance
times the identity, by the intensity of Ledoit and Wolf, which follows from the data.  The score is
the posterior of label 1: a sigmoid of the difference of the two Gaussian log densities, each a
Mahalanobis distance and a log determinant from a Cholesky factor that is kept in the model.

Features are taken once per text and written (`featurised`); the classes' moments are two distributed
sums over all labelled rows, first of z and z z', then, about the means, of |z|^4.  Nothing is
sampled; the driver gets one number per entry of the moments.

Null texts count as empty; an empty text has finite statistics and is scored like any other.  Rows
are scored one by one, so repeated rows have equal scores and there are no ties to break.  An id with
both labels teaches both classes; a document id that occurs more than once teaches with every row.
Null labels and ids teach nothing.  Without two rows of each class nothing can be learned: every
score is the share of label 1 (0.5 without labels).  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.llm.texts import LOWER, by_batches, narrow, raw
from sentivane.session import stage

# A label is held out where crc32(id as text) mod FOLDS is 0; score from which a text is good.
FOLDS, THRESHOLD = 5, 0.3
STATISTICS = ("words", "word_bytes", "upper", "marks", "shouts", "digits", "beyond_ascii",
              "repeated_windows", "repeated_lines", "distinct_words", "bytes_per_line", "stops")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_MARKS = b"#*$%&|<>@^~_={}[]\\/+"
_SHOUTS = b"!?"
_DIGITS = b"0123456789"
_ASCII = bytes(range(128))
FLOOR = 0.02


def _share(part: float, whole: float) -> float:
    """Logarithm of a share above a floor, which hides differences that say nothing."""
    return float(np.log(part / max(whole, 1) + FLOOR))


def statistics(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of one text."""
    size = len(text)
    words = text.translate(LOWER).split()
    n = len(words)
    of = lambda signs: size - len(text.translate(None, signs))
    letters = of(_LETTERS)
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = sum(map(len, words))
    return (
        float(np.log1p(n)), float(np.log1p(solid / max(n, 1))),
        _share(of(_UPPER), letters), _share(of(_MARKS), solid), _share(of(_SHOUTS), solid),
        _share(of(_DIGITS), solid), _share(size - of(_ASCII), size),
        _share(len(windows) - len(set(windows)), len(windows)),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(set(words))) - np.log1p(n)),
        float(np.log1p(size / max(len(lines), 1))),
        _share(text.count(b".") + text.count(b","), n),
    )


def featurised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, z array<double>) of every row."""

    def run(batches):
        for b in batches:
            z = np.array([statistics(t) for t in raw(b.column(1))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(
                    np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], z.ravel())], ["id", "z"])

    rows = by_batches(narrow(docs, id_col, text_col), run, "id bigint, z array<double>")
    return rows.select("id", held_out("id").alias("held_out"), "z")


def held_out(id_col: str) -> Column:
    return F.coalesce(
        F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _class_sums(rows: DataFrame, per_rows, size: int) -> np.ndarray:
    """Sums over the rows (label, z) of each class of what `per_rows(label, z)` makes of them."""

    def run(batches):
        total = np.zeros((2, size))
        for b in batches:
            if b.num_rows:
                label, z = b.column(0).to_numpy(), _matrix(b.column(1))
                for k in (0, 1):
                    total[k] += per_rows(k, z[label == k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(2 * size, dtype=np.int32)), pa.array(total.ravel())],
            ["at", "value"])

    # 2 x `size` rows, however many rows were summed
    got = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")).toArrow()
    out = np.zeros(2 * size)
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out.reshape(2, size)


@dataclass(frozen=True)
class Model:
    """Per class the mean and the inverse Cholesky factor of the covariance, in scaled statistics."""

    shift: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    inverse: tuple[np.ndarray, ...]
    log_odds: float

    def score(self, z: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for every row; equal rows get equal scores."""
        odds = np.full(len(z), self.log_odds)
        if self.means:
            z = (z - self.shift) / self.scale
            for sign, mean, inverse in zip((-1, 1), self.means, self.inverse):
                c = z - mean
                # column by column: the sum of a row doesn't depend on the rows beside it
                u = sum(c[:, j:j + 1] * inverse[:, j] for j in range(c.shape[1]))
                density = np.log(np.diag(inverse)).sum() - 0.5 * np.square(u).sum(1)
                odds = odds + sign * density
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The discriminant of all labelled rows that are not held out."""
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y")
    ).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).dropDuplicates()
    rows = features.filter(~F.col("held_out")).join(known, "id").select("y", "z")
    p = len(STATISTICS)
    one = _class_sums(rows, lambda k, z: np.concatenate(
        [[len(z)], z.sum(0), (z.T @ z).ravel()]), 1 + p + p * p)
    n = one[:, 0]
    if n.min() < 2:
        odds = 0.0 if not n.sum() else float(np.log((n[1] + 1e-300) / (n[0] + 1e-300)))
        return Model(np.zeros(p), np.ones(p), (), (), odds)
    sums, squares = one[:, 1:p + 1], one[:, p + 1:].reshape(2, p, p)
    shift = sums.sum(0) / n.sum()
    variance = np.diag(squares.sum(0)) / n.sum() - shift * shift
    # a statistic that is the same in all rows says nothing
    scale = np.sqrt(np.where(variance > 1e-9, variance, np.inf))
    raw_means = sums / n[:, None]
    means = (raw_means - shift) / scale
    covariances = (squares / n[:, None, None] - raw_means[:, :, None] * raw_means[:, None, :]) \
        / np.outer(scale, scale)
    fourth = _class_sums(rows, lambda k, z: np.square(np.square(
        (z - raw_means[k]) / scale).sum(1)).sum(keepdims=True), 1)[:, 0]
    inverse = tuple(np.linalg.inv(np.linalg.cholesky(shrunk(s, f, m)))
                    for s, f, m in zip(covariances, fourth, n))
    return Model(shift, scale, tuple(means), inverse, float(np.log(n[1] / n[0])))


def shrunk(covariance: np.ndarray, fourth: float, n: float, least: float = 1e-4) -> np.ndarray:
    """Ledoit and Wolf: the covariance drawn towards its mean variance times the identity.

    `fourth` is the sum over the rows of the centred rows' fourth powers of length.
    """
    p = len(covariance)
    level = max(float(np.trace(covariance)) / p, least)
    target = level * np.eye(p)
    spread = float(np.square(covariance - target).sum())
    noise = max(0.0, fourth / n ** 2 - float(np.square(covariance).sum()) / n)
    part = min(1.0, max(least, noise / spread if spread > 0 else 1.0))
    return (1 - part) * covariance + part * target


def score(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s),
                 pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of their labels; the texts are read once."""
    features = stage(featurised(docs), "statistics")
    return score(features, fit(features, labels))
