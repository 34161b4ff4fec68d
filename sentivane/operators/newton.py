"""Logistic regressions with a few numbers each, all models in one aggregate per Newton step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 100
TOLERANCE = 1e-10


def linear(weights: np.ndarray, model: Column, x: Column) -> Column:
    """Intercept (last) and weights of the row's model with the row's numbers."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    own = F.get(table, model)
    out = F.get(own, F.lit(weights.shape[1] - 1))
    for i in range(weights.shape[1] - 1):
        out = out + F.get(own, F.lit(i)) * F.get(x, F.lit(i))
    return out


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logistic(rows: DataFrame, models: int, size: int, ridge: float = 1.0,
             max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of every model, the intercept last and free of the ridge.

    `rows` has `model` (0 ...), `y` (0 to 1) and `x` (array of `size` numbers; a model that lacks a
    number has 0 there and gets weight 0).  A step sums the weighted Gram matrix, the gradient and
    the loss of every model in one pass; the driver gets one row per model.  A step that doesn't
    lower a model's loss is halved.
    """
    w = np.zeros((models, size + 1))
    point, value, step = w.copy(), np.full(models, np.inf), np.zeros_like(w)
    open_ = np.ones(models, bool)
    penalty = ridge * np.eye(size + 1)
    penalty[-1, -1] = 0.0
    pairs = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    for _ in range(max_steps):
        one = F.array_append(F.col("x"), F.lit(1.0))
        z = rows.select("model", "y", one.alias("x"), linear(w, F.col("model"), F.col("x")).alias("z"))
        mu = z.select("*", sigmoid(F.col("z")).alias("mu"))
        x = [F.get("x", F.lit(i)) for i in range(size + 1)]
        slope, bend = F.col("mu") - F.col("y"), F.col("mu") * (1 - F.col("mu"))
        loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest(F.col("z"), F.lit(0.0)) \
            - F.col("y") * F.col("z")
        sums = mu.groupBy("model").agg(
            F.sum(loss).alias("loss"), *[F.sum(slope * v).alias(f"g{i}") for i, v in enumerate(x)],
            *[F.sum(bend * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).collect()
        moved = False
        for row in sums:
            k = row["model"]
            if not open_[k]:
                continue
            now = row["loss"] + 0.5 * float(w[k] @ penalty @ w[k])
            if now > value[k] + 1e-12 * abs(value[k]):
                step[k] *= 0.5
            else:
                point[k], value[k] = w[k], now
                gradient = np.array([row[f"g{i}"] for i in range(size + 1)]) + penalty @ w[k]
                gram = penalty.copy()
                for i, j in pairs:
                    gram[i, j] += row[f"h{i}_{j}"]
                    gram[j, i] = gram[i, j]
                step[k] = -np.linalg.lstsq(gram, gradient, rcond=1e-14)[0]
            if np.abs(step[k]).max() <= tolerance * (1 + np.abs(point[k]).max()):
                open_[k] = False
            else:
                moved = True
            w[k] = point[k] + step[k] if open_[k] else point[k]
        if not moved:
            break
    return point
