"""TF-IDF features, the classifiers and regressors on them, and the direction models."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.let import let
from sentivane.operators import linear, newton
from sentivane.operators.metrics import binary_metrics
from sentivane.operators.ordering import exact_floor, rank_cuts
from sentivane.operators.quality import require_columns
from sentivane.session import one_row, small_table, stage
from sentivane.vocab import WORD

TERM = f"[{WORD}]{{2,}}"
MAX_FEATURES = 10_000
# Buckets of the first count of terms, the parts their sums are dealt out in, how many buckets per
# wanted term are looked at first, and the words a worker looks at together.
BUCKET_BITS, BUCKET_PARTS, FULLEST, WORDS_AT_ONCE = 20, 64, 2, 500_000
# The regularisation grid.
C_GRID = [0.01, 0.1, 1.0, 10.0]
# Iteration limits; fits end earlier when they change less than the tolerance.
MAX_ITER = {"logreg": 1000, "svm": 2000, "nb": 1}
TOLERANCE = 1e-4
# Folds of the calibration: every sigmoid is fitted on the fold its margins have not seen.
FOLDS = 3


def terms(text: Column) -> Column:
    """Lower-case words of two or more characters, then their neighbouring pairs."""
    def with_pairs(one: Column) -> Column:
        pairs = F.zip_with(
            F.slice(one, F.lit(1), F.greatest(F.size(one) - 1, F.lit(0))),
            F.slice(one, F.lit(2), F.greatest(F.size(one) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(one, pairs)

    return let(words(text), with_pairs)


def words(text: Column) -> Column:
    """The lower-case words that `terms` begins with."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _slices(batches, words: int):
    """Parts of Arrow batches with about so many words, so that a worker's memory is bounded."""
    for b in batches:
        size = pc.fill_null(pc.list_value_length(b.column("hash")), 0).to_numpy()
        part = np.cumsum(size) // words
        starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), b.num_rows]
        for i, j in zip(starts, starts[1:]):
            yield b.slice(i, j - i)


def _word_buckets(b: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every word; place of every pair's first word, and the pair's bucket."""
    size = pc.fill_null(pc.list_value_length(b.column("hash")), 0).to_numpy()
    row = np.repeat(np.arange(b.num_rows), size)
    h = b.column("hash").flatten().to_numpy().view(np.uint64)
    at = np.flatnonzero(row[1:] == row[:-1])
    shift = np.uint64(64 - bits)
    pair = h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    return row, (h >> shift).astype(np.int32), at, (pair >> shift).astype(np.int32)


def _bucket_sizes(docs: DataFrame) -> np.ndarray:
    """Occurrences of words and pairs per bucket of a hash; a fixed number of sums."""
    bits, parts, at_once = BUCKET_BITS, BUCKET_PARTS, WORDS_AT_ONCE

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in _slices(batches, at_once):
            _, word, _, pair = _word_buckets(b, bits)
            total += np.bincount(word, minlength=len(total))
            total += np.bincount(pair, minlength=len(total))
        sums = np.split(total.astype(np.float64), parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array(sums, pa.list_(pa.float64()))],
            ["k", "sums"])

    return linear.summed(docs.select("hash").mapInArrow(run, "k int, sums array<double>"),
                         parts).ravel()


def term_counts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, tf, df): occurrences and documents of the terms in the wanted buckets (one flag each)."""
    packed, bits, at_once = np.packbits(wanted), BUCKET_BITS, WORDS_AT_ONCE

    def run(batches):
        wanted = np.unpackbits(packed).astype(bool)
        for b in _slices(batches, at_once):
            row, word, at, pair = _word_buckets(b, bits)
            one, at = np.flatnonzero(wanted[word]), at[wanted[pair]]
            names = b.column("words").flatten()
            found = pa.concat_arrays([names.take(pa.array(one)), pc.binary_join_element_wise(
                names.take(pa.array(at)), names.take(pa.array(at + 1)), " ")]).dictionary_encode()
            code, n = found.indices.to_numpy(), len(found.dictionary)
            each = np.unique(np.concatenate([row[one], row[at]]) * n + code)
            yield pa.RecordBatch.from_arrays(
                [found.dictionary, pa.array(np.bincount(code, minlength=n)),
                 pa.array(np.bincount(each % max(n, 1), minlength=n))], ["term", "tf", "df"])

    return docs.select("words", "hash").mapInArrow(
        run, "term string, tf bigint, df bigint").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def top_counts(docs: DataFrame, size: int) -> DataFrame:
    """(term, tf, df) of the `size` most frequent words and pairs, equals by name; exact.

    Most terms are rare pairs, which are not shuffled.  A first scan counts the occurrences per
    bucket of a hash: no term has more than its bucket.  Then terms are counted in the fullest
    buckets.  A bucket with fewer occurrences than the last of the `size` terms found there holds
    none of the first; if others reach that number, a last scan counts in all that do.
    """
    hashed = docs.select("words", F.transform("words", lambda w: F.xxhash64(w)).alias("hash"))
    sizes = _bucket_sizes(hashed)
    bound = max(1, int(np.sort(sizes)[-min(FULLEST * size, len(sizes))]))
    while True:
        found = term_counts(hashed, sizes >= bound)
        top = stage(found.orderBy(F.desc("tf"), F.asc("term")).limit(size), "terms")
        last = top.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
        # fewer terms than wanted: all buckets are looked at
        reach = last["tf"] if last["n"] == size else 1
        if reach >= bound:
            return top
        bound = reach


def vocabulary(docs: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """The `size` most frequent terms of `words`, with idf = ln((1 + n) / (1 + df)) + 1; equals by
    name."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    top = top_counts(docs, size).orderBy(F.desc("tf"), F.asc("term"))
    return top.select(
        "term", "tf", "df",
        (F.log((1 + n).cast("double") / (1 + F.col("df")).cast("double")) + 1).alias("idf"))


class TfIdf:
    """Vector features.  The vocabulary (at most `size` terms) is the only thing collected.

    A fit scans its documents three times: write costly ones first.
    """

    def __init__(self, size: int = MAX_FEATURES):
        self.size = size

    def fit(self, docs: DataFrame, text: str = "text") -> "TfIdf":
        rows = docs.select(words(F.col(text)).alias("words"))
        vocab = vocabulary(rows, self.size).collect()
        self.terms = [r["term"] for r in vocab]
        idf = Vectors.dense([r["idf"] for r in vocab])
        counts = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="terms", outputCol="_tf")
        self.stages = [
            counts,
            ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf"),
            Normalizer(p=2.0, inputCol="_tfidf", outputCol="features"),
        ]
        return self

    def transform(self, docs: DataFrame, text: str = "text",
                  keep: Sequence[str] = ()) -> DataFrame:
        out = docs.withColumn("terms", terms(F.col(text)))
        for stage in self.stages:
            out = stage.transform(out)
        return out.drop(*[c for c in ("terms", "_tf", "_tfidf") if c not in keep])


def tfidf_long(docs: DataFrame, id_col: str, size: int = MAX_FEATURES) -> DataFrame:
    """(id, term, tf, tfidf) with L2-normalised weights, as a table.

    A text is one row, so its terms are counted and normalised inside the row; only the counts of
    the vocabulary are shuffled.
    """
    fitted = TfIdf(size).fit(docs)
    rows = fitted.transform(docs, keep=("_tf",)).select(
        id_col, F.unwrap_udt("_tf").alias("n"), F.unwrap_udt("features").alias("w"))
    each = rows.select(id_col, F.explode(F.arrays_zip(
        F.col("n.indices").alias("term"), F.col("n.values").alias("tf"),
        F.col("w.values").alias("tfidf"))).alias("t"))
    names = F.lit(fitted.terms) if fitted.terms else F.array().cast("array<string>")
    return each.select(id_col, F.get(names, F.col("t.term")).alias("term"),
                       F.col("t.tf").cast("bigint").alias("tf"), "t.tfidf")


def sparse_margins(weights: np.ndarray, features: Column) -> Column:
    """Array with the products of a sparse vector and every column of weights (intercept last)."""
    entries = linear.BLOCK_ENTRIES

    @F.arrow_udf("array<double>")
    def products(term: pa.Array, value: pa.Array) -> pa.Array:
        size = np.diff(term.offsets.to_numpy())
        out = np.tile(weights[-1], (len(size), 1))
        at, v = term.flatten().to_numpy(), value.flatten().to_numpy()
        full = np.flatnonzero(size)
        ends = np.cumsum(size)
        # some rows at a time: the products take entries x columns numbers
        part = ends[full] // entries
        for rows in np.split(full, np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                low, high = ends[rows[0]] - size[rows[0]], ends[rows[-1]]
                out[rows] += np.add.reduceat(
                    v[low:high, None] * weights[at[low:high]], ends[rows] - size[rows] - low)
        return pa.FixedSizeListArray.from_arrays(out.ravel(), out.shape[1]).cast(
            pa.list_(pa.float64()))

    return products(*sparse_parts(features))


def sparse_parts(features: Column) -> tuple[Column, Column]:
    """(terms, values) of a vector."""
    v = F.unwrap_udt(features)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


class TextClassifier:
    """TF-IDF and one of: logreg, svm (one against the rest, calibrated in 3 folds), nb.

    logreg and svm are problems of `linear.solve`; nb is a table of sums.
    """

    def __init__(self, kind: str = "logreg", c: float = 1.0, alpha: float = 1.0,
                 size: int = MAX_FEATURES, max_iter: int | None = None):
        self.kind, self.c, self.alpha = kind, c, alpha
        self.size, self.max_iter = size, max_iter or MAX_ITER[kind]

    def fit(self, train: DataFrame, text: str = "text", label: str = "sentiment_label"):
        train = train.filter(F.col(label).isNotNull())
        tfidf = TfIdf(self.size).fit(train, text)
        return self.fit_features(tfidf, tfidf.transform(train, text), text, label)

    def fit_features(self, tfidf: TfIdf, rows: DataFrame, text: str = "text",
                     label: str = "sentiment_label"):
        """As `fit`, on rows that already carry the `features` of `tfidf`."""
        self._classes(tfidf, rows, text, label)
        if self.kind == "nb":
            self.weights = class_weights(
                rows, label, self.labels, len(tfidf.terms), self.alpha)
            return self
        with packed_rows(rows, self.labels, text, label) as blocks:
            n, k = len(tfidf.terms), len(self.labels)
            if self.kind == "logreg":
                problems = [linear.Problem("softmax", self.c, k)]
            else:
                problems = [linear.Problem("hinge", self.c, positive=i, without_fold=f)
                            for f in range(FOLDS) for i in range(k)]
            self.weights = np.concatenate(
                linear.solve(blocks, n, problems, self.max_iter, TOLERANCE), 1)
            if self.kind == "svm":
                self.sigmoids = calibrated(blocks, self.weights, k)
        return self

    def _classes(self, tfidf, rows, text, label) -> None:
        self.text, self.tfidf = text, tfidf
        # class names: one row per class
        self.labels = sorted(r[0] for r in rows.select(label).distinct().collect())
        if len(self.labels) < 2:
            raise ValueError("training needs at least two classes")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `pred` and `probabilities` (in order of `self.labels`)."""
        return self.score(self.tfidf.transform(df, self.text))

    def score(self, out: DataFrame) -> DataFrame:
        """As `transform`, on rows that already carry the features."""
        k = len(self.labels)
        margins = sparse_margins(self.weights, F.col("features"))

        def shares(parts: list[Column]) -> Column:
            return let(F.array(*parts), lambda a: F.transform(
                a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))

        def probabilities(m: Column) -> Column:
            if self.kind != "svm":
                return let(m, lambda v: shares(
                    [F.exp(F.get(v, i) - F.array_max(v)) for i in range(k)]))
            # every fold's classes sum to one, then the folds are averaged
            folds = [shares([newton.sigmoid(
                F.get(m, f * k + i) * float(self.sigmoids[f * k + i, 0])
                + float(self.sigmoids[f * k + i, 1])) for i in range(k)]) for f in range(FOLDS)]
            return F.array(*[sum((F.get(x, i) for x in folds), F.lit(0.0)) / FOLDS
                             for i in range(k)])

        out = out.withColumn("_margins", margins).withColumn(
            "probabilities", let(F.col("_margins"), probabilities)).drop("_margins")
        best = F.array_position("probabilities", F.array_max("probabilities"))
        return out.withColumn("pred", F.get(F.lit(self.labels), best.cast("int") - 1)).drop(
            "features")


@contextmanager
def packed_rows(rows: DataFrame, labels: Sequence[str], text: str, label: str):
    """The rows as blocks for `linear.solve`, kept while the passes run over them."""
    index = F.array_position(F.lit(list(labels)), F.col(label)) - 1
    # the text itself only deals out the folds
    blocks = linear.packed(rows.select(
        "features", index.alias("label"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).alias("fold")),
        fold="fold").persist()
    try:
        yield blocks
    finally:
        blocks.unpersist()


def calibrated(blocks: DataFrame, weights: np.ndarray, classes: int) -> np.ndarray:
    """(slope, intercept) of a sigmoid per column of weights, fitted on the fold it has not seen.

    Targets are drawn in a little from 0 and 1 by the sizes of both sides, after Platt.
    """
    columns = weights.shape[1]

    def held(batches):
        for block in linear.blocks_of(batches):
            margin = block.margins(weights)
            model = block.fold[:, None] * classes + np.arange(classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.ravel().astype(np.int32)),
                 pa.array((block.target[:, None] == np.arange(classes)).ravel()),
                 pa.array(np.take_along_axis(margin, model, 1).ravel())],
                ["model", "hit", "margin"])

    rows = blocks.mapInArrow(held, "model int, hit boolean, margin double").persist()
    try:
        hits = {r["model"]: (r["hits"], r["n"]) for r in rows.groupBy("model").agg(
            F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
        high = [(hits.get(j, (0, 0))[0] + 1.0) / (hits.get(j, (0, 0))[0] + 2.0)
                for j in range(columns)]
        low = [1.0 / (n - h + 2.0) for h, n in (hits.get(j, (0, 0)) for j in range(columns))]
        target = F.when(F.col("hit"), F.get(F.lit(high), F.col("model"))).otherwise(
            F.get(F.lit(low), F.col("model")))
        return newton.logistic(
            rows.select("model", target.alias("y"), F.array("margin").alias("x")),
            columns, 1, ridge=0.0, tolerance=1e-6)
    finally:
        rows.unpersist()


def class_weights(rows: DataFrame, label: str, labels: Sequence[str], terms: int,
                  alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes: log of the smoothed share of every term in a class; last the class's log prior.

    The sums per (class, term) are a table; it has at most `terms` x classes rows.
    """
    term, value = sparse_parts(F.col("features"))
    each = rows.select(F.col(label).alias("class"), F.posexplode(F.arrays_zip(
        term.alias("term"), value.alias("value"))).alias("at", "v"))
    sums = each.groupBy("class", F.col("v.term").alias("term")).agg(
        F.sum("v.value").alias("total")).toArrow()
    sizes = dict(rows.groupBy(label).count().collect())
    place = {name: i for i, name in enumerate(labels)}
    total = np.zeros((terms, len(labels)))
    column = np.array([place[c] for c in sums["class"].to_pylist()], np.int64)
    total[sums["term"].to_numpy(), column] = sums["total"].to_numpy()
    total += alpha
    prior = np.log([sizes[name] / sum(sizes.values()) for name in labels])
    return np.vstack([np.log(total) - np.log(total.sum(0)), prior])


def top_features(model: TextClassifier, spark, n: int = 10) -> DataFrame:
    """(class, rank, term, weight): strongest terms per class of a fitted logreg."""
    rows = []
    for i, name in enumerate(model.labels):
        weights = list(zip(model.weights[:-1, i].tolist(), model.tfidf.terms))
        weights.sort(key=lambda x: (-x[0], x[1]))
        rows += [(name, k + 1, t, w) for k, (w, t) in enumerate(weights[:n])]
    return small_table(spark, rows, "class string, rank int, term string, weight double")


def grid_search(train: DataFrame, val: DataFrame, kind: str = "logreg",
                grid: Sequence[float] = C_GRID, label: str = "sentiment_label",
                **kw) -> DataFrame:
    """(c, macro_f1) on the validation rows, best first.

    Features are fitted once and all C share the passes; the others start from the solution of the
    least C.  Validation rows are scored once for all C.
    """
    from sentivane.operators.metrics import classification_metrics

    spark = train.sparkSession
    tfidf = TfIdf(kw.get("size", MAX_FEATURES)).fit(train)
    seen = tfidf.transform(train.filter(F.col(label).isNotNull()))
    cs = sorted(set(map(float, grid)))
    models = [TextClassifier(kind, c=c, **kw) for c in cs]
    if kind == "logreg":
        models[0]._classes(tfidf, seen, "text", label)
        k = len(models[0].labels)
        problems = [linear.Problem("softmax", c, k, after=0 if j else None)
                    for j, c in enumerate(cs)]
        with packed_rows(seen, models[0].labels, "text", label) as blocks:
            solved = linear.solve(
                blocks, len(tfidf.terms), problems, models[0].max_iter, TOLERANCE)
        for model, weights in zip(models, solved):
            model.text, model.tfidf, model.labels = "text", tfidf, models[0].labels
            model.weights = weights
    else:
        for model in models:
            model.fit_features(tfidf, seen, label=label)
    held = stage(tfidf.transform(val).select(label, "features"), "held")
    scored = [model.score(held).select(F.lit(model.c).alias("c"), F.col(label).alias("truth"), "pred")
              for model in models]
    return classification_metrics(reduce(DataFrame.unionByName, scored), ["c"]).select(
        "c", "macro_f1").orderBy(F.desc("macro_f1"), "c")


def teacher_guard(df: DataFrame, kind: str) -> str:
    """Name of the teacher column; raises where labels would come from the truth."""
    if kind == "regression":
        require_columns(df, ["teacher_soft_score"])
        return "teacher_soft_score"
    for name in ("teacher_majority_label", "dominant_label"):
        if name in df.columns:
            return name
    raise ValueError("classification needs teacher_majority_label or dominant_label")


class StudentRegressor:
    """Squared-error regression of the teacher's soft score on TF-IDF features."""

    def __init__(self, size: int = MAX_FEATURES, reg: float = 1e-3,
                 max_iter: int = 1000):
        self.size, self.reg, self.max_iter = size, reg, max_iter

    def fit(self, weak: DataFrame, text: str = "text") -> "StudentRegressor":
        target = teacher_guard(weak, "regression")
        self.text = text
        self.tfidf = TfIdf(self.size).fit(weak, text)
        rows = self.tfidf.transform(weak, text).select("features", F.col(target).alias("label")) \
            .dropna(subset=["label"])
        blocks = linear.packed(rows).persist()
        try:
            bends = linear.curvature(blocks, len(self.tfidf.terms))
            # mean squared error with `reg` against a sum with C
            problem = linear.Problem("squares", 1.0 / (self.reg * max(bends.rows, 1.0)))
            self.weights, = linear.solve(
                blocks, len(self.tfidf.terms), [problem], self.max_iter, TOLERANCE,
                linear.evaluator(blocks, len(self.tfidf.terms)), bends)
        finally:
            blocks.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.tfidf.transform(df, self.text)
        return out.withColumn(
            "score", F.get(sparse_margins(self.weights, F.col("features")), 0)).drop("features")


class StudentClassifier(TextClassifier):
    """Logistic regression of the teacher's majority label."""

    def fit(self, train: DataFrame, text: str = "text", label: str | None = None):
        return super().fit(train, text, label or teacher_guard(train, "classification"))


DIRECTION_MODELS = {
    "F3_market_only": ["lag_return_1d"],
    "F4_sentiment_only": ["mean_sentiment", "post_count"],
    "F5_combined": ["lag_return_1d", "mean_sentiment", "post_count"],
}
DIRECTION_FEATURES = DIRECTION_MODELS["F5_combined"]


def _direction_rows(joint: DataFrame, horizon: int, order: str, min_rows: int) -> DataFrame | None:
    """(model, name, x, label, train): every row once per model; None where nothing can be fitted."""
    target = f"fwd_direction_{horizon}d"
    rows = stage(joint.dropna(subset=[*DIRECTION_FEATURES, target]).select(
        "ticker", "trading_date", *[F.col(c).cast("double") for c in DIRECTION_FEATURES],
        F.col(target).cast("double").alias("label")), "direction")
    n = rows.count()
    if n < min_rows:
        return None
    keys = ["trading_date", "ticker"] if order == "time" else ["ticker", "trading_date"]
    k = exact_floor(n, 0.8)
    cut = rank_cuts(rows, keys[:1], keys, [k])[k]
    limit = F.struct(*[
        F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(keys, cut)])
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("model"), F.lit(name).alias("name"), F.array(*[
            F.col(c) if c in used else F.lit(0.0) for c in DIRECTION_FEATURES]).alias("x"))
        for i, (name, used) in enumerate(DIRECTION_MODELS.items())])).alias("m")
    out = rows.select("label", (F.struct(*keys) < limit).alias("train"), each).select(
        "m.*", "label", "train")
    sides = {r["train"]: r for r in out.groupBy("train").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    if len(sides) < 2 or any(r["low"] == r["high"] for r in sides.values()):
        return None
    return out


def _direction_weights(rows: DataFrame) -> np.ndarray:
    return newton.logistic(
        rows.filter("train").select("model", F.col("label").alias("y"), "x"),
        len(DIRECTION_MODELS), len(DIRECTION_FEATURES))


def direction_coefficients(joint: DataFrame, horizon: int = 1, order: str = "time",
                           min_rows: int = 30) -> DataFrame:
    """(model, term, weight) of the direction models, their intercepts among them."""
    spark = joint.sparkSession
    rows = _direction_rows(joint, horizon, order, min_rows)
    out = []
    if rows is not None:
        weights = _direction_weights(rows)
        for (name, used), w in zip(DIRECTION_MODELS.items(), weights.tolist()):
            out += [(name, c, v) for c, v in zip([*DIRECTION_FEATURES, "intercept"], w)
                    if c in used or c == "intercept"]
    return small_table(spark, out, "model string, term string, weight double")


def direction_models(joint: DataFrame, horizon: int = 1, order: str = "time",
                     min_rows: int = 30) -> DataFrame:
    """Up/down models on the first 80 % of rows, scored on the rest; empty if data are too few.

    Logistic regressions with a ridge of 1, all fitted by the same Newton passes.
    `order="time"` cuts by date; `order="table"` cuts the table ordered by ticker and date.
    """
    rows = _direction_rows(joint, horizon, order, min_rows)
    if rows is None:
        return small_table(
            joint.sparkSession, [], "model string, accuracy double, auc_roc double, "
            "f1_score double, train_size bigint, test_size bigint")
    score = newton.sigmoid(newton.linear(_direction_weights(rows), F.col("model"), F.col("x")))
    scored = rows.filter(~F.col("train")).select(
        F.col("name").alias("model"), F.col("label").cast("bigint").alias("truth"),
        score.alias("score"))
    sizes = rows.filter("model = 0").agg(F.count_if("train").alias("n"))
    return binary_metrics(scored, by=["model"]).select(
        "model", "accuracy", "auc_roc", "f1_score",
        one_row(sizes)["n"].alias("train_size"), F.col("n").alias("test_size"))
