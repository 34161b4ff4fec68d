"""Quality discriminant, periodic runs and whitening: brute force, edge cases, repeated rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentivane.llm import quality_model, whitening, word_runs

DOCS = "doc_id bigint, text string"


# ---- quality


def texts_of_two_kinds(n=240):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdeorst", k=rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(vocabulary, k=rnd.randint(20, 200))
        good = i % 4 > 0
        if good:
            text = " ".join(words) + "."
        elif i % 8:
            text = " ".join(w + "$$$" for w in words)
        else:
            text = " ".join(words[:9]).upper() * 20
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_learns_from_rows_that_are_not_held_out(spark):
    rows, labels = texts_of_two_kinds()
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (5, rows[5][1])], DOCS)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    # wrong labels of held-out rows must change nothing
    turned = known.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality"))
        .otherwise(F.col("quality")))
    got = quality_model.classified(docs, known).collect()
    again = quality_model.classified(docs, turned).collect()
    assert len(got) == len(rows) + 3
    assert {(r.doc_id, round(r.score, 9)) for r in got} == \
        {(r.doc_id, round(r.score, 9)) for r in again}
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {r.score for r in got if r.doc_id == 5}
    assert len(same) == 1
    assert len({r.score for r in got if r.doc_id > 8999}) == 1  # null counts as empty


def test_quality_model_equals_dense_computation(spark):
    rows, labels = texts_of_two_kinds(120)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    features = quality_model.featurised(docs)
    model = quality_model.fit(features, known)
    z = np.array([quality_model.statistics(t.encode()) for _, t in rows])
    y = np.array([q for _, q, _ in labels])
    train = np.array([zlib.crc32(str(i).encode()) % 5 > 0 for i, _ in rows])
    sd = z[train].std(0)
    sd[sd < 1e-4] = np.inf
    scaled = (z - z[train].mean(0)) / sd
    logs = []
    for k in (0, 1):
        x = scaled[train & (y == k)]
        c = x - x.mean(0)
        s = c.T @ c / len(c)
        p = len(s)
        level = np.trace(s) / p
        noise = sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / len(c) ** 2
        part = min(1, noise / ((s - level * np.eye(p)) ** 2).sum())
        s = (1 - part) * s + part * level * np.eye(p)
        d = scaled - x.mean(0)
        logs.append(np.log(len(x)) - 0.5 * np.linalg.slogdet(s)[1]
                    - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(model.score(z), want, atol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0), (4, 0, 0)],
                                    [(1, None, 0), (None, 1, 0), (1, 0, 1), (1, 1, 0)]])
def test_quality_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (4, ""), (None, "x")], DOCS)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_model.classified(docs, known).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)


def test_quality_of_empty_table_long_text_and_other_columns(spark):
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    empty = spark.createDataFrame([], DOCS)
    assert quality_model.classified(empty, known).count() == 0
    docs = spark.createDataFrame([(1, "word " * 400_000, 3, 4, "a", True)],
                                 DOCS + ", z int, id int, y string, held_out boolean")
    assert len(quality_model.classified(docs, known).collect()) == 1


# ---- runs


def plain_runs(w, shortest=12):
    """Every stretch of every period by comparing words; the smallest period only."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, 2 * q) and not any(
                    all(w[t] == w[t + k] for t in range(i, i + n - k)) for k in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(count, seed):
    rnd = random.Random(seed)
    for _ in range(count):
        n, letters = rnd.choice([0, 1, 11, 12, 40, 90]), rnd.choice("a ab abc abcde".split())
        w = rnd.choices(letters, k=n)
        if n and rnd.random() < 0.5:
            s, p = rnd.randrange(n), rnd.randint(1, 1 + n // 3)
            w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize("shortest", [2, 7, 12])
def test_runs_equal_brute_force(shortest):
    for seed in range(60):
        texts = list(periodic_texts(6, seed))
        numbers = [np.array([ord(c) for c in w], np.int64) for w in texts]
        assert word_runs.runs(numbers, shortest) == [plain_runs(w, shortest) for w in texts]


def test_run_digests_equal_brute_force(spark):
    rows = [(i, rnd_sep.join(w)) for i, (w, rnd_sep) in enumerate(
        zip(periodic_texts(150, 77), [" ", "\t", "\n ", "\x0b", "  "] * 30))]
    rows += [(None, "a " * 30), (1000, None), (1001, ""), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", start int, id int")
    got = sorted(word_runs.digests(docs.repartition(3)).collect(), key=str)
    want = []
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = plain_runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
                     hashlib.sha256(" ".join(
                         x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.n_runs > 0 for r in got)


def test_runs_as_rows_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x " * 60_000), (2, "a b c d e f " * 2), (3, "a b")], DOCS)
    got = sorted(map(tuple, word_runs.find(docs).collect()))
    assert got == [(1, 0, 60_000, 1), (2, 0, 12, 6)]
    assert word_runs.digests(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_split_batches_but_not_texts(monkeypatch):
    monkeypatch.setattr(word_runs, "CHUNK_WORDS", 3)
    chunks = list(word_runs._chunks([1, 2, 3, 4], [b"a b", b"c d e f", b"", b"g"], False))
    assert [len(ids) for ids, _ in chunks] == [2, 2]


# ---- whitening

VECTORS = "vec_id bigint, embedding array<float>"


def some_vectors(n=60, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(0.2, 1.5, d)
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def test_whitening_equals_dense_eigenvectors(spark):
    rows = some_vectors()
    bad = [(100, None), (101, [None] * 12), (102, [float("nan")] * 12), (103, [1.0, 2.0]),
           (104, [float("inf")] + [0.0] * 11), (105, []), (106, [1e30] * 12)]
    again = [(3, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows + bad + again],
                               VECTORS + ", x int, component string").repartition(4)
    got = whitening.whiten(whitening.whole_numbers(df)).collect()
    x = np.array([[np.floor(1024 * np.float64(np.float32(v))) + 100_000 for v in r]
                  for _, r in rows + again])
    n = len(x)
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 8
    whole = [[int(v) for v in r] for r in x]
    sums = [sum(col) for col in zip(*whole)]
    ids = [i for i, _ in rows + again]
    exact = {}
    for i, r in zip(ids, whole):
        exact[i] = sum((n * v - s) ** 2 for v, s in zip(r, sums))
    white = c @ u / np.sqrt(e)
    for r in got:
        k = r.component - 1
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, exact[r.vec_id], exact[r.vec_id])
        assert abs(abs(r.whitened) - abs(white[ids.index(r.vec_id), k])) < 1e-9
        assert abs(r.explained - e[k] / e.sum()) < 1e-12
        assert r.identity_error < 1e-10
    # one sign per component
    for k in range(8):
        signs = {np.sign(r.whitened * white[ids.index(r.vec_id), k])
                 for r in got if r.component == k + 1 and abs(r.whitened) > 1e-9}
        assert len(signs) == 1


@pytest.mark.parametrize("d", [1, 3, 40, 150])
def test_eigenpairs_of_dense_matrices(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 2 * d))
    v = a @ a.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return v @ block

    values, vectors = whitening.eigenpairs(product, d, space=30)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_eigenpairs_of_equal_and_missing_values():
    for diagonal in ([5.0] * 20, [3.0] * 10 + [1.0] * 10, [2.0, 1.0] + [0.0] * 18):
        values, vectors = whitening.eigenpairs(lambda b, m=np.diag(diagonal): m @ b, 20)
        assert np.allclose(values, diagonal[:8], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_whitening_without_variance_or_rows(spark):
    def run(rows):
        return whitening.whiten(whitening.whole_numbers(spark.createDataFrame(rows, VECTORS)))

    assert run([]).count() == 0
    assert run([(1, None)]).count() == 0
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    line = run([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]).collect()
    assert len(line) == 5 and abs(line[0].explained - 1) < 1e-12


def test_deviation_beyond_64_bits():
    whole = np.array([[3_000_000_123_457, -2_999_999_999_999, 5], [1, -1, 0]], np.int64)
    assert whitening.exact_deviation(whole) == [
        sum(int(v) ** 2 for v in r) for r in whole.tolist()]
