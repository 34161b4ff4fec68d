"""Reading, provenance, sinks, models and the compositions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sentivane.operators import models, weak
from sentivane.plans import flows
from sentivane.sources import posts as S
from sentivane.sources import prices, sinks

SMALL = "/root/testdata/sf0.001"

SMOKE = [
    ("p1", "NVDA", "NVDA data center revenue exploded 400%, massive beat! Buying calls", "BULLISH"),
    ("p2", "TSLA", "Deliveries down 20%, margins collapsing, cutting targets. Puts printing.",
     "BEARISH"),
    ("p3", "AAPL", "What time does Apple report earnings tomorrow afternoon?", "NEUTRAL"),
    ("p4", "AMD", "MI300 chips are ramping fast, strong growth. Long AMD.", "BULLISH"),
    ("p5", "INTC", "Suspended dividend, foundry loss, yield problems on 18A.", "BEARISH"),
    ("p6", "MSFT", "Azure is steady at 29%, valuation feels fair.", "NEUTRAL"),
    ("p7", "GME", "Management announced another share dilution after the retail pump.", "BEARISH"),
    ("p8", "AMZN", "Operating margins expanded to 38%, strong growth, buy.", "BULLISH"),
    ("p9", "GOOGL", "Search ad revenue beat consensus, calls.", "BULLISH"),
    ("p10", "META", "Reality Labs update, family of apps volume unchanged.", "NEUTRAL"),
]


def smoke(spark):
    return spark.createDataFrame(
        SMOKE, "post_id string, ticker string, text string, sentiment_label string")


def test_standardise(spark):
    raw = spark.createDataFrame(
        [("123", "Tesla stock rise", "Autonomous driving", 1620000000.0, 150, 45, "stocks")],
        "id string, title string, text string, created_utc double, score long, "
        "num_comments long, subreddit string")
    r = S.standardise(raw, "dump").first()
    assert (r["post_id"], r["body"], r["score"], r["data_source"]) == (
        "123", "Autonomous driving", 150, "REAL")
    assert r["timestamp"] == dt.datetime(2021, 5, 3, 0, 0)
    bare = spark.createDataFrame([("x", "no date"), ("y", "2021-01-01")], "selftext string, created string")
    rows = S.standardise(bare, "dump").collect()
    assert len({r["post_id"] for r in rows}) == 2 and rows[0]["timestamp"] is None
    assert rows[1]["subreddit"] == "wallstreetbets" and rows[1]["num_comments"] == 0


def test_provenance(spark):
    df = spark.createDataFrame([("t", "Synthetic_v1"), ("u", "dump")], "text string, source string")
    tags = {r["source"]: r["data_source"] for r in S.tag_provenance(df).collect()}
    assert tags == {"Synthetic_v1": "SYNTHETIC", "dump": "REAL"}
    with pytest.raises(S.SyntheticDataError):
        S.assert_real(df)
    with pytest.raises(S.SyntheticDataError):
        S.assert_real(spark.createDataFrame([("t", "SYNTHETIC")], "text string, data_source string"))
    S.assert_real(df.filter("source = 'dump'"))


def test_read_posts_guard(spark, tmp_path):
    df = spark.createDataFrame([("1", "synthetic")], "post_id string, source string")
    df.write.parquet(str(tmp_path / "p"))
    with pytest.raises(S.SyntheticDataError):
        S.read_posts(spark, str(tmp_path / "p"))
    assert S.read_posts(spark, str(tmp_path / "p"), allow_synthetic=True).count() == 1
    assert S.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "p")], "posts_v") is not None
    assert spark.table("posts_v").count() == 1


def test_fiqa_protocol(spark):
    df = spark.createDataFrame(
        [("a", "headline", "AAPL", 0.5), ("b", "headline", "A, B", 0.5), ("c", "headline", "X", 0.0),
         ("d", "post", "X", -0.1), ("e", "post", "X", None)],
        "sentence string, format string, target string, score double")
    news = S.fiqa_protocol(df, "news").collect()
    assert [(r["text"], r["sentiment_label"]) for r in news] == [("a", "BULLISH")]
    assert [r["text"] for r in S.fiqa_protocol(df, "post").collect()] == ["d"]
    assert S.fiqa_protocol(df).count() == 2


def test_label_carry(spark):
    hidden = spark.createDataFrame([("BULLISH",)], "_sentiment string")
    assert S.label_carry(hidden).first()["sentiment_score"] == 1.0
    none = S.label_carry(spark.createDataFrame([(1,)], "x int")).first()
    assert none["sentiment_label"] is None and none["sentiment_score"] is None


def test_bars_round_trip_prunes(spark, tmp_path):
    df = spark.createDataFrame(
        [("A", dt.date(2023, 1, d), float(d), 1) for d in range(1, 5)] + [("B", dt.date(2023, 1, 2), 9.0, 1)],
        "ticker string, Date date, `Adj Close` double, Volume int")
    path = str(tmp_path / "bars")
    prices.write_bars(prices.shape_bars(df), path)
    got = prices.read_bars(spark, path, ["A"], dt.date(2023, 1, 2), dt.date(2023, 1, 4))
    assert sorted(r["adj_close"] for r in got.collect()) == [2.0, 3.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ticker" in plan.split("PartitionFilters: [")[1][:60]


def test_log_grows_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([("F1", 0.5)], "experiment_id string, acc double"), path)
    sinks.append_log(spark.createDataFrame([("F2", "x")], "experiment_id string, note string"), path)
    again = spark.createDataFrame([("F2", "y"), (None, "z")], "experiment_id string, note string")
    sinks.append_log(again, path)
    sinks.append_log(again, path)  # a rerun replaces what it wrote
    rows = sinks.read_log(spark, path).collect()
    assert sorted((str(r["experiment_id"]), str(r["note"])) for r in rows) == [
        ("F1", "None"), ("F2", "y"), ("None", "z")]
    sinks.append_log(spark.createDataFrame([("F2", "x")], "experiment_id string, note string"), path)
    got = {r["experiment_id"]: r.asDict() for r in sinks.read_log(spark, path).collect()
           if r["experiment_id"]}
    assert got["F1"]["note"] is None and got["F2"]["acc"] is None


def test_write_splits_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir()


def test_preprocess(spark):
    raw = spark.createDataFrame([
        ("1", "NVDA up", "NVDA up a lot, buying $NVDA", "dump", "2023-01-02"),
        ("2", "NVDA up", "NVDA up a lot, buying $NVDA", "dump", "2023-01-01"),
        ("3", "hi", "", "dump", "2023-01-01"), ("4", "[deleted]", "null", "dump", None),
    ], "post_id string, title string, body string, source string, t string"
    ).withColumn("timestamp", F.to_timestamp("t")).drop("t")
    rows = flows.preprocess(raw).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["post_id"], r["text"], r["ticker"], r["company"], r["all_tickers"]) == (
        "1", "NVDA up a lot, buying $NVDA", "NVDA", "Nvidia", ["NVDA"])
    assert (r["ticker_confidence"], r["detection_method"], r["data_source"]) == (
        0.95, "cashtag", "REAL")
    assert (r["char_length"], r["word_count"], r["sentiment_label"]) == (27, 6, None)


def test_weak_label_flow_end_to_end(spark):
    posts = smoke(spark)
    examples = spark.createDataFrame([(1, "A", "t", "positive", "r")],
                                     "ord int, ticker string, text string, sentiment string, "
                                     "reasoning_summary string")
    req = flows.inference_requests(posts, examples, "m", "0.5")
    assert req.count() == 80 and req.select("prompt_key").distinct().count() == 80
    word = F.when(F.col("sentiment_label") == "BULLISH", "buy").when(
        F.col("sentiment_label") == "BEARISH", "sell").otherwise("hold")
    answers = req.join(posts, "post_id").select(
        "post_id", "path_id", F.concat(F.lit('{"sentiment": "'), word, F.lit('"}')).alias("response"))
    weak = flows.weak_labels(answers, posts).persist()
    assert weak.count() == 10 and weak.filter("teacher_soft_score = 1.0").count() == 4
    out = flows.distil(weak, weak, posts, size=500, max_iter=30).first()
    assert out["accuracy"] >= 0.8 and out["optimal_theta"] in (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


def test_teacher_guard(spark):
    posts = smoke(spark)
    with pytest.raises(ValueError):
        models.StudentRegressor().fit(posts)
    with pytest.raises(ValueError):
        models.StudentClassifier().fit(posts)


@pytest.mark.parametrize("kind", ["logreg", "nb", "svm"])
def test_classifiers_learn(spark, kind):
    rows = [(f"{i}", f"{'moon rocket gain' if i % 2 else 'crash dump loss'} number {i % 5} today",
             "BULLISH" if i % 2 else "BEARISH") for i in range(40)]
    df = spark.createDataFrame(rows, "post_id string, text string, sentiment_label string")
    model = models.TextClassifier(kind, size=200, max_iter=5 if kind == "svm" else 30).fit(df)
    got = model.transform(df).persist()
    assert got.filter("pred = sentiment_label").count() == 40
    probs = got.first()["probabilities"]
    assert sum(probs) == pytest.approx(1.0)
    if kind == "logreg":
        top = models.top_features(model, spark, 2).filter("class = 'BULLISH' AND rank = 1").first()
        assert top["term"] in ("moon", "rocket", "gain", "moon rocket", "rocket gain")


def test_tfidf_against_brute_force(spark):
    import math

    docs = ["Buy the dip", "the dip buys back", "x yy the"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, text string")
    got = {(r["i"], r["term"]): r["tfidf"] for r in models.tfidf_long(df, "i").collect()}
    tokens = [[w for w in d.lower().split() if len(w) > 1] for d in docs]
    grams = [t + [" ".join(p) for p in zip(t, t[1:])] for t in tokens]
    for i, g in enumerate(grams):
        w = {t: g.count(t) * (math.log(4 / (1 + sum(t in o for o in grams))) + 1) for t in g}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert got[(i, t)] == pytest.approx(v / norm)
    assert len(got) == sum(len(set(g)) for g in grams)


@pytest.mark.parametrize("size, bits", [(1, 2), (5, 3), (12, 4), (12, 20), (1000, 3)])
def test_vocabulary_is_exact_in_any_buckets(spark, monkeypatch, size, bits):
    """A few buckets, so that rare terms share theirs with frequent ones, and a last scan is needed."""
    import random
    from collections import Counter

    monkeypatch.setattr(models, "BUCKET_BITS", bits)
    monkeypatch.setattr(models, "BUCKET_PARTS", 2)
    monkeypatch.setattr(models, "WORDS_AT_ONCE", 7)
    rnd = random.Random(size)
    docs = [" ".join(rnd.choice(["aa", "bb", "Zü", "x", "dd", f"w{rnd.randrange(40)}"])
                     for _ in range(rnd.randrange(12))) for _ in range(60)] + ["", None]
    tokens = [[w for w in (d or "").lower().split() if len(w) > 1] for d in docs]
    grams = [t + [" ".join(p) for p in zip(t, t[1:])] for t in tokens]
    tf, df = Counter(t for g in grams for t in g), Counter(t for g in grams for t in set(g))
    want = sorted(tf, key=lambda t: (-tf[t], t.encode()))[:size]
    rows = spark.createDataFrame([(d,) for d in docs], "text string").repartition(3)
    got = models.vocabulary(rows.select(models.words(F.col("text")).alias("words")), size).collect()
    assert [(r["term"], r["tf"], r["df"]) for r in got] == [(t, tf[t], df[t]) for t in want]


def test_vocabulary_shuffles_no_rare_pairs(spark):
    import numpy as np

    rows = spark.range(400).select(F.array(
        F.lit("aa"), F.lit("bb"), F.concat(F.lit("w"), F.col("id")),
        F.concat(F.lit("v"), F.col("id"))).alias("words"))
    hashed = rows.select("words", F.transform("words", lambda w: F.xxhash64(w)).alias("hash"))
    sizes = models._bucket_sizes(hashed)
    assert sizes.sum() == 400 * 7
    counted = models.term_counts(hashed, sizes >= np.sort(sizes)[-3]).count()
    assert 3 <= counted < 30  # of 2,003 terms


def test_errors_are_derived_once(spark, tmp_path):
    """What several branches read of the errors is a written table."""
    from sentivane.operators import errors

    rows = [(i, f"post {i} to the moon but no calls", "en", "web") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(9)],
                          "doc_id long, toxic int, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    found = entry.queries()["union_errors"](spark, str(tmp_path))
    assert found.inputFiles() and all("/errors-" in f for f in found.inputFiles())
    predictions = spark.createDataFrame(
        [(1, "m", "BULLISH", "BEARISH"), (2, "m", "BULLISH", "BULLISH")],
        "post_id long, model string, truth string, pred string")
    posts = spark.createDataFrame([(1, "to the moon"), (2, "x")], "post_id long, text string")
    told = errors.diagnose(predictions, posts)
    assert told.inputFiles() and all("/errors-" in f for f in told.inputFiles())
    assert [(r["post_id"], r["error_category"]) for r in told.collect()] == [(1, "SARCASM_MEMES")]


def test_direction_models(spark):
    import random

    rnd = random.Random(2)
    rows = [("A" if i % 2 else "B", dt.date(2023, 1, 1) + dt.timedelta(days=i // 2),
             rnd.gauss(0, 1), rnd.choice([-1.0, 0.0, 1.0]), 2) for i in range(100)]
    df = spark.createDataFrame(
        rows, "ticker string, trading_date date, lag_return_1d double, mean_sentiment double, "
        "post_count int").withColumn("fwd_direction_1d", (F.col("mean_sentiment") > 0).cast("int"))
    got = {r["model"]: r for r in models.direction_models(df).collect()}
    assert (got["F5_combined"]["train_size"], got["F5_combined"]["test_size"]) == (80, 20)
    assert got["F4_sentiment_only"]["accuracy"] == 1.0
    assert models.direction_models(df.limit(20)).count() == 0
    assert models.direction_models(df, order="table").count() == 3


def test_quality_report(spark):
    df = smoke(spark).withColumn("timestamp", F.current_timestamp()).withColumn(
        "subreddit", F.lit("stocks"))
    rows = flows.quality_report(df).collect()
    got = {(r["part"], r["item"], r["measure"]): r["value"] for r in rows}
    assert len(got) == len(rows)
    assert got["totals", None, "total_rows"] == 10
    assert sum(part == "top_tickers" for part, _, _ in got) == 10
    assert {k[1]: v for k, v in got.items() if k[0] == "sentiment_distribution" and k[2] == "n"} == {
        "BULLISH": 4, "BEARISH": 3, "NEUTRAL": 3}
    assert got["subreddit_distribution", "stocks", "n"] == 10


def test_entry_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    q, o = entry.queries(), entry.oracle_sql()
    own = set(q) - set(entry.LLM_QUERIES)
    assert set(o) <= set(q) and len(own) > 130
    assert not [k for k in own if "pipeline" in k or k.startswith("op")]


@pytest.mark.parametrize("name", ["daily_sentiment", "k_ablation", "e2e_market"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tools.check_oracle import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def _packed_block(n=120, terms=40, seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.2)
    return x, rng.integers(0, 3, n), rng.integers(0, 3, n)


def test_solver_reaches_the_least_value_of_every_problem(spark):
    """Gradients by hand vanish at the solutions; empty rows and blocks do no harm."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from sentivane.operators import linear

    x, y, fold = _packed_block()
    x[5] = 0.0
    rows = spark.createDataFrame(
        [(Vectors.sparse(x.shape[1], [(int(j), float(r[j])) for j in np.flatnonzero(r)]),
          int(a), int(b)) for r, a, b in zip(x, y, fold)], ["features", "label", "fold"])
    blocks = linear.packed(rows.repartition(3), fold="fold").persist()
    problems = [linear.Problem("hinge", 1.0, positive=i, without_fold=k)
                for i in range(3) for k in range(3)]
    problems += [linear.Problem("softmax", c, 3, after=9 if c > 0.1 else None)
                 for c in (0.1, 1.0, 10.0)] + [linear.Problem("squares", 2.0)]
    solved = linear.solve(blocks, x.shape[1], problems, 500, 1e-9)
    ones = np.hstack([x, np.ones((len(x), 1))])
    for p, w in zip(problems, solved):
        m, used = ones @ w, fold != p.without_fold
        if p.loss == "hinge":
            s = np.where(y == p.positive, 1.0, -1.0)
            slope = (-2 * s * np.maximum(0, 1 - s * m[:, 0]) * used)[:, None]
        elif p.loss == "squares":
            slope = m - y[:, None]
        else:
            e = np.exp(m - m.max(1, keepdims=True))
            slope = e / e.sum(1, keepdims=True) - (y[:, None] == np.arange(3))
        gradient = p.c * (ones.T @ slope)
        gradient[:-1] += w[:-1]
        assert np.abs(gradient).max() < 1e-6 * max(1.0, p.c * len(x))
    with pytest.raises(ValueError):
        linear.solve(blocks.limit(0), x.shape[1], problems[:1], 5, 1e-4)
    blocks.unpersist()


def test_newton_equals_dense_newton(spark):
    import numpy as np

    from sentivane.operators import newton

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2)) * [0.01, 30]
    y = (rng.random(200) < 1 / (1 + np.exp(-x[:, 1] / 20))).astype(float)
    rows = spark.createDataFrame(
        [(m, float(b), [float(a[0]) * (m == 0), float(a[1])])
         for m in (0, 1) for a, b in zip(x, y)], "model int, y double, x array<double>")
    got = newton.logistic(rows, 2, 2)
    for m in (0, 1):
        z = np.column_stack([x[:, 0] * (m == 0), x[:, 1], np.ones(200)])
        w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + ridge,
                                    z.T @ (mu - y) + ridge @ w)
        assert np.allclose(got[m], w, atol=1e-8)


def test_naive_bayes_weights_against_brute_force(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x, y, _ = _packed_block(30, 12)
    rows = spark.createDataFrame(
        [(Vectors.dense(r) if i % 2 else Vectors.sparse(12, dict(enumerate(map(float, r)))),
          "abc"[a]) for i, (r, a) in enumerate(zip(x, y))], ["features", "label"])
    got = models.class_weights(rows, "label", ["a", "b", "c"], 12, 0.5)
    for k in range(3):
        total = x[y == k].sum(0) + 0.5
        assert np.allclose(got[:-1, k], np.log(total / total.sum()))
        assert got[-1, k] == pytest.approx(np.log((y == k).mean()))


def test_stored_responses_are_met_in_one_join_and_stay_where_they_are(spark):
    stored = spark.createDataFrame([("k1", "yes"), ("k2", None), ("k4", "no")],
                                   "prompt_key string, response string")
    asked = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3"), (4, "k1"), (5, None)],
                                  "id int, prompt_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = weak.store_responses(stored, buckets=4)
        out = weak.answered(asked, table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["response"], r["pending"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {1: ("yes", False), 2: (None, False), 3: (None, True), 4: ("yes", False),
                   5: (None, True)}
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 1
