"""Logical inputs as projections of the given tables, in Spark and as SQL CTEs.

Every adapter reads its whole table.  `ctes("a", "b")` gives the WITH clause with all that the
named inputs need, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentivane.functions import text as X
from sentivane.operators import market
from sentivane.vocab import COMMON_ENTITIES, DELETED, EMOJI_TOKENS, SPACE, SPACE_CHARS

MODELS = ["model_0", "model_1", "model_2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------------------- finance posts
def posts(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    label = (F.when(status == "F", "BULLISH").when(status == "O", "BEARISH")
             .when(status == "P", "NEUTRAL"))
    score = F.when(status == "F", 1.0).when(status == "O", -1.0).when(status == "P", 0.0)
    return o.select(
        F.col("o_orderkey").alias("post_id"),
        (F.col("o_orderdate")
         + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
         ).alias("timestamp"),
        F.col("o_orderpriority").alias("ticker"),
        label.alias("sentiment_label"), score.alias("sentiment_score"),
        (F.floor(F.col("o_totalprice") / 1000).cast("bigint") - 50).alias("score"),
        (F.col("o_custkey") % 50).alias("num_comments"),
    )


def calendar(spark, sf) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (table(spark, sf, "orders").filter(F.weekday(day) < 5)
            .select(day.alias("trading_date")).distinct())


def bars(spark, sf) -> DataFrame:
    """Orders fold onto their key's priority; the join is on the order key."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("ticker"))
    return (
        li.filter(F.weekday("date") < 5).join(o, "l_orderkey")
        .groupBy("ticker", "date").agg(
            F.round(F.avg("price"), 6).alias("adj_close"),
            F.sum("l_quantity").cast("bigint").alias("volume"))
        .join(calendar(spark, sf).withColumnRenamed("trading_date", "date"), "date",
              "left_semi")
        .select("ticker", "date", "adj_close", "volume")
    )


def aligned(spark, sf) -> DataFrame:
    return market.align_trading_day(posts(spark, sf), calendar(spark, sf))


def daily(spark, sf, min_posts: int = 1) -> DataFrame:
    return market.daily_sentiment(aligned(spark, sf), min_posts)


def returns(spark, sf, **kw) -> DataFrame:
    return market.forward_returns(bars(spark, sf), **kw)


def joint(spark, sf, **kw) -> DataFrame:
    return market.sentiment_returns(daily(spark, sf), returns(spark, sf, **kw))


# --------------------------------------------------------------------------- label paths
def paths(spark, sf) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.row_number().over(order).alias("path_id"),
        F.when(flag == "A", "positive").when(flag == "N", "neutral")
        .when(flag == "R", "negative").alias("label"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" tax "),
                 (F.col("l_tax") * 100).cast("int").cast("string")).alias("reasoning_summary"),
    )


def truth(spark, sf) -> DataFrame:
    return posts(spark, sf).select("post_id", F.col("sentiment_label").alias("truth"))


def predictions(spark, sf) -> DataFrame:
    """Three made labels per order: rows (post_id, model, truth, pred, confidence)."""
    names = ["BULLISH", "BEARISH", "NEUTRAL"]
    p = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("post_id"),
        (F.when(F.col("o_orderstatus") == "F", "BULLISH")
         .when(F.col("o_orderstatus") == "O", "BEARISH").otherwise("NEUTRAL")).alias("truth"),
        (F.col("o_totalprice") / 500000).alias("confidence"),
        F.explode(F.array(*[
            F.struct(F.lit(f"model_{m}").alias("model"),
                     ((F.col("o_orderkey") * (m + 1) + F.col("o_custkey") + m) % 3)
                     .alias("k")) for m in range(3)])).alias("v"))
    k = F.col("v.k")
    label = F.when(k == 0, names[0]).when(k == 1, names[1]).otherwise(names[2])
    return p.select("post_id", "v.model", "truth", label.alias("pred"), "confidence")


# --------------------------------------------------------------------------- text posts
SUFFIXES = {
    0: " $TSLA and $nvda over $IT with $GME $GME",
    1: " Apple and the nvidia rtx line",
    2: " AMD vs XYZ FOR THE CEO",
    3: " see https://example.com/a?b=1 and www.example.org/x now",
    4: " [earnings note](https://example.com/q) and [plain](local/path) **bold** _it_ `code`",
    5: " profit &amp; loss &lt;b&gt; &quot;quoted&quot;",
    6: " to the 🚀 with 💎🙌 hands and 🤡 ⚰️",
    8: " beat earnings but iv crush hurts my calls and puts",
    9: "",
}


def text_posts(spark, sf) -> DataFrame:
    """Documents: first line as title, rest as body, a suffix that depends on the text alone."""
    d = table(spark, sf, "documents")
    kind = F.length("text") % 10
    suffix = F.lit("")
    for k, s in SUFFIXES.items():
        suffix = F.when(kind == k, F.lit(s)).otherwise(suffix)
    title = F.substring_index("text", "\n", 1)
    rest = F.when(F.instr("text", "\n") > 0,
                  F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
                  ).otherwise("")
    body = F.when(kind == 7, "[deleted]").otherwise(F.concat(rest, suffix))
    return d.select(
        F.col("doc_id").alias("post_id"), title.alias("title"), body.alias("body"),
        F.concat(F.col("text"), suffix).alias("raw"), F.col("lang").alias("subreddit"),
        "source",
    )


def clean_posts(spark, sf, labelled: bool = False) -> DataFrame:
    """(post_id, subreddit, source, text): cleaned title and body joined.

    With `labelled` only the posts that have a label, joined before the cleaning work is done,
    and `sentiment_label`.
    """
    p = text_posts(spark, sf)
    keep = ["post_id", "subreddit", "source"]
    if labelled:
        p = p.join(text_truth(spark, sf), "post_id")
        keep.append("sentiment_label")
    text = X.combine_clean(X.clean_text(F.col("title")), X.clean_text(F.col("body")))
    return p.select(*keep, text.alias("text"))


def text_truth(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    label = (F.when(F.col("toxic") == 1, "BEARISH").when(F.col("quality") == 1, "BULLISH")
             .otherwise("NEUTRAL"))
    return lab.select(F.col("doc_id").alias("post_id"), label.alias("sentiment_label"))


def fiqa_like(spark, sf) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    k = F.col("doc_id")
    return d.select("doc_id", "text").join(lab, "doc_id").select(
        "doc_id", F.col("text").alias("sentence"),
        F.when(k % 2 == 0, "headline").otherwise("post").alias("format"),
        F.when(k % 7 == 0, "AAPL, TSLA").otherwise("AAPL").alias("target"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"),
    )


def responses(spark, sf) -> DataFrame:
    """Conversation turns wrapped in the answer forms a model gives."""
    c = table(spark, sf, "conversations")
    form = (F.col("conv_id") + F.col("turn")) % 6
    word = (F.when(F.length("text") % 3 == 0, "bullish").when(F.length("text") % 3 == 1, "Sell")
            .otherwise("mixed"))
    line = F.regexp_replace("text", r"[\n\r\t]", " ")
    js = F.concat(F.lit('{"reasoning_summary": "'), line, F.lit('", "sentiment": "'), word,
                  F.lit('"}'))
    raw = (
        F.when(form == 0, js)
        .when(form == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here you go: "), js, F.lit(" as asked.")))
        .when(form == 3, F.concat(F.lit("REASONING: "), line, F.lit("\nSENTIMENT: "), word))
        .when(form == 4, F.replace(js, F.lit('"sentiment": "'), F.lit('"sentiment": "laser_')))
        .otherwise(F.col("text"))
    )
    provider = F.when(F.col("role") == "user", "openai").when(
        F.col("role") == "assistant", "anthropic").otherwise("mock")
    return c.select("conv_id", "turn", provider.alias("provider"), "text", raw.alias("raw"))


def activity(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    s = F.signum(F.col("value") - 50)
    label = F.when(s > 0, "BULLISH").when(s < 0, "BEARISH").otherwise("NEUTRAL")
    return e.select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("ticker"), label.alias("sentiment_label"), "value")


# --------------------------------------------------------------------------- SQL twins
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chars(text: str) -> str:
    """A SQL string built from code points, for characters a literal would hide."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


def sql_trim(c: str) -> str:
    return f"trim({c}, {chars(SPACE_CHARS)})"


def sql_unescape(c: str) -> str:
    for entity, char in [("&middot;", "·"), ("&copy;", "©"), *COMMON_ENTITIES]:
        c = f"replace({c}, {q(entity)}, {q(char)})"
    return c


def sql_step(name: str, c: str) -> str:
    def sub(pattern: str, to: str) -> str:
        return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"

    if name == "unescape_html":
        return sql_unescape(c)
    if name == "drop_deleted":
        words = ", ".join(q(w) for w in DELETED)
        return f"CASE WHEN {sql_trim(c)} IN ({words}) THEN '' ELSE {c} END"
    if name == "emoji_tokens":
        for emoji, token in EMOJI_TOKENS:
            c = f"replace({c}, {q(emoji)}, {q(token)})"
        return c
    if name == "squash_ws":
        return sql_trim(sub(f"[{SPACE}]+", " "))
    pattern, to = {
        "strip_urls": (X.URL, ""),
        "strip_md_links": (X.MD_LINK, r"\1"),
        "strip_bold": (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"),
        "strip_italic": (r"\*(.*?)\*|_(.*?)_", r"\1\2"),
        "strip_code": (r"`{1,3}(.*?)`{1,3}", r"\1"),
        "strip_headers": (rf"(?m)^#+[{SPACE}]*", ""),
        "strip_quotes": (rf"(?m)^>[{SPACE}]*", ""),
        "strip_non_ascii": (r"[^\x00-\x7F]+", " "),
    }[name]
    return sub(pattern, to)


STEPS = ["unescape_html", "drop_deleted", "strip_urls", "strip_md_links", "strip_bold",
         "strip_italic", "strip_code", "strip_headers", "strip_quotes", "emoji_tokens",
         "strip_non_ascii", "squash_ws"]


def sql_clean_chain(source: str, columns: list[str], keep: str, name: str) -> str:
    """CTEs that clean the columns step by step; the last one is called `name`."""
    out, prev = [], source
    for i, step in enumerate(STEPS):
        this = name if i == len(STEPS) - 1 else f"{name}_{i}"
        cols = ", ".join(f"{sql_step(step, f'{c}')} AS {c}" for c in columns)
        out.append(f"{this} AS (SELECT {keep}, {cols} FROM {prev})")
        prev = this
    return ",\n".join(out)


def _suffix_sql() -> str:
    whens = " ".join(f"WHEN {k} THEN {q(s)}" for k, s in SUFFIXES.items())
    return f"CASE length(text) % 10 {whens} ELSE '' END"


_ROLL = "OVER (PARTITION BY ticker ORDER BY trading_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_NEXT = "lead(adj_close, {0}) OVER w / adj_close - 1 AS fwd_return_{0}d"

CTES: dict[str, tuple[list[str], str]] = {
    "posts": ([], """posts AS (
  SELECT o_orderkey AS post_id, o_orderdate + to_hours(o_orderkey % 24) AS timestamp,
    o_orderpriority AS ticker,
    CASE o_orderstatus WHEN 'F' THEN 'BULLISH' WHEN 'O' THEN 'BEARISH' WHEN 'P' THEN 'NEUTRAL' END
      AS sentiment_label,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN -1.0::DOUBLE
      WHEN 'P' THEN 0.0::DOUBLE END AS sentiment_score,
    floor(o_totalprice / 1000)::BIGINT - 50 AS score, o_custkey % 50 AS num_comments
  FROM orders)"""),
    "calendar": ([], """calendar AS (
  SELECT DISTINCT o_orderdate::DATE AS trading_date FROM orders
  WHERE isodow(o_orderdate) <= 5)"""),
    "bars": (["calendar"], """bars AS (
  SELECT o_orderpriority AS ticker, l_shipdate::DATE AS date,
    round(avg(l_extendedprice / l_quantity), 6) AS adj_close, sum(l_quantity)::BIGINT AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate::DATE IN (SELECT trading_date FROM calendar)
  GROUP BY 1, 2)"""),
    "aligned": (["posts", "calendar"], """aligned AS (
  SELECT p.* EXCLUDE (et, target), c.trading_date FROM (
    SELECT *, et::DATE + (CASE WHEN hour(et) >= 16 THEN 1 ELSE 0 END) AS target FROM (
      SELECT *, timezone('America/New_York', timezone('UTC', timestamp)) AS et FROM posts)) p
  ASOF JOIN calendar c ON p.target <= c.trading_date)"""),
    "daily": (["aligned"], f"""weighted AS (
  SELECT *, CASE WHEN w0 = 0 THEN 1.0 ELSE w0 END AS w FROM (
    SELECT *, ln(1 + greatest(0, score) + greatest(0, num_comments)) AS w0 FROM aligned)),
daily0 AS (
  SELECT ticker, trading_date, count(sentiment_score) AS volume_of_posts,
    avg(score) AS average_post_score, avg(sentiment_score) AS mean_sentiment,
    quantile_cont(sentiment_score, 0.5) AS median_sentiment,
    coalesce(stddev_samp(sentiment_score), 0) AS std_sentiment,
    count(*) FILTER (sentiment_score > 0) AS bullish_count,
    count(*) FILTER (sentiment_score < 0) AS bearish_count,
    count(*) FILTER (sentiment_score = 0) AS neutral_count,
    sum(sentiment_score * w) / greatest(sum(w), 1e-6) AS weighted_sentiment
  FROM weighted WHERE ticker IS NOT NULL GROUP BY 1, 2),
daily1 AS (
  SELECT *, volume_of_posts AS post_count, bullish_count / volume_of_posts AS positive_ratio,
    bearish_count / volume_of_posts AS negative_ratio,
    neutral_count / volume_of_posts AS neutral_ratio,
    bullish_count / volume_of_posts - bearish_count / volume_of_posts AS net_sentiment
  FROM daily0),
daily AS (
  SELECT *, net_sentiment AS bull_bear_ratio,
    coalesce(net_sentiment - lag(net_sentiment) OVER (PARTITION BY ticker ORDER BY trading_date),
      0) AS sentiment_change,
    net_sentiment AS rolling_sentiment_1d,
    avg(net_sentiment) {_ROLL.format(2)} AS rolling_sentiment_3d,
    avg(net_sentiment) {_ROLL.format(6)} AS rolling_sentiment_7d
  FROM daily1)"""),
    "rets": (["bars"], f"""rets AS (
  SELECT *, (fwd_return_1d > 0)::INT AS fwd_direction_1d,
    (fwd_return_3d > 0)::INT AS fwd_direction_3d, (fwd_return_5d > 0)::INT AS fwd_direction_5d
  FROM (SELECT *, adj_close / lag(adj_close) OVER w - 1 AS lag_return_1d,
    {_NEXT.format(1)}, {_NEXT.format(3)}, {_NEXT.format(5)}
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)))"""),
    "joint": (["daily", "rets"], """joint AS (
  SELECT d.*, r.* EXCLUDE (ticker, date) FROM daily d
  JOIN rets r ON d.ticker = r.ticker AND d.trading_date = r.date)"""),
    "cases": (["joint"], """cases AS (
  SELECT * FROM joint WHERE mean_sentiment IS NOT NULL AND fwd_return_1d IS NOT NULL
    AND fwd_return_3d IS NOT NULL AND fwd_return_5d IS NOT NULL)"""),
    "paths": ([], """paths AS (
  SELECT l_orderkey AS post_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_shipdate)::INT AS path_id,
    CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'negative'
      END AS label,
    1 - l_discount AS confidence,
    'part ' || l_partkey || ' tax ' || trunc(l_tax * 100)::INT AS reasoning_summary
  FROM lineitem)"""),
    "votes": (["paths"], """votes AS (
  SELECT *, CASE WHEN tied > 1 THEN 'neutral' ELSE first_label END AS dominant_label,
    tied > 1 AS is_tie, round(dominant_count / total_paths, 4) AS agreement_score,
    round((positive_count - negative_count) / total_paths, 4) AS teacher_soft_score
  FROM (SELECT *, (positive_count = dominant_count)::INT + (neutral_count = dominant_count)::INT
      + (negative_count = dominant_count)::INT AS tied,
    CASE WHEN positive_count = dominant_count THEN 'positive'
      WHEN neutral_count = dominant_count THEN 'neutral' ELSE 'negative' END AS first_label
    FROM (SELECT post_id, count(*) FILTER (label = 'positive') AS positive_count,
      count(*) FILTER (label = 'neutral') AS neutral_count,
      count(*) FILTER (label = 'negative') AS negative_count, count(*) AS total_paths,
      greatest(count(*) FILTER (label = 'positive'), count(*) FILTER (label = 'neutral'),
        count(*) FILTER (label = 'negative')) AS dominant_count,
      avg(confidence) FILTER (label = 'positive') AS pos_conf,
      avg(confidence) FILTER (label = 'neutral') AS neu_conf,
      avg(confidence) FILTER (label = 'negative') AS neg_conf
      FROM paths GROUP BY 1)))"""),
    "predictions": ([], """predictions AS (
  SELECT post_id, 'model_' || m AS model, truth,
    CASE k WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS pred, confidence
  FROM (SELECT o_orderkey AS post_id, m,
      CASE o_orderstatus WHEN 'F' THEN 'BULLISH' WHEN 'O' THEN 'BEARISH' ELSE 'NEUTRAL' END
        AS truth,
      o_totalprice / 500000 AS confidence, (o_orderkey * (m + 1) + o_custkey + m) % 3 AS k
    FROM orders, (VALUES (0), (1), (2)) AS g(m)))"""),
    "text_posts": ([], f"""text_posts AS (
  SELECT doc_id AS post_id, split_part(text, chr(10), 1) AS title,
    CASE WHEN length(text) % 10 = 7 THEN '[deleted]' ELSE
      CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END
      || {_suffix_sql()} END AS body,
    text || {_suffix_sql()} AS raw, lang AS subreddit, source
  FROM documents)"""),
    "cleaned": (["text_posts"], sql_clean_chain(
        "text_posts", ["title", "body"], "post_id, subreddit, source", "cleaned")),
    "clean_posts": (["cleaned"], """clean_posts AS (
  SELECT post_id, subreddit, source, CASE
    WHEN title <> '' AND body <> '' AND NOT starts_with(body, title) THEN title || ' -- ' || body
    WHEN body <> '' THEN body ELSE title END AS text
  FROM cleaned)"""),
    "text_truth": ([], """text_truth AS (
  SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 'BEARISH' WHEN quality = 1 THEN 'BULLISH'
    ELSE 'NEUTRAL' END AS sentiment_label FROM labels)"""),
    "fiqa_like": ([], """fiqa_like AS (
  SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 2 = 0 THEN 'headline' ELSE 'post' END AS format,
    CASE WHEN d.doc_id % 7 = 0 THEN 'AAPL, TSLA' ELSE 'AAPL' END AS target,
    (quality - toxic)::DOUBLE AS sentiment_score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""),
    "responses": ([], r"""responses AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'openai' WHEN 'assistant' THEN 'anthropic'
    ELSE 'mock' END AS provider, text, word, line, form,
    CASE form WHEN 0 THEN js WHEN 1 THEN '```json' || chr(10) || js || chr(10) || '```'
      WHEN 2 THEN 'Here you go: ' || js || ' as asked.'
      WHEN 3 THEN 'REASONING: ' || line || chr(10) || 'SENTIMENT: ' || word
      WHEN 4 THEN replace(js, '"sentiment": "', '"sentiment": "laser_') ELSE text END AS raw
  FROM (SELECT *, '{"reasoning_summary": "' || line || '", "sentiment": "' || word || '"}' AS js
    FROM (SELECT *, (conv_id + turn) % 6 AS form,
      CASE length(text) % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'Sell' ELSE 'mixed' END AS word,
      regexp_replace(text, '[\n\r\t]', ' ', 'g') AS line FROM conversations)))"""),
    "activity": ([], """activity AS (
  SELECT event_id AS post_id, ts AS timestamp, event_type AS ticker,
    CASE WHEN value > 50 THEN 'BULLISH' WHEN value < 50 THEN 'BEARISH' ELSE 'NEUTRAL' END
      AS sentiment_label, value
  FROM events)"""),
}


def ctes(*names: str, extra: str = "") -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    parts = [CTES[n][1] for n in done] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
