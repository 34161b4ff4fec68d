"""Queries: text cleaning, tickers, error categories, splits, prompts and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentivane.functions import errors as E
from sentivane.functions import prompts as P
from sentivane.functions import text as X
from sentivane.functions import tickers as T
from sentivane.operators import dedup, lexicon, splits
from sentivane.operators import errors as EO
from sentivane.operators import weak as K
from sentivane.operators.models import tfidf_long
from sentivane.session import stage
from sentivane.operators.ordering import running_totals
from sentivane.vocab import (
    BEARISH_CUES,
    BULLISH_CUES,
    BOOST_DAMPING,
    BOOST_STEP,
    BOOSTERS_DOWN,
    BOOSTERS_UP,
    COMPANY_OF,
    COMPANY_PATTERNS,
    ERROR_DEFAULT_4,
    ERROR_DEFAULT_5,
    ERROR_GROUPS_4,
    ERROR_GROUPS_5,
    ERROR_LONG_5,
    LEXICON,
    NEGATION_FACTOR,
    NEGATIONS,
    SPACE,
    TOKEN_RATES,
    WORD,
)
from sentivane.workload import inputs as I
from sentivane.workload.inputs import ctes, q, sql_step, sql_trim
from sentivane.workload.registry import query, rounded


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


# ------------------------------------------------------------------ one key per cleaning step
def _register_step(name: str) -> None:
    fn = getattr(X, name)

    @query(name, ctes("text_posts") + f"SELECT post_id, {sql_step(name, 'raw')} AS text "
           "FROM text_posts")
    def run(spark, sf):
        return I.text_posts(spark, sf).select("post_id", fn(F.col("raw")).alias("text"))


for _name in I.STEPS[1:]:
    _register_step(_name)


@query("unescape_html", f"SELECT page_id, {sql_step('unescape_html', 'html')} AS text FROM pages")
def unescape_html(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", X.unescape_html(F.col("html")).alias("text"))


@query("clean_text", ctes("text_posts", extra=I.sql_clean_chain(
    "text_posts", ["raw"], "post_id", "clean_raw")) + "SELECT post_id, raw AS text FROM clean_raw")
def clean_text(spark, sf):
    return I.text_posts(spark, sf).select("post_id", X.clean_text(F.col("raw")).alias("text"))


@query("clean_html", I.ctes(extra="pages0 AS (SELECT page_id, html AS text FROM pages), " +
                            I.sql_clean_chain("pages0", ["text"], "page_id", "clean_html")) +
       "SELECT page_id, text FROM clean_html")
def clean_html(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", X.clean_text(F.col("html")).alias("text"))


@query("combine_title_body", ctes("clean_posts") + "SELECT post_id, text FROM clean_posts")
def combine_title_body(spark, sf):
    return I.clean_posts(spark, sf).select("post_id", "text")


@query("text_lengths", ctes("clean_posts") + "SELECT post_id, length(text)::INT AS char_length, "
       f"len(regexp_extract_all(text, '[^{SPACE}]+'))::INT AS word_count FROM clean_posts")
def text_lengths(spark, sf):
    c = F.col("text")
    return I.clean_posts(spark, sf).select(
        "post_id", X.char_length(c).alias("char_length"), X.word_count(c).alias("word_count"))


@query("min_length", ctes("clean_posts") +
       "SELECT post_id, text FROM clean_posts WHERE length(text) >= 15")
def min_length(spark, sf):
    p = I.text_posts(spark, sf)
    text = X.combine_clean(X.clean_text(F.col("title")), X.clean_text(F.col("body")))
    return X.keep_long(p.select("post_id", "title", "body"), text, 15).select("post_id", "text")


@query("truncate_text", ctes("clean_posts") + "SELECT post_id, CASE WHEN length(text) > 300 THEN "
       "substr(text, 1, 300) || '...' ELSE text END AS text FROM clean_posts")
def truncate_text(spark, sf):
    return I.clean_posts(spark, sf).select("post_id", X.preview(F.col("text")).alias("text"))


# ------------------------------------------------------------------ tickers
_KNOWN = _in(COMPANY_OF)
_STOP = _in(T.DEFAULT_STOP)
_CASH = (f"list_filter(list_transform(regexp_extract_all(text, '\\$([A-Za-z]{{1,5}})\\b', 1), "
         f"lambda t: upper(t)), lambda t: t IN {_KNOWN} OR t NOT IN {_STOP})")
_CAPS = (f"list_filter(regexp_extract_all(text, '\\b([A-Z]{{2,5}})\\b', 1), lambda t: t IN {_KNOWN} "
         f"OR (length(t) IN (3, 4) AND t NOT IN {_STOP}))")


def _company_list(field: int) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches(lower(text), {q(p[0])}) THEN {q(p[field])} END"
        for p in COMPANY_PATTERNS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


TICKERS = f"""found AS (SELECT post_id, {_CASH} AS cash, {_CAPS} AS caps,
  {_company_list(1)} AS name_tickers, {_company_list(2)} AS names FROM clean_posts),
modes AS (SELECT kind, post_id, arg_max(t, [n, -first]) AS mode FROM (
  SELECT kind, post_id, t, count(*) AS n, min(i) AS first FROM (
    SELECT 'cash' AS kind, post_id, unnest(cash) AS t, generate_subscripts(cash, 1) AS i FROM found
    UNION ALL
    SELECT 'caps', post_id, unnest(caps), generate_subscripts(caps, 1) FROM found)
  GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_NAME = "CASE " + " ".join(
    f"WHEN {{0}} = {q(k)} THEN {q(v)}" for k, v in COMPANY_OF.items()) + " ELSE {0} END"


@query("extract_cashtags", ctes("clean_posts", extra=TICKERS) +
       "SELECT post_id, array_to_string(cash, ' ') AS tickers FROM found")
def extract_cashtags(spark, sf):
    return I.clean_posts(spark, sf).select("post_id", F.array_join(
        T.extract_cashtags(F.col("text")), " ").alias("tickers"))


@query("extract_capitals", ctes("clean_posts", extra=TICKERS) +
       "SELECT post_id, array_to_string(caps, ' ') AS tickers FROM found")
def extract_capitals(spark, sf):
    return I.clean_posts(spark, sf).select("post_id", F.array_join(
        T.extract_capitals(F.col("text")), " ").alias("tickers"))


@query("extract_companies", ctes("clean_posts", extra=TICKERS) + "SELECT post_id, "
       "array_to_string(name_tickers, ' ') AS tickers, array_to_string(names, ',') AS names "
       "FROM found")
def extract_companies(spark, sf):
    c = I.clean_posts(spark, sf).select(
        "post_id", T.extract_companies(F.col("text")).alias("c"))
    return c.select("post_id", F.array_join("c.ticker", " ").alias("tickers"),
                    F.array_join("c.company", ",").alias("names"))


_CASH_N, _CAPS_N = _NAME.format("c.mode"), _NAME.format("k.mode")
DETECTED = TICKERS + f""",
detected AS (SELECT f.post_id,
  CASE WHEN len(cash) > 0 THEN c.mode WHEN len(names) > 0 THEN name_tickers[1] ELSE k.mode END
    AS ticker,
  CASE WHEN len(cash) > 0 THEN {_CASH_N} WHEN len(names) > 0 THEN names[1]
    WHEN len(caps) > 0 THEN {_CAPS_N} END AS company,
  array_to_string(list_sort(list_distinct(CASE WHEN len(cash) > 0 THEN cash
    WHEN len(names) > 0 THEN name_tickers ELSE caps END)), ' ') AS all_tickers,
  CASE WHEN len(cash) > 0 THEN 0.95 WHEN len(names) > 0 THEN 0.85
    WHEN k.mode IN {_KNOWN} THEN 0.70 WHEN len(caps) > 0 THEN 0.50 ELSE 0.0 END::DOUBLE
    AS confidence,
  CASE WHEN len(cash) > 0 THEN 'cashtag' WHEN len(names) > 0 THEN 'company_name'
    WHEN len(caps) > 0 THEN 'capital_symbol' ELSE 'none' END AS method
  FROM found f LEFT JOIN modes c ON c.kind = 'cash' AND c.post_id = f.post_id
  LEFT JOIN modes k ON k.kind = 'caps' AND k.post_id = f.post_id)"""


@query("detect_tickers", ctes("clean_posts", extra=DETECTED) +
       "SELECT post_id, ticker, company, all_tickers, confidence, method FROM detected")
def detect_tickers(spark, sf):
    found = F.inline(F.array(T.detect_tickers(F.col("text"))))
    return I.clean_posts(spark, sf).select("post_id", found).withColumn(
        "all_tickers", F.array_join("all_tickers", " "))


@query("ticker_company", ctes("clean_posts", extra=TICKERS) + "SELECT t AS ticker, "
       f"{_NAME.format('t')} AS company, count(*) AS n FROM (SELECT unnest(cash) AS t FROM found) "
       "GROUP BY 1, 2")
def ticker_company(spark, sf):
    t = I.clean_posts(spark, sf).select(
        F.explode(T.extract_cashtags(F.col("text"))).alias("ticker"))
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "company", T.ticker_company(F.col("ticker")))


# ------------------------------------------------------------------ error categories
def _category_sql(groups, default: str, start: str = "") -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower(text), {q(E.group_pattern(p))}) THEN {q(n)}"
        for n, p in groups)
    return f"CASE {start} {whens} ELSE {q(default)} END"


_CAT4 = _category_sql(ERROR_GROUPS_4, ERROR_DEFAULT_4)
_CAT5 = _category_sql(ERROR_GROUPS_5, ERROR_DEFAULT_5,
                      f"WHEN length(text) > 1000 THEN {q(ERROR_LONG_5)}")


@query("error_category_4", ctes("clean_posts") +
       f"SELECT post_id, {_CAT4} AS error_category FROM clean_posts")
def error_category_4(spark, sf):
    return I.clean_posts(spark, sf).select(
        "post_id", E.error_category_4(F.col("text")).alias("error_category"))


@query("error_category_5", ctes("clean_posts") +
       f"SELECT post_id, {_CAT5} AS error_category FROM clean_posts")
def error_category_5(spark, sf):
    return I.clean_posts(spark, sf).select(
        "post_id", E.error_category_5(F.col("text")).alias("error_category"))


def _text_predictions(spark, sf, with_text: bool = False):
    """Two labellers on the labelled documents: cue counts and text length."""
    bull, bear = P.cue_counts(F.col("text"))
    cue = P.cue_label(bull, bear)
    names = {"positive": "BULLISH", "negative": "BEARISH", "neutral": "NEUTRAL"}
    shown = F.when(cue == "positive", names["positive"]).when(
        cue == "negative", names["negative"]).otherwise(names["neutral"])
    size = F.length("text") % 3
    by_size = F.when(size == 0, "BULLISH").when(size == 1, "BEARISH").otherwise("NEUTRAL")
    return I.clean_posts(spark, sf, labelled=True).select(
        "post_id", F.col("sentiment_label").alias("truth"),
        F.explode(F.array(
            F.struct(F.lit("cues").alias("model"), shown.alias("pred")),
            F.struct(F.lit("size").alias("model"), by_size.alias("pred")),
        )).alias("v"), *(["text"] if with_text else [])).select(
        "post_id", "truth", "v.*", *(["text"] if with_text else []))


def _cue_sum(words) -> str:
    return " + ".join(
        f"((length(lower(text)) - length(replace(lower(text), {q(w)}, ''))) // {len(w)})"
        for w in words)


TEXT_PRED = f"""cued AS (SELECT post_id, text, {_cue_sum(BULLISH_CUES)} AS bull,
  {_cue_sum(BEARISH_CUES)} AS bear FROM clean_posts),
text_pred AS (SELECT c.post_id, t.sentiment_label AS truth, m AS model, CASE WHEN m = 'cues' THEN
    CASE WHEN bull > bear THEN 'BULLISH' WHEN bear > bull THEN 'BEARISH' ELSE 'NEUTRAL' END
  ELSE CASE length(text) % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'NEUTRAL' END END
  AS pred, text FROM cued c JOIN text_truth t USING (post_id), (VALUES ('cues'), ('size')) g(m)),
errs AS (SELECT post_id, model, truth, pred, {_CAT4} AS error_category FROM text_pred
  WHERE truth <> pred)"""
_PRED = ctes("clean_posts", "text_truth", extra=TEXT_PRED)


@query("cue_label", ctes("clean_posts", extra=TEXT_PRED.split(",\ntext_pred")[0]) +
       "SELECT post_id, bull::INT AS bull, bear::INT AS bear, CASE WHEN bull > bear THEN "
       "'positive' WHEN bear > bull THEN 'negative' ELSE 'neutral' END AS label FROM cued")
def cue_label(spark, sf):
    bull, bear = P.cue_counts(F.col("text"))
    return I.clean_posts(spark, sf).select(
        "post_id", bull.alias("bull"), bear.alias("bear")
    ).withColumn("label", P.cue_label(F.col("bull"), F.col("bear")))


@query("error_rows", _PRED + "SELECT post_id, model, truth, pred FROM errs")
def error_rows(spark, sf):
    return EO.error_rows(_text_predictions(spark, sf))


@query("union_errors", _PRED + "SELECT post_id, model, truth, pred, error_category FROM errs")
def union_errors(spark, sf):
    # both models' errors come from one cleaning of the posts
    p = stage(EO.error_rows(_text_predictions(spark, sf, with_text=True)), "errors")
    return EO.diagnose(p.filter(F.col("model") == "cues")).unionByName(
        EO.diagnose(p.filter(F.col("model") == "size")))


@query("error_breakdown", _PRED + "SELECT model, " + ", ".join(
    f"count(*) FILTER (error_category = '{c}') AS {c.lower()}" for c in EO.CATEGORIES_4) +
    " FROM errs GROUP BY 1")
def error_breakdown(spark, sf):
    return EO.error_breakdown(EO.diagnose(_text_predictions(spark, sf, with_text=True)))


@query("model_disagreement", _PRED + f"""SELECT post_id, any_value(CASE WHEN length(text) > 300
  THEN substr(text, 1, 300) || '...' ELSE text END) AS text, any_value({_CAT5}) AS error_category,
  max(pred) FILTER (model = 'cues') AS cues_pred, bool_or(pred <> truth) FILTER (model = 'cues')
  AS cues_error, max(pred) FILTER (model = 'size') AS size_pred,
  bool_or(pred <> truth) FILTER (model = 'size') AS size_error,
  count(*) FILTER (pred <> truth) AS total_models_failing, max(truth) AS actual_label
  FROM text_pred GROUP BY 1""")
def model_disagreement(spark, sf):
    return EO.model_disagreement(
        I.clean_posts(spark, sf), _text_predictions(spark, sf), ["cues", "size"])


# ------------------------------------------------------------------ duplicates and splits
@query("dedup_text", ctes("clean_posts") + "SELECT post_id, subreddit, source, text FROM "
       "clean_posts QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1")
def dedup_text(spark, sf):
    return dedup.first_per_text(I.clean_posts(spark, sf), "text", "post_id")


CHRONO = ("placed AS (SELECT post_id, row_number() OVER (ORDER BY timestamp, "
          "md5(post_id::VARCHAR)) - 1 AS pos, count(*) OVER () AS n FROM posts)")
CHRONO_SPLIT = CHRONO + (", splits AS (SELECT post_id, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN "
                         "'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' "
                         "ELSE 'test' END AS split FROM placed)")


@query("chrono_position", ctes("posts", extra=CHRONO) + "SELECT post_id, pos FROM placed")
def chrono_position(spark, sf):
    keys = I.posts(spark, sf).select(
        "timestamp", splits.tie_key(F.col("post_id")).alias("tie"), "post_id",
        F.lit(1).alias("n"))
    return running_totals(keys, ["timestamp", "tie"]).select(
        "post_id", F.col("before").alias("pos"))


@query("split_chronological", ctes("posts", extra=CHRONO_SPLIT) +
       "SELECT post_id, split FROM splits")
def split_chronological(spark, sf):
    return splits.split_chronological(I.posts(spark, sf)).select("post_id", "split")


STRAT = """base AS (SELECT post_id, sentiment_label AS label, row_number() OVER (PARTITION BY
    sentiment_label ORDER BY md5('42|' || post_id)) AS pos FROM posts),
sizes AS (SELECT label, count(*) AS n, (SELECT count(*) FROM base) AS total FROM base GROUP BY 1),
q1 AS (SELECT *, floor(total * 0.7::DOUBLE)::BIGINT AS want FROM sizes),
q2 AS (SELECT *, want * n // total AS q, want * n % total AS rest FROM q1),
q3 AS (SELECT *, q + (row_number() OVER (ORDER BY rest DESC, label) <= want -
  (SELECT sum(q) FROM q2))::INT AS train FROM q2),
q4 AS (SELECT *, n - train AS left_n, total - want AS left_total,
  floor((total - want) * 0.5::DOUBLE)::BIGINT AS want_val FROM q3),
q5 AS (SELECT *, want_val * left_n // left_total AS qv, want_val * left_n % left_total AS restv
  FROM q4),
q6 AS (SELECT *, qv + (row_number() OVER (ORDER BY restv DESC, label) <= want_val -
  (SELECT sum(qv) FROM q5))::INT AS val FROM q5),
splits AS (SELECT post_id, label, CASE WHEN pos <= train THEN 'train' WHEN pos <= train + val THEN
  'val' ELSE 'test' END AS split FROM base JOIN q6 USING (label))"""


@query("split_stratified", ctes("posts", extra=STRAT) + "SELECT post_id, split FROM splits")
def split_stratified(spark, sf):
    return splits.split_stratified(I.posts(spark, sf)).select("post_id", "split")


@query("create_splits", ctes("posts", extra=STRAT) + "SELECT label AS sentiment_label, split, "
       "count(*) AS n FROM splits GROUP BY 1, 2")
def create_splits(spark, sf):
    return splits.create_splits(I.posts(spark, sf)).groupBy("sentiment_label", "split").agg(
        F.count(F.lit(1)).alias("n"))


DOC_SPLIT = CHRONO.replace("timestamp, ", "").replace("FROM posts", "FROM clean_posts")
DOC_SPLITS = (DOC_SPLIT + ", splits AS (SELECT p.post_id, text, CASE WHEN pos < "
              "floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + "
              "floor((n - floor(n * 0.7::DOUBLE)) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS "
              "split FROM placed p JOIN clean_posts USING (post_id))").replace(
    "md5(post_id::VARCHAR)", "md5('42|' || post_id)")


def _doc_splits(spark, sf):
    return splits.split_stratified(I.clean_posts(spark, sf).select("post_id", "text"))


_PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


@query("split_leakage", ctes("clean_posts", extra=DOC_SPLITS) + " UNION ALL ".join(
    f"SELECT '{a}_{b}' AS pair, (SELECT count(*) FROM (SELECT text FROM splits WHERE split = '{a}' "
    f"INTERSECT SELECT text FROM splits WHERE split = '{b}')) AS shared" for a, b in _PAIRS))
def split_leakage(spark, sf):
    return dedup.split_overlap(_doc_splits(spark, sf), F.col("text"))


@query("split_intersection", ctes("clean_posts", extra=DOC_SPLITS) + "SELECT text FROM splits "
       "WHERE split = 'train' INTERSECT SELECT text FROM splits WHERE split <> 'train'")
def split_intersection(spark, sf):
    s = _doc_splits(spark, sf)
    s = s.withColumn("_h", dedup.digest(F.col("text")))
    shared = s.groupBy("_h").agg(
        F.max((F.col("split") == "train").cast("int")).alias("a"),
        F.max((F.col("split") != "train").cast("int")).alias("b"),
        F.min("post_id").alias("post_id")).filter("a + b = 2")
    return s.join(shared.select("post_id"), "post_id", "left_semi").select("text")


# ------------------------------------------------------------------ prompts and responses
def _examples(spark, sf):
    """Six few-shot examples: the first six of the benchmark items."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("positive", "neutral", "negative")]),
                         (F.col("item_id") % 3 + 1).cast("int"))
    return I.table(spark, sf, "benchmark").orderBy("item_id").limit(6).select(
        F.col("item_id").alias("ord"), F.lit("NVDA").alias("ticker"), "text",
        label.alias("sentiment"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("reasoning_summary"))


SPEC = P.PromptSpec()


def _prompt_sql(reason: bool, shuffled: bool) -> str:
    block = ("'Example ' || i || ':' || chr(10) || 'Ticker: NVDA' || chr(10) || 'Post: \"\"\"' || "
             "text || '\"\"\"' || chr(10) || 'Output:' || chr(10) || '{' || chr(10) || ")
    if reason:
        block += "'  \"reasoning_summary\": \"item ' || item_id || '\",' || chr(10) || "
    block += ("'  \"sentiment\": \"' || ['positive', 'neutral', 'negative'][item_id % 3 + 1] || "
              "'\"' || chr(10) || '}'")
    order = "md5('7|' || item_id)" if shuffled else "item_id"
    head = SPEC.template.replace("{system_prompt}", SPEC.system_prompt).replace(
        "{instruction}", SPEC.instruction)
    a, rest = head.split("{demonstrations_formatted}")
    b, rest = rest.split("{ticker}")
    c, d = rest.split("{post_text}")
    return f"""six AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM
  (SELECT * FROM benchmark ORDER BY item_id LIMIT 6)),
demos AS (SELECT string_agg({block}, chr(10) || chr(10) ORDER BY i) AS d FROM six),
prompts AS (SELECT doc_id AS post_id, {sql_trim(f"{q(a)} || d || {q(b)} || upper(lang) || {q(c)} "
                                                f"|| text || {q(d)}")} AS prompt
  FROM documents, demos)"""


def _prompt_posts(spark, sf):
    return I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("post_id"), F.upper("lang").alias("ticker"), "text")


@query("render_prompts", ctes(extra=_prompt_sql(True, False)) + "SELECT post_id, k::INT AS path_id,"
       " md5(prompt || chr(10) || chr(10) || '[Sampling Path ' || k || '/8]') AS prompt_md5 FROM "
       "prompts, generate_series(1, 8) g(k)")
def render_prompts(spark, sf):
    p = K.render_prompts(_prompt_posts(spark, sf), _examples(spark, sf), paths=8)
    return p.select("post_id", "path_id", F.md5("prompt").alias("prompt_md5"))


@query("render_prompts_shuffled", ctes(extra=_prompt_sql(False, True)) +
       "SELECT post_id, prompt FROM prompts")
def render_prompts_shuffled(spark, sf):
    return K.render_prompts(_prompt_posts(spark, sf), _examples(spark, sf),
                            with_reasoning=False, shuffle_seed=7).select("post_id", "prompt")


_KEY = "sha256('model-a|0.5||' || text)"


def _requests(spark, sf):
    return I.responses(spark, sf).select(
        "conv_id", "turn", P.prompt_key(
            F.lit("model-a"), F.lit("0.5"), F.lit(None).cast("string"), F.col("text")
        ).alias("prompt_key"), F.col("raw").alias("response"))


@query("prompt_key", f"SELECT conv_id, turn, {_KEY} AS prompt_key FROM conversations")
def prompt_key(spark, sf):
    return _requests(spark, sf).select("conv_id", "turn", "prompt_key")


CACHE = f"""req AS (SELECT conv_id, turn, role, {_KEY} AS prompt_key, text FROM conversations),
cache AS (SELECT prompt_key, max(text) AS response FROM req WHERE role = 'assistant' GROUP BY 1)"""


@query("response_cache", ctes(extra=CACHE) + "SELECT r.conv_id, r.turn, r.prompt_key, c.response, "
       "c.prompt_key IS NULL AS pending FROM req r LEFT JOIN cache c USING (prompt_key)")
def response_cache(spark, sf):
    c = I.table(spark, sf, "conversations")
    req = c.select("conv_id", "turn", "role", "text", P.prompt_key(
        F.lit("model-a"), F.lit("0.5"), F.lit(None).cast("string"), F.col("text")
    ).alias("prompt_key"))
    cache = K.store_responses(req.filter(F.col("role") == "assistant").groupBy("prompt_key").agg(
        F.max("text").alias("response")))
    return K.answered(req.select("conv_id", "turn", "prompt_key"), cache)


PARSED = f"""parsed AS (SELECT conv_id, turn,
  CASE WHEN form IN (0, 1, 2, 3) THEN 'ok' WHEN form = 4 THEN 'invalid_label' WHEN raw = '' THEN
    'empty' ELSE 'unparsable' END AS status,
  CASE WHEN form IN (0, 1, 2, 3) THEN CASE word WHEN 'bullish' THEN 'positive' WHEN 'Sell' THEN
    'negative' ELSE 'neutral' END ELSE 'neutral' END AS label,
  CASE WHEN form IN (0, 1, 2, 3) THEN {sql_trim('line')} END AS reason, form FROM responses)"""


@query("parse_responses", ctes("responses", extra=PARSED) + f"""SELECT conv_id, turn, status, label,
  CASE label WHEN 'positive' THEN 'BULLISH' WHEN 'negative' THEN 'BEARISH' ELSE 'NEUTRAL' END
    AS display_label,
  CASE WHEN status <> 'ok' THEN '{P.FAILURE_PREFIX}' || status
    WHEN reason = '' AND form <> 3 THEN '{P.NO_REASON_JSON}' ELSE reason END AS reasoning_summary,
  CASE WHEN status = 'ok' THEN 0.85 ELSE 0.33 END::DOUBLE AS confidence FROM parsed""")
def parse_responses(spark, sf):
    return K.parse_responses(I.responses(spark, sf).select("conv_id", "turn", "raw"), "raw")


_RATES = ", ".join(f"('{a}', {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in TOKEN_RATES)


def _words_sql(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[^{SPACE}]+'))"


@query("usage_cost", ctes("responses") + "SELECT provider, prompt_tokens, completion_tokens, "
       "round(prompt_tokens * a + completion_tokens * b, 9) AS cost_usd FROM (SELECT provider, "
       f"sum({_words_sql('text')})::BIGINT AS prompt_tokens, "
       f"sum({_words_sql('raw')})::BIGINT AS completion_tokens FROM responses GROUP BY 1) "
       f"JOIN (VALUES {_RATES}) r(provider, a, b) USING (provider)")
def usage_cost(spark, sf):
    u = I.responses(spark, sf).select(
        "provider", X.word_count(F.col("text")).alias("prompt_tokens"),
        X.word_count(F.col("raw")).alias("completion_tokens"))
    return rounded(K.usage_cost(u), 9)


# ------------------------------------------------------------------ lexicon and tf-idf
def _boost_sql(p: str, d: float) -> str:
    return (f"CASE WHEN {p} IN {_in(BOOSTERS_UP)} THEN sign(valence) * {BOOST_STEP * d!r} WHEN {p} "
            f"IN {_in(BOOSTERS_DOWN)} THEN -sign(valence) * {BOOST_STEP * d!r} ELSE 0 END")


_LEX = ", ".join(f"({q(w)}, {v}::DOUBLE)" for w, v in LEXICON)
LEXSQL = f"""toks AS (SELECT post_id, regexp_extract_all(replace(lower(text), '''', ''),
  '[a-z0-9_]+') AS ts FROM clean_posts),
words AS (SELECT post_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS i FROM toks),
hits AS (SELECT w.post_id, valence, coalesce(CASE WHEN i > 1 THEN ts[i - 1] END, '') AS p1,
  coalesce(CASE WHEN i > 2 THEN ts[i - 2] END, '') AS p2,
  coalesce(CASE WHEN i > 3 THEN ts[i - 3] END, '') AS p3
  FROM words w JOIN toks USING (post_id) JOIN (VALUES {_LEX}) l(word, valence) USING (word)),
scored AS (SELECT post_id, (valence + {_boost_sql('p1', BOOST_DAMPING[0])} +
  {_boost_sql('p2', BOOST_DAMPING[1])} + {_boost_sql('p3', BOOST_DAMPING[2])}) * CASE WHEN p1 IN
  {_in(NEGATIONS)} OR p2 IN {_in(NEGATIONS)} OR p3 IN {_in(NEGATIONS)} THEN {NEGATION_FACTOR}
  ELSE 1 END AS v FROM hits),
sums AS (SELECT post_id, count(v) AS hits, coalesce(sum(v), 0) AS valence FROM clean_posts
  LEFT JOIN scored USING (post_id) GROUP BY 1),
lex AS (SELECT *, round(valence / sqrt(valence * valence + 15), 4) AS compound FROM sums)"""


@query("lexicon_score", ctes("clean_posts", extra=LEXSQL) + "SELECT post_id, hits, "
       "round(valence, 6) AS valence, compound, CASE WHEN compound > 0.05 THEN 'BULLISH' WHEN "
       "compound < -0.05 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM lex")
def lexicon_score(spark, sf):
    return rounded(lexicon.lexicon_score(I.clean_posts(spark, sf)))


@query("lexicon_join", ctes("clean_posts", extra=LEXSQL) + "SELECT word, count(*) AS n, "
       f"any_value(valence) AS valence FROM words JOIN (VALUES {_LEX}) l(word, valence) USING "
       "(word) GROUP BY 1")
def lexicon_join(spark, sf):
    words = I.clean_posts(spark, sf).select(
        F.explode(lexicon.tokens(F.col("text"))).alias("word"))
    counts = words.join(F.broadcast(lexicon.default_lexicon(spark)), "word")
    return counts.groupBy("word", "valence").agg(F.count(F.lit(1)).alias("n"))


TFIDF = f"""tt AS (SELECT doc_id, regexp_extract_all(lower(text), '[{WORD}]{{2,}}') AS ws
  FROM documents),
tw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tt),
tn AS (SELECT doc_id, w AS term FROM tw UNION ALL
  SELECT doc_id, w || ' ' || nxt FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id
    ORDER BY i) AS nxt FROM tw) WHERE nxt IS NOT NULL),
tc AS (SELECT doc_id, term, count(*) AS tf FROM tn GROUP BY 1, 2),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM tc GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10000),
tw2 AS (SELECT doc_id, term, tf, tf * idf AS w FROM tc JOIN vocab USING (term))"""


@query("tfidf", ctes(extra=TFIDF) + "SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER "
       "(PARTITION BY doc_id)), 6) AS tfidf FROM tw2")
def tfidf(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return rounded(tfidf_long(docs, "doc_id"))


