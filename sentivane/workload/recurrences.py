"""SQL of the recurrences that the fitted queries follow: p values, Newton steps, naive Bayes."""

from __future__ import annotations

from sentivane.operators.models import DIRECTION_FEATURES, DIRECTION_MODELS, MAX_FEATURES
from sentivane.operators.stats import FRACTION_STEPS
from sentivane.vocab import WORD


def with_p(source: str, r: str, name: str = "withp") -> str:
    """CTEs from `source` (r, n, ...) to `name`, which has `p_value` beside its columns."""
    far = "CASE WHEN abs({0}) > 1e-300 THEN {0} ELSE 1e-300 END"
    d = far.format("(1 + k * s.d)")
    c = far.format("(1 + k / s.c)")
    return f"""{name}0 AS (SELECT *, (n_samples - 2) / 2e0 AS a0,
  greatest(0e0, 1 - {r} * {r}) AS x0 FROM {source}),
{name}1 AS (SELECT *, x0 < (a0 + 1) / (a0 + 2.5) AS direct FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN direct THEN a0 ELSE 0.5e0 END AS a, CASE WHEN direct THEN 0.5e0
  ELSE a0 END AS b, CASE WHEN direct THEN x0 ELSE 1 - x0 END AS x FROM {name}1),
{name}3 AS (SELECT *, list_transform(range(2, {2 * FRACTION_STEPS + 2}), lambda i: CASE
  WHEN i % 2 = 0 THEN (i // 2) * (b - i // 2) * x / ((a + i - 1) * (a + i))
  ELSE -(a + i // 2) * (a + b + i // 2) * x / ((a + i - 1) * (a + i)) END) AS links,
  1e0 / (1 - (a + b) * x / (a + 1)) AS first FROM {name}2),
{name}4 AS (SELECT *, list_reduce(links, lambda s, k: {{'d': 1e0 / {d}, 'c': {c},
  'h': s.h * (1e0 / {d}) * ({c})}}, {{'d': first, 'c': 1e0, 'h': first}}).h AS h,
  exp(lgamma(a0 + 0.5) - lgamma(a0) - lgamma(0.5) + a0 * ln(greatest(x0, 1e-300))
  + 0.5 * ln(greatest(1 - x0, 1e-300))) AS front FROM {name}3),
{name} AS (SELECT *, CASE WHEN n_samples < 3 OR {r} IS NULL THEN NULL WHEN x0 >= 1 THEN 1e0
  WHEN x0 <= 0 THEN 0e0 WHEN direct THEN front * h / a0 ELSE 1 - 2 * front * h END AS p_value
  FROM {name}4)"""


def _newton(steps: int = 14) -> str:
    """CTEs w0 ... w`steps`: weights (w0 to w3, the intercept last) of every model m."""
    size = len(DIRECTION_FEATURES) + 1
    out = ["w0 AS (SELECT m, " + ", ".join(f"0e0 AS w{i}" for i in range(size)) +
           f" FROM range({len(DIRECTION_MODELS)}) t(m))"]
    z = " + ".join(f"w{i} * x{i}" for i in range(size))
    for t in range(1, steps + 1):
        sums = [f"sum((mu - y) * x{i}) AS g{i}" for i in range(size)]
        gram = [f"sum(mu * (1 - mu) * x{i} * x{j}) + {int(i == j < size - 1)} AS h{i}{j}"
                for i in range(size) for j in range(i, size)]
        out.append(
            f"s{t} AS MATERIALIZED (SELECT m, {', '.join(sums + gram)} FROM (SELECT dr.*, "
            f"1 / (1 + exp(-({z}))) AS mu FROM dr JOIN w{t - 1} USING (m) WHERE train) GROUP BY m)")
        terms = [f"g{i} + w{i} AS e{i}" for i in range(size - 1)] + [f"g{size - 1} AS e{size - 1}"]
        for j in range(size):  # the factors of the Gram matrix, column by column
            less = "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j))
            terms.append(f"h{j}{j}{less} AS d{j}")
            for i in range(j + 1, size):
                less = "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j))
                terms.append(f"(h{j}{i}{less}) / d{j} AS l{i}{j}")
        for i in range(size):
            terms.append(f"e{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f" AS z{i}")
        for i in reversed(range(size)):
            terms.append(f"z{i} / d{i}" + "".join(
                f" - l{k}{i} * v{k}" for k in range(i + 1, size)) + f" AS v{i}")
        moved = ", ".join(f"w{i} - v{i} AS w{i}" for i in range(size))
        out.append(f"w{t} AS MATERIALIZED (SELECT m, {moved} FROM (SELECT *, {', '.join(terms)} "
                   f"FROM s{t} JOIN w{t - 1} USING (m)))")
    out.append(f"weights AS (SELECT * FROM w{steps})")
    return ",\n".join(out)


_MASKED = " UNION ALL ".join(
    f"SELECT {m} AS m, '{name}' AS model, " + ", ".join(
        f"{c if c in used else '0'}::DOUBLE AS x{i}" for i, c in enumerate(DIRECTION_FEATURES))
    + f", 1e0 AS x{len(DIRECTION_FEATURES)}, y, train FROM dv"
    for m, (name, used) in enumerate(DIRECTION_MODELS.items()))

# from `joint` to `weights` of the direction models, with their rows in `dr`
DIRECTION = f"""dv AS (SELECT {', '.join(DIRECTION_FEATURES)}, fwd_direction_1d::DOUBLE AS y,
  row_number() OVER (ORDER BY trading_date, ticker) <= floor(count(*) OVER () * 0.8::DOUBLE) AS train
  FROM joint WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DIRECTION_FEATURES)}
  AND fwd_direction_1d IS NOT NULL),
dr AS MATERIALIZED ({_MASKED}),
{_newton()}"""

COEFFICIENTS = " UNION ALL ".join(
    f"SELECT '{name}' AS model, '{c}' AS term, round(w{i}, 6) AS weight FROM weights WHERE m = {m}"
    for m, (name, used) in enumerate(DIRECTION_MODELS.items())
    for i, c in enumerate([*DIRECTION_FEATURES, "intercept"]) if c in used or c == "intercept")

_Z = " + ".join(f"w{i} * x{i}" for i in range(len(DIRECTION_FEATURES) + 1))
DIRECTION_SCORES = DIRECTION + f""",
ds AS (SELECT model, y, 1 / (1 + exp(-({_Z}))) AS s FROM dr JOIN weights USING (m) WHERE NOT train),
dk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY s)
  + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS rk FROM ds),
dc AS (SELECT model, count(*) AS n, sum(y) AS pos, count(*) FILTER (s > 0.5 AND y = 1) AS tp,
  count(*) FILTER (s > 0.5 AND y = 0) AS fp, count(*) FILTER ((s > 0.5)::INT = y) AS hits,
  sum(rk) FILTER (y = 1) AS ranks FROM dk GROUP BY 1),
dm AS (SELECT model, hits / n AS accuracy, (ranks - pos * (pos + 1) / 2) / (pos * (n - pos))
  AS auc_roc, 2 * tp / (tp + fp + pos) AS f1_score,
  (SELECT count(*) FROM dv WHERE train) AS train_size, n AS test_size FROM dc)"""

# from `labelled` (post_id, text, label, split) to `nbp` (post_id, label, pred)
NAIVE_BAYES = f"""lt AS (SELECT post_id, label, split, regexp_extract_all(lower(text),
  '[{WORD}]{{2,}}') AS ws FROM labelled WHERE split IN ('train', 'test')),
lw AS (SELECT post_id, label, split, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lt),
ln2 AS (SELECT post_id, label, split, w AS term FROM lw UNION ALL
  SELECT post_id, label, split, w || ' ' || nxt FROM (SELECT *, lead(w) OVER (PARTITION BY post_id
    ORDER BY i) AS nxt FROM lw) WHERE nxt IS NOT NULL),
lc AS (SELECT post_id, label, split, term, count(*) AS tf FROM ln2 GROUP BY ALL),
lv AS (SELECT term, ln((1 + (SELECT count(*) FROM lt WHERE split = 'train')) / (1 + count(*))) + 1
  AS idf FROM lc WHERE split = 'train' GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {MAX_FEATURES}),
lx AS (SELECT post_id, label, split, term, tf * idf / sqrt(sum(tf * tf * idf * idf)
  OVER (PARTITION BY post_id)) AS v FROM lc JOIN lv USING (term)),
lp AS (SELECT label AS class, ln(count(*) / (SELECT count(*) FROM lt WHERE split = 'train')) AS prior
  FROM lt WHERE split = 'train' GROUP BY 1),
lk AS (SELECT class, term, 1 + coalesce(sum(v), 0) AS total FROM lp CROSS JOIN lv LEFT JOIN (SELECT
  label AS class, term, v FROM lx WHERE split = 'train') USING (class, term) GROUP BY 1, 2),
lg AS (SELECT class, term, ln(total) - ln(sum(total) OVER (PARTITION BY class)) AS g FROM lk),
lm AS (SELECT post_id, class, sum(v * g) AS s FROM lx JOIN lg USING (term) WHERE split = 'test'
  GROUP BY 1, 2),
nbp AS (SELECT t.post_id, t.label, arg_max(p.class, prior + coalesce(s, 0)) AS pred FROM lt t
  CROSS JOIN lp p LEFT JOIN lm ON lm.post_id = t.post_id AND lm.class = p.class
  WHERE split = 'test' GROUP BY 1, 2)"""
