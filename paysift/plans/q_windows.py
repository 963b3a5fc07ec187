"""Registered window, time-series and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import aggregates as A
from paysift.operators import timeseries as T
from paysift.operators.ranking import row_numbers, top_n_per_group
from paysift.plans.common import round_doubles
from paysift.plans.marts import cleaned, stored_clean
from paysift.plans.registry import register
from paysift.plans.sql import with_base
from paysift.session import materialize
from paysift.sources.tables import table

KEYS = ["country"]
WINDOW, STEPS, TRAIN = 3, 3, 0.8


def _series(spark, sf):
    """The monthly series (one row per series and month) is aggregated from the
    postings once and checkpointed: every later step reads that small table."""
    return materialize(T.monthly_series(cleaned(spark, sf), KEYS, "posting_date", "salary_usd"))


# ---- SQL twins of the series chain -------------------------------------------
_SERIES = """, series AS (
  SELECT country, strftime(posting_date, '%Y-%m') AS month,
         round_even(sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd), 0) / 100 AS value,
         count(salary_usd) AS count
  FROM cleaned WHERE posting_date IS NOT NULL GROUP BY 1, 2),
idx AS (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY month) - 1 AS t,
         count(*) OVER (PARTITION BY country) AS n_points FROM series),
samples AS (
  SELECT * FROM (
    SELECT country, month, value, t, n_points, lag(value, 3) OVER w AS x1, lag(value, 2) OVER w AS x2,
           lag(value, 1) OVER w AS x3, CAST(t - 3 AS INTEGER) AS sample_idx, n_points - 3 AS n_samples
    FROM idx WINDOW w AS (PARTITION BY country ORDER BY month)) WHERE t >= 3),
split AS (
  SELECT *, CASE WHEN sample_idx < floor(0.8 * n_samples) THEN 'train' ELSE 'test' END AS part FROM samples),
bounds AS (
  SELECT country, min(value) AS mn, max(value) AS mx FROM idx
  WHERE t < floor(0.8 * (n_points - 3)) + 3 GROUP BY country),
scaled AS (
  SELECT s.*, mn, mx, CASE WHEN mx <> mn THEN (value - mn) / (mx - mn) END AS ys,
         CASE WHEN mx <> mn THEN (x3 - mn) / (mx - mn) END AS xs3
  FROM split s JOIN bounds USING (country)),
fit AS (
  SELECT country, regr_intercept(ys, xs3) AS a, regr_slope(ys, xs3) AS b FROM scaled
  WHERE part = 'train' GROUP BY country),
tests AS (
  SELECT country, month, value AS actual, (a + b * xs3) * (mx - mn) + mn AS predicted
  FROM scaled JOIN fit USING (country) WHERE part = 'test'),
lastv AS (
  SELECT country, max_by(value, month) AS last_value, max(month) AS last_month FROM series GROUP BY country),
f0 AS (
  SELECT l.country, l.last_month, mn, mx, a, b,
         CASE WHEN mx <> mn THEN (last_value - mn) / (mx - mn) END AS s0
  FROM lastv l JOIN bounds USING (country) JOIN fit USING (country)),
f1 AS (SELECT *, a + b * s0 AS s1 FROM f0),
f2 AS (SELECT *, a + b * s1 AS s2 FROM f1),
f3 AS (SELECT *, a + b * s2 AS s3 FROM f2),
forecasts AS (
  SELECT country, k AS step, strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month,
         (CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) * (mx - mn) + mn AS predicted
  FROM f3, range(1, 4) r(k)),
ftable AS (
  SELECT s.country, s.month, s.value AS actual, t.predicted,
         CASE WHEN t.predicted IS NOT NULL THEN 'test_pred' ELSE 'historical' END AS type
  FROM series s LEFT JOIN tests t ON s.country = t.country AND s.month = t.month
  UNION ALL
  SELECT country, month, CAST(NULL AS DOUBLE), predicted, 'forecast' FROM forecasts)"""


def _sql(rest: str) -> str:
    return with_base(_SERIES + "\n" + rest.strip())


@register("win_row_number", with_base("""
SELECT job_id, row_number() OVER (ORDER BY job_id) AS row_num FROM cleaned"""))
def win_row_number(spark, sf):
    return row_numbers(cleaned(spark, sf).select("job_id"), ["job_id"], "row_num")


@register("ts_lag_features", _sql("""
SELECT country, month, sample_idx, round(x1, 4) AS x1, round(x2, 4) AS x2, round(x3, 4) AS x3,
       round(value, 4) AS y FROM samples"""))
def ts_lag_features(spark, sf):
    s = T.lag_samples(_series(spark, sf), KEYS, WINDOW, train_fraction=TRAIN)
    return round_doubles(s.select(*KEYS, "month", "sample_idx", "x1", "x2", "x3", F.col("value").alias("y")))


@register("ts_split_chrono", _sql("SELECT country, month, sample_idx, n_samples, part FROM split"))
def ts_split_chrono(spark, sf):
    s = T.lag_samples(_series(spark, sf), KEYS, WINDOW, train_fraction=TRAIN)
    return s.select(*KEYS, "month", "sample_idx", "n_samples", "part")


@register("ts_minmax_scale", _sql("""
SELECT country, month, round(value, 4) AS value,
       round(CASE WHEN mx <> mn THEN (value - mn) / (mx - mn) END, 4) AS scaled
FROM series JOIN bounds USING (country)"""))
def ts_minmax_scale(spark, sf):
    s = _series(spark, sf)
    b = T.minmax_bounds(s, KEYS, WINDOW, train_fraction=TRAIN)
    out = s.join(b, KEYS).select(*KEYS, "month", "value",
                                 T.scale(F.col("value"), F.col("_min"), F.col("_max")).alias("scaled"))
    return round_doubles(out)


@register("ts_minmax_inverse", _sql("""
SELECT country, month, round(value, 4) AS value,
       round(CASE WHEN mx <> mn THEN (value - mn) / (mx - mn) END * (mx - mn) + mn, 4) AS restored
FROM series JOIN bounds USING (country)"""))
def ts_minmax_inverse(spark, sf):
    s = _series(spark, sf)
    b = T.minmax_bounds(s, KEYS, WINDOW, train_fraction=TRAIN)
    lo, hi = F.col("_min"), F.col("_max")
    out = s.join(b, KEYS).select(*KEYS, "month", "value",
                                 T.unscale(T.scale(F.col("value"), lo, hi), lo, hi).alias("restored"))
    return round_doubles(out)


@register("ts_future_months", _sql("""
SELECT country, k AS step, strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month
FROM lastv, range(1, 4) r(k)"""))
def ts_future_months(spark, sf):
    last = _series(spark, sf).groupBy(*KEYS).agg(F.max("month").alias("_m"))
    return last.select(*KEYS, F.posexplode(T.future_months(F.col("_m"), STEPS)).alias("_k", "month")) \
               .select(*KEYS, (F.col("_k") + 1).cast("long").alias("step"), "month")


@register("ts_ar1_forecast", _sql("SELECT country, step, month, round(predicted, 4) AS predicted FROM forecasts"))
def ts_ar1_forecast(spark, sf):
    _, fc = T.ar1_forecast(_series(spark, sf), KEYS, WINDOW, STEPS, TRAIN)
    return round_doubles(fc.withColumn("step", F.col("step").cast("long")))


# Pooled AR(3) by ordinary least squares, solved in SQL by Cramer's rule on the
# 3x3 covariance system (the intercept follows from the means).
_POOLED_SQL = _sql(""", sc3 AS (
  SELECT s.country, s.part, (s.x1 - mn) / (mx - mn) AS a1, (s.x2 - mn) / (mx - mn) AS a2,
         (s.x3 - mn) / (mx - mn) AS a3, (s.value - mn) / (mx - mn) AS yy
  FROM split s JOIN bounds USING (country) WHERE mx <> mn),
m AS (SELECT avg(a1) AS m1, avg(a2) AS m2, avg(a3) AS m3, avg(yy) AS my,
        covar_pop(a1, a1) AS c11, covar_pop(a1, a2) AS c12, covar_pop(a1, a3) AS c13,
        covar_pop(a2, a2) AS c22, covar_pop(a2, a3) AS c23, covar_pop(a3, a3) AS c33,
        covar_pop(a1, yy) AS d1, covar_pop(a2, yy) AS d2, covar_pop(a3, yy) AS d3
      FROM sc3 WHERE part = 'train'),
dt AS (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) AS dd FROM m),
beta AS (SELECT *,
  (d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / dd AS b1,
  (c11 * (d2 * c33 - d3 * c23) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / dd AS b2,
  (c11 * (c22 * d3 - c23 * d2) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / dd AS b3 FROM dt),
coef AS (SELECT b1, b2, b3, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM beta),
last3 AS (
  SELECT country, max(month) AS last_month, count(*) AS n,
         max(CASE WHEN r = 3 THEN value END) AS h1, max(CASE WHEN r = 2 THEN value END) AS h2,
         max(CASE WHEN r = 1 THEN value END) AS h3
  FROM (SELECT country, month, value, row_number() OVER (PARTITION BY country ORDER BY month DESC) AS r FROM series)
  WHERE r <= 3 GROUP BY country),
p0 AS (
  SELECT l.country, l.last_month, mn, mx, b0, b1, b2, b3,
         CASE WHEN mx <> mn THEN (h1 - mn) / (mx - mn) END AS s1,
         CASE WHEN mx <> mn THEN (h2 - mn) / (mx - mn) END AS s2,
         CASE WHEN mx <> mn THEN (h3 - mn) / (mx - mn) END AS s3
  FROM last3 l JOIN bounds USING (country), coef WHERE l.n = 3),
p1 AS (SELECT *, b0 + b1 * s1 + b2 * s2 + b3 * s3 AS f1 FROM p0),
p2 AS (SELECT *, b0 + b1 * s2 + b2 * s3 + b3 * f1 AS f2 FROM p1),
p3 AS (SELECT *, b0 + b1 * s3 + b2 * f1 + b3 * f2 AS f3 FROM p2)
SELECT country, CAST(k AS INTEGER) AS step,
  strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month,
  round((CASE k WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END) * (mx - mn) + mn, 4) AS predicted
FROM p3, range(1, 4) r(k)""")


@register("ts_recursive_forecast", _POOLED_SQL)
def ts_recursive_forecast(spark, sf):
    _, fc = T.pooled_ar_forecast(_series(spark, sf), KEYS, WINDOW, STEPS, TRAIN)
    return round_doubles(fc)


@register("ts_forecast_table", _sql("""
SELECT country, month, round(actual, 4) AS actual, round(predicted, 4) AS predicted, type FROM ftable"""))
def ts_forecast_table(spark, sf):
    s = _series(spark, sf)
    tests, fc = T.ar1_forecast(s, KEYS, WINDOW, STEPS, TRAIN)
    return round_doubles(T.forecast_table(s, KEYS, tests, fc))


@register("union_series", _sql("""
SELECT country, month, round(value, 4) AS value, 'historical' AS type FROM series
UNION ALL SELECT country, month, round(predicted, 4), 'forecast' FROM forecasts"""))
def union_series(spark, sf):
    s = _series(spark, sf)
    _, fc = T.ar1_forecast(s, KEYS, WINDOW, STEPS, TRAIN)
    h = s.select(*KEYS, "month", "value", F.lit("historical").alias("type"))
    f = fc.select(*KEYS, "month", F.col("predicted").alias("value"), F.lit("forecast").alias("type"))
    return round_doubles(h.unionByName(f))


@register("ts_band", _sql("""
SELECT country, month, type, round(predicted, 4) AS predicted,
  CASE WHEN type = 'forecast' THEN round_even(predicted * 1.02, 0) END AS upper_bound,
  CASE WHEN type = 'forecast' THEN round_even(predicted * 0.98, 0) END AS lower_bound,
  CASE WHEN type = 'forecast' THEN round_even(predicted * 1.02, 0) - round_even(predicted * 0.98, 0) END AS band_height
FROM ftable"""))
def ts_band(spark, sf):
    s = _series(spark, sf)
    tests, fc = T.ar1_forecast(s, KEYS, WINDOW, STEPS, TRAIN)
    out = T.band(T.forecast_table(s, KEYS, tests, fc))
    return round_doubles(out.select(*KEYS, "month", "type", "predicted", "upper_bound", "lower_bound", "band_height"))


@register("ts_chart_series", _sql("""
SELECT f.country, f.month, f.type,
  round(CASE WHEN f.type <> 'forecast' THEN f.actual END, 4) AS hist_actual,
  round(CASE WHEN f.type = 'test_pred' THEN f.predicted END, 4) AS test_pred,
  round(CASE WHEN f.month = a.anchor THEN f.actual WHEN f.type = 'forecast' THEN f.predicted END, 4) AS forecast_line
FROM ftable f LEFT JOIN (
  SELECT country, max(month) FILTER (WHERE type = 'historical') AS anchor FROM ftable GROUP BY country) a
ON f.country = a.country"""))
def ts_chart_series(spark, sf):
    s = _series(spark, sf)
    tests, fc = T.ar1_forecast(s, KEYS, WINDOW, STEPS, TRAIN)
    return round_doubles(T.chart_series(T.forecast_table(s, KEYS, tests, fc), KEYS))


@register("ts_change", _sql("""
SELECT country, month, price, prev, round_even(price - prev, 2) AS change,
  CASE WHEN prev <> 0 THEN round_even(round_even(price - prev, 2) / prev * 100, 2) ELSE 0.0 END AS change_pct,
  round_even(price - prev, 2) >= 0 AS up
FROM (SELECT country, month, round_even(value, 2) AS price,
             round_even(lag(value) OVER (PARTITION BY country ORDER BY month), 2) AS prev FROM series)
WHERE prev IS NOT NULL"""))
def ts_change(spark, sf):
    return round_doubles(T.change(_series(spark, sf), KEYS))


@register("ts_metrics", _sql("""
SELECT country, count(*) AS n_test, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
  round(avg(abs(actual - predicted)), 4) AS mae, round(avg(abs((actual - predicted) / actual)) * 100, 4) AS mape
FROM tests GROUP BY country"""))
def ts_metrics(spark, sf):
    tests, _ = T.ar1_forecast(_series(spark, sf), KEYS, WINDOW, STEPS, TRAIN)
    return round_doubles(T.metrics(tests, KEYS))


@register("topk_global", with_base("""
SELECT job_id, country, round(salary_usd, 4) AS salary_usd FROM cleaned
ORDER BY salary_usd DESC, job_id LIMIT 20"""))
def topk_global(spark, sf):
    c = cleaned(spark, sf).select("job_id", "country", "salary_usd")
    return round_doubles(c.orderBy(F.desc("salary_usd"), "job_id").limit(20))


@register("topk_abs_per_row", """
SELECT vec_id, dim, round(CAST(v AS DOUBLE), 4) AS value, rank FROM (
  SELECT vec_id, dim, v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, dim) AS rank
  FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS v FROM embeddings))
WHERE rank <= 8""")
def topk_abs_per_row(spark, sf):
    # local to the row: the eight largest by absolute value, ties by place
    pairs = F.transform("embedding", lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("dim"), v.cast("double").alias("value")))
    top = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice(F.array_sort(pairs), 1, 8)).alias("rank", "x"))
    return round_doubles(top.select("vec_id", "x.dim", "x.value", (F.col("rank") + 1).cast("long").alias("rank")))


@register("latest_n_per_user", """
SELECT user_id, event_id, ts, rank FROM (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events) WHERE rank <= 20""")
def latest_n_per_user(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = top_n_per_group(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("last_n_history", """
SELECT conv_id, turn, role, text, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank
  FROM conversations WHERE role IN ('user', 'assistant')) WHERE rank <= 10""")
def last_n_history(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    out = top_n_per_group(c, ["conv_id"], [F.desc("turn")], 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("sort_mart", with_base("""
SELECT row_number() OVER (ORDER BY median_salary DESC, country) AS position, * FROM (
  SELECT country, round_even(quantile_cont(salary_usd, 0.5), 0) AS median_salary, count(*) AS job_count
  FROM cleaned GROUP BY country)"""))
def sort_mart(spark, sf):
    c = stored_clean(spark, sf, "country", "salary_usd")
    m = A.grouped_stats(c, ["country"], "salary_usd", {"job_count": "rows"}, {"median_salary": 0.5}) \
         .withColumn("median_salary", F.bround("median_salary", 0)).withColumn("_neg", -F.col("median_salary"))
    out = row_numbers(m, ["_neg", "country"], "position").drop("_neg")
    return out.select("position", "country", "median_salary", "job_count").orderBy("position")
