"""Registered source / sink queries and the flagship marts (§2.12).

Sinks are checked by writing into a fresh shared folder and reading back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions.expr import exact_mean, exact_mean_whole
from paysift.functions.sampling import hash_bucket
from paysift.operators import aggregates as A
from paysift.operators import timeseries as T
from paysift.operators import linear as L
from paysift.operators.ml import mean_abs_importance
from paysift.operators.text import classify_keywords
from paysift.plans.common import round_doubles
from paysift.plans.marts import cleaned, mart_main
from paysift.plans.q_aggregates import DATA_CATEGORIES, DATA_CATEGORY_DEFAULT, category_sql
from paysift.plans.q_ml import EXPLAINED, LINEAR_SQL, contributions, explained
from paysift.plans.registry import register
from paysift.plans.sql import hash_bucket as sql_bucket, with_base, with_main
from paysift.session import materialize, shared_dir
from paysift.sources import files as IO
from paysift.sources.postings import postings
from paysift.sources.tables import table

RAW_SCHEMA = ("job_id long, job_title string, salary_usd double, salary_currency string, "
              "experience_level string, employment_type string, company_location string, company_size string, "
              "employee_residence string, remote_ratio int, required_skills string, education_required string, "
              "years_experience int, industry string, posting_date date, application_deadline date, "
              "job_description_length int, benefits_score double, company_name string")
FALLBACK_COLUMNS = ["job_title", "salary_usd", "experience_level", "employment_type", "company_size",
                    "remote_ratio", "education_required", "years_experience", "industry", "posting_date",
                    "benefits_score", "company_location", "required_skills"]


def _raw_csv(spark, sf, parts: int = 1):
    """Write the raw postings as ``parts`` header CSV folders under one shared folder."""
    base = shared_dir(spark, "raw_csv")
    p = postings(spark, sf)
    if parts == 1:
        IO.write_csv(p, f"{base}/part0")
    else:
        b = hash_bucket(F.col("job_id"), parts, "file")
        for i in range(parts):
            IO.write_csv(p.where(b == i), f"{base}/part{i}")
    return base


@register("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, sf):
    return round_doubles(table(spark, sf, "orders"))


@register("scan_parquet_pruned", "SELECT l_orderkey, round(l_quantity, 4) AS l_quantity, "
                                 "round(l_extendedprice, 4) AS l_extendedprice FROM lineitem")
def scan_parquet_pruned(spark, sf):
    return round_doubles(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"))


@register("scan_csv_schema", with_base("""
SELECT job_id, job_title, round(salary_usd, 4) AS salary_usd, experience_level, remote_ratio, required_skills,
       years_experience, posting_date, application_deadline, round(benefits_score, 4) AS benefits_score FROM postings"""))
def scan_csv_schema(spark, sf):
    base = _raw_csv(spark, sf)
    df, _ = IO.read_csv_checked(spark, f"{base}/part0", RAW_SCHEMA)
    return round_doubles(df.select("job_id", "job_title", "salary_usd", "experience_level", "remote_ratio",
                                   "required_skills", "years_experience", "posting_date", "application_deadline",
                                   "benefits_score"))


@register("scan_csv_glob", with_base("""
SELECT job_id, round(salary_usd, 4) AS salary_usd, industry, posting_date FROM postings"""))
def scan_csv_glob(spark, sf):
    base = _raw_csv(spark, sf, parts=2)
    df, _ = IO.read_csv_checked(spark, f"{base}/*/*.csv", RAW_SCHEMA)  # one scan over every file
    return round_doubles(df.select("job_id", "salary_usd", "industry", "posting_date"))


#: Faults planted in the raw CSV: every so many postings have a field that isn't of its type.
BAD_SALARY, BAD_DATE = 97, 89


@register("scan_csv_rejects", with_base(f"""
, bad AS (SELECT CASE WHEN {sql_bucket('job_id', 2, 'file')} = 0 THEN 'part0' ELSE 'part1' END AS folder, job_id % {BAD_SALARY} = 0 AS s, job_id % {BAD_DATE} = 0 AS d FROM postings)
SELECT folder, reason, count(*) AS n FROM (
  SELECT folder, 'salary_usd: not a double' AS reason FROM bad WHERE s UNION ALL SELECT folder, 'posting_date: not a date' FROM bad WHERE d)
GROUP BY ALL
UNION ALL SELECT folder, 'typed', count(*) FROM bad WHERE NOT s AND NOT d GROUP BY folder"""))
def scan_csv_rejects(spark, sf):
    """The raw CSV with planted faults in two folders: rejected fields by folder and reason, and the typed rows that are left."""
    base, p = shared_dir(spark, "faulty_csv"), postings(spark, sf)
    p = p.withColumn("salary_usd", F.when(F.col("job_id") % BAD_SALARY == 0, F.lit("n/a")).otherwise(F.col("salary_usd").cast("string")))
    p = materialize(p.withColumn("posting_date", F.when(F.col("job_id") % BAD_DATE == 0, F.lit("2024-13-45")).otherwise(F.col("posting_date").cast("string"))))
    for i in range(2):
        IO.write_csv(p.where(hash_bucket(F.col("job_id"), 2, "file") == i), f"{base}/part{i}")
    typed, rejected = IO.read_csv_checked(spark, f"{base}/*/*.csv", RAW_SCHEMA)
    faults = rejected.select(F.split("source_file", "/")[0].alias("folder"), F.explode("reasons").alias("reason"))
    whole = typed.select(F.when(hash_bucket(F.col("job_id"), 2, "file") == 0, "part0").otherwise("part1").alias("folder"), F.lit("typed").alias("reason"))
    return faults.unionByName(whole).groupBy("folder", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("scan_with_fallback", with_base("""
SELECT job_title, round(salary_usd, 4) AS salary_usd, experience_level, employment_type, company_size, remote_ratio,
  education_required, years_experience, industry, posting_date, round(benefits_score, 4) AS benefits_score,
  company_location, required_skills, upper(trim(company_location)) AS country FROM postings"""))
def scan_with_fallback(spark, sf):
    base = _raw_csv(spark, sf)
    missing_parquet = shared_dir(spark, "cleaned_missing")
    df = IO.read_with_fallback(spark, missing_parquet, f"{base}/part0", RAW_SCHEMA, FALLBACK_COLUMNS)
    return round_doubles(df.withColumn("country", F.upper(F.trim("company_location"))))


_MAIN_SELECT = """SELECT job_title, round(salary_usd, 4) AS salary_usd, experience_level, employment_type, company_size,
  remote_ratio, education_required, years_experience, industry, posting_date, round(benefits_score, 4) AS benefits_score,
  country, exp_label, exp_order, size_label, size_order, post_year, post_month, post_ym FROM main"""


@register("mart_main", with_main(_MAIN_SELECT))
def q_mart_main(spark, sf):
    return round_doubles(mart_main(cleaned(spark, sf)))


#: What the corrected year of the overwrite has more.
RAISE = 1000


@register("sink_parquet_overwrite", with_main(_MAIN_SELECT.replace(
    "round(salary_usd, 4)", f"round(CASE WHEN post_year = (SELECT max(post_year) FROM main) THEN salary_usd + {RAISE} ELSE salary_usd END, 4)")))
def sink_parquet_overwrite(spark, sf):
    """The mart by year, written twice as a whole, then its last year again with raised salaries: the other years stay."""
    path = shared_dir(spark, "mart_main")
    m = materialize(mart_main(cleaned(spark, sf)))
    IO.write_parquet(m, path, partition_by=["post_year"])
    IO.write_parquet(m, path, partition_by=["post_year"])  # overwrite: the second write replaces the first
    last = m.agg(F.max("post_year")).first()[0]
    IO.write_parquet(m.where(F.col("post_year") == last).withColumn("salary_usd", F.col("salary_usd") + RAISE), path, partition_by=["post_year"], touched_only=True)
    back = spark.read.parquet(path)
    return round_doubles(back.select(*m.columns))


@register("sink_csv_mart", with_base("""
SELECT industry, round_even(sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd) / 100, 0) AS avg_salary,
       count(salary_usd) AS job_count
FROM cleaned GROUP BY industry"""))
def sink_csv_mart(spark, sf):
    path = shared_dir(spark, "industry_csv")
    IO.write_csv(A.industry_mean(cleaned(spark, sf)), path)
    return IO.read_csv(spark, path, "industry string, avg_salary double, job_count long")


_KEYS = ["country"]


def _series_doc(spark, sf):
    s = materialize(T.monthly_series(cleaned(spark, sf), _KEYS, "posting_date", "salary_usd"))
    tests, fc = T.ar1_forecast(s, _KEYS)
    tab = T.forecast_table(s, _KEYS, tests, fc)
    met = T.metrics(tests, _KEYS)
    # one document per series; each array holds that series' months (bounded)
    rows = tab.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "month", F.bround("actual", 0).cast("long").alias("actual"),
        F.bround("predicted", 0).cast("long").alias("predicted"), "type"))).alias("_r"))
    d = rows.join(met, _KEYS, "left")
    doc = F.to_json(F.struct(
        F.col("country"),
        F.transform("_r", lambda r: r["month"]).alias("months"),
        F.transform("_r", lambda r: r["actual"]).alias("actual"),
        F.transform("_r", lambda r: r["predicted"]).alias("predicted"),
        F.transform("_r", lambda r: r["type"]).alias("type"),
        F.struct(F.bround("rmse", 0).cast("long").alias("rmse"), F.bround("mae", 0).cast("long").alias("mae"),
                 F.bround("mape", 2).alias("mape")).alias("metrics")), {"ignoreNullFields": "false"})
    return d.select(*_KEYS, doc.alias("doc"))


_SERIES_DOC_SQL = """
, hist AS (
  SELECT country, list_sort(list(struct_pack(month := month, actual := CAST(round_even(actual, 0) AS BIGINT),
         predicted := CAST(round_even(predicted, 0) AS BIGINT), type := type))) AS r FROM ftable GROUP BY country),
met AS (
  SELECT country, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae,
         avg(abs((actual - predicted) / actual)) * 100 AS mape FROM tests GROUP BY country)
SELECT h.country, CAST(to_json(struct_pack(country := h.country, months := list_transform(r, lambda x: x.month),
  actual := list_transform(r, lambda x: x.actual), predicted := list_transform(r, lambda x: x.predicted),
  type := list_transform(r, lambda x: x.type),
  metrics := struct_pack(rmse := CAST(round_even(rmse, 0) AS BIGINT), mae := CAST(round_even(mae, 0) AS BIGINT),
                         mape := round_even(mape, 2)))) AS VARCHAR) AS doc
FROM hist h LEFT JOIN met m ON h.country = m.country"""


def _series_sql():
    from paysift.plans.q_windows import _sql
    return _sql(_SERIES_DOC_SQL)


@register("sink_json_series", _series_sql())
def sink_json_series(spark, sf):
    path = shared_dir(spark, "series_json")
    IO.write_json_docs(_series_doc(spark, sf), path)
    back = spark.read.text(path).select(F.col("value").alias("doc"))
    return back.select(F.get_json_object("doc", "$.country").alias("country"), "doc")


@register("sink_append_log", """
SELECT user_id, CAST(to_json(struct_pack(event_type := event_type, k := json_extract(props, '$.k'))) AS VARCHAR) AS input_params,
  CAST(trunc(value * 1000) AS BIGINT) AS predicted_salary, round(value, 4) AS percentile, ts AS created_at,
  CAST(ts AS DATE) AS log_date FROM events""")
def sink_append_log(spark, sf):
    e = table(spark, sf, "events")
    log = e.select("user_id",
                   F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")))
                    .alias("input_params"),
                   (F.col("value") * 1000).cast("long").alias("predicted_salary"),
                   F.col("value").alias("percentile"), F.col("ts").alias("created_at"))
    path = shared_dir(spark, "prediction_log")
    b = hash_bucket(F.col("user_id"), 2, "batch")
    IO.append_batch(log.where(b == 0), path, "requests-0")  # two request batches appended to one log
    IO.append_batch(log.where(b == 1), path, "requests-1")
    IO.append_batch(log.where(b == 1), path, "requests-1")  # a repeated call adds nothing
    back = IO.read_log(spark, path)
    return round_doubles(back.select("user_id", "input_params", "predicted_salary", "percentile", "created_at",
                                     "log_date"))


def _dashboard(spark, sf, importances):
    """The document with these (feature, importance)."""
    c = cleaned(spark, sf).withColumn(
        "job_category", classify_keywords("job_title", DATA_CATEGORIES, DATA_CATEGORY_DEFAULT))
    c = c.withColumn("month", F.when(F.col("posting_date").isNotNull(), F.date_format("posting_date", "yyyy-MM")))
    # One scan of the postings feeds every block: a grouping-sets aggregate (one
    # row per country / category / industry / month), checkpointed because all
    # blocks and the forecast read it.
    sets = c.groupingSets([["country"], ["job_category"], ["industry"], ["month"]],
                          "country", "job_category", "industry", "month").agg(
        F.count("salary_usd").alias("n"),
        exact_mean("salary_usd", 2).alias("mean"), exact_mean_whole("salary_usd").alias("whole"),
        F.grouping_id().alias("gid"))
    g = materialize(sets)
    gid = {"country": 7, "job_category": 11, "industry": 13, "month": 14}
    s = (g.where((F.col("gid") == gid["month"]) & F.col("month").isNotNull())
          .select(F.col("month").alias("_k"), "month",
                  F.col("mean").alias("value"), F.col("n").alias("count"))
          .withColumn("_all", F.when(F.col("_k").isNotNull(), F.lit("all"))).drop("_k"))
    tests, fc = T.ar1_forecast(s, ["_all"])
    hist = s.select(F.struct("month", F.bround("value", 0).cast("long").alias("salary")).alias("x"))
    fut = fc.select(F.struct("month", F.bround("predicted", 0).cast("long").alias("salary")).alias("x"))

    def block(key):
        return g.where(F.col("gid") == gid[key]).select(
            F.struct(key, F.col("whole").cast("long").alias("avg_salary"),
                     F.col("n").alias("job_count")).alias("x"))

    whole = lambda c: F.bround(c, 0).cast("long")
    line = T.forecast_table(s, ["_all"], tests, fc).select(F.struct("month", "type", whole("actual").alias("actual"), whole("predicted").alias("predicted")).alias("x"))
    scores = T.metrics(tests, ["_all"]).select(F.struct(whole("rmse").alias("rmse"), whole("mae").alias("mae"), whole(F.col("mape") * 100).alias("mape_hundredths")).alias("x"))
    imp = importances.select(
        F.struct("feature", whole(F.col("importance") * 1_000_000).alias("millionths")).alias("x"))

    # every block has one row per month / country / category: the lists grow
    # with those cardinalities, never with the row count
    blocks = [("history", hist), ("forecast", fut), ("countries", block("country")),
              ("categories", block("job_category")), ("industries", block("industry")),
              ("forecast_table", line), ("metrics", scores), ("importance", imp)]
    rows = None
    for name, b in blocks:
        r = b.agg(F.to_json(F.array_sort(F.collect_list("x")), {"ignoreNullFields": "false"}).alias("json")).select(F.lit(name).alias("block"), "json")
        rows = r if rows is None else rows.unionByName(r)
    parts = [F.concat(F.lit(f'"{name}":'), F.max(F.when(F.col("block") == name, F.col("json"))))
             for name, _ in blocks]
    return rows.agg(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc"))


_DASHBOARD_SQL = f"""
WITH s AS (
  SELECT 'all' AS k, strftime(posting_date, '%Y-%m') AS month,
         round_even(sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd), 0) / 100 AS value
  FROM cleaned WHERE posting_date IS NOT NULL GROUP BY 2),
idx AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS t, count(*) OVER () AS n_points FROM s),
smp AS (SELECT * FROM (SELECT *, lag(value, 1) OVER (ORDER BY month) AS x3, t - 3 AS sample_idx, n_points - 3 AS n_samples FROM idx) WHERE t >= 3),
b AS (SELECT min(value) AS mn, max(value) AS mx FROM idx WHERE t < floor(0.8 * (n_points - 3)) + 3),
sc AS (SELECT smp.*, mn, mx, CASE WHEN mx <> mn THEN (value - mn) / (mx - mn) END AS ys,
              CASE WHEN mx <> mn THEN (x3 - mn) / (mx - mn) END AS xs3 FROM smp, b
       WHERE sample_idx < floor(0.8 * n_samples)),
fit AS (SELECT regr_intercept(ys, xs3) AS a, regr_slope(ys, xs3) AS bb FROM sc),
l AS (SELECT max_by(value, month) AS lv, max(month) AS lm FROM s),
f AS (SELECT lm, mn, mx, a, bb, CASE WHEN mx <> mn THEN (lv - mn) / (mx - mn) END AS s0 FROM l, b, fit),
f1 AS (SELECT *, a + bb * s0 AS s1 FROM f), f2 AS (SELECT *, a + bb * s1 AS s2 FROM f1), f3 AS (SELECT *, a + bb * s2 AS s3 FROM f2),
fc AS (SELECT strftime(CAST(lm || '-01' AS DATE) + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month,
              (CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) * (mx - mn) + mn AS predicted FROM f3, range(1, 4) r(k)),
tst AS (SELECT month, value, (a + bb * (x3 - mn) / (mx - mn)) * (mx - mn) + mn AS p FROM smp, b, fit WHERE sample_idx >= floor(0.8 * n_samples)),
cat AS (SELECT {category_sql('job_title')} AS job_category, salary_usd FROM cleaned)
SELECT CAST(to_json(struct_pack(
  history := (SELECT list_sort(list(struct_pack(month := month, salary := CAST(round_even(value, 0) AS BIGINT)))) FROM s),
  forecast := (SELECT list_sort(list(struct_pack(month := month, salary := CAST(round_even(predicted, 0) AS BIGINT)))) FROM fc),
  countries := (SELECT list_sort(list(struct_pack(country := country, avg_salary := CAST(round_even(a, 0) AS BIGINT), job_count := n)))
                FROM (SELECT country, sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd) / 100 AS a, count(*) AS n FROM cleaned GROUP BY 1)),
  categories := (SELECT list_sort(list(struct_pack(job_category := job_category, avg_salary := CAST(round_even(a, 0) AS BIGINT), job_count := n)))
                 FROM (SELECT job_category, sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd) / 100 AS a, count(*) AS n FROM cat GROUP BY 1)),
  industries := (SELECT list_sort(list(struct_pack(industry := industry, avg_salary := CAST(round_even(a, 0) AS BIGINT), job_count := n)))
                 FROM (SELECT industry, sum(CAST(round(salary_usd * 100) AS BIGINT)) / count(salary_usd) / 100 AS a, count(*) AS n FROM cleaned GROUP BY 1)),
  forecast_table := (SELECT list_sort(list(struct_pack(month := month, type := type, actual := actual, predicted := predicted))) FROM (
    SELECT s.month, CASE WHEN p IS NULL THEN 'historical' ELSE 'test_pred' END AS type, CAST(round_even(s.value, 0) AS BIGINT) AS actual,
      CAST(round_even(p, 0) AS BIGINT) AS predicted FROM s LEFT JOIN tst ON s.month = tst.month
    UNION ALL SELECT month, 'forecast', CAST(NULL AS BIGINT), CAST(round_even(predicted, 0) AS BIGINT) FROM fc)),
  metrics := (SELECT [struct_pack(rmse := CAST(round_even(sqrt(avg((value - p) * (value - p))), 0) AS BIGINT), mae := CAST(round_even(avg(abs(value - p)), 0) AS BIGINT),
    mape_hundredths := CAST(round_even(avg(abs((value - p) / value)) * 10000, 0) AS BIGINT))] FROM tst),
  importance := (SELECT list_sort(list(struct_pack(feature := feature, millionths := CAST(round_even(m * 1000000, 0) AS BIGINT)))) FROM (
    SELECT feature, avg(abs(contribution)) AS m FROM k GROUP BY feature)))) AS VARCHAR) AS doc"""


def _dashboard_sql():
    from paysift.plans.sql import BASE
    # the linear model's CTEs take their own names: its b and s are renamed
    linear = LINEAR_SQL.replace("\ns AS (", "\nls AS (").replace("FROM s)", "FROM ls)").replace("\nb AS (", "\nlb AS (").replace("FROM filled, b)", "FROM filled, lb)")
    return BASE + linear + ",\n" + _DASHBOARD_SQL.strip()[len("WITH "):]


@register("mart_dashboard")
def mart_dashboard(spark, sf):
    """The dashboard with the importances of the model on all features."""
    m, model = explained(spark, sf)
    return _dashboard(spark, sf, L.mean_abs(m.rows, model).join(m.names, "idx").select("feature", "importance"))


@register("mart_dashboard_two", _dashboard_sql())
def mart_dashboard_two(spark, sf):
    """The same document with the importances of level and years alone, which SQL can solve."""
    return _dashboard(spark, sf, mean_abs_importance(contributions(spark, sf), EXPLAINED))
