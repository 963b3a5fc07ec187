"""Registered aggregate queries on the cleaned postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import exact_mean as exact_mean_col, year_month
from paysift.operators import aggregates as A
from paysift.operators.text import classify_keywords
from paysift.plans.common import round_doubles, sql_case
from paysift.plans.marts import cleaned, mart_main, stored_clean
from paysift.session import materialize, shared_dir
from paysift.plans.registry import register
from paysift.functions.sampling import hash_split
from paysift.plans.sql import hash_bucket as sql_hash
from paysift.plans.sql import exact_mean, exact_mean_whole, title_case, with_base, with_main

_COUNTRY_NAME_SQL = f"coalesce({sql_case('country', K.COUNTRY_DISPLAY)}, {title_case('country')})"

# Category rules for the driver's data: ordered, overlapping keyword lists over
# the part vocabulary of the derived job titles, so that priority decides.
DATA_CATEGORIES = [
    ("Precision Parts", ["ring", "gear"]),
    ("Fasteners", ["bolt", "rod", "ring"]),
    ("Promotional", ["promo"]),
    ("Heavy Duty", ["large", "anvil", "plate"]),
    ("Small Items", ["small", "gizmo", "widget"]),
]
DATA_CATEGORY_DEFAULT = "Other Items"


def category_sql(expr: str, rules=DATA_CATEGORIES, default=DATA_CATEGORY_DEFAULT) -> str:
    t = f"lower(coalesce({expr}, ''))"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, '{k.lower()}')" for k in kws) + f" THEN '{name}'"
        for name, kws in rules)
    return f"(CASE {whens} ELSE '{default}' END)"


@register("agg_country_summary", with_base(f"""
SELECT country, {exact_mean_whole('salary_usd')} AS avg_salary,
       round_even(quantile_cont(salary_usd, 0.5), 0) AS median_salary,
       count(salary_usd) AS job_count, max(salary_usd) AS max_salary,
       {_COUNTRY_NAME_SQL} AS country_name
FROM cleaned GROUP BY country ORDER BY avg_salary DESC, country"""))
def agg_country_summary(spark, sf):
    return A.country_summary(stored_clean(spark, sf, "country", "salary_usd"))


@register("agg_level_describe", with_main(f"""
SELECT experience_level, exp_label, exp_order, count(salary_usd) AS count,
  round({exact_mean('salary_usd')}, 4) AS mean, round(stddev_samp(salary_usd), 4) AS std,
  round(min(salary_usd), 4) AS min, round(quantile_cont(salary_usd, 0.25), 4) AS q25,
  round(quantile_cont(salary_usd, 0.5), 4) AS median, round(quantile_cont(salary_usd, 0.75), 4) AS q75,
  round(max(salary_usd), 4) AS max
FROM main WHERE exp_order IS NOT NULL GROUP BY ALL ORDER BY exp_order"""))
def agg_level_describe(spark, sf):
    main = mart_main(cleaned(spark, sf)).select("experience_level", "exp_label", "exp_order", "salary_usd")
    return round_doubles(A.level_describe(materialize(main)))


@register("agg_industry_mean", with_base(f"""
SELECT industry, {exact_mean_whole('salary_usd')} AS avg_salary, count(salary_usd) AS job_count
FROM cleaned GROUP BY industry ORDER BY avg_salary DESC, industry"""))
def agg_industry_mean(spark, sf):
    return A.industry_mean(cleaned(spark, sf))


@register("agg_trend_mart", with_main(f"""
SELECT post_ym, {exact_mean_whole('salary_usd')} AS avg_salary, count(salary_usd) AS job_count
FROM main WHERE post_ym IS NOT NULL GROUP BY post_ym ORDER BY post_ym"""))
def agg_trend_mart(spark, sf):
    return A.trend_mart(mart_main(cleaned(spark, sf)))


@register("agg_monthly_mean", with_base(f"""
SELECT strftime(posting_date, '%Y-%m') AS month, round({exact_mean('salary_usd')}, 4) AS mean_salary,
       count(salary_usd) AS count
FROM cleaned WHERE posting_date IS NOT NULL GROUP BY 1 ORDER BY 1"""))
def agg_monthly_mean(spark, sf):
    return round_doubles(A.monthly_mean(cleaned(spark, sf)))


@register("agg_skill_frequency", with_base("""
SELECT skill, count(*) AS count FROM (
  SELECT trim(unnest(string_split(required_skills, ','))) AS skill FROM cleaned)
WHERE skill <> '' GROUP BY skill ORDER BY count DESC, skill"""))
def agg_skill_frequency(spark, sf):
    return A.skill_frequency(cleaned(spark, sf))


@register("agg_category_stats", with_base(f"""
SELECT job_category, count(salary_usd) AS count, round({exact_mean('salary_usd')}, 4) AS mean,
  round(quantile_cont(salary_usd, 0.5), 4) AS median, round(quantile_cont(salary_usd, 0.25), 4) AS q25,
  round(quantile_cont(salary_usd, 0.75), 4) AS q75, round(stddev_samp(salary_usd), 4) AS std
FROM (SELECT *, {category_sql('job_title')} AS job_category FROM cleaned)
GROUP BY job_category HAVING count(salary_usd) >= 50 ORDER BY median DESC, job_category"""))
def agg_category_stats(spark, sf):
    category = classify_keywords("job_title", DATA_CATEGORIES, DATA_CATEGORY_DEFAULT).alias("job_category")
    return round_doubles(A.category_stats(stored_clean(spark, sf, category, "salary_usd")))


@register("agg_value_counts", with_base("""
SELECT experience_level, count(*) AS count FROM cleaned WHERE experience_level IS NOT NULL
GROUP BY 1 ORDER BY count DESC, experience_level"""))
def agg_value_counts(spark, sf):
    return A.value_counts(cleaned(spark, sf), "experience_level")


@register("agg_nunique", with_base("""
SELECT count(DISTINCT industry) AS n_industry, count(DISTINCT country) AS n_country,
       count(DISTINCT employment_type) AS n_employment_type FROM cleaned"""))
def agg_nunique(spark, sf):
    return A.nunique(cleaned(spark, sf), ["industry", "country", "employment_type"])


_SKETCHED = ["industry", "country", "company_name", "job_title"]


@register("agg_nunique_sketch", with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, TRUE AS within_bound FROM cleaned" for c in _SKETCHED)))
def agg_nunique_sketch(spark, sf):
    """Distinct counts from a stored table of daily sketches, merged over all days, beside the exact ones: within four standard errors."""
    c = stored_clean(spark, sf, "posting_date", *_SKETCHED)
    path = shared_dir(spark, "distinct_sketches")
    A.distinct_sketches(c, ["posting_date"], _SKETCHED).write.parquet(path)
    near, exact = A.nunique_from_sketches(spark.read.parquet(path), _SKETCHED), A.nunique(c, _SKETCHED)
    long = lambda d, name: d.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(f"n_{x}").alias(name)) for x in _SKETCHED])).alias("x")).select("x.*")
    ok = F.abs(F.col("n_near") - F.col("n_exact")) <= F.greatest(F.lit(1), 4 * A.SKETCH_ERROR * F.col("n_exact"))
    return long(exact, "n_exact").join(long(near, "n_near"), "column_name").select("column_name", "n_exact", ok.alias("within_bound"))


_DESCRIBE_COLS = ["salary_usd", "years_experience", "benefits_score"]


@register("agg_describe", with_base(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, round({exact_mean(c)}, 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM cleaned""" for c in _DESCRIBE_COLS)))
def agg_describe(spark, sf):
    return round_doubles(A.describe_columns(stored_clean(spark, sf, *_DESCRIBE_COLS), _DESCRIBE_COLS))


@register("agg_global_baseline", with_base(f""", m AS (
  SELECT strftime(posting_date, '%Y-%m') AS month, {exact_mean('salary_usd')} AS mean_salary
  FROM cleaned WHERE posting_date IS NOT NULL GROUP BY 1)
SELECT month, round(mean_salary, 4) AS mean_salary,
  round_even(avg(mean_salary) OVER (), 4) AS baseline_mean,
  round(min(mean_salary) OVER (), 4) AS series_min, round(max(mean_salary) OVER (), 4) AS series_max
FROM m"""))
def agg_global_baseline(spark, sf):
    m = cleaned(spark, sf).where(F.col("posting_date").isNotNull()).groupBy(
        year_month("posting_date").alias("month")).agg(exact_mean_col("salary_usd", 4).alias("mean_salary"))
    return round_doubles(A.global_baseline(m, "mean_salary"))


@register("peer_percentile", with_base("""
SELECT job_id, country, experience_level, round(salary_usd, 4) AS salary_usd,
  count(salary_usd) OVER g AS sample_size, count(salary_usd) OVER g >= 10 AS enough,
  CASE WHEN count(salary_usd) OVER g >= 10 THEN
    round_even(CAST(rank() OVER (PARTITION BY country, experience_level ORDER BY salary_usd) - 1 AS DOUBLE)
               / count(salary_usd) OVER g * 100, 1) END AS percentile,
  CASE WHEN count(salary_usd) OVER g >= 10 THEN round_even(quantile_cont(salary_usd, 0.5) OVER g, 0) END AS median,
  CASE WHEN count(salary_usd) OVER g >= 10 THEN round_even(quantile_cont(salary_usd, 0.25) OVER g, 0) END AS p25,
  CASE WHEN count(salary_usd) OVER g >= 10 THEN round_even(quantile_cont(salary_usd, 0.75) OVER g, 0) END AS p75
FROM cleaned WINDOW g AS (PARTITION BY country, experience_level)"""))
def peer_percentile(spark, sf):
    c = stored_clean(spark, sf, "job_id", "country", "experience_level", "salary_usd")
    return round_doubles(A.peer_percentile(c, ["country", "experience_level"], "salary_usd"))


@register("peer_percentile_request", with_base(f""",
req AS (SELECT job_id, ' ' || lower(country) || ' ' AS country, lower(experience_level) AS experience_level, salary_usd + 5000 AS salary_usd
  FROM cleaned WHERE {sql_hash('job_id', 10)} >= 8),
ref AS (SELECT country, experience_level, salary_usd FROM cleaned WHERE {sql_hash('job_id', 10)} < 8),
q AS (SELECT country, experience_level, count(salary_usd) AS n, quantile_cont(salary_usd, 0.5) AS med, quantile_cont(salary_usd, 0.25) AS p25,
  quantile_cont(salary_usd, 0.75) AS p75 FROM ref GROUP BY 1, 2),
below AS (SELECT r.job_id, count(*) AS below FROM req r JOIN ref f ON f.country = upper(trim(r.country))
  AND f.experience_level = upper(trim(r.experience_level)) AND f.salary_usd < r.salary_usd GROUP BY 1)
SELECT r.job_id, r.country, r.experience_level, round(r.salary_usd, 4) AS salary_usd, coalesce(n, 0) AS sample_size, coalesce(n, 0) >= 10 AS enough,
  CASE WHEN n >= 10 THEN round_even(CAST(coalesce(below, 0) AS DOUBLE) / n * 100, 1) END AS percentile,
  CASE WHEN n >= 10 THEN round_even(med, 0) END AS median, CASE WHEN n >= 10 THEN round_even(p25, 0) END AS p25,
  CASE WHEN n >= 10 THEN round_even(p75, 0) END AS p75
FROM req r LEFT JOIN q ON q.country = upper(trim(r.country)) AND q.experience_level = upper(trim(r.experience_level))
LEFT JOIN below b ON b.job_id = r.job_id"""))
def peer_percentile_request(spark, sf):
    """Raised salaries of the held-out postings, their keys as users type them, among the others."""
    c = stored_clean(spark, sf, "job_id", "country", "experience_level", "salary_usd", hash_split(F.col("job_id")).alias("part"))
    asked = c.where("part = 'test'").select("job_id", F.concat(F.lit(" "), F.lower("country"), F.lit(" ")).alias("country"),
                                            F.lower("experience_level").alias("experience_level"), (F.col("salary_usd") + 5000).alias("salary_usd"))
    return round_doubles(A.request_percentile(asked, c.where("part = 'train'"), ["country", "experience_level"], "salary_usd"))


@register("hist_equal_width", with_base(""", b AS (SELECT min(salary_usd) AS lo, max(salary_usd) AS hi FROM cleaned),
h AS (SELECT least(49, CAST(floor((salary_usd - lo) / ((hi - lo) / 50)) AS INTEGER)) AS bin, count(*) AS count
      FROM cleaned, b WHERE salary_usd IS NOT NULL GROUP BY 1)
SELECT bin, round(lo + bin * ((hi - lo) / 50), 4) AS bin_low, round(lo + (bin + 1) * ((hi - lo) / 50), 4) AS bin_high,
       count FROM h, b ORDER BY bin"""))
def hist_equal_width(spark, sf):
    return round_doubles(A.hist_equal_width(cleaned(spark, sf), "salary_usd", 50))


@register("kde_curve", with_base(""", s AS (
  SELECT count(salary_usd) AS n, min(salary_usd) AS lo, max(salary_usd) AS hi,
         stddev_samp(salary_usd) * pow(count(salary_usd), -0.2) AS h FROM cleaned),
d AS (SELECT salary_usd AS v, count(*) AS c FROM cleaned WHERE salary_usd IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(50))
SELECT point, round(lo + point * ((hi - lo) / 49), 4) AS x,
  round(sum(c * exp(-0.5 * pow((lo + point * ((hi - lo) / 49) - v) / h, 2)))
        * (1.0 / (n * h * sqrt(2 * pi()))) * 1000000, 4) AS density_per_million
FROM g, d, s GROUP BY point, lo, hi, n, h ORDER BY point"""))
def kde_curve(spark, sf):
    return round_doubles(A.kde_curve(cleaned(spark, sf), "salary_usd", 50))


# Box plots run on whole cents: quartiles at the 1/4 positions and 1.5·IQR
# fences are then exact binary fractions, so the fence tests and the printed
# values cannot depend on an engine's last floating-point bit.
@register("boxplot_stats", with_base(f""", top AS (
  SELECT industry FROM cleaned WHERE industry IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, industry LIMIT 10),
c AS (SELECT *, CAST(round(salary_usd * 100) AS BIGINT) AS cents FROM cleaned),
long AS (
  SELECT 'experience_level' AS dimension, experience_level AS group_value, cents FROM c
  UNION ALL SELECT 'company_size', company_size, cents FROM c
  UNION ALL SELECT 'industry', industry, cents FROM c WHERE industry IN (SELECT industry FROM top)
  UNION ALL SELECT 'remote_ratio', CAST(remote_ratio AS VARCHAR), cents FROM c
  UNION ALL SELECT 'job_category', {category_sql('job_title')}, cents FROM c),
q AS (
  SELECT dimension, group_value, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.5) AS median,
         quantile_cont(cents, 0.75) AS q3 FROM long WHERE group_value IS NOT NULL AND cents IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS fence_low, q3 + 1.5 * (q3 - q1) AS fence_high FROM q)
SELECT f.dimension, f.group_value, round(q1 / 100, 4) AS q1, round(median / 100, 4) AS median, round(q3 / 100, 4) AS q3,
  round(fence_low / 100, 4) AS fence_low, round(fence_high / 100, 4) AS fence_high,
  round(min(cents) FILTER (WHERE cents BETWEEN fence_low AND fence_high) / 100, 4) AS whisker_low,
  round(max(cents) FILTER (WHERE cents BETWEEN fence_low AND fence_high) / 100, 4) AS whisker_high,
  count(*) FILTER (WHERE NOT (cents BETWEEN fence_low AND fence_high)) AS n_outliers, count(*) AS n
FROM f JOIN long l ON l.dimension = f.dimension AND l.group_value = f.group_value
WHERE l.cents IS NOT NULL
GROUP BY ALL ORDER BY 1, 2"""))
def boxplot_stats(spark, sf):
    category = classify_keywords("job_title", DATA_CATEGORIES, DATA_CATEGORY_DEFAULT).alias("job_category")
    c = stored_clean(spark, sf, "experience_level", "company_size", "industry", "remote_ratio", category, F.round(F.col("salary_usd") * 100).cast("long").alias("cents"))
    # the top-10 industry list is at most 10 rows: a bounded broadcast
    top = F.broadcast(A.value_counts(c, "industry").limit(10).select(F.col("industry").alias("_top")))
    c = c.join(top, c["industry"] == top["_top"], "left")
    dims = {
        "experience_level": F.col("experience_level"),
        "company_size": F.col("company_size"),
        "industry": F.when(F.col("_top").isNotNull(), F.col("industry")),
        "remote_ratio": F.col("remote_ratio"),
        "job_category": F.col("job_category"),
    }
    out = A.boxplot_by_dimensions(c, dims, "cents")
    money = ["q1", "median", "q3", "fence_low", "fence_high", "whisker_low", "whisker_high"]
    return round_doubles(out.select("dimension", "group_value", *[(F.col(m) / 100).alias(m) for m in money],
                                    "n_outliers", "n"))


@register("corr_skill_count", with_base(f""", x AS (
  SELECT CAST(len(regexp_split_to_array(required_skills, ',\\s*')) AS INTEGER) AS skill_count, salary_usd FROM cleaned)
SELECT skill_count, count(salary_usd) AS n, round({exact_mean('salary_usd')}, 4) AS mean_y,
  round(quantile_cont(salary_usd, 0.5), 4) AS median_y,
  round((SELECT corr(skill_count, salary_usd) FROM x), 4) AS corr_xy
FROM x GROUP BY skill_count ORDER BY skill_count"""))
def corr_skill_count(spark, sf):
    c = stored_clean(spark, sf, F.size("skills_array").cast("int").alias("skill_count"), "salary_usd")
    out = A.corr_by_count(c, "skill_count", "salary_usd")
    return round_doubles(out.select("skill_count", "n", "mean_y", "median_y", "corr_xy"))
