"""Registered scalar-expression and row-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions import expr as X
from paysift.operators import rules as R
from paysift.operators.selection import grouped_stats
from paysift.operators.text import classify_keywords
from paysift.plans.common import round_doubles, sql_case
from paysift.plans.marts import cleaned, stored_clean
from paysift.plans.q_aggregates import DATA_CATEGORIES, DATA_CATEGORY_DEFAULT, category_sql
from paysift.plans.registry import register
from paysift.plans.sql import title_case, with_base
from paysift.session import materialize
from paysift.sources.tables import table


@register("scalar_string", with_base(f"""
SELECT job_id, upper(trim(company_location)) AS upper_trim, lower(job_title) AS lower_title,
  CAST(len(regexp_split_to_array(required_skills, ',\\s*')) AS INTEGER) AS n_split,
  trim(company_location) AS stripped, industry || ' / ' || country AS joined,
  lpad(CAST(job_id AS VARCHAR), 8, '0') AS padded, starts_with(job_title, 'PROMO') AS is_promo,
  substr(country, 8) AS country_suffix, {title_case('company_location')} AS title,
  contains(lower(job_title), 'ring') OR contains(lower(job_title), 'bolt') AS ring_or_bolt,
  CASE WHEN length(required_skills) > 80 THEN substr(required_skills, 1, 80) || '…' ELSE required_skills END AS short_skills
FROM cleaned"""))
def scalar_string(spark, sf):
    c = cleaned(spark, sf)
    return c.select(
        "job_id", X.norm_upper("company_location").alias("upper_trim"), F.lower("job_title").alias("lower_title"),
        F.size(X.split_tokens(F.col("required_skills"))).alias("n_split"),
        F.trim("company_location").alias("stripped"),
        F.concat("industry", F.lit(" / "), "country").alias("joined"),
        F.lpad(F.col("job_id").cast("string"), 8, "0").alias("padded"),
        F.col("job_title").startswith("PROMO").alias("is_promo"),
        F.substr("country", F.lit(8)).alias("country_suffix"),
        X.title_case("company_location").alias("title"),
        X.contains_any(F.lower("job_title"), ["ring", "bolt"]).alias("ring_or_bolt"),
        X.truncate_text("required_skills", 80).alias("short_skills"))


@register("scalar_format", with_base("""
SELECT job_id, '$' || format('{:,}', CAST(trunc(salary_usd) AS BIGINT)) AS money,
  '$' || CAST(CAST(round_even(salary_usd / 1000, 0) AS BIGINT) AS VARCHAR) || 'K' AS money_k,
  printf('%+.1f%%', round_even(benefits_score - 5.0, 1)) AS signed_pct,
  regexp_replace(company_name, '[^0-9]', '', 'g') AS digits
FROM cleaned"""))
def scalar_format(spark, sf):
    c = cleaned(spark, sf)
    return c.select("job_id", X.money("salary_usd").alias("money"), X.money_k("salary_usd").alias("money_k"),
                    X.signed_pct(F.col("benefits_score") - 5.0).alias("signed_pct"),
                    X.digits_only("company_name").alias("digits"))


@register("scalar_date", with_base("""
SELECT job_id, TRY_CAST(CAST(posting_date AS VARCHAR) AS DATE) AS parsed,
  TRY_CAST('x' || CAST(posting_date AS VARCHAR) AS DATE) AS bad_parsed,
  CAST(year(posting_date) AS INTEGER) AS year, CAST(month(posting_date) AS INTEGER) AS month,
  CAST(quarter(posting_date) AS INTEGER) AS quarter, strftime(posting_date, '%Y-%m') AS ym,
  CASE WHEN application_deadline IS NULL OR posting_date IS NULL THEN NULL
       ELSE CAST(greatest(date_diff('day', posting_date, application_deadline), 0) AS INTEGER) END AS days_clipped,
  CAST(date_trunc('month', posting_date) + INTERVAL 1 MONTH AS DATE) AS next_month_start,
  CAST(CASE WHEN month(posting_date) < 12 THEN month(posting_date) + 1 ELSE 1 END AS INTEGER) AS next_month,
  CAST(CASE WHEN month(posting_date) < 12 THEN year(posting_date) ELSE year(posting_date) + 1 END AS INTEGER) AS next_month_year
FROM cleaned"""))
def scalar_date(spark, sf):
    c = cleaned(spark, sf)
    d = F.col("posting_date")
    nxt = F.add_months(d, 1)
    return c.select("job_id", X.to_date_safe(d).alias("parsed"),
                    X.to_date_safe(F.concat(F.lit("x"), d.cast("string"))).alias("bad_parsed"),
                    F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
                    X.year_month(d).alias("ym"),
                    X.days_between_clipped("application_deadline", d).alias("days_clipped"),
                    X.next_month_start(d).alias("next_month_start"),
                    F.month(nxt).alias("next_month"), F.year(nxt).alias("next_month_year"))


@register("scalar_math", with_base("""
SELECT job_id, round(ln(salary_usd), 4) AS ln_salary, round(exp(ln(salary_usd)), 4) AS exp_ln,
  round(abs(benefits_score - 5.0), 4) AS abs_dev, round_even(sqrt(salary_usd), 0) AS r0,
  round_even(sqrt(salary_usd), 1) AS r1, round_even(sqrt(salary_usd), 2) AS r2,
  round_even(sqrt(salary_usd), 4) AS r4, CAST(trunc(salary_usd) AS BIGINT) AS as_int,
  round(CASE WHEN years_experience <> 0 THEN salary_usd / (years_experience * 30007.0) - 1 END, 4) AS ratio_m1
FROM cleaned"""))
def scalar_math(spark, sf):
    c = cleaned(spark, sf)
    s = F.col("salary_usd")
    out = c.select("job_id", F.ln(s).alias("ln_salary"), F.exp(F.ln(s)).alias("exp_ln"),
                   F.abs(F.col("benefits_score") - 5.0).alias("abs_dev"),
                   *[F.bround(F.sqrt(s), d).alias(f"r{d}") for d in (0, 1, 2, 4)],
                   X.truncate_int(s).alias("as_int"),
                   X.ratio_minus_one(s, F.col("years_experience") * 30007.0).alias("ratio_m1"))
    return round_doubles(out)


@register("scalar_array", with_base("""
SELECT job_id, CAST(len(skills_array) AS INTEGER) AS n,
  CAST(len(list_filter(skills_array, lambda x: trim(x) <> '')) AS INTEGER) AS n_nonblank,
  array_to_string(list_transform(skills_array, lambda x: upper(x)), '|') AS upper_joined,
  list_contains(skills_array, 'blue ring') AS has_blue_ring, skills_array[1] AS first_skill
FROM cleaned"""))
def scalar_array(spark, sf):
    c = cleaned(spark, sf)
    a = F.col("skills_array")
    return c.select("job_id", F.size(a).alias("n"),
                    F.size(F.filter(a, lambda x: F.trim(x) != "")).alias("n_nonblank"),
                    F.array_join(F.transform(a, lambda x: F.upper(x)), "|").alias("upper_joined"),
                    F.array_contains(a, "blue ring").alias("has_blue_ring"),
                    F.element_at(a, 1).alias("first_skill"))


@register("scalar_json", """
SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS INTEGER) AS k,
  CAST(coalesce(TRY_CAST(CASE WHEN json_valid(substr(props, 2)) THEN json_extract_string(substr(props, 2), '$.k') END
                         AS INTEGER), -1) AS INTEGER) AS k_broken,
  CAST(to_json(struct_pack(user_id := user_id, event_type := event_type)) AS VARCHAR) AS params
FROM events""")
def scalar_json(spark, sf):
    e = table(spark, sf, "events")
    broken = F.substr("props", F.lit(2))
    return e.select("event_id", X.json_get("props", "$.k", -1, "int").alias("k"),
                    X.json_get(broken, "$.k", -1, "int").alias("k_broken"),
                    F.to_json(F.struct("user_id", "event_type")).alias("params"))


@register("scalar_conditional", with_base(f"""
SELECT job_id, CAST(coalesce({sql_case('experience_level', K.EXPERIENCE_CODE)}, 1) AS INTEGER) AS exp_code,
  CASE WHEN salary_usd > 300000 THEN 'high' WHEN salary_usd < 100000 THEN 'low' ELSE 'mid' END AS band,
  TRY_CAST(substr(company_name, 10) AS INTEGER) AS customer_no, TRY_CAST(job_title AS INTEGER) AS title_no
FROM cleaned"""))
def scalar_conditional(spark, sf):
    c = cleaned(spark, sf)
    return c.select("job_id", X.lookup("experience_level", K.EXPERIENCE_CODE, 1).cast("int").alias("exp_code"),
                    F.when(F.col("salary_usd") > 300000, "high").when(F.col("salary_usd") < 100000, "low")
                     .otherwise("mid").alias("band"),
                    X.safe_number(F.substr("company_name", F.lit(10)), "int").alias("customer_no"),
                    X.safe_number("job_title", "int").alias("title_no"))


@register("classify_keywords", with_base(f"""
SELECT job_id, job_title, {category_sql('job_title')} AS job_category FROM cleaned"""))
def q_classify_keywords(spark, sf):
    c = cleaned(spark, sf)
    return c.select("job_id", "job_title",
                    classify_keywords("job_title", DATA_CATEGORIES, DATA_CATEGORY_DEFAULT).alias("job_category"))


@register("interval_17", with_base("""
SELECT job_id, CAST(trunc(salary_usd) AS BIGINT) AS point,
  CAST(trunc(trunc(salary_usd) * 0.83) AS BIGINT) AS low, CAST(trunc(trunc(salary_usd) * 1.17) AS BIGINT) AS high,
  '$' || format('{:,}', CAST(trunc(salary_usd) AS BIGINT)) AS point_text,
  '$' || format('{:,}', CAST(trunc(trunc(salary_usd) * 0.83) AS BIGINT)) AS low_text,
  '$' || format('{:,}', CAST(trunc(trunc(salary_usd) * 1.17) AS BIGINT)) AS high_text
FROM cleaned"""))
def interval_17(spark, sf):
    return cleaned(spark, sf).select("job_id", *R.interval(F.col("salary_usd")))


def _skill_hint_sql() -> str:
    return (f"CASE WHEN skill_count < {K.SKILL_HINT_BELOW} THEN 'add: ' || array_to_string(coalesce(ts.skills, [])[1:2], ' / ')"
            " ELSE 'deepen: ' || array_to_string(coalesce(ts.skills, []), ' / ') END")


@register("advise_rules", with_base(f""", bm AS (
  SELECT country, quantile_cont(salary_usd, 0.5) AS benchmark FROM cleaned GROUP BY country),
hv AS (SELECT country FROM bm ORDER BY benchmark DESC, country LIMIT {K.HIGH_VALUE_COUNTRY_COUNT}),
sk AS (SELECT industry, skill, row_number() OVER (PARTITION BY industry ORDER BY count(*) DESC, skill) AS k FROM (
  SELECT industry, unnest(regexp_split_to_array(required_skills, ',\\s*')) AS skill FROM cleaned) GROUP BY industry, skill),
ts AS (SELECT industry, list(skill ORDER BY k) AS skills FROM sk WHERE k <= {K.HINT_SKILLS} GROUP BY industry),
p AS (SELECT job_id, experience_level, country, industry,
             CAST(len(regexp_split_to_array(required_skills, ',\\s*')) AS INTEGER) AS skill_count,
             salary_usd AS current_salary FROM cleaned)
SELECT p.job_id, p.experience_level, p.country, p.industry, p.skill_count, round(p.current_salary, 4) AS current_salary,
  {sql_case('p.experience_level', K.LEVEL_ADVICE, "''")} AS level_advice,
  {sql_case('p.experience_level', K.NEXT_LEVEL)} AS next_level,
  round(coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}), 4) AS benchmark,
  round(p.current_salary - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}), 4) AS gap,
  CASE WHEN p.current_salary - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}) > {K.BENCHMARK_BAND} THEN 'above'
       WHEN p.current_salary - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}) < -{K.BENCHMARK_BAND} THEN 'below'
       ELSE 'level' END AS geo_band,
  {_skill_hint_sql()} AS skill_hint,
  CASE WHEN p.experience_level IN ('SE', 'EX') AND hv.country IS NOT NULL THEN '{K.NEGOTIATION_HIGH_VALUE}'
       WHEN p.experience_level = 'EN' THEN '{K.NEGOTIATION_ENTRY}' ELSE '{K.NEGOTIATION_DEFAULT}' END AS negotiation
FROM p LEFT JOIN bm ON p.country = bm.country LEFT JOIN hv ON p.country = hv.country
  LEFT JOIN ts ON p.industry IS NOT DISTINCT FROM ts.industry"""))
def advise_rules(spark, sf):
    c = stored_clean(spark, sf, "job_id", "experience_level", "country", "industry", "skills_array", "salary_usd")
    # one row per country, read twice (join and top-k): computed once
    bm = materialize(grouped_stats(c, ["country"], "salary_usd", {"_n": "count"}, {"benchmark": 0.5}).drop("_n"))
    # the high-value list is a top-k of at most K rows: a bounded broadcast
    hv = F.broadcast(bm.orderBy(F.desc("benchmark"), "country").limit(K.HIGH_VALUE_COUNTRY_COUNT).select("country"))
    prof = c.select("job_id", "experience_level", "country", "industry",
                    F.size("skills_array").cast("int").alias("skill_count"),
                    F.col("salary_usd").alias("current_salary"))
    return round_doubles(R.advise(prof, bm, hv, R.top_skills(c)))
