"""Registered cleaning, projection, quality and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import clean_tokens, feature_display
from paysift.functions.sampling import hash_bucket
from paysift.operators import aggregates as A
from paysift.operators import clean as C
from paysift.operators import quality as Q
from paysift.operators.columns import select_by_prefix, vector_to_columns
from paysift.plans.common import round_doubles, sql_case
from paysift.plans.marts import cleaned, feature_names, mart_clean
from paysift.plans.registry import register
from paysift.plans.sql import BASE_FEATURE_NAMES_SQL, hash_bucket as sql_hash, title_case, with_base
from paysift.sources.postings import RAW_COLUMNS, postings
from paysift.sources.tables import table

EMB_DIM = 64  # the driver's embeddings table holds 64 floats per row


@register("project_cast", with_base("SELECT * FROM postings"))
def project_cast(spark, sf):
    return round_doubles(C.project_cast(postings(spark, sf), RAW_COLUMNS))


@register("surrogate_id", with_base("""
SELECT 'AI' || lpad(CAST(row_number() OVER (ORDER BY job_id) AS VARCHAR),
                    CAST(greatest(5, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS job_id,
       job_id AS source_job_id, round(salary_usd, 4) AS salary_usd
FROM cleaned"""))
def surrogate_id(spark, sf):
    c = cleaned(spark, sf).select("job_id", F.col("job_id").alias("source_job_id"), "salary_usd")
    return round_doubles(C.surrogate_id(c, ["source_job_id"]))


@register("rename_drop_reorder", with_base("""
SELECT country, job_id, salary_usd AS salary, industry, experience_level FROM cleaned"""))
def rename_drop_reorder(spark, sf):
    c = cleaned(spark, sf).select("job_id", "salary_usd", "industry", "experience_level",
                                  "country", "company_name")
    out = C.rename_drop_reorder(c, drop=["company_name"], rename={"salary_usd": "salary"},
                                front=["country"])
    return round_doubles(out)


_EMB_COLS = ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 4) AS skill_emb_{i}" for i in range(EMB_DIM))


@register("vector_to_columns", f"SELECT vec_id, label, {_EMB_COLS} FROM embeddings")
def q_vector_to_columns(spark, sf):
    e = table(spark, sf, "embeddings")
    return round_doubles(vector_to_columns(e, "embedding", "skill_emb_", EMB_DIM))


@register("select_by_prefix", f"SELECT vec_id, {_EMB_COLS} FROM embeddings")
def q_select_by_prefix(spark, sf):
    wide = vector_to_columns(table(spark, sf, "embeddings"), "embedding", "skill_emb_", EMB_DIM)
    return round_doubles(select_by_prefix(wide, "skill_emb_", keep=["vec_id"]))


_FEATURE_NAMES_SQL = f""", features AS (
  SELECT DISTINCT 'ind_' || industry AS feature FROM cleaned
  UNION SELECT DISTINCT 'emp_' || employment_type FROM cleaned
  UNION SELECT DISTINCT 'ctry_' || country FROM cleaned
  UNION SELECT * FROM ({BASE_FEATURE_NAMES_SQL}) b(feature)
  UNION SELECT 'skill_emb_' || CAST(i AS VARCHAR) FROM range(100) t(i))"""

_DISPLAY_SQL = f"""CASE WHEN {sql_case('feature', K.FEATURE_DISPLAY)} IS NOT NULL THEN {sql_case('feature', K.FEATURE_DISPLAY)}
  WHEN starts_with(feature, 'ctry_') THEN 'Country: ' || {title_case('substr(feature, 6)')}
  WHEN starts_with(feature, 'ind_') THEN 'Industry: ' || substr(feature, 5)
  WHEN starts_with(feature, 'emp_') THEN 'EmpType: ' || substr(feature, 5)
  WHEN starts_with(feature, 'skill_emb_') THEN 'SkillVec[' || substr(feature, 11) || ']'
  ELSE feature END"""


@register("feature_display_name", with_base(_FEATURE_NAMES_SQL + f"""
SELECT feature, {_DISPLAY_SQL} AS display_name FROM features"""))
def feature_display_name(spark, sf):
    f = feature_names(cleaned(spark, sf))
    return f.select("feature", feature_display("feature").alias("display_name"))


@register("drop_null_target", with_base("""
SELECT job_id, round(salary_usd, 4) AS salary_usd FROM postings WHERE salary_usd IS NOT NULL"""))
def drop_null_target(spark, sf):
    return round_doubles(C.drop_null_target(postings(spark, sf)).select("job_id", "salary_usd"))


@register("fill_defaults", with_base("""
SELECT job_id, coalesce(required_skills, '') AS required_skills,
  coalesce(company_size, 'unknown') AS company_size,
  coalesce(experience_level, 'Unknown') AS experience_level,
  coalesce(employment_type, 'Unknown') AS employment_type,
  coalesce(education_required, 'Unknown') AS education_required,
  coalesce(industry, 'Unknown') AS industry, coalesce(company_name, 'Unknown') AS company_name
FROM postings"""))
def fill_defaults(spark, sf):
    cols = ["job_id"] + list(C.FILL_DEFAULTS)
    return C.fill_defaults(postings(spark, sf).select(*cols))


@register("range_filter", with_base("""
SELECT job_id, round(salary_usd, 4) AS salary_usd FROM postings
WHERE salary_usd > 0 AND salary_usd < 1000000"""))
def range_filter(spark, sf):
    return round_doubles(C.range_filter(postings(spark, sf).select("job_id", "salary_usd")))


@register("filter_in_topk", with_base(""", top AS (
  SELECT job_title FROM cleaned WHERE job_title IS NOT NULL
  GROUP BY job_title ORDER BY count(*) DESC, job_title LIMIT 10)
SELECT job_id, job_title, round(salary_usd, 4) AS salary_usd FROM cleaned
WHERE job_title IN (SELECT job_title FROM top)"""))
def filter_in_topk(spark, sf):
    c = cleaned(spark, sf).select("job_id", "job_title", "salary_usd")
    return round_doubles(A.filter_in_topk(c, "job_title", 10))


# request values, normalised the way the percentile endpoint does (trim + upper)
_GROUP_COUNTRY, _GROUP_LEVEL = " nation_7 ", "se "


@register("filter_group_eq", with_base(f"""
SELECT job_id, country, experience_level, round(salary_usd, 4) AS salary_usd FROM cleaned
WHERE country = upper(trim('{_GROUP_COUNTRY}')) AND experience_level = upper(trim('{_GROUP_LEVEL}'))"""))
def filter_group_eq(spark, sf):
    c = cleaned(spark, sf)
    out = C.filter_group_eq(c, {"country": _GROUP_COUNTRY, "experience_level": _GROUP_LEVEL})
    return round_doubles(out.select("job_id", "country", "experience_level", "salary_usd"))


@register("filter_blank_tokens", with_base("""
SELECT job_id, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)),
                               lambda x: x <> ''), '|') AS tokens,
       CAST(len(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_tokens
FROM (SELECT job_id, coalesce(required_skills, '') || ' , ,' AS raw FROM cleaned)"""))
def filter_blank_tokens(spark, sf):
    # every list gets two blank tokens appended so the filter always has work to do
    c = cleaned(spark, sf).select("job_id", F.concat(F.col("required_skills"), F.lit(" , ,")).alias("raw"))
    t = clean_tokens("raw")
    return c.select("job_id", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n_tokens"))


_RAW_COLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM postings" for c in RAW_COLUMNS)


@register("null_profile", with_base(_RAW_COLS_SQL))
def null_profile(spark, sf):
    return Q.null_profile(postings(spark, sf))


@register("rule_checks", with_base("""
SELECT * FROM (
  SELECT 'null_target' AS rule, count(*) FILTER (WHERE salary_usd IS NULL) AS violations FROM postings
  UNION ALL SELECT 'target_le_low', count(*) FILTER (WHERE salary_usd <= 0) FROM postings
  UNION ALL SELECT 'target_ge_high', count(*) FILTER (WHERE salary_usd >= 1000000) FROM postings
  UNION ALL SELECT 'skills_null', count(*) FILTER (WHERE required_skills IS NULL) FROM postings
  UNION ALL SELECT 'skills_blank', count(*) FILTER (WHERE trim(required_skills) = '') FROM postings
  UNION ALL SELECT 'skills_no_token', count(*) FILTER (WHERE len(list_filter(
      list_transform(string_split(coalesce(required_skills, ''), ','), lambda x: trim(x)),
      lambda x: x <> '')) = 0) FROM postings)"""))
def rule_checks(spark, sf):
    return Q.rule_report(postings(spark, sf), Q.posting_rules())


@register("token_coverage", with_base("""
SELECT count(*) AS rows,
  count(*) FILTER (WHERE n > 0) AS non_empty_rows,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total_tokens,
  coalesce(sum(n), 0) > 0 AS ok
FROM (SELECT len(list_filter(list_transform(string_split(required_skills, ','), lambda x: trim(x)),
                             lambda x: x <> '')) AS n FROM cleaned)"""))
def token_coverage(spark, sf):
    c = cleaned(spark, sf).select(clean_tokens("required_skills").alias("tokens"))
    return Q.token_coverage(c, "tokens")


@register("column_set_compare", with_base(f""", split AS (
  SELECT *, CASE WHEN {sql_hash('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part FROM cleaned),
names AS (
  SELECT part, 'ind_' || industry AS feature FROM split
  UNION SELECT part, 'emp_' || employment_type FROM split
  UNION SELECT part, 'ctry_' || country FROM split),
l AS (SELECT DISTINCT feature FROM names WHERE part = 'train'),
r AS (SELECT DISTINCT feature FROM names WHERE part = 'test')
SELECT coalesce(l.feature, r.feature) AS feature, l.feature IS NOT NULL AS in_left,
       r.feature IS NOT NULL AS in_right
FROM l FULL OUTER JOIN r ON l.feature = r.feature"""))
def column_set_compare(spark, sf):
    from paysift.functions.sampling import hash_split
    c = cleaned(spark, sf).withColumn("part", hash_split(F.col("job_id")))
    names = feature_names(c, keep=["part"], base=False)
    return Q.column_set_compare_by(names, "part", "train", "test")


#: The feature dimensions that the reference's own data must have: base features and embedding.
EXPECTED_DIMENSIONS = (53, 100)


@register("dimension_check", with_base(f""", split AS (
  SELECT *, CASE WHEN {sql_hash('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part FROM cleaned),
names AS (
  SELECT part, 'ind_' || industry AS feature FROM split
  UNION SELECT part, 'emp_' || employment_type FROM split
  UNION SELECT part, 'ctry_' || country FROM split)
SELECT part, {len(K.BASE_NUMERIC_FEATURES)} + count(feature) AS n_base, CAST({K.EMBEDDING_DIM} AS BIGINT) AS n_embedding,
  {len(K.BASE_NUMERIC_FEATURES)} + count(feature) = {EXPECTED_DIMENSIONS[0]} AND {K.EMBEDDING_DIM} = {EXPECTED_DIMENSIONS[1]} AS as_expected
FROM names GROUP BY part"""))
def dimension_check(spark, sf):
    """Number of base features (numeric and one-hot) and of embedding columns in train and test, against the expectation."""
    from paysift.functions.sampling import hash_split
    c = cleaned(spark, sf).withColumn("part", hash_split(F.col("job_id")))
    n = feature_names(c, keep=["part"], base=False).groupBy("part").agg((F.lit(len(K.BASE_NUMERIC_FEATURES)) + F.count_distinct("feature")).alias("n_base"))
    return n.select("part", "n_base", F.lit(K.EMBEDDING_DIM).cast("long").alias("n_embedding"),
                    ((F.col("n_base") == EXPECTED_DIMENSIONS[0]) & F.lit(K.EMBEDDING_DIM == EXPECTED_DIMENSIONS[1])).alias("as_expected"))


@register("distinct_pairs", with_base("""
SELECT DISTINCT company_location, country FROM cleaned"""))
def distinct_pairs(spark, sf):
    return cleaned(spark, sf).select("company_location", "country").distinct()


@register("row_sample", with_base(f"""
SELECT job_id, round(salary_usd, 4) AS salary_usd FROM cleaned
WHERE {sql_hash('job_id', 1000000, 'sample')} < 1000"""))
def row_sample(spark, sf):
    c = cleaned(spark, sf).select("job_id", "salary_usd")
    return round_doubles(Q.hash_sample(c, "job_id", 0.001, salt="sample"))


@register("distinct_rows", with_base("""
SELECT DISTINCT industry, experience_level, company_size FROM cleaned"""))
def distinct_rows(spark, sf):
    return cleaned(spark, sf).select("industry", "experience_level", "company_size").distinct()


# two "source files" of the same schema: the posting stream split by an md5 bucket
@register("union_by_name", with_base(f"""
SELECT job_id, round(salary_usd, 4) AS salary_usd, industry, posting_date FROM postings"""))
def union_by_name(spark, sf):
    p = postings(spark, sf)
    b = hash_bucket(F.col("job_id"), 2, "file")
    a = p.where(b == 0).select("job_id", "salary_usd", "industry", "posting_date")
    z = p.where(b == 1).select("posting_date", "industry", "salary_usd", "job_id")
    return round_doubles(C.union_by_name([a, z]))


@register("union_subset", with_base(f"""
SELECT posting_date, round(salary_usd, 4) AS salary_usd FROM postings"""))
def union_subset(spark, sf):
    p = postings(spark, sf)
    b = hash_bucket(F.col("job_id"), 2, "file")
    return round_doubles(C.union_subset([p.where(b == 0), p.where(b == 1)], ["posting_date", "salary_usd"]))


_MART_CLEAN_SQL = with_base("""
SELECT 'AI' || lpad(CAST(row_number() OVER (ORDER BY job_id) AS VARCHAR),
                    CAST(greatest(5, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS job_id,
  job_title, round(salary_usd, 4) AS salary_usd, salary_currency, experience_level, employment_type,
  company_location, company_size, employee_residence, remote_ratio, required_skills,
  education_required, years_experience, industry, posting_date, application_deadline,
  job_description_length, round(benefits_score, 4) AS benefits_score, company_name,
  array_to_string(skills_array, '|') AS skills_array, country
FROM cleaned""")


@register("mart_clean", _MART_CLEAN_SQL)
def q_mart_clean(spark, sf):
    m = mart_clean(postings(spark, sf))
    return round_doubles(m.withColumn("skills_array", F.array_join("skills_array", "|")))
