"""Shared SQL text for the DuckDB oracle: the postings and cleaned views as CTEs.

The oracle is written independently of the DataFrame code so the two can
disagree; it runs on the same Parquet tables registered as views.
"""

LINES = r"""_lines AS (
  SELECT l.l_orderkey,
         max(p.p_type || ' ' || p.p_name) AS job_title,
         string_agg(DISTINCT p.p_name, ', ' ORDER BY p.p_name) AS required_skills,
         max(l.l_returnflag) AS employment_type,
         min(l.l_shipdate) AS first_ship,
         count(*) AS n_lines
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey)"""

POSTINGS = r"""postings AS (
  SELECT o.o_orderkey AS job_id, ln.job_title, o.o_totalprice AS salary_usd,
    'USD' AS salary_currency,
    CASE o.o_orderpriority WHEN '5-LOW' THEN 'EN' WHEN '3-MEDIUM' THEN 'MI'
         WHEN '2-HIGH' THEN 'SE' WHEN '1-URGENT' THEN 'EX' END AS experience_level,
    ln.employment_type,
    ' ' || lower(n.n_name) AS company_location,
    CASE o.o_orderstatus WHEN 'F' THEN 'S' WHEN 'P' THEN 'M' WHEN 'O' THEN 'L' END AS company_size,
    n.n_name AS employee_residence,
    CAST((o.o_orderkey % 3) * 50 AS INTEGER) AS remote_ratio,
    ln.required_skills,
    CASE o.o_custkey % 5 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' WHEN 2 THEN 'PhD'
         WHEN 3 THEN 'Associate' END AS education_required,
    CAST(coalesce(ln.n_lines, 0) AS INTEGER) AS years_experience,
    c.c_mktsegment AS industry,
    CAST(o.o_orderdate AS DATE) AS posting_date,
    CAST(ln.first_ship AS DATE) AS application_deadline,
    CAST((o.o_orderkey * 37) % 4000 + 500 AS INTEGER) AS job_description_length,
    CAST(o.o_orderkey % 100 AS DOUBLE) / 10.0 AS benefits_score,
    c.c_name AS company_name
  FROM orders o
  LEFT JOIN _lines ln ON ln.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

CLEANED = r"""cleaned AS (
  SELECT job_id, job_title, salary_usd, salary_currency,
    coalesce(experience_level, 'Unknown') AS experience_level,
    coalesce(employment_type, 'Unknown') AS employment_type,
    company_location, coalesce(company_size, 'unknown') AS company_size, employee_residence,
    remote_ratio, coalesce(required_skills, '') AS required_skills,
    coalesce(education_required, 'Unknown') AS education_required,
    years_experience, coalesce(industry, 'Unknown') AS industry,
    posting_date, application_deadline, job_description_length, benefits_score,
    coalesce(company_name, 'Unknown') AS company_name,
    regexp_split_to_array(coalesce(required_skills, ''), ',\s*') AS skills_array,
    upper(trim(company_location)) AS country
  FROM postings
  WHERE salary_usd IS NOT NULL AND salary_usd > 0 AND salary_usd < 1000000)"""

BASE = "WITH " + ",\n".join([LINES, POSTINGS, CLEANED])


def with_base(rest: str) -> str:
    """``rest`` either starts with ``, name AS (...)`` (more CTEs) or a SELECT."""
    rest = rest.strip()
    return BASE + ("\n" if rest.startswith(",") else "\n") + rest


def title_case(expr: str) -> str:
    """DuckDB form of Python ``str.title`` (capitalise after every non-letter)."""
    return (f"list_aggregate(list_transform(regexp_extract_all(lower({expr}), '\\p{{L}}+|[^\\p{{L}}]+'),"
            f" lambda w: upper(w[1]) || w[2:]), 'string_agg', '')")


def hash_bucket(expr: str, modulus: int, salt: str = "") -> str:
    """DuckDB twin of ``paysift.functions.sampling.hash_bucket``."""
    return (f"(CAST(('0x' || substr(md5('{salt}' || CAST({expr} AS VARCHAR)), 1, 7)) AS BIGINT)"
            f" % {modulus})")


def _base_feature_names_sql() -> str:
    from paysift.functions.constants import BASE_NUMERIC_FEATURES
    return "VALUES " + ", ".join(f"('{f}')" for f in BASE_NUMERIC_FEATURES)


BASE_FEATURE_NAMES_SQL = _base_feature_names_sql()

MAIN = r"""main AS (
  SELECT job_title, salary_usd, experience_level, employment_type, company_size, remote_ratio,
    education_required, years_experience, industry, posting_date, benefits_score, country,
    coalesce(CASE experience_level WHEN 'EN' THEN 'Entry (EN)' WHEN 'MI' THEN 'Mid (MI)'
      WHEN 'SE' THEN 'Senior (SE)' WHEN 'EX' THEN 'Expert (EX)' END, 'Unknown') AS exp_label,
    CAST(CASE experience_level WHEN 'EN' THEN 1 WHEN 'MI' THEN 2 WHEN 'SE' THEN 3 WHEN 'EX' THEN 4 END
         AS INTEGER) AS exp_order,
    coalesce(CASE company_size WHEN 'S' THEN 'Small (S)' WHEN 'M' THEN 'Medium (M)'
      WHEN 'L' THEN 'Large (L)' END, 'Unknown') AS size_label,
    CAST(CASE company_size WHEN 'S' THEN 1 WHEN 'M' THEN 2 WHEN 'L' THEN 3 END AS INTEGER) AS size_order,
    CAST(year(posting_date) AS INTEGER) AS post_year, CAST(month(posting_date) AS INTEGER) AS post_month,
    strftime(posting_date, '%Y-%m') AS post_ym
  FROM cleaned)"""


def with_main(rest: str) -> str:
    return with_base(", " + MAIN + ("\n" if rest.strip().startswith(",") else "\n") + rest.strip())


def exact_mean(x: str, digits: int = 4) -> str:
    """The mean by its definition, rounded once."""
    return f"round_even(avg({x}), {digits})"


def exact_mean_whole(x: str) -> str:
    return exact_mean(x, 0)
