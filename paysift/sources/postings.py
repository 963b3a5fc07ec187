"""The postings view: job-posting shaped rows derived from the driver's tables.

Grain is one order (``o_orderkey`` is unique).  Line items are rolled up per
order with map-side partial aggregation before they meet ``orders``; the
tiny ``nation`` dimension (a fixed 25 rows) is the only explicit broadcast,
every other join is left to AQE, which demotes a side to broadcast only when
its measured size is under the threshold.

| posting column | built from |
| --- | --- |
| job_id | o_orderkey |
| job_title | max(p_type || ' ' || p_name) over the order's lines |
| salary_usd | o_totalprice |
| salary_currency | 'USD' |
| experience_level | o_orderpriority 5→EN, 3→MI, 2→SE, 1→EX, other→null |
| employment_type | max(l_returnflag) |
| company_location | ' ' || lower(n_name) of the customer's nation |
| company_size | o_orderstatus F/P/O → S/M/L |
| employee_residence | n_name |
| remote_ratio | (o_orderkey % 3) * 50 |
| required_skills | sorted distinct p_name joined by ', ' |
| education_required | o_custkey % 5 → Bachelor, Master, PhD, Associate, null |
| years_experience | number of lines |
| industry | c_mktsegment |
| posting_date | date(o_orderdate) |
| application_deadline | date(min(l_shipdate)) |
| job_description_length | (o_orderkey * 37) % 4000 + 500 |
| benefits_score | (o_orderkey % 100) / 10.0 |
| company_name | c_name |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.sources.tables import table

RAW_COLUMNS = [
    "job_id", "job_title", "salary_usd", "salary_currency", "experience_level",
    "employment_type", "company_location", "company_size", "employee_residence",
    "remote_ratio", "required_skills", "education_required", "years_experience",
    "industry", "posting_date", "application_deadline", "job_description_length",
    "benefits_score", "company_name",
]

_PRIORITY_LEVEL = {"5-LOW": "EN", "3-MEDIUM": "MI", "2-HIGH": "SE", "1-URGENT": "EX"}
_STATUS_SIZE = {"F": "S", "P": "M", "O": "L"}
_EDUCATION_BY_MOD = {0: "Bachelor", 1: "Master", 2: "PhD", 3: "Associate"}


def _case(col, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out


def line_rollup(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per-order rollup of line items (partial aggregation before the shuffle)."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    pt = part.select("p_partkey", "p_name", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey, "left")
    names = F.array_sort(F.collect_set("p_name"))
    return j.groupBy("l_orderkey").agg(
        F.max(F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))).alias("job_title"),
        F.when(F.size(names) > 0, F.array_join(names, ", ")).alias("required_skills"),
        F.max("l_returnflag").alias("employment_type"),
        F.min("l_shipdate").alias("first_ship"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def postings_from(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                  customer: DataFrame, nation: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded by definition.
    n = F.broadcast(nation.select("n_nationkey", "n_name"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    lines = line_rollup(lineitem, part)
    j = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(cn, o.o_custkey == cn.c_custkey, "left"))
    return j.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("job_title"),
        F.col("o_totalprice").alias("salary_usd"),
        F.lit("USD").alias("salary_currency"),
        _case(F.col("o_orderpriority"), _PRIORITY_LEVEL).alias("experience_level"),
        F.col("employment_type"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("company_location"),
        _case(F.col("o_orderstatus"), _STATUS_SIZE).alias("company_size"),
        F.col("n_name").alias("employee_residence"),
        ((F.col("o_orderkey") % 3) * 50).cast("int").alias("remote_ratio"),
        F.col("required_skills"),
        _case(F.col("o_custkey") % 5, _EDUCATION_BY_MOD).alias("education_required"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("int").alias("years_experience"),
        F.col("c_mktsegment").alias("industry"),
        F.col("o_orderdate").cast("date").alias("posting_date"),
        F.col("first_ship").cast("date").alias("application_deadline"),
        ((F.col("o_orderkey") * 37) % 4000 + 500).cast("int").alias("job_description_length"),
        ((F.col("o_orderkey") % 100) / 10.0).alias("benefits_score"),
        F.col("c_name").alias("company_name"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings (19 columns, before cleaning) for a scale-factor directory."""
    t = lambda name: table(spark, sf_dir, name)
    return postings_from(t("orders"), t("lineitem"), t("part"), t("customer"), t("nation"))
