"""Composed plans: the cleaning job, the BI main table, the dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import lookup, to_date_safe, year_month
from paysift.operators.clean import clean_postings, surrogate_id
from paysift.session import materialize
from paysift.sources.postings import postings

MAIN_COLUMNS = ["job_title", "salary_usd", "experience_level", "employment_type", "company_size",
                "remote_ratio", "education_required", "years_experience", "industry",
                "posting_date", "benefits_score", "country"]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned postings keyed by the source key ``job_id`` (lazy, one pass)."""
    return clean_postings(postings(spark, sf_dir))


def stored_clean(spark: SparkSession, sf_dir: str, *cols) -> DataFrame:
    """Columns of the cleaned postings, written once: for operators that scan their input several times."""
    return materialize(cleaned(spark, sf_dir).select(*cols))


def mart_clean(raw: DataFrame) -> DataFrame:
    """Whole cleaning job: typed, filled, filtered, split, normalised, then numbered
    ``AI00001…`` in source-key order (numbering after the filter gives gap-free ids)."""
    return surrogate_id(clean_postings(raw), ["job_id"])


def mart_main(clean: DataFrame) -> DataFrame:
    """BI main table: 12 posting columns + labels, sort orders and year/month/ym."""
    d = to_date_safe("posting_date")
    return (clean.select(*MAIN_COLUMNS)
                 .withColumn("exp_label", F.coalesce(lookup("experience_level", K.EXPERIENCE_LABEL),
                                                     F.lit(K.UNKNOWN_LABEL)))
                 .withColumn("exp_order", lookup("experience_level", K.EXPERIENCE_ORDER).cast("int"))
                 .withColumn("size_label", F.coalesce(lookup("company_size", K.SIZE_LABEL),
                                                      F.lit(K.UNKNOWN_LABEL)))
                 .withColumn("size_order", lookup("company_size", K.SIZE_ORDER).cast("int"))
                 .withColumn("posting_date", d)
                 .withColumn("post_year", F.year("posting_date"))
                 .withColumn("post_month", F.month("posting_date"))
                 .withColumn("post_ym", year_month("posting_date")))


def feature_names(clean: DataFrame, keep=(), base: bool = True) -> DataFrame:
    """Feature-name table (``feature`` + ``keep`` columns) fitted from the data:
    one-hot names of the categorical levels present, plus (``base``) the fixed
    numeric and embedding feature names."""
    keep = list(keep)
    # one pass: every row contributes its three one-hot names
    names = clean.select(*keep, F.explode(F.array(*[F.concat(F.lit(p), F.col(c))
                                                    for c, p in K.ONEHOT_PREFIXES.items()])).alias("feature"))
    if base:
        spark = clean.sparkSession
        fixed = K.BASE_NUMERIC_FEATURES + [f"{K.EMBEDDING_PREFIX}{i}" for i in range(K.EMBEDDING_DIM)]
        names = names.unionByName(spark.createDataFrame([(f,) for f in fixed], "feature string"))
    return names.distinct()
