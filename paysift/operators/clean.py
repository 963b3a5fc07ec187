"""Cleaning operators: typed projection, keyed ids, null handling, range filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.functions.expr import norm_upper, split_tokens
from paysift.operators.ranking import row_numbers

CASTS = {"salary_usd": "double", "years_experience": "int",
         "job_description_length": "int", "benefits_score": "double"}

FILL_DEFAULTS = {
    "required_skills": "",
    "company_size": "unknown",
    "experience_level": "Unknown",
    "employment_type": "Unknown",
    "education_required": "Unknown",
    "industry": "Unknown",
    "company_name": "Unknown",
}

SALARY_MIN_EXCLUSIVE, SALARY_MAX_EXCLUSIVE = 0, 1_000_000


def project_cast(df: DataFrame, columns: Sequence[str], casts: dict[str, str] = CASTS) -> DataFrame:
    """Fixed projection with ANSI-safe casts (bad values become null, not errors)."""
    return df.select(*[F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c)
                       for c in columns])


def surrogate_id(df: DataFrame, order_cols: Sequence[str], name: str = "job_id",
                 prefix: str = "AI", min_width: int = 5) -> DataFrame:
    """Replace ``name`` by ``prefix`` + zero-padded running number, placed first.

    Numbers follow ``order_cols`` (a real key, not arrival order).  The pad
    width grows with the row count, so 100,000+ rows never collide.
    """
    numbered = row_numbers(df, order_cols, "_rn", total_name="_n_rows")
    width = F.greatest(F.lit(min_width), F.length(F.col("_n_rows").cast("string")))
    new_id = F.concat(F.lit(prefix), F.lpad(F.col("_rn").cast("string"), width, "0"))
    rest = [c for c in df.columns if c != name]
    return numbered.select(new_id.alias(name), *rest)


def drop_null_target(df: DataFrame, target: str = "salary_usd") -> DataFrame:
    return df.dropna(subset=[target])


def fill_defaults(df: DataFrame, defaults: dict[str, str] = FILL_DEFAULTS) -> DataFrame:
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def range_filter(df: DataFrame, col: str = "salary_usd", low=SALARY_MIN_EXCLUSIVE,
                 high=SALARY_MAX_EXCLUSIVE) -> DataFrame:
    """Strict on both ends: ``low < x < high``."""
    return df.where((F.col(col) > low) & (F.col(col) < high))


def clean_postings(raw: DataFrame) -> DataFrame:
    """The cleaning job in one lazy pass: 19 typed columns + ``skills_array`` + ``country``."""
    df = project_cast(raw, [c for c in raw.columns])
    df = fill_defaults(drop_null_target(df))
    df = range_filter(df)
    return (df.withColumn("skills_array", split_tokens(F.col("required_skills")))
              .withColumn("country", norm_upper("company_location"))
              .withColumn("posting_date", F.col("posting_date").cast("date"))
              .withColumn("application_deadline", F.col("application_deadline").cast("date")))


def rename_drop_reorder(df: DataFrame, drop: Sequence[str] = (), rename: dict[str, str] | None = None,
                        front: Sequence[str] = ()) -> DataFrame:
    """Drop columns, rename others, then move ``front`` columns first (pure projection)."""
    rename = rename or {}
    cols = [F.col(c).alias(rename.get(c, c)) for c in df.columns if c not in drop]
    out = df.select(*cols)
    return out.select(*front, *[c for c in out.columns if c not in front])


def filter_group_eq(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns equal request values after ``upper(trim(.))`` of the values."""
    cond = None
    for col, v in wanted.items():
        e = F.col(col) == F.upper(F.trim(F.lit(v)))
        cond = e if cond is None else cond & e
    return df.where(cond)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Strict union-all by column name (schemas must agree; duplicates kept)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=False)
    return out


def union_subset(frames: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    return union_by_name([f.select(*cols) for f in frames])
