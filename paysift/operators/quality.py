"""Data-quality operators: one-pass null profile, rule checks, token coverage.

Each report is a single aggregate over the input (one job, one scan) whose
wide one-row result is turned into long form with ``stack``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions.expr import clean_tokens


def _stack(names: Sequence[str], label: str, value: str) -> Column:
    pairs = ", ".join(f"'{n}', `_{i}`" for i, n in enumerate(names))
    return F.expr(f"stack({len(names)}, {pairs}) AS (`{label}`, `{value}`)")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count of every column in one pass: ``(column_name, null_count)``."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    return wide.select(_stack(cols, "column_name", "null_count"))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violation count per named boolean rule, one pass: ``(rule, violations)``."""
    names = list(rules)
    wide = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"_{i}")
                    for i, n in enumerate(names)])
    return wide.select(_stack(names, "rule", "violations"))


def posting_rules(target: str = "salary_usd", skills: str = "required_skills",
                  low: float = 0, high: float = 1_000_000) -> dict[str, Column]:
    """The cleaning job's checks: null target, out-of-range target, empty or blank skill lists."""
    t, s = F.col(target), F.col(skills)
    return {
        "null_target": t.isNull(),
        "target_le_low": t <= low,
        "target_ge_high": t >= high,
        "skills_null": s.isNull(),
        "skills_blank": F.trim(s) == "",
        "skills_no_token": F.size(clean_tokens(s)) == 0,
    }


def token_coverage(df: DataFrame, tokens: str) -> DataFrame:
    """rows, rows with at least one token, total tokens, and ``ok`` (tokens > 0)."""
    n = F.coalesce(F.size(tokens), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(n > 0).alias("non_empty_rows"),
                 F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_tokens"))
    return out.withColumn("ok", F.col("total_tokens") > 0)


def column_set_compare(left: DataFrame, right: DataFrame, name_col: str = "feature") -> DataFrame:
    """Which names occur on each side: full outer join of two name lists."""
    a = left.select(F.col(name_col).alias("feature")).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col(name_col).alias("feature")).distinct().withColumn("in_right", F.lit(True))
    j = a.join(b, "feature", "full_outer")
    return j.select("feature", F.coalesce("in_left", F.lit(False)).alias("in_left"),
                    F.coalesce("in_right", F.lit(False)).alias("in_right"))


def hash_sample(df: DataFrame, key: str, fraction: float, salt: str = "") -> DataFrame:
    """Deterministic sample: rows whose md5 bucket of ``key`` is below ``fraction``.

    Independent of partitioning and reproducible in any SQL engine.
    """
    from paysift.functions.sampling import hash_bucket
    buckets = 1_000_000
    return df.where(hash_bucket(F.col(key), buckets, salt) < int(round(fraction * buckets)))


def column_set_compare_by(names: DataFrame, side_col: str, left: str, right: str,
                          name_col: str = "feature") -> DataFrame:
    """``column_set_compare`` for one long table with a side column: one
    grouped pass, no join (``feature, in_left, in_right``)."""
    return names.groupBy(F.col(name_col).alias("feature")).agg(
        F.max(F.col(side_col) == left).alias("in_left"), F.max(F.col(side_col) == right).alias("in_right"))


def random_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample (``DataFrame.sample``) — fast, but which rows it keeps
    depends on the partitioning; ``hash_sample`` is the reproducible form."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
