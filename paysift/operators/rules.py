"""Row rules of the serving layer, applied to whole tables of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import lookup, money, truncate_int


def interval(point: Column, low: float = K.INTERVAL_LOW, high: float = K.INTERVAL_HIGH) -> list[Column]:
    """Point estimate truncated to whole dollars, and the fixed ±17 % interval."""
    p = truncate_int(point)
    return [p.alias("point"), truncate_int(p * F.lit(low)).alias("low"),
            truncate_int(p * F.lit(high)).alias("high"),
            money(p).alias("point_text"), money(truncate_int(p * F.lit(low))).alias("low_text"),
            money(truncate_int(p * F.lit(high))).alias("high_text")]


def benchmark_band(gap: Column, band: float = K.BENCHMARK_BAND) -> Column:
    """``above`` / ``below`` when the gap exceeds ±band (strict), else ``level``."""
    return F.when(gap > band, "above").when(gap < -band, "below").otherwise("level")


def top_skills(profiles: DataFrame, industry: str = "industry", skills: str = "skills_array", n: int = K.HINT_SKILLS) -> DataFrame:
    """(industry, skills): the ``n`` most frequent skills of each industry, ties by name; a row an industry."""
    counts = profiles.select(F.col(industry).alias("industry"), F.explode(skills).alias("skill")).groupBy("industry", "skill").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("n"), "skill"))).where(F.col("k") <= n)
    return (ranked.groupBy("industry").agg(F.array_sort(F.collect_list(F.struct("k", "skill"))).alias("s"))
            .select("industry", F.col("s.skill").alias("skills")))


def advise(profiles: DataFrame, benchmarks: DataFrame, high_value_countries: DataFrame, industry_skills: DataFrame,
           level: str = "experience_level", country: str = "country", industry: str = "industry",
           skill_count: str = "skill_count", salary: str = "current_salary") -> DataFrame:
    """Advice columns for every profile: level advice, next level, benchmark, gap and band,
    skill hint, negotiation code.  ``benchmarks`` is ``(country, benchmark)``
    and ``high_value_countries`` is ``(country)``; ``industry_skills`` is ``(industry, skills)`` as
    ``top_skills`` makes it, and an industry without a row gets an empty hint.  All are joined (AQE picks
    broadcast only when their measured size allows it)."""
    hv = high_value_countries.select(F.col("country").alias("_hv"))
    j = (profiles.join(benchmarks.select(F.col("country").alias("_bc"), "benchmark"),
                       F.col(country) == F.col("_bc"), "left")
                 .join(hv, F.col(country) == F.col("_hv"), "left")
                 .join(industry_skills.select(F.col("industry").alias("_bi"), F.col("skills").alias("_skills")),
                       F.col(industry).eqNullSafe(F.col("_bi")), "left"))
    bm = F.coalesce(F.col("benchmark"), F.lit(K.BENCHMARK_DEFAULT).cast("double"))
    gap = F.col(salary) - bm
    skills = F.coalesce(F.col("_skills"), F.array().cast("array<string>"))
    hint = (F.when(F.col(skill_count) < K.SKILL_HINT_BELOW, F.concat(F.lit("add: "), F.array_join(F.slice(skills, 1, 2), " / ")))
            .otherwise(F.concat(F.lit("deepen: "), F.array_join(skills, " / "))))
    neg = (F.when(F.col(level).isin(*K.HIGH_VALUE_LEVELS) & F.col("_hv").isNotNull(), K.NEGOTIATION_HIGH_VALUE)
            .when(F.col(level) == "EN", K.NEGOTIATION_ENTRY).otherwise(K.NEGOTIATION_DEFAULT))
    keep = [c for c in profiles.columns]
    return j.select(*keep, lookup(level, K.LEVEL_ADVICE, "").alias("level_advice"), lookup(level, K.NEXT_LEVEL).alias("next_level"), bm.alias("benchmark"),
                    gap.alias("gap"), benchmark_band(gap).alias("geo_band"), hint.alias("skill_hint"),
                    neg.alias("negotiation"))
