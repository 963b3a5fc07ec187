"""Group-by marts and distribution summaries.

Means, counts, extremes and standard deviations are partial (map-side)
aggregates with fixed-size buffers.  Quantiles and ranks go through ``selection``,
so a huge group never lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import clean_tokens, exact_mean, exact_mean_whole, lookup, norm_upper, title_case, year_month
from paysift.operators.ranking import join_on_keys
from paysift.operators.selection import RankIndex, box_stats, group_struct, grouped_stats, rank_below


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return join_on_keys(left, right, keys, how)


def country_summary(df: DataFrame, key: str = "country", value: str = "salary_usd") -> DataFrame:
    """Mean, median, count, max per country; half-even rounding; display name; mean desc."""
    out = grouped_stats(df, [key], value, {"avg_salary": "mean:0", "job_count": "count", "max_salary": "max"}, {"median_salary": 0.5})
    name = F.coalesce(lookup(key, K.COUNTRY_DISPLAY), title_case(key))
    return (out.select(key, F.bround("avg_salary", 0).alias("avg_salary"),
                       F.bround("median_salary", 0).alias("median_salary"),
                       "job_count", "max_salary", name.alias("country_name"))
               .orderBy(F.desc("avg_salary"), F.asc(key)))


def describe_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """pandas ``describe``: count, mean, std (ddof 1), min, q25, median, q75, max per group."""
    keys = list(keys)
    if not keys:  # a global describe is the one-group case
        return describe_by(df.withColumn("_all", F.lit(0)), ["_all"], value).drop("_all")
    out = grouped_stats(df, keys, value, {"count": "count", "mean": "mean:4", "std": "std", "min": "min", "max": "max"}, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.select(*keys, "count", "mean", "std", "min", "q25", "median", "q75", "max")


def level_describe(main: DataFrame, value: str = "salary_usd") -> DataFrame:
    """Describe per experience level, ordered by rank; unmapped levels drop out
    (their sort order is null and null group keys are dropped)."""
    m = main.where(F.col("exp_order").isNotNull())
    return (describe_by(m, ["experience_level", "exp_label", "exp_order"], value)
            .orderBy("exp_order"))


def mean_count_by(df: DataFrame, key: str, value: str = "salary_usd",
                  mean_name: str = "avg_salary", count_name: str = "job_count",
                  round_digits: int | None = 0) -> DataFrame:
    m = exact_mean_whole(value) if round_digits == 0 else exact_mean(value, 4 if round_digits is None else round_digits)
    return df.groupBy(key).agg(m.alias(mean_name), F.count(value).alias(count_name))


def industry_mean(df: DataFrame) -> DataFrame:
    return mean_count_by(df, "industry").orderBy(F.desc("avg_salary"), "industry")


def monthly_mean(df: DataFrame, date_col: str = "posting_date", value: str = "salary_usd") -> DataFrame:
    """Per month (``yyyy-MM``) mean and count, in month order; null dates dropped."""
    return (df.where(F.col(date_col).isNotNull())
              .groupBy(year_month(date_col).alias("month"))
              .agg(exact_mean(value, 4).alias("mean_salary"), F.count(value).alias("count"))
              .orderBy("month"))


def trend_mart(main: DataFrame) -> DataFrame:
    return (main.where(F.col("post_ym").isNotNull())
                .transform(lambda d: mean_count_by(d, "post_ym")).orderBy("post_ym"))


def skill_frequency(df: DataFrame, col: str = "required_skills", sep: str = ",") -> DataFrame:
    """Token frequency of a separated list; blank tokens dropped; ties broken by token."""
    return (df.select(F.explode(clean_tokens(col, sep)).alias("skill"))
              .groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), "skill"))


def category_stats(df: DataFrame, cat: str = "job_category", value: str = "salary_usd",
                   min_count: int = K.CATEGORY_MIN_COUNT) -> DataFrame:
    out = grouped_stats(df, [cat], value, {"count": "count", "mean": "mean:4", "std": "std"},
                        {"median": 0.5, "q25": 0.25, "q75": 0.75})
    out = out.where(F.col("count") >= min_count)
    return out.select(cat, "count", "mean", "median", "q25", "q75", "std").orderBy(F.desc("median"), cat)


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Frequency of each value, most frequent first (ties by value); nulls dropped by default."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def nunique(df: DataFrame, cols: Sequence[str], approx_rsd: float | None = None) -> DataFrame:
    """Exact distinct counts (or HyperLogLog++ with ``approx_rsd``) in one pass."""
    if approx_rsd is None:
        return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])
    return df.agg(*[F.approx_count_distinct(c, approx_rsd).alias(f"n_{c}") for c in cols])


#: log2 of the registers of a distinct-count sketch, and its relative standard error.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """A distinct-count sketch of each column for each group of ``by`` (say, a day): to be stored, and merged later with
    those of other groups without the rows.  Values count by their text form; nulls don't count."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(c) for c in cols])


def nunique_from_sketches(sketches: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and an estimate ``n_<col>`` of the distinct values over the merged sketches; off by some SKETCH_ERROR."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in cols])


def filter_in_topk(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Keep rows whose ``col`` is among the k most frequent (ties by value).

    The top-k list is at most k rows, so the semi join broadcasts a bounded side.
    """
    top = value_counts(df, col).limit(k).select(col)
    return df.join(F.broadcast(top), col, "left_semi")


def hist_equal_width(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram between min and max; the last bin is closed."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, count bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("int"))
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
              .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_low"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_high"), "count")
              .orderBy("bin"))


def kde_curve(df: DataFrame, col: str, grid: int = 50) -> DataFrame:
    """Gaussian kernel density on an equal grid over [min, max], Scott bandwidth.

    Two scans: one scalar aggregate for n, bounds and bandwidth, then one
    aggregate with a sum for each grid point.  No row is copied, and each task
    ships one row.
    """
    n, lo, hi, sd = df.agg(F.count(col), F.min(col), F.max(col), F.stddev_samp(col)).first()
    if not n or sd is None or sd == 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density_per_million double")
    h = sd * n ** (-1.0 / 5)
    step = (hi - lo) / (grid - 1)
    at = [float(lo) + i * float(step) for i in range(grid)]
    v = F.col(col).cast("double")
    sums = df.agg(*[F.sum(F.exp(-0.5 * F.pow((F.lit(x) - v) / F.lit(h), 2))).alias(f"_{i}") for i, x in enumerate(at)])
    norm = 1_000_000.0 / (n * h * math.sqrt(2 * math.pi))
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(x).alias("x"), (F.col(f"_{i}") * F.lit(norm)).alias("density_per_million"))
                       for i, x in enumerate(at)])
    return sums.select(F.explode(points).alias("p")).select("p.*").orderBy("point")


_BOX = ["q1", "median", "q3", "fence_low", "fence_high", "whisker_low", "whisker_high", "n_outliers", "n"]


def boxplot_stats(df: DataFrame, keys, value: str) -> DataFrame:
    """q1, median, q3, 1.5·IQR fences, whisker ends and outlier count per group, from the counts of the
    value's bins; only rows of bins that hold a quartile or a fence are looked at again (``selection.box_stats``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out, _ = box_stats(df, {"": group_struct(keys)}, value)
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], *_BOX).orderBy(*keys)


def boxplot_by_dimensions(df: DataFrame, dims: dict, value: str) -> DataFrame:
    """Box-plot statistics for several groupings in the same passes, without a copy of a row for each.
    ``dims`` maps a name to a column (rows whose column is null are left out of that dimension)."""
    out, names = box_stats(df, {n: c.cast("string") for n, c in dims.items()}, value)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_d") + 1)
    return out.select(name.alias("dimension"), F.col("_g").alias("group_value"), *_BOX).orderBy("dimension", "group_value")


def corr_by_count(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of x and y plus mean / median of y per x.

    One pass over the input: the per-x statistics carry Σy and Σy², from
    which the global correlation follows (x is constant inside its group), so
    the scalar is an aggregate over one row per distinct x, not another scan.
    """
    out = grouped_stats(df.where(F.col(x).isNotNull()), [x], y, {"n": "count", "mean_y": "mean:4", "_sy": "sum", "_syy": "sum_squares"}, {"median_y": 0.5})
    from paysift.session import materialize
    out = materialize(out)
    xv, n = F.col(x).cast("double"), F.col("n").cast("double")
    s = out.agg(F.sum(n).alias("N"), F.sum(n * xv).alias("Sx"), F.sum("_sy").alias("Sy"),
                F.sum(n * xv * xv).alias("Sxx"), F.sum("_syy").alias("Syy"), F.sum(xv * F.col("_sy")).alias("Sxy")).first()
    den = ((s["N"] * s["Sxx"] - s["Sx"] ** 2) * (s["N"] * s["Syy"] - s["Sy"] ** 2)) if s["N"] else 0
    r = (s["N"] * s["Sxy"] - s["Sx"] * s["Sy"]) / den ** 0.5 if den and den > 0 else None
    return out.drop("_sy", "_syy").withColumn("corr_xy", F.lit(r).cast("double")).orderBy(x)


def global_baseline(series: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Mean of non-null values repeated on every row, with min and max (scalar bounds)."""
    mean, lo, hi = series.agg(exact_mean(value, digits), F.min(value), F.max(value)).first()
    return series.select("*", F.lit(mean).cast("double").alias("baseline_mean"),
                         F.lit(lo).cast("double").alias("series_min"),
                         F.lit(hi).cast("double").alias("series_max"))


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``describe`` of several columns in one pass: stacked to (column_name, value) first."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, value)"))
    return describe_by(long, ["column_name"], "value")


def peer_percentile(df: DataFrame, keys: Sequence[str], value: str,
                    min_samples: int = K.PEER_MIN_SAMPLES) -> DataFrame:
    """Every row's place inside its peer group: sample size, percent of peers
    strictly below (1 dp), median / p25 / p75 (0 dp), and ``enough`` (n ≥ min).

    Ranks come from a written index of the groups' values and quantiles from its bins, so a peer
    group of any size is split over many tasks.
    """
    keys = list(keys)
    j = rank_below(df, keys, value, probs={"_med": 0.5, "_p25": 0.25, "_p75": 0.75})
    n = F.coalesce(F.col("_n"), F.lit(0))
    ok = n >= min_samples
    return j.select(*df.columns, n.alias("sample_size"), ok.alias("enough"),
                    F.when(ok, F.bround(F.col("_below") / n * 100, 1)).alias("percentile"),
                    F.when(ok, F.bround("_med", 0)).alias("median"),
                    F.when(ok, F.bround("_p25", 0)).alias("p25"),
                    F.when(ok, F.bround("_p75", 0)).alias("p75"))


def request_percentile(requests: DataFrame, reference: DataFrame, keys: Sequence[str], value: str,
                       min_samples: int = K.PEER_MIN_SAMPLES) -> DataFrame:
    """Each request's place among the reference rows of its group: sample size, whether that is
    enough, percent of them strictly below (1 dp), and their median / p25 / p75 (0 dp).

    Request keys are trimmed and upper-cased.  The requests look their places up in the index of the reference
    (``selection.RankIndex``), each different (group, value) once, so neither a large group nor many requests for one
    go to one task.  Rows with a null value have no place; requests of an unknown group have sample size 0.
    """
    keys = list(keys)
    index = RankIndex(reference, keys, value)
    asked = (requests.withColumn("_g", F.struct(*[norm_upper(k).alias(k) for k in keys])).withColumn("_v", F.col(value).cast("double")))
    about = index.about({"_p25": 0.25, "_med": 0.5, "_p75": 0.75}).withColumnRenamed("_g", "_qg")
    place = index.of_requests(asked).select(F.col("_g").alias("_rg"), F.col("_v").alias("_rv"), "_below")
    j = (asked.join(place, (asked["_g"] == place["_rg"]) & (asked["_v"] == place["_rv"]), "left")
              .join(about, F.col("_g") == F.col("_qg"), "left"))
    n = F.coalesce("_n", F.lit(0))
    ok = n >= min_samples
    whole = lambda c: F.when(ok, F.bround(c, 0))
    return j.select(*requests.columns, n.alias("sample_size"), ok.alias("enough"),
                    F.when(ok, F.bround(F.col("_below") / n * 100, 1)).alias("percentile"),
                    whole("_med").alias("median"), whole("_p25").alias("p25"), whole("_p75").alias("p75"))
