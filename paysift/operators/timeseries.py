"""Many short monthly series at once: lags, chronological split, min-max
scaling, AR forecasts unrolled as projections, forecast tables and metrics.

A series is identified by ``keys``; every step is a group-by or a window
partitioned by the series key over its months (a few dozen rows per series),
so the work spreads over series and never gathers one table into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import exact_mean, year_month
from paysift.session import materialize


def monthly_series(df: DataFrame, keys: Sequence[str], date_col: str, value: str) -> DataFrame:
    """``keys, month, value, count`` — the mean of ``value`` per series and month.

    The mean comes from an exact sum, so it does not depend on summation order, and
    is rounded half-even to a whole cent.
    """
    n = F.count(value)
    return (df.where(F.col(date_col).isNotNull())
              .groupBy(*keys, year_month(date_col).alias("month"))
              .agg(exact_mean(value, 2).alias("value"), n.alias("count")))


def _w(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("month")


def lag_samples(series: DataFrame, keys: Sequence[str], window: int = 3,
                value: str = "value", train_fraction: float = 0.8) -> DataFrame:
    """Windows ``x1..x{window}`` (oldest first) -> ``y`` for every month with a
    full history; ``sample_idx`` counts samples from 0 and ``part`` is the
    chronological split: the first ``floor(fraction * n)`` samples train."""
    keys = list(keys)
    w = _w(keys)
    s = series.withColumn("t", F.row_number().over(w) - 1) \
              .withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    for i in range(1, window + 1):
        s = s.withColumn(f"x{i}", F.lag(value, window - i + 1).over(w))
    s = s.where(F.col("t") >= window).withColumn("sample_idx", F.col("t") - window) \
         .withColumn("n_samples", F.col("n_points") - window)
    split = F.floor(F.lit(train_fraction) * F.col("n_samples"))
    return s.withColumn("part", F.when(F.col("sample_idx") < split, "train").otherwise("test"))


def minmax_bounds(series: DataFrame, keys: Sequence[str], window: int = 3, value: str = "value",
                  train_fraction: float | None = 0.8) -> DataFrame:
    """Per series ``_min, _max`` of ``value``; with ``train_fraction`` only the
    months that feed training samples are used (no look-ahead)."""
    keys = list(keys)
    s = series
    if train_fraction is not None:
        s = (s.withColumn("_t", F.row_number().over(_w(keys)) - 1)
              .withColumn("_np", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
              .where(F.col("_t") < F.floor(F.lit(train_fraction) * (F.col("_np") - window)) + window))
    return s.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))


def scale(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi != lo, (v - lo) / (hi - lo))


def unscale(s: Column, lo: Column, hi: Column) -> Column:
    return s * (hi - lo) + lo


def ar1_fit(samples: DataFrame, keys: Sequence[str], x: str = "xs3", y: str = "ys") -> DataFrame:
    """Per series least squares ``y = a + b x`` on the training samples."""
    t = samples.where(F.col("part") == "train")
    return t.groupBy(*keys).agg(F.regr_intercept(y, x).alias("_a"), F.regr_slope(y, x).alias("_b"))


def ar1_unrolled(last: Column, a: Column, b: Column, steps: int) -> list[Column]:
    """``f1 = a + b*last, f(k+1) = a + b*f(k)`` as ``steps`` column expressions."""
    out, prev = [], last
    for _ in range(steps):
        prev = a + b * prev
        out.append(prev)
    return out


def future_months(last_month: Column, steps: int) -> Column:
    """Array of the next ``steps`` ``yyyy-MM`` labels after ``last_month``."""
    start = F.to_date(F.concat(last_month, F.lit("-01")))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)),
                       lambda k: F.date_format(F.add_months(start, k), "yyyy-MM"))


def ar1_forecast(series: DataFrame, keys: Sequence[str], window: int = 3, steps: int = 3,
                 train_fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """AR(1) on min-max scaled values per series.

    Returns ``(tests, forecasts)``: test-sample predictions ``keys, month,
    actual, predicted`` and future rows ``keys, step, month, predicted``.
    """
    keys = list(keys)
    b = minmax_bounds(series, keys, window, train_fraction=train_fraction)
    sm = lag_samples(series, keys, window, train_fraction=train_fraction).join(b, keys)
    lo, hi = F.col("_min"), F.col("_max")
    # fit and test predictions both read the samples: they are made once
    sm = materialize(sm.withColumn("ys", scale(F.col("value"), lo, hi)).withColumn(f"xs{window}", scale(F.col(f"x{window}"), lo, hi)))
    fit = ar1_fit(sm, keys, f"xs{window}", "ys")
    tests = (sm.where(F.col("part") == "test").join(fit, keys)
               .select(*keys, "month", F.col("value").alias("actual"),
                       unscale(F.col("_a") + F.col("_b") * F.col(f"xs{window}"), lo, hi).alias("predicted")))
    last = series.groupBy(*keys).agg(F.max_by("value", "month").alias("_last"),
                                     F.max("month").alias("_last_month"))
    f = last.join(b, keys).join(fit, keys)
    fs = ar1_unrolled(scale(F.col("_last"), lo, hi), F.col("_a"), F.col("_b"), steps)
    preds = F.array(*[unscale(c, lo, hi) for c in fs])
    months = future_months(F.col("_last_month"), steps)
    fc = f.select(*keys, F.posexplode(F.arrays_zip(months.alias("m"), preds.alias("p"))).alias("_k", "_z"))
    fc = fc.select(*keys, (F.col("_k") + 1).alias("step"), F.col("_z.m").alias("month"),
                   F.col("_z.p").alias("predicted"))
    return tests, fc


def forecast_table(series: DataFrame, keys: Sequence[str], tests: DataFrame,
                   forecasts: DataFrame) -> DataFrame:
    """History (``historical`` / ``test_pred`` with the back-filled prediction)
    union the ``forecast`` rows: ``keys, month, actual, predicted, type``."""
    keys = list(keys)
    t = tests.select(*keys, "month", F.col("predicted").alias("_p"))
    hist = series.join(t, keys + ["month"], "left").select(
        *keys, "month", F.col("value").alias("actual"), F.col("_p").alias("predicted"),
        F.when(F.col("_p").isNotNull(), "test_pred").otherwise("historical").alias("type"))
    fut = forecasts.select(*keys, "month", F.lit(None).cast("double").alias("actual"), "predicted",
                           F.lit("forecast").alias("type"))
    return hist.unionByName(fut)


def band(table: DataFrame, width: float = K.FORECAST_BAND) -> DataFrame:
    """±width band on forecast rows only, half-even to whole units, and its height."""
    fc = F.col("type") == "forecast"
    up = F.when(fc, F.bround(F.col("predicted") * (1 + width), 0))
    lo = F.when(fc, F.bround(F.col("predicted") * (1 - width), 0))
    return table.withColumn("upper_bound", up).withColumn("lower_bound", lo) \
                .withColumn("band_height", F.col("upper_bound") - F.col("lower_bound"))


def chart_series(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chart lines: actual outside the forecast, test predictions, and the
    forecast line anchored on the last ``historical`` month."""
    keys = list(keys)
    anchor = table.groupBy(*keys).agg(F.max(F.when(F.col("type") == "historical", F.col("month")))
                                      .alias("_anchor"))
    t = table.join(anchor, keys, "left")
    return t.select(*keys, "month", "type",
                    F.when(F.col("type") != "forecast", F.col("actual")).alias("hist_actual"),
                    F.when(F.col("type") == "test_pred", F.col("predicted")).alias("test_pred"),
                    F.when(F.col("month") == F.col("_anchor"), F.col("actual"))
                     .when(F.col("type") == "forecast", F.col("predicted")).alias("forecast_line"))


def change(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Value against the previous month: 2-dp prices, change, percent (0 when the
    previous value is 0) and an ``up`` flag (change >= 0)."""
    keys = list(keys)
    price = F.bround(F.col(value), 2)
    prev = F.bround(F.lag(value).over(_w(keys)), 2)
    s = series.select(*keys, "month", price.alias("price"), prev.alias("prev"))
    chg = F.bround(F.col("price") - F.col("prev"), 2)
    pct = F.when(F.col("prev") != 0, F.bround(chg / F.col("prev") * 100, 2)).otherwise(F.lit(0.0))
    return s.where(F.col("prev").isNotNull()).select(
        *keys, "month", "price", "prev", chg.alias("change"), pct.alias("change_pct"), (chg >= 0).alias("up"))


def metrics(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, MAE and MAPE (%) of the test predictions per series."""
    e = F.col("actual") - F.col("predicted")
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(e / F.col("actual"))) * 100).alias("mape"))


def pooled_ar_forecast(series: DataFrame, keys: Sequence[str], window: int = 3, steps: int = 3,
                       train_fraction: float = 0.8):
    """One AR(window) ``LinearRegression`` pooled over all series' scaled lag
    windows; the recursive forecast (each prediction fed back as the newest
    lag) is unrolled into ``steps`` projections.  Returns ``(model, forecasts)``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    keys = list(keys)
    b = minmax_bounds(series, keys, window, train_fraction=train_fraction)
    sm = lag_samples(series, keys, window, train_fraction=train_fraction).join(b, keys)
    lo, hi = F.col("_min"), F.col("_max")
    xs = [f"xs{i}" for i in range(1, window + 1)]
    for i in range(1, window + 1):
        sm = sm.withColumn(f"xs{i}", scale(F.col(f"x{i}"), lo, hi))
    sm = sm.withColumn("ys", scale(F.col("value"), lo, hi)).dropna(subset=xs + ["ys"])
    train = VectorAssembler(inputCols=xs, outputCol="features").transform(sm.where(F.col("part") == "train"))
    model = LinearRegression(featuresCol="features", labelCol="ys", regParam=0.0,
                             solver="normal").fit(train)
    coef = [float(c) for c in model.coefficients]  # window numbers: a bounded, fitted parameter
    icpt = float(model.intercept)
    w = _w(keys)
    last = series.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("month"))))
    lastw = (last.where(F.col("_rn") <= window)
                 .groupBy(*keys).agg(F.max("month").alias("_last_month"),
                                     F.sort_array(F.collect_list(F.struct("month", "value"))).alias("_hist")))
    f = lastw.join(b, keys)
    hist = [scale(F.col("_hist")[i]["value"], lo, hi) for i in range(window)]
    preds = []
    for _ in range(steps):
        p = F.lit(icpt)
        for c, h in zip(coef, hist[-window:]):
            p = p + F.lit(c) * h
        preds.append(p)
        hist = hist + [p]
    months = future_months(F.col("_last_month"), steps)
    arr = F.array(*[unscale(p, lo, hi) for p in preds])
    out = f.where(F.size("_hist") == window).select(
        *keys, F.posexplode(F.arrays_zip(months.alias("m"), arr.alias("p"))).alias("_k", "_z"))
    return model, out.select(*keys, (F.col("_k") + 1).alias("step"), F.col("_z.m").alias("month"),
                             F.col("_z.p").alias("predicted"))
