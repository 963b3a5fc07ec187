"""Histogram refinement, the rank index and shared box plots against NumPy and pandas."""

import glob
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paysift.operators import selection as S
from paysift.operators.aggregates import boxplot_by_dimensions, peer_percentile, request_percentile

PROBS = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "med": 0.5, "p90": 0.9, "p100": 1.0}


def frame(spark, groups, parts=5):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").repartition(parts)


def groups(seed=3):
    rng = np.random.default_rng(seed)
    hot = np.concatenate([rng.normal(1e5, 50, 4000), np.full(700, 1e5), [np.nextafter(1e5, 2e5)] * 3])
    return {"hot": hot, "wide": rng.lognormal(0, 8, 900) * rng.choice([-1, 1], 900), "tiny": rng.uniform(0, 1e-12, 300), "one": [7.0],
            "none": [None, None], "tied": [5.0] * 40 + [6.0], "neg": -rng.exponential(3, 500), "big": rng.choice([1e300, -1e300, 0.0], 50)}


@pytest.mark.parametrize("small,split", [(4096, 1024), (3, 4)])
def test_quantiles_and_moments_equal_numpy(spark, monkeypatch, small, split):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "SPLIT", split)
    gs = groups()
    if small == 3:  # every level of refinement is walked
        gs = {k: v[:400] for k, v in gs.items() if k in ("hot", "tied", "one", "none")}
    got = {r["g"]: r for r in S.grouped_stats(frame(spark, gs), ["g"], "v", {"rows": "rows", "n": "count", "lo": "min", "hi": "max", "sd": "std"}, PROBS).collect()}
    assert set(got) == set(gs)
    for g, vs in gs.items():
        v = np.array([x for x in vs if x is not None], float)
        r = got[g]
        assert (r["rows"], r["n"]) == (len(vs), len(v))
        if not len(v):
            assert all(r[p] is None for p in PROBS) and r["lo"] is None
            continue
        assert (r["lo"], r["hi"]) == (v.min(), v.max())
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-300)
        if len(v) > 1 and g not in ("big", "wide"):
            assert r["sd"] == pytest.approx(v.std(ddof=1), rel=1e-9)


def test_infinities_and_nan_have_bins_of_their_own(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", x) for x in (-inf, -1.0, 0.0, 2.0, inf)] + [("b", x) for x in (1.0, nan, nan)], "g string, v double")
    got = {r["g"]: r for r in S.group_quantiles(df, ["g"], "v", {"lo": 0.0, "med": 0.5, "hi": 1.0}).collect()}
    assert (got["a"]["lo"], got["a"]["med"], got["a"]["hi"]) == (-inf, 0.0, inf)
    assert got["b"]["lo"] == 1.0 and np.isnan(got["b"]["med"]) and np.isnan(got["b"]["hi"])


def test_bins_and_parts_rise_with_the_value(spark):
    v = sorted({*np.random.default_rng(1).normal(0, 1e6, 400), *np.random.default_rng(2).normal(0, 1e-6, 400), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")})
    b = [r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").orderBy("i").select(S.bin_of(F.col("v"))).collect()]
    assert b == sorted(b)
    lo, hi = 1e5, float(np.nextafter(1e5, 2e5))
    two = spark.createDataFrame([(lo,), (hi,)], "v double").select(S.part_of(F.col("v"), F.lit(lo), F.lit(hi), 4)).collect()
    assert [r[0] for r in two] == [0, 3]


def test_what_is_shuffled_grows_with_bins_not_rows(tmp_path):
    """Four times the rows, the same values' range: as many records shuffled, but for the values of wanted bins."""
    import subprocess
    import sys
    code = f"""
import sys; sys.path.insert(0, {str(__import__('conftest').ROOT)!r})
from pyspark.sql import functions as F
from paysift.session import build_session
from paysift.operators.selection import group_quantiles
spark = build_session("local[2]", "sel", 4, {{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{tmp_path}", "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": "{tmp_path}/ck"}})
for n in (50_000, 200_000):
    path = "{tmp_path}/t%d" % n
    spark.range(n).select((F.col("id") % 3 % 2).alias("g"), (20_000 + (F.xxhash64("id") % 40_000_000) / 1000.0).alias("v")).write.parquet(path)
    spark.sparkContext.setJobDescription(str(n))
    spark.read.parquet(path).transform(lambda d: group_quantiles(d, ["g"], "v", {{"m": 0.5, "q": 0.9}})).collect()
    spark.sparkContext.setJobDescription(None)
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    records = {"50000": 0, "200000": 0}
    of = {}
    for line in open(next(f for f in glob.glob(f"{tmp_path}/local-*"))):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageSubmitted":
            of[e["Stage Info"]["Stage ID"]] = e.get("Properties", {}).get("spark.job.description")
        if e["Event"] == "SparkListenerTaskEnd" and of.get(e["Stage ID"]) in records:
            records[of[e["Stage ID"]]] += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
    assert 0 < records["50000"] < 25_000 and records["200000"] < 2.5 * records["50000"]


def brute_below(values, x):
    return sum(1 for v in values if v < x)


@pytest.mark.parametrize("leaf", [1 << 17, 8])
def test_rank_index_serves_rows_and_requests(spark, leaf):
    gs = {k: list(v)[:160] for k, v in groups(5).items()}
    gs["tied"] = [5.0] * 90 + [6.0, 6.5]
    df = frame(spark, gs)
    index = S.RankIndex(df, ["g"], "v", leaf)
    assert leaf > 8 or len(index.levels) > 1
    rows = index.of_table(df.withColumn("i", F.monotonically_increasing_id()), "v").collect()
    assert len(rows) == sum(map(len, gs.values()))
    for r in rows:
        known = [x for x in gs[r["g"]] if x is not None]
        assert r["_n"] in (len(known), None) and r["_below"] == (None if r["v"] is None else brute_below(known, r["v"]))
    rng = np.random.default_rng(9)
    asked = [(g, float(x)) for g, vs in gs.items() for x in [*(v for v in vs[:20] if v is not None), *rng.normal(1e5, 300, 20), -1e9, 1e9, 0.0, 5.5, -0.5]]
    asked += [("unknown", 3.0), (None, 1.0)] * 2
    got = index.of_requests(spark.createDataFrame(asked, "g string, _v double").select(F.struct("g").alias("_g"), "_v")).collect()
    assert len(got) == len(set(asked))
    for r in got:
        assert r["_below"] == brute_below([x for x in gs.get(r["_g"]["g"], []) if x is not None], r["_v"]), r


def test_request_percentile_unknown_group_and_ties(spark):
    ref = spark.createDataFrame([("FRANCE", float(v)) for v in [10, 20, 20, 30, 40, 50, 60, 70, 80, 90, 100, 20]], "country string, s double")
    asked = spark.createDataFrame([(1, " france", 20.0), (2, "France ", 20.5), (3, "x", 5.0), (4, "FRANCE", None), (5, None, 1.0), (6, "france", 20.0)], "id int, country string, s double")
    got = {r["id"]: r for r in request_percentile(asked, ref, ["country"], "s").collect()}
    assert got[1]["percentile"] == got[6]["percentile"] == round(100 / 12, 1) and got[2]["percentile"] == round(400 / 12, 1)
    assert (got[3]["sample_size"], got[3]["enough"], got[3]["percentile"]) == (0, False, None) and got[5]["sample_size"] == 0
    assert got[4]["percentile"] is None and got[4]["sample_size"] == 12


def test_peer_percentile_of_a_hot_group(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(50, 10, 2000), 1)
    df = spark.createDataFrame([("hot" if i % 3 else "cold", float(x)) for i, x in enumerate(v)], "g string, v double").repartition(6)
    got = peer_percentile(df, ["g"], "v").collect()
    by = {g: np.array([r["v"] for r in got if r["g"] == g]) for g in ("hot", "cold")}
    assert sum(map(len, by.values())) == 2000
    assert all(r["percentile"] == pytest.approx((by[r["g"]] < r["v"]).sum() / len(by[r["g"]]) * 100, abs=0.0500001) for r in got)


def test_box_plots_of_several_groupings_copy_no_row(spark):
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"a": rng.choice(["x", "y", None], n, p=[0.8, 0.15, 0.05]), "b": rng.integers(0, 4, n), "v": np.round(rng.lognormal(8, 1, n), 2)})
    pdf.loc[:20, "v"] = np.nan
    sdf = pdf.astype(object).where(pdf.notna(), None)
    df = spark.createDataFrame([(r.a, int(r.b), r.v) for r in sdf.itertuples()], "a string, b int, v double").repartition(4)
    got = {(r["dimension"], r["group_value"]): r for r in boxplot_by_dimensions(df, {"a": F.col("a"), "b": F.col("b")}, "v").collect()}
    want = [("a", g, d) for g, d in pdf.groupby("a")] + [("b", str(g), d) for g, d in pdf.groupby("b")]
    assert set(got) == {(d, g) for d, g, _ in want}
    for dim, g, d in want:
        v = d["v"].dropna().to_numpy()
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got[dim, g]
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [q1, med, q3, inside.min(), inside.max()])
        assert (r["n_outliers"], r["n"]) == (len(v) - len(inside), len(v))
    b = S.Bins(df, {"a": F.col("a"), "b": F.col("b").cast("string")}, F.col("v"))
    assert "Expand" not in b.rows._jdf.queryExecution().executedPlan().toString()
    assert b.table.agg(F.sum("rows")).first()[0] == 2 * n - int(pdf["a"].isna().sum())


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert S.grouped_stats(df, ["g"], "v", {"n": "count"}, {"m": 0.5}).count() == 0
    assert S.rank_below(df, ["g"], "v").count() == 0
