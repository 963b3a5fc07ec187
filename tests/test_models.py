"""Model operators against NumPy, with small settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from paysift.functions import constants as K
from paysift.operators import ml as M
from paysift.operators import timeseries as T
from paysift.plans.marts import cleaned


@pytest.fixture(scope="module")
def table(spark):
    from paysift.plans.q_ml import model_table
    m = model_table(spark, SMALL)
    return m.vectors.cache(), [r["feature"] for r in m.names.orderBy("idx").collect()]


def test_linear_contributions_are_exact_shapley(table):
    t, _ = table
    cols = ["years_experience", "benefits_score", "remote_ratio", "exp_level_encoded"]
    model, wide = M.linear_contributions(t, ["job_id"], cols, "log_salary")
    long = M.contributions_long(wide, ["job_id"], cols)
    per = long.groupBy("job_id").agg(F.sum("contribution").alias("s")).join(wide, "job_id")
    assert per.where(F.abs(F.col("base") + F.col("s") - F.col("prediction")) > 1e-9).count() == 0
    imp = {r["feature"]: r["importance"] for r in M.mean_abs_importance(wide, cols).collect()}
    exp = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("i")).collect()
    assert all(imp[r["feature"]] == pytest.approx(r["i"]) for r in exp)
    pdf = t.select(*cols, "log_salary").fillna(0.0).toPandas()
    X = np.c_[np.ones(len(pdf)), pdf[cols].to_numpy(float)]
    beta = np.linalg.lstsq(X, pdf["log_salary"].to_numpy(float), rcond=None)[0]
    lr = model.stages[-1]
    assert lr.intercept == pytest.approx(beta[0], rel=1e-6, abs=1e-8)
    assert np.allclose(lr.coefficients.toArray(), beta[1:], rtol=1e-6, atol=1e-9)


def test_pooled_ar_matches_numpy(spark):
    s = T.monthly_series(cleaned(spark, SMALL), ["country"], "posting_date", "salary_usd")
    model, fc = T.pooled_ar_forecast(s, ["country"])
    b = T.minmax_bounds(s, ["country"])
    sm = T.lag_samples(s, ["country"]).join(b, "country").where("part = 'train'")
    pdf = sm.toPandas()
    pdf = pdf[pdf["_max"] != pdf["_min"]]
    sc = lambda c: (pdf[c] - pdf["_min"]) / (pdf["_max"] - pdf["_min"])
    X = np.c_[np.ones(len(pdf)), sc("x1"), sc("x2"), sc("x3")]
    beta = np.linalg.lstsq(X, sc("value"), rcond=None)[0]
    assert model.intercept == pytest.approx(beta[0], abs=1e-6)
    assert np.allclose(model.coefficients.toArray(), beta[1:], atol=1e-6)
    assert fc.groupBy("country").count().where("count <> 3").count() == 0


def test_gbt_fit_score_save_load(spark, table, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    t, feats = table
    pipe = Pipeline(stages=[M.gbt(params={"maxIter": 5, "maxDepth": 3})])
    model = pipe.fit(t.where("part = 'train'"))
    test = t.where("part = 'test'")
    m = M.regression_metrics(model.transform(test), "log_salary").first()
    assert m["n"] == test.count() and m["rmse"] > 0
    scored = M.score(model, test, ["job_id"]).collect()
    assert all(r["low"] <= r["point"] <= r["high"] for r in scored)
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(test).select("job_id", F.col("prediction").alias("q"))
    j = model.transform(test).select("job_id", "prediction").join(again, "job_id")
    assert j.where(F.col("prediction") != F.col("q")).count() == 0
    names = spark.createDataFrame(list(enumerate(feats)), "idx int, feature string")
    imp = M.gain_importances(spark, model.stages[-1], names).collect()
    assert sorted(r["feature"] for r in imp) == sorted(feats) and sum(r["importance"] for r in imp) == pytest.approx(1)


def test_random_search_small(spark, table):
    from paysift.functions.sampling import hash_bucket
    t, feats = table
    tr = t.where("part = 'train'") \
          .withColumn("_fold", hash_bucket(F.col("job_id"), 2, "fold").cast("int"))
    est = M.gbt()
    maps = M.random_param_maps(est, 2, ranges={"maxIter": (3, 5), "maxDepth": (2, 4)})
    assert len(maps) == 2 and all(3 <= m[est.maxIter] < 5 for m in maps)
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, numFolds=2, foldCol="_fold",
                        evaluator=RegressionEvaluator(labelCol="log_salary", metricName="rmse")).fit(tr)
    assert len(cv.avgMetrics) == 2


def test_word2vec_shape(spark):
    sent = spark.createDataFrame([(["a", "b", "c"],)] * 10, "tokens array<string>")
    m = M.train_word2vec(sent, "tokens", {"vectorSize": 8})
    v = m.getVectors().collect()
    assert sorted(r["word"] for r in v) == ["a", "b", "c"] and len(v[0]["vector"]) == 8


def test_gbt_recovers_planted_signal(table):
    """The driver's salary stand-in is independent of every feature (corr ~ 0),
    so on it any model scores R² ~ 0.  With a planted signal the same pipeline
    must learn it."""
    from pyspark.ml import Pipeline
    t, feats = table
    signal = (F.lit(10.0) + 0.1 * F.col("years_experience") + 0.05 * F.col("benefits_score")
              + 0.2 * F.col("exp_level_encoded") + 0.01 * (F.col("job_id") % 7))
    tt = t.withColumn("log_salary", signal)
    pipe = Pipeline(stages=[M.gbt(params={"maxIter": 20, "maxDepth": 4})])
    model = pipe.fit(tt.where("part = 'train'"))
    m = M.regression_metrics(model.transform(tt.where("part = 'test'")), "log_salary").first()
    assert m["r2"] > 0.9


def test_explained_queries_take_all_features(spark, monkeypatch):
    import json
    from paysift.operators import linear as L
    from paysift.plans import q_io, q_ml
    both = q_ml.explained(spark, SMALL)
    monkeypatch.setattr(q_ml, "explained", lambda *_: both)
    monkeypatch.setattr(q_io, "explained", lambda *_: both)
    m, model = both
    feats = [r["feature"] for r in m.names.orderBy("idx").collect()]
    assert len(feats) == m.size > 14 + 100 and set(K.BASE_NUMERIC_FEATURES) < set(feats)
    pdf = m.vectors.select("job_id", "part", "log_salary", q_ml.vector_to_array("features").alias("f")).toPandas()
    X = np.stack(pdf["f"])
    train = (pdf["part"] == "train").to_numpy()
    Z = (X - X[train].mean(axis=0)) / np.where(X[train].std(axis=0) > 0, X[train].std(axis=0), 1)
    A = np.c_[np.ones(train.sum()), Z[train]]
    # the fit is least squares: its predictions on the training rows are unique; of the solutions it is the least
    beta = np.linalg.lstsq(A, pdf["log_salary"].to_numpy()[train], rcond=1e-10)[0]
    contrib = model.coef * (X - model.mean)
    assert np.allclose(model.base + contrib.sum(axis=1), beta[0] + Z @ beta[1:], atol=1e-6)
    imp = {r["feature"]: r["importance"] for r in q_ml.importance_mean_abs(spark, SMALL).collect()}
    assert sorted(imp) == sorted(feats) and np.allclose([imp[f] for f in feats], np.abs(contrib).mean(axis=0), atol=1e-4)
    doc = json.loads(q_io.mart_dashboard(spark, SMALL).first()["doc"])
    assert {x["feature"] for x in doc["importance"]} == set(feats)
    top = q_ml.contrib_additive(spark, SMALL).toPandas().sort_values(["job_id", "rank"])
    assert len(top) == len(pdf) * K.TOP_CONTRIBUTIONS
    at = {j: i for i, j in enumerate(pdf["job_id"])}
    for job, part in list(top.groupby("job_id"))[:50]:
        c = contrib[at[job]]
        assert np.allclose(np.abs(part["contribution"]), np.sort(np.abs(c))[::-1][:K.TOP_CONTRIBUTIONS], atol=1e-4)
        assert all(abs(c[feats.index(f)] - v) < 1e-4 for f, v in zip(part["feature"], part["contribution"]))
    dep = q_ml.dependence_table(spark, SMALL).toPandas()
    assert dep.groupby("feature")["n"].sum().to_dict() == dict.fromkeys(q_ml.EXPLAINED, len(pdf))


def test_assembled_rows_hold_every_feature(spark, monkeypatch):
    from paysift.plans import q_ml
    enc = q_ml._encoded(spark, SMALL)
    fitted = q_ml._w2v(enc)
    monkeypatch.setattr(q_ml, "_w2v", lambda _: fitted)
    m = q_ml.model_table(spark, SMALL)
    feats = [r["feature"] for r in m.names.orderBy("idx").collect()]
    assert feats[:14] == K.BASE_NUMERIC_FEATURES and feats[14:-100] == sorted(feats[14:-100]) and feats[-100:] == [f"{K.EMBEDDING_PREFIX}{i}" for i in range(100)]
    rows = {r["job_id"]: dict(zip(feats, r["f"])) for r in m.vectors.select("job_id", q_ml.vector_to_array("features").alias("f")).collect()}
    base = q_ml.feat_assemble(spark, SMALL).collect()
    assert len(rows) == len(base)
    assert all(rows[r["job_id"]][c] == pytest.approx(r[c], abs=1e-4) for r in base for c in K.BASE_NUMERIC_FEATURES)
    # one-hot places against the long form, which has an oracle
    ones = {(r["job_id"], r["feature"]) for r in q_ml.feat_onehot(spark, SMALL).collect()}
    hot = [f for f in feats if f.startswith(tuple(K.ONEHOT_PREFIXES.values()))]
    assert {(i, f) for i, r in rows.items() for f in hot if r[f] == 1} == ones
    assert {r[f] for r in rows.values() for f in hot} == {0.0, 1.0}
    # each vector is the mean of the row's in-vocabulary skills' vectors
    words = {r["word"]: np.array(r["vector"]) for r in fitted.collect()}
    tokens = enc.select("job_id", q_ml._tokens_column().alias("s")).collect()
    mine = np.array([[rows[r["job_id"]][f"{K.EMBEDDING_PREFIX}{i}"] for i in range(K.EMBEDDING_DIM)] for r in tokens])
    mean = np.array([np.mean([words[w] for w in r["s"] if w in words] or [np.zeros(K.EMBEDDING_DIM)], axis=0) for r in tokens])
    assert np.abs(mine).max() > 0 and np.allclose(mine, mean, atol=2e-4)


def sparse_frame(spark, X, y):
    rows = [(i, [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[np.flatnonzero(x)]], float(t), "ab"[i % 2]) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, indices array<int>, values array<double>, y double, level string").repartition(4)


def test_sparse_fit_is_the_least_norm_solution_both_ways(spark):
    from paysift.operators import linear as L
    rng = np.random.default_rng(1)
    n = 400
    level = rng.integers(0, 5, n)
    X = np.c_[rng.normal(2000, 3, n), rng.integers(0, 3, n), np.eye(5)[level], rng.normal(0, 1, n), np.full(n, 4.0)]
    y = X[:, 0] * 0.3 - X[:, 1] + level + rng.normal(0, 0.1, n)
    df = sparse_frame(spark, X, y)
    std = X.std(axis=0)
    Z = np.where(std > 1e-12, (X - X.mean(axis=0)) / np.where(std > 1e-12, std, 1), 0)
    want = np.linalg.pinv(Z) @ (y - y.mean()) / np.where(std > 1e-12, std, 1)
    pairs, steps = L.fit(df, 9, "y"), L.fit(df, 9, "y", dense=0)
    assert np.allclose(pairs.coef, want, atol=1e-8) and np.allclose(steps.coef, want, atol=1e-8)
    assert pairs.base == pytest.approx(y.mean()) and pairs.coef[-1] == 0
    left = [r["product"] for r in L.residual_products(df, pairs, "y").collect()]
    assert len(left) == 9 and np.abs(left).max() < 1e-8
    assert L.fit(df.limit(0), 9, "y").base == 0.0
    C = want * (X - X.mean(axis=0))
    imp = {r["idx"]: r["importance"] for r in L.mean_abs(df, pairs).collect()}
    assert np.allclose([imp[i] for i in range(9)], np.abs(C).mean(axis=0))
    for r in L.contributions_top(df, "id", pairs, 3).collect():
        assert abs(abs(r["contribution"]) - np.sort(np.abs(C[r["id"]]))[-r["rank"]]) < 1e-8 and r["total"] + r["base"] == pytest.approx(r["prediction"])


def test_dependence_grows_with_bins_not_rows(spark):
    from paysift.operators import linear as L
    rng = np.random.default_rng(2)
    for n in (300, 1200):
        X = np.c_[rng.normal(0, 5, n), rng.integers(0, 3, n)]
        df = sparse_frame(spark, X, X[:, 0] + X[:, 1])
        out = L.dependence(df, [0, 1], L.fit(df, 2, "y"), "level", bins=10).toPandas()
        assert len(out[out["idx"] == 0]) == 20 and len(out[out["idx"] == 1]) <= 6 and out.groupby("idx")["n"].sum().tolist() == [n, n]
        deep = out[out["idx"] == 0].groupby("bin")["n"].sum()
        assert deep.max() - deep.min() <= 1
        assert (out["mean_contribution"] >= out["p10"] - 1e-6).all() and (out["lo"] <= out["hi"]).all()


def test_a_hundred_thousand_levels(spark):
    """No level becomes a column or reaches the driver: places come from joins with a written index."""
    from paysift.operators import features as FE
    n = 100_000
    df = spark.range(n).select("id", F.format_string("firm %06d", F.col("id")).alias("a"), (F.col("id") % 3).cast("string").alias("b"),
                               F.when(F.col("id") != 7, F.array(F.lit(0.5), F.lit(2.0))).alias("v"), F.col("id").cast("double").alias("x"))
    prefixes = {"a": "a_", "b": "b_"}
    index = FE.level_index(df, prefixes)
    assert index.count() == n + 3 and index.agg(F.min("place"), F.max("place")).first()[:] == (0, n + 2)
    rows = FE.sparse_rows(df, ["x"], prefixes, index, n + 3, "v", 2)
    assert len(rows.columns) == 6
    sparse, vectors = FE.stored_vectors(rows, 1 + n + 3 + 2)
    got = sparse.where("id IN (7, 99999)").orderBy("id").collect()
    assert [list(r["indices"]) for r in got] == [[0, 8, n + 2, n + 4, n + 5], [0, n, n + 1, n + 4, n + 5]]
    assert [list(r["values"]) for r in got] == [[7.0, 1, 1, 0, 0], [99999.0, 1, 1, 0.5, 2]]
    v = vectors.where("id = 99999").first()["features"]
    assert v.size == n + 6 and v[n] == 1.0 and v.indices.tolist() == [0, n, n + 1, n + 4, n + 5]


def brute_pairs(lists, window, least):
    from collections import Counter
    freq = Counter(w for x in lists for w in x)
    n = Counter()
    for x in lists:
        for i, a in enumerate(x):
            for b in x[i + 1:i + 1 + window]:
                if a != b:
                    n[a, b] += 1
                    n[b, a] += 1
    keep = {w for w, c in freq.items() if c >= least}
    return {**{p: c for p, c in n.items() if set(p) <= keep}, **{(w, w): freq[w] for w in keep}}


def word_lists(n=500, words=60):
    rng = np.random.default_rng(4)
    topic = rng.integers(0, 6, n)
    return [[f"w{(t * 10 + int(k)) % words}" for k in rng.integers(0, 14, rng.integers(0, 12))] for t in topic]


@pytest.mark.parametrize("dim", [7, 80])
def test_word_vectors_are_the_leading_eigenvectors(spark, dim):
    from paysift.operators import vectors as V
    lists = word_lists()
    df = spark.createDataFrame([(x,) for x in lists] + [(None,)], "t array<string>").repartition(5)
    pairs = brute_pairs(lists, 3, 5)
    vocab, got = V.cooccurrences(df, "t", 3, 5)
    assert {(r["word"], r["other"]): r["n"] for r in got.collect()} == pairs
    words = sorted({a for a, _ in pairs})
    at = {w: i for i, w in enumerate(words)}
    n = np.zeros((len(words), len(words)))
    for (a, b), c in pairs.items():
        n[at[a], at[b]] = c
    m = np.maximum(np.log(np.where(n > 0, n, 1) * n.sum() / np.outer(n.sum(1), n.sum(1))), 0) * (n > 0)
    out, values = V.leading_vectors(V.information(got), vocab.select("word"), dim, rounds=40, tol=1e-9)
    e, u = np.linalg.eigh(m)
    order = np.argsort(-np.abs(e))[:dim]
    k = min(dim, len(words))
    assert np.allclose(values[:k], e[order][:k], atol=1e-2) and np.allclose(values[k:], 0)
    rows = {r["word"]: np.array(r["vector"]) for r in out.collect()}
    mine = np.array([rows[w] for w in words])
    want = u[:, order] * np.sqrt(np.maximum(e[order], 0))
    assert mine.shape == (len(words), dim) and np.allclose(mine @ mine.T, want @ want.T, atol=0.1)
    gaps = np.abs(np.diff(np.abs(e[order])))
    assert all(min(np.abs(mine[:, j] - want[:, j]).max(), np.abs(mine[:, j] + want[:, j]).max()) < 5e-2 for j in range(3) if gaps[j] > 0.1)


def test_word_vectors_do_not_depend_on_the_layout(spark):
    from paysift.operators import vectors as V
    df = spark.createDataFrame([(x,) for x in word_lists(200)], "t array<string>")
    a, b = ({r["word"]: np.array(r["vector"]) for r in V.train(d, "t", 5, 5, 5).collect()} for d in (df.coalesce(1), df.repartition(9)))
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-6) for w in a)
    empty = V.train(df.limit(0), "t", 5, 5, 5)
    assert empty.count() == 0
