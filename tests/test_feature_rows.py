"""Feature rows whose skill vectors are taken as they are read, against the joined way and plain Python."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from paysift.operators import features as FE

WORDS = {"a": [1.0, 0.0, 2.0], "b": [-1.0, 4.0, 0.5], "c": [0.25, 0.25, 0.25]}
ROWS = [(1, ["a", "b"], "x", "p"), (2, ["a", "a", "c", "?"], "y", None), (3, [], "x", "q"), (4, ["?"], None, None), (5, None, "y", "p"), (6, ["c"] * 50 + ["b"], "x", "p")]


@pytest.fixture(scope="module")
def small_tables(spark):
    df = spark.createDataFrame([(i, t, a, b, i * 10) for i, t, a, b in ROWS], "id long, tokens array<string>, a string, b string, num int").repartition(3)
    words = spark.createDataFrame(list(WORDS.items()), "word string, vector array<double>")
    prefixes = {"a": "a_", "b": "b_"}
    index = FE.level_index(df, prefixes)
    assert index.count() == 4
    return df, words, prefixes, index


@pytest.mark.parametrize("tokens_at_a_time", [1, 4, 1 << 15])
def test_rows_of_tokens_equal_the_joined_rows(spark, small_tables, monkeypatch, tokens_at_a_time):
    df, words, prefixes, index = small_tables
    monkeypatch.setattr(FE, "TOKENS", tokens_at_a_time)
    batch = df.coalesce(1).toArrow().to_batches()[0].column("tokens")
    want = [np.mean([WORDS[w] for w in t or [] if w in WORDS] or [[0.0] * 3], axis=0) for t in batch.to_pylist()]
    assert np.allclose(FE._means(batch, list(WORDS), np.array(list(WORDS.values()))), want)
    sparse, vectors = FE.rows_of_tokens(df, ["id", "num"], ["num"], prefixes, index, 4, "tokens", words, 3)
    exploded = df.select("id", F.explode("tokens").alias("token"))
    joined = FE.sparse_rows(df.join(FE.pool_vectors(exploded, ["id"], words, 3), "id", "left"), ["num"], prefixes, index, 4, "pooled", 3)
    old, old_vectors = FE.stored_vectors(joined.select("id", "num", "indices", "values"), 8)
    a, b = ({r["id"]: r for r in d.collect()} for d in (sparse, old))
    assert sorted(a) == [1, 2, 3, 4, 5, 6] and sparse.columns == old.columns
    assert all(a[i]["num"] == b[i]["num"] and a[i]["indices"] == b[i]["indices"] and np.allclose(a[i]["values"], b[i]["values"]) for i in b)
    v, w = ({r["id"]: r["features"] for r in d.collect()} for d in (vectors, old_vectors))
    assert all(v[i].size == 8 and np.allclose(v[i].toArray(), w[i].toArray()) for i in w)
    assert np.allclose(v[6].toArray()[-3:], (50 * np.array(WORDS["c"]) + np.array(WORDS["b"])) / 51)


def test_many_words_go_by_the_join(spark, small_tables):
    words = small_tables[1]
    assert FE.vectors_fit(words, 3, 3 * 3 * 8 + 3) and not FE.vectors_fit(words, 3, 3 * 3 * 8 + 2)
    assert FE.vectors_fit(words.limit(0), 3, 0)


def test_no_row_has_its_vector_written(spark, monkeypatch):
    """The written feature rows hold places and skills: before, a vector of 100 numbers each was shuffled and written."""
    from paysift.plans import q_ml
    enc = q_ml._encoded(spark, SMALL)
    fitted = enc.select(F.explode(q_ml._tokens_column()).alias("word")).distinct().select("word", F.array(*[F.length("word") * 1.0 + i for i in range(100)]).alias("vector"))
    fitted = fitted.localCheckpoint()
    monkeypatch.setattr(q_ml, "_w2v", lambda _: fitted)
    m = q_ml.model_table(spark, SMALL)
    written = {n for f in m.sparse.inputFiles() for n in pq.read_schema(f.removeprefix("file:")).names}
    assert not written & {"features", "values", "indices"} and "_tokens" in written
    monkeypatch.setattr(FE, "VECTOR_BYTES", 0)
    joined = q_ml.model_table(spark, SMALL)
    a, b = ({r["job_id"]: r for r in x.sparse.collect()} for x in (m, joined))
    assert m.size == joined.size and a.keys() == b.keys() and len(a) > 100
    assert all(a[k]["indices"] == b[k]["indices"] and np.allclose(a[k]["values"], b[k]["values"]) for k in a)


def test_falling_contributions_need_no_lists(spark, monkeypatch):
    """Rising contributions, and rows that share an id, are told as before."""
    from paysift.plans import q_ml
    rows = [(i, r, float(c)) for i, c in ((1, [3, -2, 1]), (2, [1, 2, 3])) for r, c in zip((1, 2, 3), c)]
    rows += [(3, 1, 5.0), (3, 1, -5.0), (3, 2, 4.0), (3, 2, 4.0), (4, 1, 5.0), (4, 1, 4.0), (5, 1, 2.0), (5, 2, 1.0), (5, 2, 2.0)]
    top = spark.createDataFrame(rows, "job_id long, rank long, contribution double").selectExpr("*", "1.0D AS base", "2.0D AS total", "3.0D AS prediction")
    monkeypatch.setattr(q_ml, "explained", lambda *_: (None, None))
    monkeypatch.setattr(q_ml, "_top", lambda *_: top)
    q = q_ml.contrib_additive_check(spark, SMALL)
    assert "collect_list" not in q._jdf.queryExecution().optimizedPlan().toString()
    got = {r["job_id"]: (r["n_top"], r["falling"], r["adds_up"]) for r in q.collect()}
    assert got == {1: (3, True, True), 2: (3, False, True), 3: (4, True, True), 4: (2, False, True), 5: (3, False, True)}


def numbered(spark, small_tables):
    df, words, prefixes, index = small_tables
    rows = FE.token_rows(df.withColumn("y", F.col("id") * 1.0), ["id", "num", "y", "a"], ["num"], prefixes, index, 4, "tokens", words, 3)
    return rows, rows.frames()[0]


def test_linear_models_read_written_rows_in_one_pass(spark, small_tables):
    """The same numbers as over assembled rows, which went through Python twice a pass, those of the other part too."""
    from paysift.operators import linear as L
    rows, sparse = numbered(spark, small_tables)
    a, b = L.fit(rows.where("id < 6"), 8, "y"), L.fit(sparse.where("id < 6"), 8, "y")
    assert np.allclose(a.coef, b.coef) and np.allclose(a.mean, b.mean) and a.base == b.base
    plan = rows.where("id < 6").map([F.col("y").alias("z")], lambda it: it, "z double, indices array<int>, values array<double>")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Filter")
    for f in (lambda r: L.contributions_top(r, "id", b, 3), lambda r: L.mean_abs(r, b), lambda r: L.residual_products(r, b, "y")):
        x, y = (f(r).toPandas() for r in (rows, sparse))
        by = [c for c in ("id", "rank", "idx") if c in x]
        assert list(x.columns) == list(y.columns) and np.allclose(x.sort_values(by), y.sort_values(by))


def test_dependence_of_a_number_assembles_no_row(spark, small_tables, monkeypatch):
    from paysift.operators import linear as L
    rows, sparse = numbered(spark, small_tables)
    model = L.fit(sparse, 8, "y")
    want = L.dependence(sparse, [0], model, "a", bins=4).toPandas()
    monkeypatch.setattr(FE.TokenRows, "map", None)
    got = L.dependence(rows, [0], model, "a", bins=4).toPandas()
    order = lambda d: d.sort_values(["idx", "bin", "a"]).reset_index(drop=True)
    assert order(got).equals(order(want)) and len(got) > 3


@pytest.mark.parametrize("d, share, k", [(148, 0.8, 8), (9, 0.3, 3), (400, 0.02, 8), (5, 0.0, 5)])
def test_largest_contributions_of_all_rows_at_once(d, share, k):
    """What a loop over the rows found, ties (the first feature) and values that aren't numbers too."""
    from paysift.operators import linear as L
    rng = np.random.default_rng(d)
    rows, cols = np.nonzero(rng.random((300, d)) < share)
    x = L.Sparse(300, rows, cols.astype(np.int32), np.ones(len(rows)))
    own, constant = rng.normal(size=len(rows)).round(1) * 2, rng.normal(size=d).round(1)
    own[::97] = np.nan
    idx, value = L._largest(x, own, constant, np.lexsort((np.arange(d), -np.abs(constant))), k)
    for i in range(300):
        all_of = constant.copy()
        all_of[cols[rows == i]] = own[rows == i]
        best = np.lexsort((np.arange(d), -np.abs(all_of)))[:k]
        assert (idx[i] == best).all() and np.array_equal(value[i], all_of[best], equal_nan=True)
