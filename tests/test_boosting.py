"""Boosted trees from counted histograms, against pyspark.ml and plain NumPy."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from paysift.operators import boosting as B
from paysift.operators import ml as M


@pytest.fixture(autouse=True)
def own_fit(monkeypatch):
    monkeypatch.setattr(B, "LEAST", 1)


def drawn(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(n, 3)), rng.integers(0, 4, n), np.eye(3)[rng.integers(0, 3, n)], np.full(n, 2.0), -rng.exponential(size=n)]
    return x, x[:, 0] * 2 + (x[:, 3] > 1) * x[:, 1] + 3 * x[:, 5] + rng.normal(0, 0.1, n)


def frame(spark, x, y):
    # every other row as a sparse vector, as an assembler leaves them
    vector = lambda i, r: Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) if i % 2 else Vectors.dense(r)
    return spark.createDataFrame([(i, vector(i, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], ["id", "features", "log_salary"]).repartition(3).cache()


def shape(tree):
    return tree.toDebugString.split("\n", 1)[1]


PARAMS = {"labelCol": "log_salary", "seed": 3}


def test_trees_are_those_of_pyspark_ml(spark):
    """Without draws the fit is the library's: the same splits, leaves, gains and predictions."""
    x, y = drawn()
    df = frame(spark, x, y)
    same = dict(PARAMS, maxIter=4, maxDepth=4, maxBins=16, minInstancesPerNode=5)
    a, b = B.TableGBT(**same).fit(df), GBTRegressor(**same).fit(df)
    assert a.getNumTrees == 4 and a.treeWeights == b.treeWeights and a.numFeatures == b.numFeatures == 9
    numbers = lambda s: [float(w) for w in s.replace(")", " ").split() if w.replace(".", "").replace("-", "").replace("E", "").isdigit()]
    for s, t in zip(a.trees, b.trees):
        assert s.numNodes == t.numNodes and np.allclose(numbers(shape(s)), numbers(shape(t)))
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray())
    p = a.transform(df).select("id", "prediction").join(b.transform(df).select("id", F.col("prediction").alias("q")), "id")
    assert p.where(F.abs(F.col("prediction") - F.col("q")) > 1e-9).count() == 0 and p.count() == 3000


def test_stored_nodes_hold_their_rows(spark, tmp_path):
    """Counts, sums and squares of every node, leaves too: inner ones are the sum of their children."""
    x, y = drawn()
    df = frame(spark, x, y)
    path = str(tmp_path / "m")
    B.TableGBT(**PARAMS, maxIter=3, maxDepth=3, subsamplingRate=0.7, featureSubsetStrategy="0.5").fit(df).write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    at = {(r["treeID"], r["id"]): r for r in nodes}
    assert {t for t, _ in at} == {0, 1, 2}
    for r in nodes:
        n, s, q = r["impurityStats"]
        assert r["prediction"] == pytest.approx(s / n) and r["impurity"] == pytest.approx(q / n - (s / n) ** 2, abs=1e-9) and r["rawCount"] == n
        if r["leftChild"] >= 0:
            kids = [at[r["treeID"], r[c]] for c in ("leftChild", "rightChild")]
            assert np.allclose(np.sum([k["impurityStats"] for k in kids], axis=0), r["impurityStats"])
    roots = [at[t, 0]["rawCount"] for t in range(3)]
    assert all(abs(c - 2100) < 150 for c in roots) and len(set(roots)) > 1  # each tree draws its own rows


def test_many_blocks_and_few_bytes_give_the_same_trees(spark, monkeypatch):
    """However the rows are cut in blocks and the nodes in passes, the fit is the same where nothing is drawn."""
    x, y = drawn(20_000)
    df = frame(spark, x, y)
    fit = lambda: B.TableGBT(**PARAMS, maxIter=2, maxDepth=4).setMaxMemoryInMB(1).fit(df)
    whole = fit()
    monkeypatch.setattr(B, "BYTES", 1 << 11)
    monkeypatch.setattr(B, "TASKS", 1)
    cut = fit()
    assert [s.numNodes for s in whole.trees] == [s.numNodes for s in cut.trees]
    p = whole.transform(df).join(cut.transform(df).select("id", F.col("prediction").alias("q")), "id")
    assert p.where(F.abs(F.col("prediction") - F.col("q")) > 1e-9).count() == 0


def test_a_pass_counts_the_smaller_sibling_and_moves_no_rows(spark, monkeypatch):
    """Before, each of the passes of a tree counted every row of the sample in every feature."""
    x, y = drawn()
    seen, real = [], B.TableGBT._boost

    def boost(self, sc, parts, layout, folder):
        files = {b.file for p in parts for b in p}
        assert all(os.path.getsize(f) >= 2 * layout.n_cols for f in files) and sum(b.n for p in parts for b in p) == len(y)
        seen.append((layout, parts, folder))
        return real(self, sc, parts, layout, folder)

    nodes, grow = [], B.TableGBT._grow

    def counting(self, count, layout, draw, step, rng):
        def noted(tree, wanted, *rest):
            nodes.append((len(wanted), sum(left < 0 for left in tree.left)))
            return count(tree, wanted, *rest)
        return grow(self, noted, layout, draw, step, rng)

    monkeypatch.setattr(B.TableGBT, "_boost", boost)
    monkeypatch.setattr(B.TableGBT, "_grow", counting)
    B.TableGBT(**PARAMS, maxIter=1, maxDepth=4).fit(frame(spark, x, y))
    assert nodes == [(1, 1), (1, 2), (2, 4), (4, 8)]
    layout, _, folder = seen[0]
    assert layout.n_cols < 9 and not os.path.exists(folder)  # several features to a column; nothing is left behind


def test_bins_and_packed_columns_against_numpy():
    x, y = drawn(500)
    x[::7, 0] = 0.0
    splits = [B.thresholds(x[:, f], len(x), 32) for f in range(x.shape[1])]
    assert [len(s) for s in splits[3:8]] == [3, 1, 1, 1, 0] and list(splits[3]) == [0.5, 1.5, 2.5]
    assert np.allclose(B.thresholds(np.array([1.0, 2.0]), 4, 32), [0.5, 1.5])  # what isn't listed is 0
    layout = B.Layout(splits)
    rows, cols = np.nonzero(x)
    codes = layout.pack(len(x), rows, cols, x[rows, cols])
    for f, s in enumerate(splits):
        if len(s):
            assert (layout.bins_of(codes, f, np.arange(len(x))) == np.searchsorted(s, x[:, f])).all()
    with pytest.raises(ValueError):
        layout.pack(1, np.array([0]), np.array([0]), np.array([np.nan]))
    joint = np.zeros((layout.n_cols, 2, 1, 1 << layout.width))
    for c in range(layout.n_cols):
        joint[c, 0, 0], joint[c, 1, 0] = (np.bincount(codes[c], w, minlength=1 << layout.width) for w in (None, y))
    hist, at = layout.unpacked(joint)[:, 0], 0
    for b, feats in layout.classes:
        for f in feats:
            bins = np.searchsorted(splits[f], x[:, f])
            assert np.allclose(hist[:, at:at + (1 << b)], [np.bincount(bins, w, minlength=1 << b) for w in (None, y)])
            at += 1 << b


def test_what_it_does_not_know_goes_to_pyspark_ml(spark, monkeypatch):
    x, y = drawn(300)
    df = frame(spark, x, y).withColumn("w", F.lit(1.0))
    with monkeypatch.context() as m:
        m.setattr(B.TableGBT, "_boost", None)
        m.setattr(B, "LEAST", 301)
        assert B.TableGBT(**PARAMS, maxIter=2).fit(df).getNumTrees == 2  # few rows
        m.setattr(B, "LEAST", 300)
        with pytest.raises(TypeError):
            B.TableGBT(**PARAMS, maxIter=2).fit(df)
    assert not B.TableGBT(**PARAMS, weightCol="w")._own(df) and not B.TableGBT(**PARAMS, lossType="absolute")._own(df) and B.TableGBT(**PARAMS)._own(df)
    assert B._mounted("hdfs://host/a") is None and B._mounted("file:/a%20b/c") == "/a b/c" and B._mounted("/a") == "/a"
    assert B.TableGBT(**PARAMS, weightCol="w", maxIter=2).fit(df).getNumTrees == 2
    with pytest.raises(Exception):
        B.TableGBT(**PARAMS).fit(df.limit(0))
    assert isinstance(M.gbt(), B.TableGBT) and [B._parts(s, 148) for s in ("auto", "0.8", "1", "7", "1.0", "onethird", "sqrt", "log2")] == [148, 119, 1, 7, 148, 50, 13, 8]
