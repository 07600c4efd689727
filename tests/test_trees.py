"""The forest against plain recursion, and however its rows are spread."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import model, trees
from millrace.plans import catalog

NAMES = ["a", "b", "c"]


def _rows(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 6, n), rng.normal(size=n).round(2), rng.exponential(size=n)
    y = np.where(a > 2, 5.0, 1.0) + b * (a % 2) + rng.normal(size=n) / 10
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": y}))


def _plain(x, y, w, depth):
    """{place of a row: value} by plain recursion over thresholds between bins."""
    value = (w * y).sum() / w.sum()
    best = None
    if depth and np.ptp(y) > 0:
        for k in range(x.shape[1]):
            for cut in np.unique(x[:, k])[:-1]:
                left = x[:, k] <= cut
                s = sum((w[m] * y[m]).sum() ** 2 / w[m].sum() for m in (left, ~left))
                if best is None or s > best[0] + 1e-9:
                    best = s, left
    if best is None or best[0] - value**2 * w.sum() <= 1e-9:
        return np.full(len(y), value)
    out = np.empty(len(y))
    for m in (best[1], ~best[1]):
        out[m] = _plain(x[m], y[m], w[m], depth - 1)
    return out


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_branch_equals_plain_recursion(depth):
    rng = np.random.default_rng(1)
    x, w = rng.integers(0, 12, (3, 200)).astype(np.uint8), rng.poisson(1, 200) + 1
    y = x[0] * 1.5 - (x[1] > 6) * x[2] + rng.normal(size=200)
    tree, gains = trees.grown(x, y, w, depth)
    assert np.allclose(tree.value[trees._reached(tree, x, depth)], _plain(x.T, y, w, depth))
    assert (gains >= 0).all() and (gains.sum() > 0) == (depth > 0)


def _nodes(forest):
    """Of each tree, what its nodes are, in the order of a walk from the root."""

    def walk(tree, at):
        if tree.child[at] == at:
            return [round(float(tree.value[at]), 9)]
        return [int(tree.feature[at]), int(tree.cut[at]), *walk(tree, tree.child[at]), *walk(tree, tree.child[at] + 1)]

    return [walk(t, 0) for t in forest.trees]


def test_forest_does_not_depend_on_partitions(spark):
    df = _rows(spark)
    one, many = (model.fit(d, NAMES, "y", trees=5, depth=6) for d in (df.coalesce(1), df.repartition(7, "c")))
    assert _nodes(one) == _nodes(many) and np.allclose(one.shares, many.shares)


@pytest.mark.parametrize("depth", [2, 7])
def test_large_nodes_are_split_by_sums(spark, monkeypatch, depth):
    """The same trees whether tasks grow them whole or only their small branches, in one pass over the rows or several."""
    df = _rows(spark)
    whole = model.fit(df, NAMES, "y", trees=4, depth=depth)
    monkeypatch.setattr(trees, "LOCAL", 600)
    monkeypatch.setattr(trees, "SUMS", 3 * 3 * trees.BINS * 3)
    parts = model.fit(df.repartition(5), NAMES, "y", trees=4, depth=depth)
    assert _nodes(parts) == _nodes(whole) and np.allclose(parts.shares, whole.shares)


def test_copies_are_drawn_each_on_their_own():
    """Of a row that stands n times n are drawn in the mean, with the variance of n draws."""
    hashes = trees._mixed(np.arange(200_000, dtype=np.uint64))
    for n in (1, 7, 5000):
        drawn = trees._drawn(hashes, np.full(len(hashes), n), 3, 42)
        assert abs(drawn.mean() - n) < 0.01 * n + 0.01 and abs(drawn.var() - n) < 0.02 * n


def test_few_values_are_all_told_apart(spark):
    """Also those that hardly any row has."""
    df = spark.createDataFrame([(0.0, 0.0)] * 5000 + [(1.0, 7.0)] * 3 + [(2.0, -9.0)] * 3, "x double, y double")
    forest = model.fit(df, ["x"], "y", trees=20, depth=3)
    assert list(forest.cuts[0]) == [0.5, 1.5]
    got = {r.x: r.prediction for r in model.predict(df.distinct(), forest, ["x"]).collect()}
    assert abs(got[0.0]) < 0.01 and got[1.0] > 4 and got[2.0] < -6


def test_nulls_and_empty_tables_are_refused(spark):
    df = _rows(spark, 50)
    with pytest.raises(Exception, match="null or NaN in b"):
        model.fit(df.withColumn("b", F.when(F.col("a") > 0, F.col("b"))), NAMES, "y", trees=2)
    with pytest.raises(ValueError, match="no rows"):
        model.fit(df.limit(0), NAMES, "y", trees=2)
    forest = model.fit(df, NAMES, "y", trees=2)
    with pytest.raises(Exception, match="null or NaN in c"):
        model.predict(df.withColumn("c", F.lit(None).cast("double")), forest, NAMES).collect()


@pytest.fixture
def shuffled(spark):
    """MB that tasks write for others while a function runs, which fits a forest of its own."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(60_000)
        return sum(context.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(context.statusStore().executorList(False).length())) / 1e6

    def mb(f):
        catalog._FORESTS.clear()
        before = written()
        f()
        return written() - before

    return mb


#: Sums by bin of every node of every tree were 130 MB.
FITTED = ["ml_importance_sum", "ml_importances", "ml_predict_join", "ml_predictions_file", "ml_residual_by_brand", "ml_residual_rank", "ml_rf_bound", "ml_rf_eval"]


@pytest.mark.parametrize("name", FITTED)
def test_rows_not_sums_of_small_nodes_leave_tasks(spark, sf_dir, shuffled, name):
    assert 0 < shuffled(lambda: catalog.QUERIES[name](spark, sf_dir).collect()) < 10
