"""Sketches and frequent values against exact answers; plans; odd groups."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import frequent, sketches


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).alias("part"), (F.col("id") * 7919 % 20_011).alias("a"), F.nullif(F.col("id") % 100, F.lit(5)).alias("b"), F.when(F.col("id") % 3 > 0, F.pow(F.col("id") / 100, F.lit(1.5))).alias("x"))
    return df.repartition(6).cache()


def test_distinct_sketches_merge(rows):
    columns = ["a", "b"]
    parts = sketches.distinct_sketches(rows, ["g", "part"], columns)
    for keys in (["g"], []):
        whole = sketches.distinct_estimates(sketches.merged(parts, keys, columns), keys, columns)
        at_once = sketches.distinct_counts(rows, keys, columns, exact=columns)
        found, exact = ({r.g if keys else "": r for r in df.collect()} for df in (whole, at_once))
        assert found.keys() == exact.keys()
        for g, r in found.items():
            assert r.n_b == exact[g].n_b == 99  # exact up to the sketch's entries
            assert abs(r.n_a - exact[g].n_a) <= 4 * exact[g].n_a / 2 ** (sketches.LG_K / 2)
        assert not keys or exact["0"].n_a == len({k * 7919 % 20_011 for k in range(0, 60_000, 3)})


def test_many_columns_without_expand(rows):
    assert "Expand" not in plan(sketches.distinct_counts(rows, ["g"], ["a", "b", "id"], exact=["id"]))
    assert "Expand" in plan(rows.groupBy("g").agg(F.countDistinct("a"), F.countDistinct("b")))


def test_null_groups_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("b", 1), ("b", 1)], "g string, v int")
    got = {r.g: r.n_v for r in sketches.distinct_counts(df, ["g"], ["v"]).collect()}
    assert got == {None: 2, "a": 0, "b": 1} == {r.g: r.n_v for r in sketches.distinct_counts(df, ["g"], ["v"], exact=["v"]).collect()}
    none = df.limit(0)
    assert sketches.distinct_counts(none, ["g"], ["v"]).count() == 0 and sketches.distinct_counts(none, [], ["v"], exact=["v"]).first().n_v == 0


def test_shared_and_missing_parts(spark):
    df = spark.createDataFrame([("k", "a", v) for v in range(10)] + [("k", "b", v) for v in range(6, 20)] + [("l", "a", 1)], "g string, p string, v int")
    got = {r.g: tuple(r)[1:] for r in sketches.in_both(sketches.distinct_sketches(df, ["g", "p"], ["v"]), "p", "a", "b", "v", ["g"]).collect()}
    assert got == {"k": (10, 14, 4, 6), "l": (1, 0, 0, 1)}


def test_quantiles_merge(rows):
    shares = {"low": 0.01, "q1": 0.25, "median": 0.5, "high": 0.999}
    parts = sketches.quantile_sketches(rows, ["g", "part"], "x")
    for keys in (["g"], []):
        found = sketches.quantiles(sketches.merged_quantiles(parts, keys), keys, shares | {"least": 0, "most": 1})
        for r in sketches.rank_errors(rows, keys, "x", found, shares).collect():
            assert all(r[s] <= sketches.RANK_ERROR for s in shares), r
        ends = {r.g if keys else "": (r.least, r.most) for r in found.collect()}
        assert ends == {r.g if keys else "": (r.a, r.b) for r in rows.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    boxes = {r.g: r for r in sketches.boxes(rows, ["g"], "x").collect()}
    assert boxes["0"].n == 0 and boxes["0"].median is None and boxes["1"].low < boxes["1"].q1 < boxes["1"].median < boxes["1"].q3 < boxes["1"].high


def zipf(rng, n, kinds):
    return rng.choices([f"w{k:04d}" for k in range(kinds)] + [None], [1 / (k + 1) for k in range(kinds)] + [0.5], k=n)


@pytest.mark.parametrize("tracked", [1 << 12, 64, 8])
def test_most_frequent_is_exact(spark, tracked):
    """Also where summaries are too small to be sure, in which case groups are counted in full."""
    rng = random.Random(tracked)
    data = [(g, w) for g, n in (("a", 9000), (None, 3000), ("few", 5)) for w in zipf(rng, n, 800)] + [("even", f"e{k % 500}") for k in range(2000)]
    df = spark.createDataFrame(data, "g string, w string").repartition(5)
    best = lambda counts, k: sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    want = []
    for g in {g for g, _ in data}:
        want += [(g, *x) for x in best(collections.Counter(w for h, w in data if h == g and w is not None), 6)]
    assert sorted(map(repr, map(tuple, frequent.most_frequent(df, "w", 6, ["g"], tracked).collect()))) == sorted(map(repr, want))
    every = best(collections.Counter(w for _, w in data if w is not None), 6)
    assert sorted(tuple(r) for r in frequent.most_frequent(df, "w", 6, tracked=tracked).collect()) == sorted(every)


def test_only_survivors_are_counted(spark, monkeypatch):
    """The exchange of counts holds no more than the summary's items from each task, however many values there are."""
    df = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("often"), (F.col("id") % 3).cast("string"))).otherwise(F.col("id").cast("string")).alias("w"))
    counted, first = [], frequent._first
    monkeypatch.setattr(frequent, "_first", lambda counts, *rest: counted.append(plan(counts)) or first(counts, *rest))
    got = frequent.most_frequent(df, "w", 3, tracked=1000)
    assert sorted(r.w for r in got.collect()) == ["often0", "often1", "often2"]
    assert len(counted) == 1 and "LeftSemi" in counted[0]
    assert frequent.most_frequent(df.limit(0), "w", 3).count() == 0
