"""First rows of each group: ties, nulls, plans."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking


def plain(rows, k, ties, descending):
    """(group, value, place) by sorting each group."""
    worse = lambda v: (v is None, 0 if v is None else -v if descending else v)
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r[1] for r in rows if r[0] == g), key=worse)
        for at, v in enumerate(own):
            better = [x for x in own if worse(x) < worse(v)]
            place = {"row": at, "rank": len(better), "dense": len({worse(x) for x in better})}[ties] + 1
            if place <= k:
                out.append((g, v, place))
    return sorted(map(repr, out))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ties", ["row", "rank", "dense"])
def test_first_per_group(spark, ties, descending):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([1.0, 2.0, 2.5, 7.0, None]), k) for k in range(60)] + [("few", None, 99)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    for k in (0, 1, 3, 40):
        want = plain(rows, k, ties, descending)
        got = ranking.first_per_group(df, ["g"], k, "v", "id", ties=ties, descending=descending).collect()
        assert sorted(repr((r.g, r.v, r.place)) for r in got) == want
        if ties != "row":
            got = ranking.first_values_per_group(df, ["g"], k, "v", ties, descending)
            assert got.columns == ["g", "v", "id", "place"]
            assert sorted(repr((r.g, r.v, r.place)) for r in got.collect()) == want


def test_ties_go_by_further_columns(spark):
    df = spark.createDataFrame([("a", 1, k) for k in range(9)], "g string, v int, id int").repartition(4)
    assert [r.id for r in ranking.first_per_group(df, ["g"], 3, "v", "id").orderBy("place").collect()] == [0, 1, 2]
    assert [r.id for r in ranking.nth_per_group(df, ["g"], [2, 9, 11], "v", "id").orderBy("place").collect()] == [1, 8]


def test_unknown_ties(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v int")
    for call in (lambda: ranking.first_per_group(df, ["g"], 1, "v", ties="x"), lambda: ranking.first_values_per_group(df, ["g"], 1, "v", "row")):
        with pytest.raises(ValueError):
            call()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ties", ["row", "rank", "dense"])
def test_limit_before_the_exchange(spark, sf_dir, ties):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = plan(ranking.first_per_group(orders, ["o_orderpriority"], 3, "o_totalprice", "o_orderkey", ties=ties))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_spread_form_has_no_window_over_rows(spark):
    """A group of all rows with one value: each task compares its own rows, and the window sees a value, not the rows."""
    df = spark.range(50_000).select(F.lit("hot").alias("g"), F.lit(1.0).alias("v"), "id").repartition(8)
    out = ranking.first_values_per_group(df, ["g"], 1, "v")
    assert out.count() == 50_000
    text = plan(out)
    assert text.index("Window") < text.index("partial_count")  # read from the end of the plan: counts come before windows
