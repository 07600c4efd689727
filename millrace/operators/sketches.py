"""Distinct counts and quantiles from sketches that are stored by part and merged upward.

A sketch has a bounded size whatever it has seen, so a group that holds a third of all rows is one small row in each task; and the
sketches of days make those of months, of all groups, or of sets of parts, without another look at the rows.  Many columns at once
cost one pass and no Expand.

Distinct values are counted with theta sketches, which can also be intersected and subtracted.  The estimate of n distinct values has a
standard error of about n / sqrt(2^LG_K) and is exact up to 2^LG_K values.  Quantiles come from KLL sketches with a rank error under
``RANK_ERROR`` of the rows.  Nulls count nowhere; a group of nulls alone has 0 distinct values and null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a theta sketch as a power of two; the parameter of KLL sketches and the rank error that goes with it (99 % of the time).
LG_K, KLL_K, RANK_ERROR = 12, 400, 0.007
#: Tasks that merge the sketches of a group before one merges theirs.
SIDES = 64


def _by_sides(df: DataFrame, keys: Sequence[str], of_rows: Sequence[Column], of_parts: Sequence[Column]) -> DataFrame:
    """Aggregates of each group in two steps: tasks merge a few sides of it side by side, so none gets what every task of a large table has."""
    sides = df.withColumn("__side", F.pmod(F.spark_partition_id(), F.lit(SIDES))).groupBy(*keys, "__side").agg(*of_rows)
    return sides.groupBy(*keys).agg(*of_parts)


def _text(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(keys, s_<column>...): a theta sketch of each column's values in each group, to be stored and merged."""
    own = [F.theta_sketch_agg(_text(c), lg_k).alias(f"s_{c}") for c in columns]
    return _by_sides(df, keys, own, [F.theta_union_agg(f"s_{c}", lg_k).alias(f"s_{c}") for c in columns])


def merged(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Stored sketches united for coarser groups; no keys: for all."""
    return sketches.groupBy(*keys).agg(*[F.theta_union_agg(f"s_{c}", lg_k).alias(f"s_{c}") for c in columns])


def distinct_estimates(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n_<column>...) from sketches, rounded."""
    return sketches.select(*keys, *[F.coalesce(F.theta_sketch_estimate(f"s_{c}"), F.lit(0)).cast("long").alias(f"n_{c}") for c in columns])


def in_both(sketches: DataFrame, part: str, first: object, second: object, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_first, n_second, n_both, n_only_first): how many values of the column two stored parts have, share, and don't share."""
    one = lambda v: F.theta_union_agg(F.when(F.col(part) == v, F.col(f"s_{column}")), LG_K)
    # a part that a group lacks is an empty sketch: what a sketch has beyond itself
    rows = sketches.groupBy(*keys).agg(one(first).alias("a"), one(second).alias("b"))
    a, b = F.col("a"), F.col("b")
    n = lambda s: F.coalesce(F.theta_sketch_estimate(s), F.lit(0)).cast("long")
    return rows.select(*keys, n(a).alias("n_first"), n(b).alias("n_second"), n(F.theta_intersection(a, b)).alias("n_both"), n(F.theta_difference(a, b)).alias("n_only_first"))


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], exact: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(keys, n_<column>...): estimates for all columns, exact counts for those in ``exact``.

    Exact counts of one column come from its distinct values, which tasks combine before they are exchanged; each such column is an
    aggregation of its own that joins the others by group, so no row is multiplied by the number of columns.
    """
    out = distinct_estimates(distinct_sketches(df, keys, columns, lg_k), keys, columns)
    for c in exact:
        values = df.select(*keys, F.col(f"`{c}`").alias("__v")).distinct().groupBy(*keys).agg(F.count("__v").alias(f"n_{c}"))
        names = [*keys, *[f"n_{x}" for x in columns]]
        if not keys:
            out = out.drop(f"n_{c}").join(F.broadcast(values)).select(*names)
            continue
        right = values.select(*[F.col(k).alias(f"__{k}") for k in keys], f"n_{c}")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.drop(f"n_{c}").join(right, same).select(*names)
    return out


def quantile_sketches(df: DataFrame, keys: Sequence[str], column: str, k: int = KLL_K) -> DataFrame:
    """(keys, n, least, most, sketch) of a numeric column in each group, to be stored and merged."""
    x = F.col(f"`{column}`").cast("double")
    own = [F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch")]
    return _by_sides(df, keys, own, _merged_quantiles(k))


def _merged_quantiles(k: int) -> list[Column]:
    return [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")]


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], k: int = KLL_K) -> DataFrame:
    """Stored sketches merged for coarser groups; no keys: for all."""
    return sketches.groupBy(*keys).agg(*_merged_quantiles(k))


def quantiles(sketches: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(keys, n, <name>...) for shares by name, as {"median": 0.5}; 0 and 1 are the exact ends."""
    at = lambda p: F.col("least") if p == 0 else F.col("most") if p == 1 else F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return sketches.select(*keys, "n", *[at(p).alias(name) for name, p in shares.items()])


def boxes(df: DataFrame, keys: Sequence[str], column: str, k: int = KLL_K) -> DataFrame:
    """(keys, n, least, q1, median, q3, most, low, high) of each group: quartiles and the fences 1.5 quartile distances beyond them."""
    out = quantiles(quantile_sketches(df, keys, column, k), keys, {"least": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return out.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})


def rank_errors(df: DataFrame, keys: Sequence[str], column: str, found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(keys, n, <name>...): how far the exact rank of each quantile in ``found`` is from its share, in shares of the rows of its group.

    A value has all ranks between the rows below it and those up to it.
    """
    x = F.col(f"`{column}`").cast("double")
    right = found.select(*[F.col(c).alias(f"__{c}") for c in keys], *[F.col(s).alias(f"__q_{s}") for s in shares])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = df.filter(x.isNotNull()).join(right, same)
    own = lambda s, p: F.greatest(F.count_if(x < F.col(f"__q_{s}")) / F.count(x) - p, p - F.count_if(x <= F.col(f"__q_{s}")) / F.count(x), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), *[own(s, p).alias(s) for s, p in shares.items()])
