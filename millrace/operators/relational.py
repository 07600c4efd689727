"""Joins, groups, places and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n", of: str | None = None) -> DataFrame:
    """Rows (or non-null values of ``of``) of each group, most first, then by key."""
    return df.groupBy(*keys).agg(F.count(F.col(of) if of else F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def distinct_by(df: DataFrame, keys: Sequence[str], name: str, of: str, approximate: bool = False) -> DataFrame:
    """Distinct values of ``of`` in each group; approximately, with a sketch of fixed size, for very many values."""
    return df.groupBy(*keys).agg((F.approx_count_distinct(of) if approximate else F.countDistinct(of)).alias(name))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the largest ``by``; ties go to the smaller of the columns ``ties``."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def places(df: DataFrame, wanted: Sequence[int], by: str, *ties: str, place: str = "place") -> DataFrame:
    """Rows in the given places (1: the largest ``by``).  Only as many rows as the last place wanted are numbered."""
    first = top(df, max(wanted), by, *ties)
    numbered = first.withColumn(place, F.row_number().over(Window.orderBy(F.desc_nulls_last(by), *ties)))
    return numbered.filter(F.col(place).isin(list(wanted)))


def having_count(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n)


def without_match(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` joins."""
    return left.join(right.select(F.col(right_key).alias(key)), key, "left_anti")


def with_counts(left: DataFrame, right: DataFrame, key: str, right_key: str, name: str) -> DataFrame:
    """``left`` with the number of rows of ``right``; these are counted before the join, so nothing is multiplied."""
    counts = right.groupBy(F.col(right_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def in_table(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose value stands in the table ``names`` under the same column name."""
    return df.join(names.select(column), column, "left_semi")


def with_total(df: DataFrame, key: str, name: str = "n", total: str = "Total") -> DataFrame:
    """Counts by key and a row for all of them, in one aggregation; no rows give no total."""
    counts = df.filter(F.col(key).isNotNull()).rollup(key).agg(F.count(F.lit(1)).alias(name), F.grouping(key).alias("all"))
    return counts.filter(F.col(name) > 0).select(F.when(F.col("all") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), name)


def share_by(df: DataFrame, keys: Sequence[str], condition: Column, name: str = "share") -> DataFrame:
    """The share of rows for which the condition holds."""
    return df.groupBy(*keys).agg(F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6).alias(name))


def at_max(df: DataFrame, column: str) -> DataFrame:
    """Rows with the column's largest value; that value is one row, so it goes to all tasks."""
    most = df.agg(F.max(column).alias("__most"))
    return df.join(F.broadcast(most), F.col(column) == F.col("__most")).drop("__most")


def flag_means(df: DataFrame, flags: Sequence[str], value: str) -> DataFrame:
    """(flag, mean_0, mean_1): the mean of a value by each of several 0/1 columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])).alias("p")
    long = df.select(pairs, F.col(value).alias("value")).select("p.*", "value")
    mean = lambda k: F.round(F.avg(F.when(F.col("on") == k, F.col("value"))), 6).alias(f"mean_{k}")
    return long.groupBy("flag").agg(mean(0), mean(1))


def mean_by_period(df: DataFrame, keys: Sequence[str], date: str, unit: str, value: Column, name: str = "mean", digits: int = 2) -> DataFrame:
    """(keys, period, n, mean, change): the mean of ``value`` in each ``unit`` of time, and its difference from the period before
    that the group has.  Groups are numbered by their periods, of which there are few, and never by their rows."""
    rows = df.select(*keys, F.date_trunc(unit, date).alias("period"), value.alias("__value"))
    means = rows.groupBy(*keys, "period").agg(F.count("__value").alias("n"), F.avg("__value").alias("__mean"))
    before = F.lag("__mean").over(Window.partitionBy(*keys).orderBy("period"))
    return means.select(*keys, "period", "n", F.round("__mean", digits).alias(name), F.round(F.col("__mean") - before, digits).alias("change"))
