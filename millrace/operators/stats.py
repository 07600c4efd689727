"""Screening of features: correlation, variance between classes, error of predictions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import relative_error
from millrace.operators import correlation

MANY = 30


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_i, col_j, r) of all pairs, the later column first, in one aggregation; null with a constant column.

    Over ``MANY`` columns the sums come from one Gramian, as a plan of all pairs would be too long to compile.
    """
    if len(columns) > MANY:
        return correlation.pearson(df, columns).drop("n")
    pairs = [(b, a) for a, b in combinations(columns, 2)]
    sums = []
    for k, (i, j) in enumerate(pairs):
        x, y = F.col(i).cast("double"), F.col(j).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        sums.append(F.when(F.var_pop(x) * F.var_pop(y) > 0, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"r{k}"))
    rows = [F.struct(F.lit(i).alias("col_i"), F.lit(j).alias("col_j"), F.round(F.col(f"r{k}"), 6).alias("r")) for k, (i, j) in enumerate(pairs)]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_i, col_j, r) by average ranks, of each pair among the rows that have both values."""
    return correlation.spearman(df, columns).drop("n")


def collinear(correlations: DataFrame, bound: float) -> DataFrame:
    """(column) of the later column of each pair at least ``bound`` alike, in either direction, whether or not the earlier one goes too."""
    return correlations.filter(F.abs("r") >= bound).select(F.col("col_i").alias("column")).distinct()


def anova_f(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, f): variance between the target's classes over that within; the table is grouped once for all features."""
    clean = df.filter(F.col(target).isNotNull())
    own = lambda c: (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))
    groups = clean.groupBy(target).agg(*[x for c in columns for x in own(c)])
    totals = []
    for c in columns:
        n, m, v = F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"v_{c}")
        totals += [F.sum(n).alias(f"N_{c}"), F.count_if(n > 0).alias(f"k_{c}"), F.sum(n * m).alias(f"s_{c}"), F.sum(n * m * m).alias(f"q_{c}"), F.sum(n * v).alias(f"w_{c}")]
    row = groups.agg(*totals)
    rows = []
    for c in columns:
        n, k = F.col(f"N_{c}"), F.col(f"k_{c}")
        between = F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / F.nullif(n, F.lit(0))
        f = (between / F.nullif(k - 1, F.lit(0))) / F.nullif(F.col(f"w_{c}") / F.nullif(n - k, F.lit(0)), F.lit(0.0))
        rows.append(F.struct(F.lit(c).alias("feature"), F.round(f, 6).alias("f")))
    return row.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def selected(scores: DataFrame, least: float) -> DataFrame:
    """(feature, f) of the features whose score reaches a bound."""
    return scores.filter(F.col("f") >= least)


def mape(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(mape, n_used, n_zero): mean relative error in percent; rows whose actual value is 0 are counted apart."""
    return df.agg(F.round(100 * F.avg(relative_error(F.col(actual), F.col(predicted))), 6).alias("mape"), F.count_if(F.col(actual) != 0).alias("n_used"), F.count_if(F.col(actual) == 0).alias("n_zero"))
