"""Regression with a random forest, and what is reported about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.trees import Forest
from millrace.operators.trees import fit as grown_forest


def in_training(key: str, below: str = "cd") -> Column:
    """About 80 % of the keys, by a hash: the same however the rows are spread over partitions."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2) < below


def split_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.when(in_training(key), "train").otherwise("valid").alias("split")).agg(F.count(F.lit(1)).alias("n"))


def fit(df: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 15, seed: int = 42) -> Forest:
    return grown_forest(df, features, target, trees, depth, seed)


def predict(df: DataFrame, model: Forest, features: Sequence[str]) -> DataFrame:
    """``df`` with a column ``prediction``: rows keep their keys, so nothing is matched by position."""
    return df.withColumn("prediction", model.column(df, features))


def importances(df: DataFrame, model: Forest, features: Sequence[str], n: int = 15) -> DataFrame:
    """(feature, importance) of the most important features."""
    pairs = sorted(zip(features, model.shares.tolist()), key=lambda x: (-x[1], x[0]))[:n]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")


def residual_rank(df: DataFrame, group: str, actual: str, predicted: str, n: int) -> DataFrame:
    """The groups whose predicted values lie farthest from the actual ones on average."""
    gaps = df.groupBy(group).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("gap"))
    return gaps.orderBy(F.desc("gap"), group).limit(n)
