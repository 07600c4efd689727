"""What is in a table: counts of values, of nulls, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.functions.numbers import right_closed_bin


def _long(row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """A one-row table as (column, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in columns])).alias("x")).select("x.*")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct); nulls don't count."""
    return _long(df.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(c) for c in columns]), columns, "n_distinct")


def distinct_per_group(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def null_counts(df: DataFrame, only_some: bool = True) -> DataFrame:
    """(column, n_null) of the columns that have nulls, or of all."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    out = _long(row, df.columns, "n_null")
    return out.filter(F.col("n_null") > 0) if only_some else out


def overview(df: DataFrame) -> DataFrame:
    """(column, type, n_not_null) of all columns."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _long(row, df.columns, "n_not_null").select("column", types[F.col("column")].alias("type"), "n_not_null")


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How often each value (or pair, ...) occurs, most first; rows with a null in any of the columns don't count."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def histogram(df: DataFrame, column: str, width: float, bins: int) -> DataFrame:
    """(bin, n) for the bins (0, width], ..., those without rows too; values outside are left out."""
    numbers = df.select(right_closed_bin(F.col(column), width).alias("bin")).filter(F.col("bin").between(1, bins) & (F.lit(True)))
    counts = numbers.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """Quartiles, the fences 1.5 times the quartile distance beyond them, and the number of values outside.

    Exact quartiles keep every distinct value in one buffer; with an ``accuracy`` they come from a sketch of bounded size, with
    ranks off by one in that many at most.
    """
    places = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = df.agg((F.percentile(column, places) if accuracy is None else F.percentile_approx(F.col(column).cast("double"), places, F.lit(accuracy))).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    fences = q.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    outside = df.join(F.broadcast(fences)).agg(F.count_if((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).alias("n_outside"))
    return fences.join(F.broadcast(outside))


def token_counts(df: DataFrame, column: str, n: int, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """The n most frequent words, lower-cased, of a text column."""
    words = df.select(F.explode(F.split(F.lower(F.col(column)), pattern)).alias("token")).filter(F.col("token") != "")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(n)


def cleaned(df: DataFrame, keys: Sequence[str], required: Sequence[str], fenced: str) -> DataFrame:
    """Without repeated keys, rows that lack a required value, and values outside the fences of ``box``."""
    kept = df.dropna(subset=list(required)).dropDuplicates(list(keys))
    fences = box(kept, fenced).select("low", "high")
    return kept.join(F.broadcast(fences)).filter(F.col(fenced).between(F.col("low"), F.col("high"))).drop("low", "high")
