"""Encoders that are fitted on one table, stored, and applied to others and to streams.

A fitted encoder is a table: of codes, of bounds, or of names.  ``save`` and ``load`` keep it as Parquet; applying one is a join of rows
with a small table or a row, so rows of a stream are encoded as those of a table are.

A null stays null.  A value that fitting has not seen has no code, or with ``unseen="keep"`` one more than the last code, the same for all
such values.  A table without rows fits an encoder that has seen nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.prefix import before


def save(encoder: DataFrame, path: str) -> None:
    encoder.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fit_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the values of each column as text, numbered from 0 in the order of the column's type."""
    out = None
    for c in columns:
        values = df.select(F.col(f"`{c}`").alias("own")).dropna().distinct().select(F.lit(c).alias("column"), "own", F.lit(1).alias("one"))
        numbered = before(values, ["column"], ["own"], "one", "code").select("column", F.col("own").cast("string").alias("value"), F.col("code").cast("long").alias("code"))
        out = numbered if out is None else out.unionByName(numbered)
    return out


def encode(df: DataFrame, codes: DataFrame, columns: Mapping[str, str], unseen: str = "null") -> DataFrame:
    """``df`` with the codes of columns, given as {column: name of its code}; whether a table of codes is sent to all tasks is left to its size."""
    if unseen not in ("null", "keep"):
        raise ValueError("unseen is null or keep")
    out, names = df, list(df.columns)
    for c, name in columns.items():
        own = codes.filter(F.col("column") == c)
        side = own.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        out = out.join(side, F.col(f"`{c}`").cast("string") == F.col("__value"), "left")
        code = F.col("__code")
        if unseen == "keep":
            # one row
            out = out.join(F.broadcast(own.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("__next"))))
            code = F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(code, F.col("__next")))
        names.append(name)
        out = out.withColumn(name, code).select(*[f"`{x}`" for x in names])
    return out


def fit_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, least, most) of numeric columns, in one aggregation; null without values."""
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{n}") for k, c in enumerate(columns) for n, f in (("least", F.min), ("most", F.max))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{k}least").alias("least"), F.col(f"{k}most").alias("most")) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def scale(df: DataFrame, bounds: DataFrame, columns: Mapping[str, str], clip: bool = False) -> DataFrame:
    """``df`` with columns scaled to [0, 1] by fitted bounds, given as {column: name}; a constant becomes 0.

    Values beyond the bounds fall outside [0, 1] unless they are clipped.
    """
    # one row of as many pairs as columns
    row = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("least", "most")))).alias("__bounds"))

    def own(c: str) -> Column:
        x, b = F.col(f"`{c}`").cast("double"), F.col("__bounds")[c]
        y = F.when(b["most"] > b["least"], (x - b["least"]) / F.nullif(b["most"] - b["least"], F.lit(0.0))).when(x.isNotNull() & b["least"].isNotNull(), 0.0)
        return F.when(y.isNotNull(), F.greatest(F.least(y, F.lit(1.0)), F.lit(0.0))) if clip else y

    return df.join(F.broadcast(row)).withColumns({name: own(c) for c, name in columns.items()}).drop("__bounds")


def fit_names(df: DataFrame, name: str, value: str, mean: float, count: int) -> DataFrame:
    """(name, mean, n) of the names whose rows' mean and number reach the bounds."""
    stats = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("name")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return stats.filter((F.col("mean") >= mean) & (F.col("n") >= count))


def top_or_other(df: DataFrame, names: DataFrame, column: str, out: str = "group_name", other: str = "other") -> DataFrame:
    """``df`` with the name where it is among the fitted ones, else ``other``."""
    known = names.select(F.col("name").alias("__name"))
    rows = df.join(known, F.col(f"`{column}`").cast("string") == F.col("__name"), "left")
    return rows.select(*[f"`{c}`" for c in df.columns], F.coalesce("__name", F.lit(other)).alias(out))
