"""Correlation of many columns, and of average ranks, each pair over the rows that have both values.

``pearson`` makes one Gramian: tasks hold sums for all pairs of a band of columns and add batches of rows to them by matrix products, so
the plan has the same size for three columns and for hundreds, and a task sends each pair once.  Values are shifted by the mean and scaled
by the largest distance from it, which keeps the sums accurate.

``spearman`` ranks counted values rather than rows: ties cost one row, prefix sums of the counts give average ranks, and each pair of
columns has ranks of its own among the rows that have both.

Nulls and NaN are missing values; a pair without two common rows, or with a column that is constant on them, has no correlation (null).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import before
from millrace.sources import checkpointed

#: Pairs whose sums a task holds at once (six numbers each); more are counted in several passes.
PAIRS = 1 << 20
#: A variance that is less than this share of the sum of squares is rounding.
ROUNDING = 1e-12


def _double(column: str) -> Column:
    x = F.col("`" + column.replace("`", "``") + "`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)


def _shifts(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, largest distance from it) of each column, finite values only; three numbers for each column and task."""
    width = len(values.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(width), np.zeros(width)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                there = np.isfinite(x)
                n += there.sum(axis=0)
                total += np.where(there, x, 0.0).sum(axis=0)
                low = np.minimum(low, np.where(there, x, np.inf).min(axis=0))
                high = np.maximum(high, np.where(there, x, -np.inf).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, (n, total, low, high))], names=["at", "n", "total", "low", "high"])

    sums = values.mapInArrow(run, "at long, n double, total double, low double, high double")
    mean, reach = np.zeros(width), np.ones(width)
    for r in sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row for each column
        if r["n"] and np.isfinite(r["total"]):
            mean[r["at"]] = r["total"] / r["n"]
            reach[r["at"]] = max(r["high"] - mean[r["at"]], mean[r["at"]] - r["low"]) or 1.0
    return mean, reach


def gramian(df: DataFrame, columns: Sequence[str], most: int = PAIRS) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for each pair i > j of columns by number: sums over the rows that have both, of shifted, scaled values."""
    values = df.select(*[_double(c).alias(f"c{k}") for k, c in enumerate(columns)])
    mean, reach = _shifts(values)
    names = ["n", "x", "y", "xx", "yy", "xy"]
    schema = "i long, j long, " + ", ".join(f"{s} double" for s in names)
    out, width = None, max(1, most // max(1, len(columns)))
    for first in range(0, len(columns), width):
        band = slice(first, min(first + width, len(columns)))

        def run(batches: Iterator[pa.RecordBatch], band=band) -> Iterator[pa.RecordBatch]:
            size = (band.stop - band.start, band.stop)
            sums = [np.zeros(size) for _ in names]
            for batch in batches:
                x = (_matrix(batch) - mean[: band.stop]) / reach[: band.stop]
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(np.float64)
                xi, mi, squares = x[:, band].T, m[:, band].T, x * x
                for s, product in zip(sums, (mi @ m, xi @ m, mi @ x, squares[:, band].T @ m, mi @ squares, xi @ x)):
                    s += product
            i, j = np.nonzero(np.arange(band.start, band.stop)[:, None] > np.arange(band.stop)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(i + band.start), pa.array(j), *[pa.array(s[i, j]) for s in sums]], names=["i", "j", *names])

        part = values.select(*values.columns[: band.stop]).mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in names])
        out = part if out is None else out.unionByName(part)
    return out


def _r(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    a, b = xx - x * x / n, yy - y * y / n
    r = (xy - x * y / n) / F.sqrt(a * b)
    return F.when((n > 1) & (a > ROUNDING * xx) & (b > ROUNDING * yy), F.round(r, 6))


def _every(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j) of all pairs i > j, so that pairs without a row have one too."""
    k = len(columns)
    return df.sparkSession.range(k * k).select(F.floor(F.col("id") / k).alias("i"), (F.col("id") % k).alias("j")).filter("i > j")


def _named(columns: Sequence[str], at: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col(at).cast("int"))


def pearson(df: DataFrame, columns: Sequence[str], most: int = PAIRS) -> DataFrame:
    """(col_i, col_j, n, r) of all pairs, the later column first; n rows have both values."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_i string, col_j string, n long, r double")
    sums = _every(df, columns).join(gramian(df, columns, most), ["i", "j"], "left")
    return sums.select(_named(columns, "i").alias("col_i"), _named(columns, "j").alias("col_j"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), _r(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).alias("r"))


def average_ranks(counts: DataFrame, within: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Counted values with ``rank``, the average place of their rows in the order of values (from 1), and ``centre``, the middle of all places."""
    placed = before(counts, within, [value], n, "__before")
    groups = counts.groupBy(*within).agg(((F.sum(n) + 1) / 2).alias("centre"))
    return placed.join(groups, list(within)).withColumn("rank", F.col("__before") + (F.col(n) + 1) / 2).drop("__before")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_i, col_j, n, r) of all pairs, the later column first, by average ranks among the rows that have both values."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _double(columns[i]).alias("x"), _double(columns[j]).alias("y")) for i in range(len(columns)) for j in range(i)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_i string, col_j string, n long, r double")
    both = F.filter(F.array(*pairs), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # equal pairs of values are one row from here on; -0.0 and 0.0 are one value
    zero = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c)
    met = checkpointed(df.select(F.explode(both).alias("p")).select("p.i", "p.j", F.col("p.x").alias("x"), F.col("p.y").alias("y")).select("i", "j", zero("x"), zero("y")).groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    ranks = {s: average_ranks(met.groupBy("i", "j", F.col(s).alias("value")).agg(F.sum("n").alias("n")), ["i", "j"]).select("i", "j", F.col("value").alias(s), (F.col("rank") - F.col("centre")).alias(f"r{s}")) for s in ("x", "y")}
    rows = met.join(ranks["x"], ["i", "j", "x"]).join(ranks["y"], ["i", "j", "y"])
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    sums = rows.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(n * a * a).alias("xx"), F.sum(n * b * b).alias("yy"), F.sum(n * a * b).alias("xy"))
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6))
    found = _every(df, columns).join(sums.withColumn("r", r), ["i", "j"], "left")
    return found.select(_named(columns, "i").alias("col_i"), _named(columns, "j").alias("col_j"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "r")
