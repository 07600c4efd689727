"""The first rows of each group, with a choice of what ties mean.

``row``: k rows, ties broken by further columns.  ``rank``: rows with fewer than k better ones, so all that tie for the last place.
``dense``: rows with one of the k best values.

``first_per_group`` numbers rows in a window whose limit Spark applies in every task before the exchange (WindowGroupLimit), so of a
group only what ties for the first k places moves.  That is unbounded where a value repeats without end: ``first_values_per_group``
sends k values of each group instead and compares rows with them where they are, so no task holds a group.

A null value is worse than any other, and rows without a value take places too; a null key is a group; k of 0 gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = {"row": F.row_number, "rank": F.rank, "dense": F.dense_rank}
#: Spark pushes the limit of a window for so many rows of a group at most (spark.sql.optimizer.windowGroupLimitThreshold).
PUSHED = 1000


def _best_first(by: str, descending: bool) -> Column:
    return F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)


def first_per_group(df: DataFrame, keys: Sequence[str], k: int, by: str, *ties_by: str, ties: str = "row", descending: bool = True, place: str = "place") -> DataFrame:
    """The rows in the first ``k`` places of each group, with their place.  ``ties_by`` breaks ties, smaller first, for ``row`` alone."""
    if ties not in _NUMBERS:
        raise ValueError(f"ties are one of {', '.join(_NUMBERS)}")
    order = [_best_first(by, descending), *(ties_by if ties == "row" else ())]
    number = _NUMBERS[ties]().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(place, number).filter(F.col(place) <= k)


def nth_per_group(df: DataFrame, keys: Sequence[str], wanted: Sequence[int], by: str, *ties_by: str, descending: bool = True, place: str = "place") -> DataFrame:
    """The rows in the given places of each group; a group with fewer rows has none in the later ones."""
    first = first_per_group(df, keys, max(wanted), by, *ties_by, descending=descending, place=place)
    return first.filter(F.col(place).isin(list(wanted)))


def first_values_per_group(df: DataFrame, keys: Sequence[str], k: int, by: str, ties: str = "rank", descending: bool = True, place: str = "place") -> DataFrame:
    """``first_per_group`` for ``rank`` and ``dense`` without a window over the rows of a group.

    A group's k best values (of distinct ones for ``dense``; of all rows for ``rank``, counted before they are placed) come from an
    aggregation over (group, value), which combines equal values in every task; rows join them by group and count the better ones.
    """
    if ties not in ("rank", "dense"):
        raise ValueError("rows without ties need a window")
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_best_first(by, descending))
    values = counts.withColumn("__at", F.row_number().over(before)).filter(F.col("__at") <= k)
    earlier = F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 if ties == "rank" else F.col("__at")
    placed = values.withColumn(place, earlier.cast("int")).filter(F.col(place) <= k)
    heads = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.collect_list(F.struct(F.col(by).alias("value"), F.col(place).alias("place"))).alias("__first"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # one row of at most k values for each group
    own = F.filter("__first", lambda x: x["value"].eqNullSafe(F.col(by)))
    rows = df.join(heads, same).withColumn(place, F.get(own, 0)["place"])
    return rows.filter(F.col(place).isNotNull()).select(*df.columns, place)
