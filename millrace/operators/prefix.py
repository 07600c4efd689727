"""Sums of what comes before, over tables of any size.

Rows are put in ranges of the order, which are summed side by side, and each range goes on from where those before it end; the driver and
single tasks see one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources import checkpointed


def before(df: DataFrame, within: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``within`` that are earlier in the order; rows should not tie in it.

    ``within`` are columns without nulls.  A group may span any number of ranges, and a range any number of groups.
    """
    # ranges are found once, so that sums and rows speak of the same ones
    held = checkpointed(df.repartitionByRange(*within, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy("__range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("__range", *within).agg(F.sum(value).alias("__sum"))
    ranges = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", *within, F.coalesce(F.sum("__sum").over(ranges), F.lit(0)).alias("__start"))
    own = held.withColumn("__own", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return own.join(starts, ["__range", *within]).withColumn(name, F.col("__own") + F.col("__start")).select(*df.columns, name)
