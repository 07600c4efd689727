"""The most frequent values, exactly, from bounded summaries.

A first pass keeps a summary of frequent items for each group in every task; summaries merge, and what moves is bounded by their size and
not by the number of distinct values.  A second pass counts the survivors alone, which rows meet by a semi-join.  A summary of ``tracked``
items misses no value that occurs in more than ``MISSED / tracked`` of a group's rows (Misra and Gries, 1982, in the form of the
frequent-items sketch), so where the last value of the answer is more frequent than that, the answer is exact; groups where it isn't are
counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources import checkpointed

#: Items of a summary.  The sketch holds at least 4/3 of them, its counts are off by at most 3.5 / that of all rows, and it reports
#: items whose count is surely over that error, so what it leaves out occurs at most twice the error.
TRACKED, MISSED = 1 << 16, 2 * 3.5 * 3 / 4
#: Tasks that merge the summaries of a group side by side before one merges theirs.
SIDES = 64
#: Survivors that are sent to every task at most.
SENT = 500_000


def most_frequent(df: DataFrame, column: str, k: int, keys: Sequence[str] = (), tracked: int = TRACKED, name: str = "n") -> DataFrame:
    """(keys, column, n) of the ``k`` most frequent values of each group, or of all rows; ties go to the smaller value, nulls don't count.

    A null key is a group of its own.
    """
    own = [f"__{c}" for c in keys]
    rows = df.filter(F.col(column).isNotNull()).select(*[F.col(c).alias(o) for c, o in zip(keys, own)], F.col(column).alias("__value"))
    sides = rows.withColumn("__side", F.pmod(F.spark_partition_id(), F.lit(SIDES))).groupBy(*own, "__side").agg(F.count(F.lit(1)).alias("__n"), F.call_function("approx_top_k_accumulate", F.col("__value"), F.lit(tracked)).alias("__state"))
    # without rows there is no summary to merge, so all rows are a group of their own here
    parts = sides.withColumn("__one", F.lit(1)).groupBy(*own, "__one").agg(F.sum("__n").alias("__all"), F.call_function("approx_top_k_combine", F.col("__state"), F.lit(tracked)).alias("__state"))
    # a row of bounded size for each group, used three times
    found = checkpointed(parts.select(*own, F.coalesce("__all", F.lit(0)).alias("__all"), F.call_function("approx_top_k_estimate", F.col("__state"), F.lit(tracked)).alias("__items")))
    kept = found.select(*[F.col(o).alias(f"{o}_") for o in own], F.explode("__items.item").alias("__item"))
    # at most ``tracked`` items of each group; with many groups the join is left to the planner
    kept = F.broadcast(kept) if (found.agg(F.sum(F.size("__items"))).first()[0] or 0) <= SENT else kept
    same = F.col("__value") == F.col("__item")
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
    counts = rows.join(kept, same, "left_semi").groupBy(*own, "__value").agg(F.count(F.lit(1)).alias(name))
    first = checkpointed(_first(counts, own, k, name))  # k rows of each group
    # of each group: how frequent its last value is, or 0 if there are fewer than k
    last = first.groupBy(*own).agg(F.when(F.count(F.lit(1)) >= k, F.min(name)).otherwise(0).alias("__last"))
    groups = found.select(*own, "__all")
    equal = F.lit(True)
    for o in own:
        equal = equal & groups[o].eqNullSafe(last[o])
    sure = F.coalesce(F.col("__last"), F.lit(0)) > F.col("__all") * MISSED / tracked
    unsure = groups.join(last, equal, "left").filter(~sure).select(*[groups[o].alias(f"{o}_") for o in own])
    if own:
        again = F.lit(True)
        for o in own:
            again = again & F.col(o).eqNullSafe(F.col(f"{o}_"))
        full = _first(rows.join(unsure, again, "left_semi").groupBy(*own, "__value").agg(F.count(F.lit(1)).alias(name)), own, k, name)
        out = first.join(unsure, again, "left_anti").unionByName(full)
    else:
        out = first if unsure.isEmpty() else _first(rows.groupBy("__value").agg(F.count(F.lit(1)).alias(name)), own, k, name)
    return out.select(*[F.col(o).alias(c) for c, o in zip(keys, own)], F.col("__value").alias(column), name)


def _first(counts: DataFrame, own: Sequence[str], k: int, name: str) -> DataFrame:
    order = [F.desc(name), F.asc("__value")]
    if not own:
        return counts.orderBy(*order).limit(k)
    return counts.withColumn("__at", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).filter(F.col("__at") <= k).drop("__at")


def frequent_tokens(df: DataFrame, text: str, k: int, keys: Sequence[str] = (), pattern: str = r"[^\p{L}]+", tracked: int = TRACKED) -> DataFrame:
    """(keys, token, n): the ``k`` most frequent words, lower-cased, of a text column; ``profile.token_counts`` with a bounded exchange."""
    words = df.select(*keys, F.explode(F.split(F.lower(F.col(text)), pattern)).alias("token")).filter(F.col("token") != "")
    return most_frequent(words, "token", k, keys, tracked)
