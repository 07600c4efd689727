"""Features of reviews and the places they are about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.strings import first_contained, number_in, quoted_items, word_from_end
from millrace.sources import checkpointed

# Tags and room names as the source data writes them, in their order, and the codes of party types.
MOBILE_TAG = "Submitted from a mobile device"
PET_TAG = "With a pet"
BUSINESS_TAG = "Business trip"
LEISURE_TAG = "Leisure trip"
PARTY_CODES = {
    "Solo traveler": 1,
    "Couple": 2,
    "Travelers with friends": 3,
    "Family with young children": 4,
    "Family with older children": 5,
    "Group": 6,
}
NIGHTS_PATTERN = r"Stayed\s\d+\snight\w?"
ROOM_NAMES = ["without Window", "Guestroom", "Classic", "Single", "Standard", "Superior", "Comfort", "Club", "Suite", "Deluxe", "King", "Premier"]
DOUBLE_NAMES = {"Double": ["Double", "Twin"]}
VIEW_NAMES = ["View", "Panoramic"]
# End of fixed values.


def tag_features(tags: Column) -> dict[str, Column]:
    """Mobile, pet and leisure flags, party code, nights and room tag of a list written as text."""
    return _of_items(quoted_items(tags))


def with_tag_features(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the columns of ``tag_features``; the list is cut up once for all of them."""
    return df.withColumn("__items", quoted_items(F.col(column))).withColumns(_of_items(F.col("__items"))).drop("__items")


def _of_items(items: Column) -> dict[str, Column]:
    party = F.filter(items, lambda x: x.isin(list(PARTY_CODES)))
    codes = F.create_map(*[F.lit(x) for pair in PARTY_CODES.items() for x in pair])
    nights = F.filter(items, lambda x: x.rlike(f"^(?:{NIGHTS_PATTERN})$"))
    known = [MOBILE_TAG, PET_TAG, BUSINESS_TAG, LEISURE_TAG, *PARTY_CODES]
    other = F.filter(items, lambda x: ~(x.isin(known) | x.rlike(f"^(?:{NIGHTS_PATTERN})$")))
    return {
        "mobile": F.array_contains(items, MOBILE_TAG).cast("int"),
        "pet": F.array_contains(items, PET_TAG).cast("int"),
        "leisure": (~F.array_contains(items, BUSINESS_TAG)).cast("int"),
        "party": F.coalesce(codes[F.try_element_at(party, F.lit(-1))], F.lit(0)),
        "nights": F.coalesce(number_in(F.try_element_at(nights, F.lit(-1)), NIGHTS_PATTERN), F.lit(0.0)),
        # without an unknown tag, the last one of several stands for the room
        "room_tag": F.coalesce(F.try_element_at(other, F.lit(1)), F.when(F.size(items) > 1, F.try_element_at(items, F.lit(-1))).otherwise("")),
    }


def room_type(tag: Column) -> Column:
    return first_contained(tag, ROOM_NAMES, DOUBLE_NAMES, "Other")


def has_view(tag: Column) -> Column:
    out = F.lit(False)
    for name in VIEW_NAMES:
        out = out | tag.contains(name)
    return out.cast("int")


def distinct_names(df: DataFrame, name: str, address: str, word: int = 2) -> DataFrame:
    """Names that stand for several addresses get a word of the address (counted from its end) added."""
    shared = df.groupBy(name).agg(F.countDistinct(address).alias("__n")).filter(F.col("__n") != 1).select(name, F.lit(True).alias("__shared"))
    added = F.concat_ws(" ", F.col(name), word_from_end(F.col(address), word))
    return df.join(shared, name, "left").withColumn("full_name", F.when(F.col("__shared"), added).otherwise(F.col(name))).drop("__shared")


def top_or_other(df: DataFrame, name: str, value: str, mean: float, count: int, other: str = "other", fit_on: DataFrame | None = None) -> DataFrame:
    """The name where its rows' mean and number reach the bounds, else ``other``."""
    stats = (df if fit_on is None else fit_on).groupBy(name).agg(F.avg(value).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    best = stats.filter((F.col("__mean") >= mean) & (F.col("__n") >= count)).select(name, F.lit(True).alias("__top"))
    return df.join(best, name, "left").withColumn("group_name", F.when(F.col("__top"), F.col(name)).otherwise(other)).drop("__top")


def _values(df: DataFrame, column: str, most: int) -> list:
    """The distinct values of a category column in their order; more than ``most`` are refused."""
    rows = df.select(column).dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has over {most} values: it is no category, join a table of codes instead")
    return sorted(r[0] for r in rows)


def ordinal_code(df: DataFrame, column: str, code: str, most: int = 1000) -> DataFrame:
    """Numbers from 0 for the values of a category in their order; null stays null.

    Up to ``most`` values are literals of the plan; more are numbered in a table of their own, which joins the rows.
    """
    values = df.select(column).dropna().distinct().limit(most + 1).collect()
    if len(values) > most:
        return df.join(_numbered(df, column, code), column, "left").select(*df.columns, code)
    if not values:
        return df.withColumn(code, F.lit(None).cast("int"))
    return df.withColumn(code, (F.array_position(F.array(*[F.lit(v) for v in sorted(r[0] for r in values)]), F.col(column)) - 1).cast("int"))


def _numbered(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code) of the distinct values: ranges of values are numbered side by side, each from where those before it end."""
    ranges = df.select(column).dropna().distinct().repartitionByRange(F.col(column)).withColumn("__range", F.spark_partition_id())
    held = checkpointed(ranges)  # the ranges are found once, so that counts and numbers speak of the same ones
    sizes = held.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range, of which there are as many as shuffle partitions
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    return held.withColumn("__place", place).join(starts, "__range").select(column, (F.col("__start") + F.col("__place")).cast("int").alias(code))


def one_hot(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` for each value of a category."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in _values(df, column, most)})


def min_max(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", fit_on: DataFrame | None = None) -> DataFrame:
    """Columns scaled to [0, 1] by the least and largest value of ``fit_on`` (all rows if not given); a constant becomes 0."""
    source = df if fit_on is None else fit_on
    bounds = source.agg(*[f(c).cast("double").alias(f"__{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    scaled = {}
    for c in columns:
        low, high = F.col(f"__min_{c}"), F.col(f"__max_{c}")
        scaled[c + suffix] = F.when(high > low, (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))).when(F.col(c).isNotNull(), 0.0)
    return df.join(F.broadcast(bounds)).withColumns(scaled).drop(*[f"__{n}_{c}" for c in columns for n in ("min", "max")])
