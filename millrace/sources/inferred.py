"""CSV of unknown types: the types come from all rows, and rows that fit none are kept apart.

Types form a lattice: boolean; bigint < decimal < double; date < timestamp; string above all.  One aggregation counts, for each column,
the values of each kind, so a column gets the narrowest type that all its values have, or all but a given share of them, whatever the
order of the rows and files.  A record with too few or too many fields, or with a value that isn't of its column's type, goes to the
table of bad records with a reason.

A missing value (``sources.NULL``, or empty in a column that isn't text) has any type; a column without values is text; numbers may have
leading zeros and a sign; decimals of over 38 digits are doubles; a date may stand among timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import NULL

#: Kinds of values, and for each type in the order of preference the kinds that it holds.
KINDS = ("boolean", "long", "decimal", "double", "date", "timestamp", "string")
TYPES = {
    "boolean": ("boolean",),
    "bigint": ("long",),
    "decimal": ("long", "decimal"),
    "double": ("long", "decimal", "double"),
    "date": ("date",),
    "timestamp": ("date", "timestamp"),
    "string": KINDS,
}
_RECORD = "__record"
_WHOLE, _POINT = r"^[+-]?[0-9]+$", r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
_FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"


@dataclass
class Read:
    """``rows`` with the types found, ``bad`` (record, reason), and ``types`` by column."""

    rows: DataFrame
    bad: DataFrame
    types: dict[str, str]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _digits(value: Column) -> tuple[Column, Column]:
    """Digits before the point, without leading zeros, and after it."""
    return F.length(F.regexp_extract(value, r"^[+-]?0*([0-9]*)", 1)), F.length(F.regexp_extract(value, r"\.([0-9]*)$", 1))


def _double(value: Column) -> Column:
    return F.regexp_replace(value, "(?i)inf$", "Infinity").try_cast("double")


def kind(value: Column) -> Column:
    """The narrowest kind of a value; null for a missing one."""
    before, after = _digits(value)
    return (
        F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
        .when(value.rlike("^(?i:true|false)$"), "boolean")
        .when(value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(), "long")
        .when(value.rlike(_POINT) & (before + after <= 38), "decimal")
        .when(value.rlike(_FLOAT), "double")
        .when(value.rlike(_DAY) & value.try_cast("date").isNotNull(), "date")
        .when(value.rlike(_TIME) & value.try_cast("timestamp").isNotNull(), "timestamp")
        .otherwise("string")
    )


def _typed(value: Column, type_: str) -> Column:
    if type_ == "string":
        return value
    return _double(value) if type_ == "double" else value.try_cast(type_)


def types_of(rows: DataFrame, columns: Sequence[str], bad_share: float = 0.0) -> dict[str, str]:
    """The type of each column of texts: the first whose kinds hold all values but at most ``bad_share`` of them."""
    counts = []
    for k, c in enumerate(columns):
        value = _column(c)
        before, after = _digits(value)
        counts += [F.count_if(F.col(f"__k{k}") == x).alias(f"{k}_{x}") for x in KINDS]
        counts += [F.coalesce(F.max(F.when(F.col(f"__k{k}").isin("long", "decimal"), x)), F.lit(0)).alias(f"{k}_{n}") for x, n in ((before, "before"), (after, "after"))]
    row = rows.withColumns({f"__k{k}": kind(_column(c)) for k, c in enumerate(columns)}).agg(*counts).first()
    found = {}
    for k, c in enumerate(columns):
        n = {x: row[f"{k}_{x}"] for x in KINDS}
        whole, digits = sum(n.values()), row[f"{k}_before"] + row[f"{k}_after"]
        for type_, kinds in TYPES.items():
            fits = sum(n[x] for x in kinds)
            if type_ == "string" or whole and fits and whole - fits <= bad_share * whole and not (type_ == "decimal" and digits > 38):
                found[c] = f"decimal({max(digits, 1)},{row[f'{k}_after']})" if type_ == "decimal" else type_
                break
    return found


def read_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None, bad_share: float = 0.0, **options: str) -> Read:
    """CSV files with a header, or without one if ``names`` are given; quoted line breaks and doubled quotes as in ``sources.read_csv``."""
    reader = spark.read.options(multiLine="true", escape='"', nullValue=NULL, header=str(names is None).lower(), **options)
    columns = list(names or reader.csv(path).columns)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, _RECORD])
    # all columns are asked for, as records are only counted through whole
    raw = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD, columnPruning="false").csv(path, schema=schema)
    # Spark reads the record's column beside another one only
    raw = raw.filter(F.length(F.coalesce(_column(columns[0]), F.lit(""))) >= 0)
    whole = raw.filter(F.col(_RECORD).isNull())
    types = types_of(whole, columns, bad_share)
    misfits = {}
    for c, type_ in types.items():
        value = _column(c)
        kinds = TYPES["decimal" if type_.startswith("decimal") else type_]
        misfits[c] = F.lit(False) if type_ == "string" else F.coalesce(~kind(value).isin(*kinds), F.lit(False))
    fits = ~F.coalesce(*[F.when(m, True) for m in misfits.values()], F.lit(False))
    rows = whole.filter(fits).select(*[_typed(_column(c), t).alias(c) for c, t in types.items()])
    fields = F.when(F.col(_RECORD).isNotNull(), F.lit("fields"))
    reason = F.coalesce(fields, *[F.when(m, F.lit(f"{c}: not {types[c]}")) for c, m in misfits.items()])
    record = F.coalesce(F.col(_RECORD), F.to_csv(F.struct(*[_column(c) for c in columns])))
    return Read(rows, raw.select(record.alias("record"), reason.alias("reason")).filter(F.col("reason").isNotNull()), types)
