"""Reading and writing tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: How a null stands in CSV files.
NULL = "\\N"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> None:
    """Temporary views of the tables of a folder, for ``spark.sql``."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the folder of ``spark.checkpoint.dir``; on one machine without it, in a new temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A server's table in ``parts`` ranges of an integer key, read side by side; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def read_jdbc_by_range(spark: SparkSession, url: str, name: str, key: str, parts: int, **options: str) -> DataFrame:
    """``read_jdbc`` in ranges between the key's least and largest value, which the server is asked for first."""
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT min({quoted}) AS low, max({quoted}) AS high FROM {name}", **options).load().first()
    low, high = (0, 0) if ends[0] is None else ends
    # of one value all ranges but one would be empty, and the upper bound must be the larger
    return read_jdbc(spark, url, name, key, int(low), int(high) + 1, max(1, min(parts, int(high) - int(low) + 1)), **options)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; the schema is given, so nothing is read to guess it."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', nullValue=NULL)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as a folder of part files; nulls are written as NULL, so that they differ from empty strings."""
    df.write.csv(path, header=True, escape='"', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def union_with_flag(parts: dict[object, DataFrame], flag: str, **fill: object) -> DataFrame:
    """All rows of all parts with a column that names the part; a part without a column has nulls or ``fill`` in it."""
    out = None
    for value, part in parts.items():
        part = part.withColumns({k: F.lit(v) for k, v in fill.items() if k not in part.columns} | {flag: F.lit(value)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
