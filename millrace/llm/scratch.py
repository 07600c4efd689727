"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and one machine is all there is, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            folder = context.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="spark-millrace-")
            spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables and files of this process; results that are still to be computed from them are lost."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of ``df`` from a table written now: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit hash of id and text: never null, evenly spread, equal for equal rows."""
    return F.xxhash64(F.col(id).cast("string"), F.lit(0), F.col(text))


#: The type of ``wide_key``.
WIDE = "struct<a: bigint, b: bigint>"


def wide_key(id: str = "doc_id", text: str = "text") -> Column:
    """``row_key`` and a second hash, 128 bits in all: of any number of rows that are likely to be met, no two that differ share it."""
    return F.struct(row_key(id, text).alias("a"), F.xxhash64(F.col(text), F.lit(1), F.col(id).cast("string")).alias("b"))


def packed(docs: DataFrame) -> DataFrame:
    """(row, key): whole rows as one struct, so that no name of theirs meets a name that an operator uses, and their ``wide_key``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), wide_key().alias("key"))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of packed rows again, those in ``new`` replaced."""
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
