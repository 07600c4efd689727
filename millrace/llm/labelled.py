"""Samples of labelled documents of bounded size, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of an id's text modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label int): documents with a label, ``most`` of them or nearly so, chosen by a hash of the id.

    A document with several labels takes the largest, and of several documents with one id the one whose text has the least
    hash counts, so an id on very many rows is one row here.  Null ids and labels are left out.
    """
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = most / max(given.count(), 1)
    if share < 1:
        given = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    # about ``most`` pairs of two numbers, so this side may be sent to every executor
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(given), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")).select("doc_id", F.col("x.text").alias("text"), "label")
