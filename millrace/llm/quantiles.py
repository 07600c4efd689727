"""Exact quantiles of numeric columns over tables of any size.

Each pass counts the rows of an interval in ``BUCKETS`` equal parts and goes on in the part that holds the wanted rank, between that
part's own least and largest value, until these are equal.  Every row is counted; the driver sees one row for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
_FOUND = pa.schema([("interval", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _parts(df: DataFrame, intervals: list[tuple[str, float, float]]) -> dict[int, list]:
    """Of each (column, lowest, highest) its parts with rows, in order: how many, least and largest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (name, low, high) in enumerate(intervals):
                v = batch.column(name).to_numpy(zero_copy_only=False)
                v = np.sort(v[(v >= low) & (v <= high)])
                # the place in the interval grows with the value, so parts are runs of the sorted values
                bucket = np.minimum((v - low) / (high - low) * BUCKETS, BUCKETS - 1).astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(v) else np.zeros(0, np.int64)
                end = np.append(first[1:], len(v)) if len(v) else first
                out.append((np.full(len(first), k, np.int32), bucket[first], end - first, v[first], v[end - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    counted = df.mapInArrow(run, "interval int, bucket int, n long, low double, high double").groupBy("interval", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict[int, list] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["interval"], r["bucket"])):
        found.setdefault(r["interval"], []).append((r["n"], r["low"], r["high"]))
    return found


def quantiles(df: DataFrame, shares: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles at ``shares`` of every column of ``df`` (finite doubles, no nulls), between two values in proportion; none of a table without rows."""
    names = df.columns
    ends = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("low", F.min), ("high", F.max))]).first()
    n = ends["n"]
    if not n:
        return {c: [] for c in names}
    # a rank that misses a whole number by rounding alone is that number
    places = [round(p) if abs(p - round(p)) < 1e-6 else p for p in (share * (n - 1) for share in shares)]
    # of each wanted (column, rank): the interval that holds it and how many values come before
    at = {(c, rank): (ends[f"low_{i}"], ends[f"high_{i}"], 0) for i, c in enumerate(names) for p in places for rank in (math.floor(p), math.ceil(p))}
    while wide := sorted({(c, low, high) for (c, _), (low, high, _) in at.items() if low < high}):
        found = _parts(df, wide)
        for (c, rank), (low, high, before) in at.items():
            if low < high:
                for count, *own in found[wide.index((c, low, high))]:
                    if rank < before + count:
                        break
                    before += count
                at[c, rank] = (*own, before)
    between = lambda c, p: at[c, math.floor(p)][0] + (p - math.floor(p)) * (at[c, math.ceil(p)][0] - at[c, math.floor(p)][0])
    return {c: [between(c, p) for p in places] for c in names}
