"""Importance resampling toward a target distribution of hashed n-grams (after Xie et al., Data Selection via Importance Resampling, 2023).

A document's features are its runs of 1 to ``runs`` words, each in the bucket of its CRC-32.  A bucket's gain is the scaled log ratio of
its share in the target to its share in the corpus, both smoothed by one; a document's weight is the sum of its features' gains, and
Gumbel noise from the hash of its id turns the best scores into a draw without replacement by weight.

Within a block of texts the n-grams are interned in an open-addressed table of NumPy arrays: XXH64 keys place each occurrence, equal
keys are verified byte by byte, and slots that hold something else are left for the next.  A slot has its n-gram's bucket and count,
so a bucket is worked out once for each distinct n-gram of a block, and occurrences gather gains through the ids of their slots.
The driver sees one number for each bucket.

Defined cases: a null or empty text has no features and weight 0; a null id is written as nothing in the noise and is last in a tie;
rows equal in id and text have one score and ranks that follow each other; a target without features leaves all gains to the
smoothing; texts and words of any length are worked on whole; columns other than id and text are not read, whatever their names; an
empty table gives no rows, and one with fewer eligible documents than a draw of one needs draws none.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.scratch import WIDE, packed, partitions, stored, unpacked, wide_key

BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of text that are interned together.
BLOCK = 2 << 20
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes as a number from each place of ``data``, which has eight more at its end; nothing is copied."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of byte ranges of ``data``, which has eight more bytes at its end."""
    lanes = _lanes(data)
    out = lengths.astype(np.uint64) + _P5
    for k in range(3):  # whole lanes
        on = np.flatnonzero((lengths >= 8 * (k + 1)) & (lengths < 32))
        if len(on):
            out[on] = _rotl(out[on] ^ (_rotl(lanes[starts[on] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
    at, left = starts + lengths // 8 * 8, lengths % 8
    on = np.flatnonzero((left >= 4) & (lengths < 32))
    if len(on):
        half = lanes[at[on]] & np.uint64(0xFFFFFFFF)
        out[on] = _rotl(out[on] ^ (half * _P1), 23) * _P2 + _P3
    at, left = at + (left >= 4) * 4, left % 4
    for k in range(3):
        on = np.flatnonzero((left > k) & (lengths < 32))
        if len(on):
            out[on] = _rotl(out[on] ^ (data[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        view = memoryview(data)
        out[long] = [xxhash.xxh64_intdigest(view[s : s + n]) for s, n in zip(starts[long].tolist(), lengths[long].tolist())]
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``lengths`` bytes from ``a`` and from ``b`` agree in every byte."""
    lanes, same, on, done = _lanes(data), np.ones(len(a), bool), np.flatnonzero(a != b), 0
    while len(on) and done < 64:
        left = np.minimum(lengths[on] - done, 8).astype(np.uint64)
        apart = ((lanes[a[on] + done] ^ lanes[b[on] + done]) << (np.uint64(8) * (np.uint64(8) - left))) != 0
        same[on[apart]] = False
        done += 8
        on = on[~apart & (lengths[on] > done)]
    for k in on.tolist():
        n = int(lengths[k])
        same[k] = np.array_equal(data[a[k] : a[k] + n], data[b[k] : b[k] + n])
    return same


@dataclass
class Table:
    """Interned n-grams: by slot the occurrence that stands for it (-1: free), its bucket and its count; by occurrence its slot."""

    owner: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def interned(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int) -> Table:
    n = len(starts)
    size = 1 << max(4, (2 * n - 1).bit_length())
    keys = xxh64(data, starts, lengths)
    slot, owner, waiting = (keys & np.uint64(size - 1)).astype(np.int64), np.full(size, -1, np.int64), np.arange(n)
    while len(waiting):
        # equal n-grams try the same slots in the same rounds, so the first of them to find a free one holds it for all
        at = slot[waiting]
        free = owner[at] < 0
        owner[at[free][::-1]] = waiting[free][::-1]
        holder = owner[at]
        met = (keys[holder] == keys[waiting]) & (lengths[holder] == lengths[waiting])
        alike = np.flatnonzero(met)
        met[alike] = _same(data, starts[holder[alike]], starts[waiting[alike]], lengths[waiting[alike]])
        waiting = waiting[~met]
        slot[waiting] = (slot[waiting] + 1) & (size - 1)
    held, view = np.flatnonzero(owner >= 0), memoryview(data)
    bucket = np.zeros(size, np.int64)
    bucket[held] = [zlib.crc32(view[s : s + k]) % buckets for s, k in zip(starts[owner[held]].tolist(), lengths[owner[held]].tolist())]
    return Table(owner, bucket, np.bincount(slot, minlength=size), slot)


def _features(texts: pa.Array, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and length of each n-gram in them, the text of each, the number of words of each text)."""
    words = blocks.split(texts, blocks.ALNUM, blocks.LOWER)
    lengths, per_text = np.diff(words.offsets), np.diff(words.first)
    data = np.full(len(words.data) + len(lengths) + 8, 32, np.uint8)
    data[np.arange(len(words.data)) + np.repeat(np.arange(len(lengths)), lengths)] = words.data
    starts = words.offsets[:-1] + np.arange(len(lengths))
    owner, last = words.text_of_word(), np.repeat(words.first[1:], per_text)
    found = []
    for run in range(1, runs + 1):
        first = np.flatnonzero(np.arange(len(lengths)) + run <= last)
        found.append((starts[first], starts[first + run - 1] + lengths[first + run - 1] - starts[first], owner[first]))
    return data, *(np.concatenate(x) for x in zip(*found)), per_text


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any; a task sends each of its buckets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in blocks.slices(batches, "text", BLOCK):
            data, starts, lengths, _, _ = _features(batch.column(0), runs)
            table = interned(data, starts, lengths, buckets)
            np.add.at(sums, table.bucket[table.owner >= 0], table.count[table.owner >= 0])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the ``bucket_counts`` of corpus and target."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, side in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():  # at most ``buckets`` rows
            side[bucket] = n
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def noise(id: object, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score) of each row."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", BLOCK):
            data, starts, lengths, owner, n_words = _features(batch.column(2), runs)
            table = interned(data, starts, lengths, buckets)
            of_slot = held.value[table.bucket]
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, owner, of_slot[table.slot])
            extra = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            columns = [n_words, np.bincount(owner, minlength=batch.num_rows), weight, weight + extra]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.astype(np.int64)) for x in columns]], names=["doc_id", "key", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), wide_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, key {WIDE}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with ``rank``: 1, 2, ... of the ``percent`` highest scores among rows of enough words, null for the others.

    Ranges of the order are numbered side by side, each from where those before it end.
    """
    rows = stored(scored.withColumn("eligible", F.col("n_words") >= least_words), "scores")
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("key")]
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    held = stored(sorted_.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    # a row for each range, of which there are as many as shuffle partitions
    counts = held.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("e"))
    earlier, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = counts.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.floor(F.sum("e").over(every) * percent / 100).alias("drawn"))
    place = F.col("start") + F.col("at") + 1
    return held.join(F.broadcast(starts), "range").withColumn("rank", F.when(F.col("eligible") & (place <= F.col("drawn")), place))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn; a row equal to a drawn one in id and text is drawn with it."""
    gain = gains(bucket_counts(docs, runs=runs, buckets=buckets), bucket_counts(target, runs=runs, buckets=buckets), buckets)
    drawn = ranked(scores(docs, gain, runs, seed), percent, least_words).filter(F.col("rank").isNotNull()).select("key")
    return unpacked(packed(docs).join(drawn, "key", "left_semi"), docs.columns)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of each document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return ranked(scores(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
