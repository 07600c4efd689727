"""Shards along a Hilbert curve over several metadata columns, in DataFrame operations only.

Each dimension is quantised at its own quantiles, the cells of all dimensions give a place on a Hilbert curve, and the rows in the
curve's order are cut into runs: one run is one shard and one file.  Neighbours on the curve are alike in every dimension, so the
least and largest value of each dimension in a file leave most files out whichever dimension a reader filters by.

The runs follow one law: ``bytes`` (sizes near equal: a run ends where the running size is nearest to its share, so no shard is off
by more than the largest document) or ``rows`` (counts at most one apart).  Only ids, checksums and sizes are put in order; the first
key of each run then tells the shard of a whole row, so whole rows are exchanged once.

Defined cases: a null text has no bytes; a null of a dimension counts as its smallest value and NaN as null; equal places on the
curve go by id (null first), then by checksum of the text; rows equal in id and text stay together in one shard, whose law counts
them as they come; texts of any length stay whole; fewer rows than shards leave shards empty; columns are kept in one struct ``row``,
so that no name of theirs meets ``shard``, ``slot`` or ``curve``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from millrace.llm.scratch import new_path, partitions, stored

DIMENSIONS = ("lang", "source", "n_chars")
#: Bits of a dimension's cell, the accuracy of its quantiles, and the bytes of a string that follow what all its values begin with.
BITS, ACCURACY, HEAD = 6, 10_000, 7


def _rotated(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_steps(n: int) -> list[int]:
    """For each state of the curve in ``n`` dimensions and each corner that comes next: next state * 2^n + the corner's place.

    A state is the corner that a cell is entered by and the axis of its last step (Hamilton, Compact Hilbert Indices, 2006).
    """
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    place = {g: w for w, g in enumerate(gray)}
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  set bits at the low end
    entry = [gray[(w - 1) // 2 * 2] if w else 0 for w in range(1 << n)]
    axis = [0 if not w else ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    steps = []
    for state in range(n << n):
        e, d = divmod(state, n)
        for corner in range(1 << n):
            w = place[_rotated(corner ^ e, n - (d + 1) % n, n)]
            after = (e ^ _rotated(entry[w], d + 1, n)) * n + (d + axis[w] + 1) % n
            steps.append(after << n | w)
    return steps


def hilbert(cells: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point whose coordinates are integers of ``bits`` bits."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the curve's index must fit 62 bits")
    corners = []
    for level in range(bits - 1, -1, -1):
        bit = lambda c: F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1))  # noqa: B023, E731
        corner = bit(cells[0])
        for k, c in enumerate(cells[1:], 1):
            corner = corner + bit(c) * (1 << k)
        corners.append(corner)
    steps = F.array(*[F.lit(x) for x in curve_steps(n)])
    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("state"))

    def step(at: Column, corner: Column) -> Column:
        x = F.get(steps, at["state"] * (1 << n) + corner)
        return F.struct((at["place"] * (1 << n) + x.bitwiseAND(F.lit((1 << n) - 1))).alias("place"), F.shiftright(x, n).alias("state"))

    return F.aggregate(F.array(*corners), start, step, lambda at: at["place"])


def _before(values: Column, most: int, smaller) -> Column:
    """How many of the sorted ``values`` (at most ``most``) are ``smaller``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(smaller(F.get(values, at + s - 1)), at + s).otherwise(at))


def _numbers(docs: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """Each dimension as a number in its order; of strings, the bytes after those that the smallest and the largest value share."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    texts = [d for d in dimensions if not isinstance(kinds[d], (NumericType, BooleanType, DateType, TimestampType))]
    text = {d: F.col(f"`{d}`").cast("string").cast("binary") for d in texts}
    ends = docs.agg(*[f(text[d]).alias(f"{k}{n}") for k, d in enumerate(texts) for n, f in (("least", F.min), ("most", F.max))]).first() if texts else None
    out = []
    for d in dimensions:
        column = F.col(f"`{d}`")
        if d in texts:
            a, b = (bytes(ends[f"{texts.index(d)}{n}"] or b"") for n in ("least", "most"))
            shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            out.append(F.conv(F.rpad(F.hex(F.substring(text[d], shared + 1, HEAD)), 2 * HEAD, "0"), 16, 10).cast("double"))
        else:
            number = (column.cast("timestamp") if isinstance(kinds[d], DateType) else column).cast("double")
            out.append(F.nanvl(number, F.lit(None).cast("double")))
    return out


def places(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> Column:
    """The place of a row of ``docs`` on the curve.  Reads the dimensions, and no text, for their ends and quantiles."""
    numbers = _numbers(docs, dimensions)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(x, shares, ACCURACY).alias(f"q{k}") for k, x in enumerate(numbers)]).first()
    cells = []
    for k, x in enumerate(numbers):
        own = F.array(*[F.lit(float(q)) for q in cuts[k] or [0.0]])
        cells.append(F.coalesce(_before(own, len(cuts[k] or [0.0]), lambda cut, x=x: cut < x), F.lit(0)))
    return hilbert(cells, bits)


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def cuts(keyed: DataFrame, shards: int, law: str) -> DataFrame:
    """One row: the first key of each shard that gets any, and its number, from (key, size) of all rows."""
    # ranges of keys are numbered side by side, each from where those before it end
    ranged = keyed.repartitionByRange(partitions(keyed.sparkSession), "key").withColumn("range", F.spark_partition_id())
    running = Window.partitionBy("range").orderBy("key")
    upto = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = stored(ranged.select("key", "size", "range", (F.sum("size").over(upto) - F.col("size")).alias("bytes"), (F.row_number().over(running) - 1).alias("rows")), "placed")
    # a row for each range, of which there are as many as shuffle partitions
    sums = held.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    earlier, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = sums.select("range", *[x for c in ("b", "n") for x in (F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start"), F.sum(c).over(every).alias(f"{c}_all"))])
    placed = held.join(F.broadcast(starts), "range")
    if law == "bytes":
        shard = F.floor(shards * (F.col("b_start") + F.col("bytes") + F.col("size") / 2) / F.col("b_all"))
    elif law == "rows":
        shard = F.floor((F.col("n_start") + F.col("rows")) * shards / F.col("n_all"))
    else:
        raise ValueError(f"no law {law}")
    first = placed.groupBy(F.least(shard, F.lit(shards - 1)).cast("int").alias("shard")).agg(F.min("key").alias("key"))
    # a key on both sides of a cut belongs to the first shard that has it
    return first.groupBy("key").agg(F.min("shard").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("key", "shard"))).alias("cuts"))


def write(docs: DataFrame, path: str, shards: int = 16, law: str = "bytes", dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes (slot, curve, row) as one Parquet file for each shard, in the curve's order, and returns the files with column ``shard``.

    ``slot`` numbers the rows of a shard from 0; ``row`` has the columns of ``docs``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = F.col(f"`{text}`").cast("string")
    key = F.struct(places(docs, dimensions, bits).alias("curve"), F.col(f"`{id}`").alias("id"), _crc(own).alias("crc")).alias("key")
    table = cuts(stored(docs.select(key, _size(own).alias("size")), "keys"), shards, law)
    # one row of as many keys as there are shards
    rows = docs.select(whole, key).join(F.broadcast(table))
    at = _before(F.col("cuts"), shards, lambda cut: cut["key"] <= F.col("key"))
    dealt = rows.select("row", "key", F.get(F.col("cuts"), at - 1)["shard"].alias("shard")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key")
    # a partition is a shard, so the row's number in its partition is its slot
    slot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.select(slot.alias("slot"), F.col("key.curve").alias("curve"), "row", "shard")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def manifest(files: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(shard, n, ends) of the shards with rows; ``ends`` has ``least``, ``most`` and the number of nulls of each dimension."""
    own = lambda x: F.struct(F.min(x).alias("least"), F.max(x).alias("most"), F.count_if(x.isNull()).alias("nulls"))
    return files.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.struct(*[own(F.col("row")[d]).alias(d) for d in dimensions]).alias("ends"))


def touched(found: DataFrame, wanted: Mapping[str, tuple[object, object]]) -> DataFrame:
    """(shard, n) of the shards that can hold a row whose dimensions lie between the two values, ends included, given for some of them."""
    for d, (low, high) in wanted.items():
        found = found.filter((F.col("ends")[d]["least"] <= F.lit(high)) & (F.col("ends")[d]["most"] >= F.lit(low)))
    return found.select("shard", "n")


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of each document, read from the shards' files."""
    files = write(docs, new_path(docs.sparkSession, "shards"), shards, "bytes")
    text = F.col("row.text").cast("string")
    return files.select(F.col("row.doc_id").alias("doc_id"), _size(text).alias("size"), _crc(text).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
