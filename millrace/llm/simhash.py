"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint of ``BITS`` bits is cut into so few segments that two fingerprints within ``distance`` bits agree up to one
bit in at least one segment.  Each segment is indexed once for every bit, with that bit left out (a one-wildcard
variant); two segments that differ by at most one bit share such a variant, so an equality join on (segment, wildcard,
rest) brings all links together.  Every candidate is verified with the whole fingerprints.

Only distinct fingerprints are indexed, so a group of copies costs one row however large it is, and of a bucket only the
edges of a spanning forest leave the task.  Documents get their component through their fingerprint.

Fingerprints alone say little about how much two texts share.  With a ``similarity`` given, links are between distinct texts
instead: those within ``distance`` bits whose sets of shingles have at least that Jaccard similarity, by the 64-bit hashes of
all their shingles.  Sets of candidates stand in files of the shared folder, which workers map into memory.

Defined cases: null and empty texts have fingerprint zero, which links like any other; null ids stay and never become a
component's name unless all ids of the component are null; equal rows are separate documents of one component; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks, shared
from millrace.llm.graph import components
from millrace.llm.scratch import WIDE, new_path, packed, partitions, stored, unpacked, wide_key

BITS = 64
#: Buckets up to this size are compared in one matrix, larger ones by pieces of the rest of the fingerprint first.
MATRIX = 512
#: Buckets over this are cut by pieces before they are compared, and dealt anew.
LARGE = 20_000
#: Candidates (two numbers each) that are sent to every executor at most.
SENT = 500_000


def _normalized(words: blocks.Words) -> bytes:
    """The words with one space after each."""
    sizes = np.diff(words.offsets)
    out = np.full(len(words.data) + len(words), 32, np.uint8)
    out[np.arange(len(words.data)) + np.repeat(np.arange(len(words)), sizes)] = words.data
    return out.tobytes()


def _hashed(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(XXH64 with seed 42 of all shingles by text, the number of each text's, XXH64 of each text's normalized words)."""
    words = blocks.split(texts, blocks.NON_SPACE, blocks.LOWER)
    text, n = _normalized(words), np.diff(words.first)
    starts = words.offsets[:-1] + np.arange(len(words))
    ends = words.offsets[1:] + np.arange(len(words))
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    which = blocks.ragged(words.first[:-1], count)
    last = np.minimum(which + shingle, np.repeat(words.first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], 42) for s, e in zip(starts[which].tolist(), ends[last].tolist())), np.uint64, len(which))
    edges = np.append(starts, len(text))[words.first].tolist()
    return hashes, count, np.array([digest(text[s:e], 42) for s, e in zip(edges[:-1], edges[1:])], np.uint64)


def _sets(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct hashes of each text, sorted within it, the number of each text's)."""
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(count))


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of each text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    hashes, n, _ = _hashed(texts, shingle)
    return _voted(hashes, n)


def _voted(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    n = count
    sums = np.zeros((len(n), BITS), np.int64)
    at = 0
    while at < len(n):  # about a million shingles at once
        to = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), 1_000_000, side="right")) + at)
        first = int(count[:at].sum())
        part = np.unpackbits(hashes[first : first + int(count[at:to].sum())].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(count[at:to])
        if len(full):
            sums[at + full] = np.add.reduceat(part, (np.cumsum(count[at:to]) - count[at:to])[full], axis=0, dtype=np.int32)
        at = to
    set_bits = (2 * sums > count[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fingerprint as a signed long) of each row; key is the hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            prints = fingerprints_of(batch.column(2), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "key", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), wide_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, key {WIDE}, fingerprint long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width): one of n segments has at most one of up to 2n - 1 differing bits."""
    n = distance // 2 + 1
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, distance: int, *others: str) -> DataFrame:
    """(segment, wildcard, rest, fingerprint, others) of each distinct fingerprint: ``rest`` is the segment with the wildcard bit cleared."""
    kinds = [F.struct(F.lit(k).alias("segment"), F.lit(bit).alias("wildcard"), F.col("fingerprint").bitwiseAND(F.lit(((((1 << width) - 1) << low) & ~(1 << (low + bit))) - (1 << 64 if low + width == 64 and bit != width - 1 else 0))).alias("rest")) for k, (low, width) in enumerate(segments(distance)) for bit in range(width)]
    return prints.select(F.explode(F.array(*kinds)).alias("v"), "fingerprint", *others).select("v.*", "fingerprint", *others)


def _forest(prints: np.ndarray, distance: int, rest: list[tuple[int, int]]) -> np.ndarray:
    """(n, 2) edges that connect what links within ``distance`` connect among these fingerprints, a row for all but one of a group."""
    label = np.arange(len(prints))

    def join(members: np.ndarray) -> None:
        for at in range(0, len(members), MATRIX):
            rows = members[at : at + MATRIX]
            for to in range(at, len(members), MATRIX):
                columns = members[to : to + MATRIX]
                i, j = np.nonzero(np.bitwise_count(prints[rows][:, None] ^ prints[columns][None, :]) <= distance)
                i, j = rows[i], columns[j]
                while len(i):
                    a, b = label[i], label[j]
                    apart = a != b
                    if not apart.any():
                        break
                    np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                    while (label[label] != label).any():
                        label[:] = label[label]

    if len(prints) <= MATRIX:
        join(np.arange(len(prints)))
    else:  # within ``distance``, one of distance + 1 pieces of the bits outside the bucket's segment agrees wholly
        for low, width in rest:
            piece = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
            order = np.argsort(piece, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                if len(members) > 1:
                    join(members)
    other = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([prints[label[other]], prints[other]], axis=1)


def _pieces(distance: int, segment: int) -> list[tuple[int, int]]:
    bits = [b for k, (low, width) in enumerate(segments(distance)) if k != segment for b in [(low, width)]]
    out, n = [], distance + 1
    if not bits:  # one segment holds all bits: its buckets have two fingerprints at most
        return out
    share = [max(1, round(n * width / sum(w for _, w in bits))) for _, width in bits]
    while sum(share) < n:
        share[0] += 1
    for (low, width), k in zip(bits, share):
        cuts = [round(width * j / k) for j in range(k + 1)]
        out += [(low + a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
    return out


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): edges whose components are those of all links between distinct fingerprints (column ``fingerprint``).

    A bucket of more than ``LARGE`` fingerprints isn't compared where it is found: its rows are dealt anew by pieces of the
    bits outside the bucket's segment, one of which agrees wholly in every link.  A bucket and a piece together fix so many bits that
    few distinct fingerprints are left: at a distance of two all but 23 bits, so a task holds 2^23 of them, or 64 MB, at the very most.
    """
    n = partitions(prints.sparkSession)
    pieces = [_pieces(distance, k) for k in range(len(segments(distance)))]
    # few fingerprints stand on few partitions, and each becomes 64 rows; by the column itself no exchange would be made
    keyed = variants(prints.repartition(n, F.xxhash64("fingerprint")), distance)
    first = stored(_compared(keyed, n, ["segment", "wildcard", "rest"], distance, LARGE), "links")
    if not any(pieces):  # one segment holds all bits, so no bucket is large
        return first.select("a", "b")
    large = first.filter(F.col("segment").isNotNull()).select("segment", "wildcard", "rest", F.col("a").alias("fingerprint"))
    bits = lambda low, width: F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << width) - 1))
    cut = None
    for k, own in enumerate(pieces):
        listed = F.array(*[F.struct(F.lit(j).alias("piece"), bits(low, width).alias("bits")) for j, (low, width) in enumerate(own)])
        cut = F.when(F.col("segment") == k, listed) if cut is None else cut.when(F.col("segment") == k, listed)
    dealt = large.select("segment", "wildcard", "rest", F.explode(cut).alias("p"), "fingerprint").select("segment", "wildcard", "rest", "p.piece", "p.bits", "fingerprint")
    again = _compared(dealt, n, ["segment", "wildcard", "rest", "piece", "bits"], distance, None)
    return first.filter(F.col("segment").isNull()).select("a", "b").unionByName(again.select("a", "b"))


def _compared(keyed: DataFrame, n: int, keys: list[str], distance: int, large: int | None) -> DataFrame:
    """(a, b, segment, wildcard, rest): edges of each bucket with nulls after them; of buckets over ``large`` all rows, with nulls for b."""
    pieces = [_pieces(distance, k) for k in range(len(segments(distance)))]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("segment", pa.int32()), ("wildcard", pa.int32()), ("rest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, passing = [], 0, False  # of the last bucket: its rows so far, or that they are passed on

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, passing
            if size > 1 and not passing:
                yield found(np.concatenate(held, axis=1), np.zeros(0, np.int64))
            held, size, passing = [], 0, False

        last = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            change = np.flatnonzero((rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)) + 1
            if last is not None and (rows[:-1, 0] != last).any():
                yield from ended()
            last = rows[:-1, -1]
            if len(change):  # the first bucket ends here, those between are whole, the last one may go on
                head, middle, rows = rows[:, : change[0]], rows[:, change[0] : change[-1]], rows[:, change[-1] :]
                if passing:
                    yield passed(head)
                else:
                    held.append(head)
                    size += head.shape[1]
                    if large and size > large:
                        yield passed(np.concatenate(held, axis=1))
                        passing = True
                yield from ended()
                if middle.shape[1]:
                    at = change[:-1] - change[0]
                    yield from whole(middle, at[at > 0])
            if passing:
                yield passed(rows)
                continue
            held.append(rows)
            size += rows.shape[1]
            if large and size > large:
                yield passed(np.concatenate(held, axis=1))
                held, passing = [], True
        yield from ended()

    def whole(rows: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        if large:
            first = np.concatenate([[0], change])
            sizes = np.diff(np.append(first, rows.shape[1]))
            for f, k in zip(first[sizes > large].tolist(), sizes[sizes > large].tolist()):
                yield passed(rows[:, f : f + k])
            if (sizes > large).any():
                keep = np.repeat(sizes <= large, sizes)
                rows = rows[:, keep]
                change = np.cumsum(sizes[sizes <= large])[:-1]
        if rows.shape[1]:
            yield found(rows, change)

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        segment, wildcard, rest = rows[:3]
        return pa.RecordBatch.from_arrays([pa.array(rows[-1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(segment.astype(np.int32)), pa.array(wildcard.astype(np.int32)), pa.array(rest)], schema=schema)

    def found(rows: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[0], change])
        size = np.diff(np.append(first, rows.shape[1]))
        prints = rows[-1].astype(np.int64).view(np.uint64)
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
        edges = [np.stack([prints[two], prints[two + 1]], axis=1)]
        edges += [_forest(prints[f : f + n], distance, pieces[rows[0, f]]) for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist())]
        both = np.unique(np.concatenate(edges), axis=0).view(np.int64)
        nulls = [pa.nulls(len(both), t) for t in (pa.int32(), pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *nulls], schema=schema)

    return keyed.repartition(n, *keys).sortWithinPartitions(*keys, "fingerprint").mapInArrow(run, "a long, b long, segment int, wildcard int, rest long")


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, node, fingerprint, size) of each row; node is the hash of the text's words, size the number of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            hashes, count, node = _hashed(batch.column(2), shingle)
            new = [pa.array(x) for x in (node.view(np.int64), _voted(hashes, count).view(np.int64), _sets(hashes, count)[1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "key", "node", "fingerprint", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), wide_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, key {WIDE}, node long, fingerprint long, size long")


def _bucketed(rows: DataFrame, distance: int, of_bucket, schema: str) -> DataFrame:
    """of_bucket(segment, wildcard, the bucket's rows by size) of each bucket of ``rows`` (columns fingerprint, size, any others)."""
    n = partitions(rows.sparkSession)
    kinds = variants(rows.repartition(n, F.xxhash64("fingerprint")), distance, *[c for c in rows.columns if c != "fingerprint"])
    keys = ["segment", "wildcard", "rest"]
    dealt = kinds.repartition(n, *keys).sortWithinPartitions(*keys, "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last bucket, which may go on in the next batch

        def ended() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from of_bucket(table.column("segment")[0].as_py(), table.column("wildcard")[0].as_py(), table)
            held.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys])
            if last is not None and (k[:, 0] != last).any():
                yield from ended()
            last = k[:, -1]
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
                held.append(batch.slice(a, b - a))
                yield from ended()
            held.append(batch.slice(int(cuts[-1])) if len(cuts) else batch)
        yield from ended()
        batch = k = None
        shared.forget()
        blocks.give_back()

    return dealt.mapInArrow(run, schema)


def _beside_another(prints: np.ndarray, sizes: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """Which fingerprints, by size, have another within ``distance`` whose size allows the similarity."""
    found = np.zeros(len(prints), bool)
    for at in range(0, len(prints), MATRIX):
        rows = slice(at, min(at + MATRIX, len(prints)))
        most = int(np.searchsorted(sizes, sizes[rows.stop - 1] / similarity + 1e-6, side="right"))
        for to in range(at, most, MATRIX):
            columns = slice(to, min(to + MATRIX, most))
            if found[rows].all() and found[columns].all():
                continue
            near = np.bitwise_count(prints[rows][:, None] ^ prints[columns][None, :]) <= distance
            if at == to:
                np.fill_diagonal(near, False)
            found[rows] |= near.any(axis=1)
            found[columns] |= near.any(axis=0)
    return found


def _similar_forest(prints: np.ndarray, sizes: np.ndarray, set_of, segment: int, wildcard: int, distance: int, similarity: float) -> list[tuple[int, int]]:
    """Edges (places in the bucket, by size) that connect what verified links connect.

    A pair is looked at in one bucket alone: that of the first segment with one differing bit at most, and of that bit.
    """
    label, out = np.arange(len(prints)), []
    cuts = [(np.uint64(low), np.uint64((1 << width) - 1)) for low, width in segments(distance)]
    most = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
    for i in range(len(prints) - 1):
        x = prints[i] ^ prints[i + 1 : most[i]]
        ok = (np.bitwise_count(x) <= distance) & (label[i + 1 : most[i]] != label[i])
        j = np.flatnonzero(ok)
        if not len(j):
            continue
        x = x[j]
        ok = np.ones(len(j), bool)
        for low, mask in cuts[:segment]:
            ok &= np.bitwise_count((x >> low) & mask) > 1
        if wildcard:
            ok &= (x >> cuts[segment][0]) & cuts[segment][1] != 0
        j = j[ok] + i + 1
        while len(j):
            a, b = set_of(i), set_of(int(j[0]))
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                out.append((i, int(j[0])))
                label[label == label[j[0]]] = label[i]
                j = j[label[j] != label[i]]
            else:
                j = j[1:]
    return out


def similar(nodes: DataFrame, docs: DataFrame, shingle: int, distance: int, similarity: float) -> DataFrame:
    """(a, b): edges whose components are those of all links between the texts of ``docs``, from their ``_nodes``."""
    spark = docs.sparkSession
    texts = nodes.groupBy("node", "fingerprint", "size").agg(F.min("key").alias("key"))
    prints = texts.groupBy("fingerprint", "size").agg(F.count(F.lit(1)).alias("n"))

    def beside(segment: int, wildcard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints, sizes = rows.column("fingerprint").to_numpy(), rows.column("size").to_numpy()
        found = _beside_another(prints.view(np.uint64), sizes, distance, similarity)
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(prints[found]), pa.array(sizes[found])], names=["fingerprint", "size"])

    several = prints.filter("n > 1").select("fingerprint", "size")
    near = _bucketed(prints.select("fingerprint", "size"), distance, beside, "fingerprint long, size long").unionByName(several).distinct()
    chosen = stored(texts.join(near, ["fingerprint", "size"], "left_semi"), "candidates")
    folder = new_path(spark, "shingles")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 << 20):
            hashes, count, _ = _hashed(batch.column(1), shingle)
            hashes, count = _sets(hashes, count)
            name = uuid.uuid4().hex
            shared.put(f"{folder}/{name}", hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(count), pa.string()), pa.array(np.cumsum(count) - count)], names=["node", "file", "start"])

    keys = chosen.select("key", "node")
    rows = docs.select(wide_key().alias("key"), F.col("text").cast("string").alias("text")).join(F.broadcast(keys) if keys.count() <= SENT else keys, "key").select("node", "text")
    places = stored(rows.mapInArrow(written, "node long, file string, start long"), "places").groupBy("node").agg(F.first(F.struct("file", "start")).alias("place"))
    placed = chosen.join(places, "node").select("fingerprint", "size", "node", "place.file", "place.start")

    def linked(segment: int, wildcard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints, sizes, node, start = (rows.column(c).to_numpy() for c in ("fingerprint", "size", "node", "start"))
        file = rows.column("file")
        set_of = lambda i: shared.mapped(f"{folder}/{file[i].as_py()}", "<u8")[start[i] : start[i] + sizes[i]]
        edges = _similar_forest(prints.view(np.uint64), sizes, set_of, segment, wildcard, distance, similarity)
        if edges:
            i, j = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return _bucketed(placed, distance, linked, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, key, fingerprint) of each row, (fingerprint, component, component_id) of each distinct fingerprint)."""
    every = stored(fingerprints(docs, shingle), "prints")
    prints = every.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    labels = components(links(prints.select("fingerprint"), distance))
    named = prints.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return every, named.join(least, "component").select("fingerprint", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    every, by_print = _grouped(docs, shingle, distance)
    return every.join(by_print, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, then of the smallest hash; null ids last.

    With ``similarity``, components are those of verified links between texts, else of links between fingerprints.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    if similarity is None:
        every, by_name = _grouped(docs, shingle, distance)
        name = "fingerprint"
    else:
        every = stored(_nodes(docs, shingle), "nodes")
        labels = components(similar(every, docs, shingle, distance, similarity))
        name = "node"
        by_name = every.select(name).distinct().join(labels, name, "left").withColumn("component", F.coalesce("component", name))
    # first within each fingerprint or text, so that a group of copies is one row in the join
    first = every.groupBy(name).agg(least)
    stay = first.join(by_name, name).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    return unpacked(packed(docs).join(stay, "key", "left_semi").dropDuplicates(["key"]), docs.columns)
