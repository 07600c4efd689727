"""Byte-level BPE encoding and decoding by replaying merges over the vocabulary of a whole corpus.

Texts are cut into units at white space, of which the corpus has far fewer distinct ones than occurrences.  ``vocabulary``
groups the units of all documents with Spark; those of two blocks of text or more are cut into pieces by a pattern, in shards
of bounded size, and the distinct pieces of a shard form one array of linked symbols.  An inverted index from pair (by the rank
of what the pair makes) to positions drives the replay: merges are applied in rank order, each at all its positions in all
pieces at once, and only the pairs next to a merge are looked up anew and added to the index.  A piece that is a token as a
whole is that token, as in tiktoken.  Shards write sorted hashes of their units with their ids, which workers map into memory.

Texts then take the ids of their units.  A unit found by its hash counts only if its ids stand for its very bytes; other units
(those of one block only, above all) are replayed with the block that they stand in.  So what is in the vocabulary decides on
the work but never on the result, and each unit is replayed once for the corpus, or where it stands alone.

Defined cases: null and empty texts have no ids and decode to nothing; ids of documents may be null or repeat; rows stay
as they are; texts of any length are a block of their own and never cut but at white space; other columns, whatever their
names, are ignored; an empty table gives no rows; ids outside the vocabulary make decoding fail.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.scratch import new_path
from millrace.llm.shared import forget, mapped, put

#: Bytes of text that are encoded at once, text that a shard of the vocabulary stands for, and bytes of units replayed at once.
BLOCK, SHARD_BYTES, REPLAYED = 4 << 20, 64 << 20, 2 << 20
_NONE = np.iinfo(np.int64).max
#: ASCII bytes after which a white-space byte may start a new unit: all but white space and the controls beside it.
_SOLID = np.array([0x21 <= b < 0x7F or b >= 0x80 for b in range(256)])
_SPACE = ~blocks.NON_SPACE


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; for the many short arrays here faster than np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Ranks as arrays: the rank of every pair of tokens that makes a token, and the tokens' bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], _NONE), np.append(made[order], _NONE)
        # tokens that make one of lower rank with some neighbour: where that is, the order of merges within a piece matters
        self.early = np.zeros(self.size, bool)
        for side in (keys // self.size, keys % self.size):
            self.early[side[made < side]] = True
        by_id: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.binary())

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, _NONE if it makes none."""
        key = a * self.size + b
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.made[k], _NONE)

    def one(self, piece: bytes) -> list[int]:
        """The plain form: merge the leftmost pair of lowest rank until none is left."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], _NONE))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbol = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after = np.arange(1, n + 1)
        after[np.cumsum(sizes) - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.cumsum(sizes) - sizes] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE)
        odd = np.zeros(len(pieces), bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            """Looks up the pairs that start at these positions and adds them to the index."""
            found = self.pair_ranks(symbol[at], symbol[after[at]])
            rank[at] = found
            at, found = at[found < _NONE], found[found < _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, spots in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(at, cuts)):
                if r not in index:
                    heapq.heappush(queue, r)
                    index[r] = []
                index[r].append(spots)

        add(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else _distinct(np.concatenate(held))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if follows.any():  # overlapping pairs (aaa): of each run the first, third, ... from the left
                    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            if self.early[r]:  # with the neighbours as they are before any of these merges
                for spots, beside, key in ((at, after[gone], lambda k: (r, symbol[k])), (at, before[at], lambda k: (symbol[k], r))):
                    spots, beside = spots[beside >= 0], beside[beside >= 0]
                    odd[piece[spots[self.pair_ranks(*key(beside)) < r]]] = True
            symbol[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            right = after[gone]
            after[at] = right
            has = right >= 0
            before[right[has]] = at[has]
            rank[at] = _NONE
            left = before[at]
            touched = _distinct(np.concatenate([at[has], left[left >= 0]]))
            if len(touched):
                add(touched)
        ids, counts = symbol[alive], np.bincount(piece[alive], minlength=len(pieces))
        if odd.any():
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                lists[k] = np.array(self.one(pieces[k]), np.int64)
            ids, counts = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return ids, counts


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(load_ranks(path))


def _units(texts: pa.Array) -> blocks.Words:
    """Texts cut before white space that follows anything else; no match of a pattern of this family crosses such a cut.

    After characters whose first byte may start one of Unicode's spaces there is no cut: a longer unit does no harm.
    """
    data, offsets = blocks.raw(texts)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = _SPACE[data[1:]] & _SOLID[data[:-1]]
    for back, leads in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        k = np.flatnonzero(cut[back:]) + back
        cut[k[np.isin(data[k - back], leads)]] = False
    cut[offsets] = True
    ends = np.flatnonzero(cut)
    return blocks.Words(data, ends, np.searchsorted(ends, offsets))


def encode_units(units: list[bytes], table: Merges, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, number of ids of each); each distinct piece of them is looked up or replayed once."""
    number: dict[bytes, int] = {}
    pieces_of, n_pieces = [], np.zeros(len(units), np.int64)
    find = regex.compile(pattern).findall
    for k, unit in enumerate(units):
        found = find(unit.decode())
        n_pieces[k] = len(found)
        pieces_of += [number.setdefault(p, len(number)) for p in found]
    pieces = [p.encode() for p in number]
    ranks = np.array([table.ranks.get(p, -1) for p in pieces], np.int64)
    rest = np.flatnonzero(ranks < 0)
    counts = np.ones(len(pieces), np.int64)
    first = np.arange(len(pieces))
    ids = ranks
    if len(rest):
        more, counts[rest] = table.replay([pieces[k] for k in rest.tolist()])
        first[rest] = len(pieces) + np.cumsum(counts[rest]) - counts[rest]
        ids = np.concatenate([ranks, more])
    pieces_of = np.array(pieces_of, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts[pieces_of])])[np.concatenate([[0], np.cumsum(n_pieces)])]
    return ids[blocks.ragged(first[pieces_of], counts[pieces_of])].astype(np.int32), np.diff(ends)


def _portions(units: list[bytes]) -> Iterator[list[bytes]]:
    """The units in runs of about REPLAYED bytes."""
    at, size = 0, 0
    for k, unit in enumerate(units):
        size += len(unit)
        if size >= REPLAYED:
            yield units[at : k + 1]
            at, size = k + 1, 0
    if at < len(units):
        yield units[at:]


def _replayed(units: list[bytes], table: Merges, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [encode_units(p, table, pattern) for p in _portions(units)]
    return np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


def _hashes(units: list[bytes]) -> np.ndarray:
    """The hash of Spark's xxhash64."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(u, 42) for u in units), np.uint64, len(units))


@dataclass(frozen=True)
class Vocabulary:
    """Where the shards' arrays are, and how many units each has."""

    folder: str
    sizes: tuple[int, ...]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the units that are there, their ids one after the other, the number of each one's ids)."""
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        cuts = np.searchsorted((sorted_ >> np.uint64(32)) * np.uint64(len(self.sizes)) >> np.uint64(32), np.arange(len(self.sizes) + 1))
        rows, ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for s in np.flatnonzero((np.diff(cuts) > 0) & (np.array(self.sizes) > 0)).tolist():
            held, first, own = (mapped(f"{self.folder}/{name}-{s}", kind) for name, kind in (("hashes", "<u8"), ("first", "<u4"), ("ids", "<i4")))
            part = sorted_[cuts[s] : cuts[s + 1]]
            k = np.minimum(np.searchsorted(held, part), len(held) - 1)
            hit = np.flatnonzero(held[k] == part)
            start = first[k[hit]].astype(np.int64)
            size = first[k[hit] + 1].astype(np.int64) - start
            rows.append(order[cuts[s] + hit])
            ids.append(own[blocks.ragged(start, size)])
            counts.append(size)
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(counts)


def vocabulary(docs: DataFrame, path: str, pattern: str) -> Vocabulary:
    """The ids of all units that stand in two blocks of the documents or more."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "vocabulary")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    shards = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 2 * BLOCK):
            _, distinct = _units(batch.column(0)).encoded()
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary())], names=["unit"])

    several = texts.mapInArrow(cut, "unit binary").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("unit", F.xxhash64("unit").alias("hash"))
    shard = F.shiftrightunsigned(F.shiftrightunsigned("hash", 32) * F.lit(shards), 32).cast("int")
    # ascending as unsigned numbers
    dealt = several.repartitionById(shards, shard).sortWithinPartitions(F.col("hash") < 0, "hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, table, hashes, ids, counts = TaskContext.get().partitionId(), merges(path), [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        units: list[bytes] = []
        for batch in batches:
            hashes.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            units += batch.column(0).to_pylist()
        if not units:
            return
        flat, n = _replayed(units, table, pattern)
        put(f"{folder}/hashes-{s}", np.concatenate(hashes).astype("<u8"))
        put(f"{folder}/first-{s}", np.concatenate([[0], np.cumsum(n)]).astype("<u4"))
        put(f"{folder}/ids-{s}", flat.astype("<i4"))
        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(units)])], names=["shard", "n"])
        del flat, n, units
        blocks.give_back()

    # one row for each shard
    sizes = {r["shard"]: r["n"] for r in dealt.select("unit", "hash").mapInArrow(write, "shard long, n long").collect()}
    return Vocabulary(folder, tuple(sizes.get(s, 0) for s in range(shards)))


def encode_texts(texts: pa.Array, table: Merges, pattern: str, known: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    units = _units(texts)
    if not len(units):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    which, distinct = units.encoded()
    listed = distinct.to_pylist()
    first, counts, missing = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64), np.ones(len(listed), bool)
    pool = [np.zeros(0, np.int32)]
    if known is not None:
        rows, ids, n = known.look_up(_hashes(listed))
        # a unit of the same hash stands for other bytes
        same = pc.equal(decode_ids(pa.array(ids), np.concatenate([[0], np.cumsum(n)]), table), distinct.cast(pa.binary()).take(pa.array(rows))).to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, bool)
        first[rows], counts[rows], missing[rows[same]] = np.cumsum(n) - n, n, False
        pool.append(ids)
    rest = np.flatnonzero(missing)
    if len(rest):
        more, counts[rest] = _replayed([listed[k] for k in rest.tolist()], table, pattern)
        first[rest] = len(pool[-1]) + np.cumsum(counts[rest]) - counts[rest]
        pool.append(more)
    lengths = counts[which]
    flat = np.concatenate(pool)[blocks.ragged(first[which], lengths)]
    return flat, np.diff(np.concatenate([[0], np.cumsum(lengths)])[units.first])


def decode_ids(ids: pa.Array, first: np.ndarray, table: Merges) -> pa.Array:
    """The bytes of each list of ids (first: where each list starts, and the end)."""
    tokens = table.tokens.take(ids)
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = tokens.buffers()
    at = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1][first].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(at), data if data is not None else pa.py_buffer(b"")])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, known: Vocabulary | None) -> Iterator[pa.RecordBatch]:
    for batch in blocks.slices(batches, "text", BLOCK):
        flat, n = encode_texts(batch.column(1), merges(path), pattern, known)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])
    forget()
    blocks.give_back()


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        decoded = decode_ids(pc.list_flatten(lists), np.concatenate([[0], np.cumsum(n)]), merges(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, known: Vocabulary | None = None) -> DataFrame:
    """(doc_id, ids) of each row; ``known`` is the documents' ``vocabulary``, without which every block replays its own units."""
    return _texts(docs).mapInArrow(lambda batches: _encoded(batches, path, pattern, known), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of (doc_id, ids) with the bytes that the ids stand for as ``decoded``; null ids decode to nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and their ids decoded again, in one worker for each task."""
    known = vocabulary(docs, path, pattern)
    both = _texts(docs).mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern, known), path), "doc_id long, ids array<int>, decoded binary")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
