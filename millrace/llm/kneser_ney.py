"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted arrays that workers map.

An n-gram's number is its place in all shards of its order one after the other.  Words are found by their 64-bit hashes; an
n-gram of a higher order by two numbers, those of its first and of its last n - 1 words, so one of them names the context
and the other what it continues, and a text's n-grams of all orders follow from its words' numbers.  Training is, for each
order, a map over blocks of texts and a grouping of packed partial counts by shard:

1. Words.  The hashes of words with their counts go to shards by hash range; each shard writes its sorted hashes and counts.
2. Order k.  Distinct pairs of numbers of order k - 1, sorted and stored as differences, go to shards by a hash of the pair, so
   that a frequent first word is spread over all of them.  Each shard writes its sorted pairs, and counts if k is the highest order.
3. How many n-grams of order k end in each one of order k - 1 (its count in a model of lower order), and what follows each
   context (once, twice, more often; in all), is added up by ranges of numbers and written in their order.

Tasks hold the partial counts of ``SHARD_BYTES`` of text or ``SHARD_TOKENS`` tokens, for as many shards as the corpus asks for;
numbers and counts have 64 bits.  Scoring is a map over blocks: every array is a memory map of a file in the shared folder.  The
driver sees a few numbers for each shard and nothing else.

    p(w | u) = max(c(u w) - D(c(u w)), 0) / c(u .) + g(u) p(w | u')        p(w | u) = p(w | u') for a u that begins nothing
    p(w) = max(t(w) - D'(t(w)), 0) / t + g' / (V + 1)

u' is u without its first word, c(u w) is the count for the highest order and below it the number of distinct words before
(the count, where u begins at the start of a text), D are the discounts of Chen and Goodman for 1, 2 and 3 or more, g their
mass, and V the number of distinct tokens.  All unknown words together are one more token.

Defined cases: null and empty texts are the end token alone; without training texts every token has probability 1 / (V + 1)
= 1; texts of any length are one block; null ids are learned from and never held out; equal rows count as often as they occur;
other columns, whatever their names, are ignored; an empty table gives no rows.  Two words with the same 64-bit hash are
taken for one; nothing else is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.scratch import new_path
from millrace.llm.shared import mapped, put

_BLOCK = 3 << 20
#: Text that one shard of words stands for, and tokens that one shard of n-grams stands for.
SHARD_BYTES, SHARD_TOKENS = 24 << 20, 2_500_000
#: Distinct n-grams that a task gathers before it sends them.
_GATHERED = 1_500_000
#: Pairs of numbers below this are one 64-bit key, others two.
_HALF = 1 << 32
_ROWS = "shard int, kind int, a binary, b binary, c binary"
_TYPES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, so that the planes of zeros in small numbers compress to nothing."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _summed(first: np.ndarray, second: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys (of one or two numbers), ascending, and the sums of their counts."""
    if not len(first):
        return first, second, counts
    if second is not None and max(int(first.max()), int(second.max())) < _HALF:
        keys, _, counts = _summed((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), None, counts)
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    first, counts = first[order], counts[order]
    fresh = np.concatenate([[True], first[1:] != first[:-1]])
    if second is not None:
        second = second[order]
        fresh[1:] |= second[1:] != second[:-1]
    at = np.flatnonzero(fresh)
    return first[at], None if second is None else second[at], np.add.reduceat(counts, at)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash, ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return blocks.mix(blocks.mix(first) + second.astype(np.uint64))


def _put_counts(folder: str, name: str, shard: int, counts: np.ndarray) -> None:
    """Counts as bytes; those from 255 on stand in a list of their own."""
    many = np.flatnonzero(counts >= 255)
    put(f"{folder}/{name}-{shard}", np.minimum(counts, 255).astype(np.uint8))
    put(f"{folder}/{name}-large-{shard}", np.concatenate([many, counts[many]]).astype("<u8"))


def _put_contexts(folder: str, name: str, shard: int, sums: np.ndarray) -> None:
    """(all, once, twice, more) of each context; those that one thing follows once aren't written."""
    kept = np.flatnonzero((sums != (1, 1, 0, 0)).any(axis=1))
    put(f"{folder}/{name}-{shard}", np.concatenate([kept, sums[kept].T.ravel()]).astype("<u8"))


def _hashes(distinct: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    order: int
    texts: int = 0
    tokens: int = 0  # with the end tokens
    #: For each order, the number of the first n-gram of each shard, and of the end token (words) or one past the last.
    bases: tuple[tuple[int, ...], ...] = ()
    discounts: tuple[tuple[float, ...], ...] = ()  # by order
    total: int = 0  # t
    word_mass: float = 1.0  # g'
    half: int = _HALF

    @property
    def end(self) -> int:
        return self.bases[0][-1]

    @property
    def distinct(self) -> int:
        return self.end + (self.texts > 0)

    def narrow(self, order: int) -> bool:
        """Whether the pairs of an order are single keys: all numbers of the order below, with end and start, have 32 bits."""
        return self.bases[order - 2][-1] + 2 < self.half

    def _array(self, name: str, shard: int, kind: str) -> np.ndarray:
        return mapped(f"{self.folder}/{name}-{shard}", kind)

    def _by_shard(self, order: int, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows, places in the shard) of the numbers of an order that are there."""
        bases = np.array(self.bases[order - 1])
        shard = np.clip(np.searchsorted(bases, numbers, side="right") - 1, 0, len(bases) - 2)
        shard[numbers < 0] = -1
        for s, (rows,) in _dealt(shard + 1, len(bases), np.arange(len(numbers))):
            if s:
                yield s - 1, rows, numbers[rows] - bases[s - 1]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by hash; -1 for unknown ones."""
        order = np.argsort(hashes, kind="stable")
        sorted_, number = hashes[order], np.full(len(hashes), -1, np.int64)
        bases = self.bases[0]
        shard = _shard_of(sorted_, len(bases) - 1)
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            own = self._array("words", s, "<u8")
            if len(own):
                k = np.minimum(np.searchsorted(own, sorted_[a:b]), len(own) - 1)
                hit = np.flatnonzero(own[k] == sorted_[a:b])
                number[order[a + hit]] = bases[s] + k[hit]
        return number

    def grams(self, order: int, first: np.ndarray, second: np.ndarray, counts: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(numbers of n-grams by the two numbers of the order below, -1 for unknown ones; their counts from the arrays of that name)."""
        out, times = np.full(len(first), -1, np.int64), None if counts is None else np.zeros(len(first), np.int64)
        here = np.flatnonzero((first >= 0) & (second >= 0))
        if not len(here):
            return out, times
        narrow = self.narrow(order)
        a, b = first[here].astype(np.uint64), second[here].astype(np.uint64)
        by_key = np.argsort((a << np.uint64(32)) | b, kind="stable") if narrow else np.lexsort((b, a))
        a, b = a[by_key], b[by_key]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[fresh], b[fresh]
        bases, found, seen = self.bases[order - 1], np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
        for s, (rows,) in _dealt(_shard_of(_pair_hash(a, b), len(bases) - 1), len(bases) - 1, np.arange(len(a))):
            k = self._places(f"grams{order}", s, a[rows], b[rows], narrow)
            rows, k = rows[k >= 0], k[k >= 0]
            found[rows] = bases[s] + k
            if counts is not None:
                seen[rows] = self._counts(counts, s, k)
        which = np.cumsum(fresh) - 1
        out[here[by_key]] = found[which]
        if counts is not None:
            times[here[by_key]] = seen[which]
        return out, times

    def _places(self, name: str, shard: int, a: np.ndarray, b: np.ndarray, narrow: bool) -> np.ndarray:
        """The places of ascending pairs in a shard, -1 for those that aren't there."""
        held = self._array(name, shard, "<u8")
        if not len(held):
            return np.full(len(a), -1, np.int64)
        if narrow:
            keys = (a << np.uint64(32)) | b
            k = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            return np.where(held[k] == keys, k, -1)
        own, other = np.split(held, 2)
        k, stop = np.searchsorted(own, a, side="left"), np.searchsorted(own, a, side="right")
        last = stop
        while (open_ := k < stop).any():  # the second number within the range of the first
            mid = (k + stop) // 2
            less = other[np.minimum(mid, len(other) - 1)] < b
            k, stop = np.where(open_ & less, mid + 1, k), np.where(open_ & ~less, mid, stop)
        return np.where((k < last) & (other[np.minimum(k, len(other) - 1)] == b), k, -1)

    def _counts(self, name: str, shard: int, places: np.ndarray) -> np.ndarray:
        own = self._array(name, shard, "|u1")
        found, inside = np.zeros(len(places), np.int64), places < len(own)
        found[inside] = own[places[inside]]
        many = np.flatnonzero(found == 255)
        if len(many):
            place, count = np.split(self._array(f"{name}-large", shard, "<u8"), 2)
            found[many] = count[np.searchsorted(place, places[many].astype(np.uint64))]
        return found

    def counts(self, name: str, order: int, numbers: np.ndarray) -> np.ndarray:
        """The counts of n-grams of ``order`` by number; 0 for unknown ones."""
        out = np.zeros(len(numbers), np.int64)
        for s, rows, at in self._by_shard(order, numbers):
            out[rows] = self._counts(name, s, at)
        return out

    def contexts(self, order: int, numbers: np.ndarray) -> np.ndarray:
        """(all, once, twice, more often) of what follows the n-grams of ``order``; zeros for unknown ones."""
        out = np.zeros((len(numbers), 4), np.int64)
        out[numbers >= 0] = (1, 1, 0, 0)
        for s, rows, at in self._by_shard(order, numbers):
            own = self._array(f"contexts{order}", s, "<u8").reshape(5, -1)
            if own.shape[1]:
                k = np.minimum(np.searchsorted(own[0], at.astype(np.uint64)), own.shape[1] - 1)
                hit = np.flatnonzero(own[0][k] == at.astype(np.uint64))
                out[rows[hit]] = own[1:, k[hit]].T
        return out

    def discount(self, order: int, counts: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[order - 1]])
        return d[np.minimum(counts, 3).astype(np.int64)]


def _dealt(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts for each shard that has any, in their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[s] : cuts[s + 1]]
        yield s, [a[rows] for a in arrays]


def _block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each token as an index of the distinct words, bounds of the texts, hashes of the distinct words)."""
    words = blocks.split(texts, blocks.NON_SPACE, blocks.LOWER)
    which, distinct = words.encoded()
    return which.astype(np.int64), words.first, _hashes(distinct)


def _tokens(model: Model, number: np.ndarray, which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token with an end after each text, place of each token in its text, bounds of the texts)."""
    word = np.insert(number[which], first[1:], model.end)
    bounds = first + np.arange(len(first))
    return word, np.arange(len(word)) - np.repeat(bounds[:-1], np.diff(bounds)), bounds


def _before(model: Model, order: int, numbers: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each token the number of the n-gram of ``order`` that ends just before it, -1 if there is none."""
    out = np.concatenate([[-1], numbers[:-1]])[: len(numbers)]
    out[place < order - 1] = -1
    if order == 1:
        out[place == 0] = model.end + 1  # the start of the text
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (shard, kind, bytes, bytes, bytes)."""
    columns = list(zip(*rows)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES.types)], schema=_TYPES)


def _discounts(n: list[int]) -> tuple[float, ...]:
    """D1, D2, D3+ from the numbers of things seen once to four times; 0.5, 1 and 1.5 where these don't say."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
    for k, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] and y else default
        out.append(float(min(max(d, 0.05), k - 0.05)))
    return tuple(out)


class _Gatherer:
    """Keys with counts, added up until there are ``_GATHERED`` of them."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *part) -> bool:
        self.parts.append(part)
        self.size += len(part[0])
        return self.size >= _GATHERED

    def take(self) -> tuple:
        first, second, counts = zip(*self.parts) if self.parts else ([np.zeros(0, np.uint64)], [None], [np.zeros(0, np.int64)])
        self.parts, self.size = [], 0
        return _summed(np.concatenate(first), None if second[0] is None else np.concatenate(second), np.concatenate(counts))


def _ranged(bases: tuple[int, ...], kind: int, numbers: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows (shard, kind, numbers, values) by the shards of the numbers; the last shard also has what follows the last number."""
    where = np.clip(np.searchsorted(bases, numbers, side="right") - 1, 0, len(bases) - 2)
    return [(s, kind, _packed(n), _packed(np.stack(v).ravel()), None) for s, (n, *v) in _dealt(where, len(bases) - 1, numbers, *values)]


def _following(first: np.ndarray, counts: np.ndarray, bases: tuple[int, ...]) -> list[tuple]:
    """Rows of (all, once, twice, more) for the contexts ``first``, ascending, of n-grams with these counts."""
    if not len(first):
        return []
    at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
    return _ranged(bases, _CONTEXT, first[at], *sums)


#: Kinds of rows: counts (of words, n-grams, or of what ends in an n-gram), sums of contexts, n-grams that begin their text, tallies.
_COUNT, _CONTEXT, _START, _TALLY = range(4)


def _tally(order: int, counts: np.ndarray, size: int, shard: int) -> tuple:
    """A row of (order, shard, size, how many counts are 1, 2, 3 and 4, at least 3, and their sum), for the driver."""
    numbers = [order, shard, size, *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()), int(counts.sum())]
    return (0, _TALLY, _packed(np.array(numbers)), None, None)


def _bases(sizes: list[int]) -> tuple[int, ...]:
    return tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)]))


def _by_shard(rows: DataFrame, shards: int, function, schema: str) -> DataFrame:
    """``function(shard, rows)`` of each shard's rows (_ROWS) as tuples; a shard without rows gets none, as each writes its files."""
    none = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in "abc"])

    def run(table: pa.Table):
        columns = [table.column(c) for c in ("kind", "a", "b", "c")]
        listed = ((k.as_py(), *(None if x is None else x.as_py() for x in rest)) for k, *rest in zip(*columns) if k.as_py() >= 0)
        out = function(table.column("shard")[0].as_py(), listed)
        blocks.give_back()
        return out

    # a partition for each shard: by the hash of its number some would get several
    return rows.unionByName(none).repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(lambda table: run(table), schema)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


class _Grams:
    """The stages that count the n-grams of an order; ``model`` has the arrays of the orders below."""

    def __init__(self, model: Model, order: int, shards: int):
        self.model, self.order, self.shards, self.below = model, order, shards, model.bases[order - 2]

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with counts, and the n-grams of the order below that begin their text, for the shards."""
        model, pairs, starts = self.model, _Gatherer(), _Gatherer()

        def sent() -> pa.RecordBatch:
            out, (a, b, counts) = [], pairs.take()
            if len(a):
                for s, (x, y, c) in _dealt(_shard_of(_pair_hash(a, b), self.shards), self.shards, a, b, counts):
                    out.append((s, _COUNT, _packed(np.diff(x, prepend=0)), _packed(y), _packed(c)))
            a, _, counts = starts.take()
            out += [(s, _START, _packed(x), _packed(c), None) for s, (x, c) in _dealt(_shard_of(blocks.mix(a), self.shards), self.shards, a, counts)]
            return _rows(out)

        for batch in blocks.slices(batches, "text", _BLOCK):
            which, first, hashes = _block(batch.column(0))
            numbers, place, _ = _tokens(model, model.words(hashes), which, first)
            for k in range(2, self.order):
                numbers, _ = model.grams(k, _before(model, k - 1, numbers, place), numbers)
            before = _before(model, self.order - 1, numbers, place)
            both = (before >= 0) & (numbers >= 0)
            full = pairs.add(*_summed(before[both], numbers[both], np.ones(int(both.sum()), np.int64)))
            if self.order > 2:
                begin = numbers[place == self.order - 3]
                full |= starts.add(begin, None, np.ones(len(begin), np.int64))
            if full:
                yield sent()
        yield sent()

    def merged(self, shard: int, rows: Iterator[tuple]) -> pa.Table:
        """Writes the shard's pairs; gives what ends in the n-grams of the order below, and for the highest order what follows them."""
        model, pairs, starts = self.model, _Gatherer(), _Gatherer()
        for kind, a, b, c in rows:
            if kind == _COUNT:
                pairs.add(np.cumsum(_unpacked(a).astype(np.int64)), _unpacked(b).astype(np.int64), _unpacked(c).astype(np.int64))
            else:
                starts.add(_unpacked(a).astype(np.int64), None, _unpacked(b).astype(np.int64))
        a, b, counts = pairs.take()
        b = np.zeros(0, np.int64) if b is None else b
        x, y = a.astype(np.uint64), b.astype(np.uint64)
        narrow = model.narrow(self.order)
        put(f"{model.folder}/grams{self.order}-{shard}", ((x << np.uint64(32)) | y if narrow else np.concatenate([x, y])).astype("<u8"))
        top = self.order == model.order
        out = [_tally(self.order, counts if top else counts[:0], len(a), shard)]
        if top:
            _put_counts(model.folder, f"counts{self.order}", shard, counts)
            out += _following(a, counts, self.below)
        last, times = np.unique(b, return_counts=True)
        begin, _, more = starts.take()
        out += _ranged(self.below, _COUNT, last, times) + _ranged(self.below, _COUNT, begin, more)
        return _table(out)

    def added(self, shard: int, rows: Iterator[tuple]) -> pa.Table:
        """Writes the counts of the order below in a range of its numbers, and its sums as contexts of the highest order."""
        model, below = self.model, self.order - 1
        base, size = self.below[shard], self.below[shard + 1] - self.below[shard]
        size += 2 if below == 1 and shard == len(self.below) - 2 else 0  # the end and the start
        counts, sums, out = np.zeros(size, np.int64), np.zeros((size, 4), np.int64), []
        for kind, a, b, _ in rows:
            if kind == _TALLY:
                out.append((0, _TALLY, a, None, None))
                continue
            own = _unpacked(a).astype(np.int64) - base  # the numbers of one row differ
            if kind == _COUNT:
                counts[own] += _unpacked(b).astype(np.int64)
            else:
                sums[own] += _unpacked(b).astype(np.int64).reshape(4, -1).T
        _put_counts(model.folder, f"counts{below}", shard, counts)
        out.append(_tally(below, counts, size, shard))
        if self.order == model.order:
            _put_contexts(model.folder, f"contexts{below}", shard, sums)
        if below > 1:  # these counts are what the contexts of this order are made of
            held = mapped(f"{model.folder}/grams{below}-{shard}", "<u8")
            narrow = model.narrow(below)
            first = (held >> np.uint64(32) if narrow else held[: len(held) // 2]).astype(np.int64)
            out += _following(first, counts, model.bases[below - 2])
        return _table(out)

    def contexts(self, shard: int, rows: Iterator[tuple]) -> pa.Table:
        """Writes the sums of contexts two orders below in a range of its numbers."""
        bases, order = self.model.bases[self.order - 3], self.order - 2
        size = bases[shard + 1] - bases[shard] + (2 if order == 1 and shard == len(bases) - 2 else 0)
        sums, out = np.zeros((size, 4), np.int64), []
        for kind, a, b, _ in rows:
            if kind == _TALLY:
                out.append((0, _TALLY, a, None, None))
            else:
                sums[_unpacked(a).astype(np.int64) - bases[shard]] += _unpacked(b).astype(np.int64).reshape(4, -1).T
        _put_contexts(self.model.folder, f"contexts{order}", shard, sums)
        return _table(out)

    def run(self, texts: DataFrame) -> dict[int, dict[int, np.ndarray]]:
        """order -> shard -> (size, tallies)."""
        rows = _by_shard(texts.mapInArrow(self.partial, _ROWS), self.shards, self.merged, _ROWS)
        rows = _by_shard(rows, len(self.below) - 1, self.added, _ROWS)
        if self.order > 2:
            rows = _by_shard(rows, len(self.model.bases[self.order - 3]) - 1, self.contexts, _ROWS)
        out: dict[int, dict[int, np.ndarray]] = {}
        for r in rows.filter(F.col("kind") == _TALLY).select("a").collect():
            order, shard, *numbers = _unpacked(r["a"]).astype(np.int64).tolist()
            out.setdefault(order, {})[shard] = np.array(numbers)
        return out


def train(docs: DataFrame, order: int = 2, half: int = _HALF) -> Model:
    """The model of all texts of ``docs`` (column ``text``); ``order`` is 2 or more, numbers below ``half`` share a key."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "kneser-ney")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_words = max(1, math.ceil(size / SHARD_BYTES))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_texts = _Gatherer(), 0

        def sent() -> pa.RecordBatch:
            hashes, _, counts = held.take()
            return _rows([(s, _COUNT, _packed(np.diff(h, prepend=np.uint64(0))), _packed(c), None) for s, (h, c) in _dealt(_shard_of(hashes, n_words), n_words, hashes, counts)])

        for batch in blocks.slices(batches, "text", _BLOCK):
            which, first, hashes = _block(batch.column(0))
            n_texts += len(first) - 1
            if held.add(hashes, None, np.bincount(which, minlength=len(hashes)).astype(np.int64)):
                yield sent()
        if held.size:
            yield sent()
        yield _rows([(0, _TALLY, _packed(np.array([n_texts])), None, None)])

    def merged_words(shard: int, rows: Iterator[tuple]) -> pa.Table:
        held, n_texts = _Gatherer(), 0
        for kind, a, b, _ in rows:
            if kind == _TALLY:
                n_texts += int(_unpacked(a)[0])
            else:
                held.add(np.cumsum(_unpacked(a), dtype=np.uint64), None, _unpacked(b).astype(np.int64))
        keys, _, counts = held.take()
        put(f"{folder}/words-{shard}", keys.astype("<u8"))
        _put_counts(folder, "word-counts", shard, counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)]), "tokens": pa.array([int(counts.sum())]), "texts": pa.array([n_texts])})

    sizes = {r["shard"]: r for r in _by_shard(texts.mapInArrow(words, _ROWS), n_words, merged_words, "shard int, n long, tokens long, texts long").collect()}
    bases = [_bases([sizes[s]["n"] for s in range(n_words)])]
    n_texts = sum(r["texts"] for r in sizes.values())
    tokens = sum(r["tokens"] for r in sizes.values()) + n_texts
    shards, tallies = max(1, math.ceil(tokens / SHARD_TOKENS)), {}
    for k in range(2, order + 1):
        found = _Grams(Model(folder, order, n_texts, tokens, tuple(bases), half=half), k, shards).run(texts)
        bases.append(_bases([int(found[k][s][0]) for s in range(shards)]))
        tallies |= {j: sum(x[1:] for x in found[j].values()).tolist() for j in (k - 1, k)}
    discounts = tuple(_discounts(tallies[k][:4]) for k in range(1, order + 1))
    (one, two, _, _, more, total), d = tallies[1], discounts[0]
    mass = (d[0] * one + d[1] * two + d[2] * more) / total if total else 1.0
    return Model(folder, order, n_texts, tokens, tuple(bases), discounts, total, mass, half)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): log10 probabilities of each text with its end token.

    base_score is that of single tokens with 0.1 added to each count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.distinct
        floor = model.tokens + 0.1 * (v + 1)
        for batch in blocks.slices(batches, "text", _BLOCK):
            which, first, hashes = _block(batch.column(1))
            number = model.words(hashes)
            count = np.append(model.counts("word-counts", 1, number), model.texts)
            token = np.insert(which, first[1:], len(hashes))
            numbers, place, bounds = _tokens(model, number, which, first)
            base = np.log10((count + 0.1) / floor)[token]
            t = model.counts("counts1", 1, np.append(number, model.end)) if model.texts else np.zeros(len(number) + 1, np.int64)
            p = (np.maximum(t - model.discount(1, t), 0) / max(model.total, 1) + model.word_mass / (v + 1))[token]
            # sums of contexts: of the block's words, of the end and of the start
            sums = model.contexts(1, np.concatenate([number, [model.end, model.end + 1]])) if model.texts else None
            at = np.concatenate([[0], token[:-1]])[: len(token)]
            at[place == 0] = len(hashes) + 1
            for k in range(2, model.order + 1) if model.texts else ():
                context = _before(model, k - 1, numbers, place)
                s = sums[at] if k == 2 else model.contexts(k - 1, context)
                numbers, c = model.grams(k, context, numbers, f"counts{k}")
                n = np.maximum(s[:, 0], 1)
                own = (np.maximum(c - model.discount(k, c), 0) + s[:, 1:] @ np.array(model.discounts[k - 1]) * p) / n
                p = np.where(s[:, 0] > 0, own, p)
            add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0, x.dtype)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(add((count[token] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
