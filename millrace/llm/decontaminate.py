"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every token of the training texts.  The index is cut by documents: a block is a
run of documents with about ``block_bytes`` of text, and each (block, term) row holds the ascending addresses of that
term, counted in words from the block's start, as differences of two or four bytes.  A row without a term holds the
block's directory: the documents and their numbers of words.  Blocks bound what any task holds, whatever a term's count.

The phrases of a benchmark (windows of its items, or whole items) are cut in tasks and stand in a table of their own, however
many there are.  One scan of the index gives how often their terms stand where; a phrase goes to the blocks that hold the term
of it that is rarest in the corpus, and a block gets those phrases and the postings of their terms.  There offset-adjusted lists
are intersected from the block's rarest term of each phrase on, so that one frequent word costs nothing when another is rare.
Nothing passes the driver, and no side is broadcast but by the planner's measure of its size.

Defined cases: a null or empty text has no words and no hits; null ids of documents stay, items without an id mark words
but are not listed; equal rows are separate documents, equal items and ids that repeat count once; texts of any length are read
whole, as a block of their own; other columns, whatever their names, are ignored; an empty table gives no rows; an empty
benchmark gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.scratch import packed, row_key, stored, unpacked

INDEX = "block long, term binary, n int, postings binary, doc_ids array<bigint>, doc_words array<int>"
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32()))])
#: Phrases in one batch of those that a task cuts.
_PHRASES = 50_000
#: Candidate starts that are intersected at once.
_AT_ONCE = 1_000_000


def _pack(indices: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Addresses of each term as little-endian differences: (bytes, offsets of the terms in them, counts)."""
    keys = np.sort((indices.astype(np.int64) << 32) | np.arange(len(indices)))
    at = keys & 0xFFFFFFFF
    counts = np.bincount(indices, minlength=n_terms)
    first = np.cumsum(counts) - counts
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    wide = np.maximum.reduceat(gaps, first) > 0xFFFF
    width = np.where(wide, 4, 2)
    keep = np.ones((len(at), 4), bool)
    keep[:, 2:] = np.repeat(wide, counts)[:, None]
    data = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]
    return data, np.concatenate([[0], np.cumsum(counts * width)]), counts


def _unpack(postings: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(postings, "<u4" if len(postings) == 4 * n else "<u2").astype(np.int64))


def build_index(docs: DataFrame, block_bytes: int = 12 << 20) -> DataFrame:
    """A row for each block and term, and one without a term for each block (see above), as a stored table.

    Blocks are numbered by partition, so the rows of one index must come from one run.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks.slices(batches, "text", block_bytes):
            words = blocks.split(batch.column(1), blocks.ALNUM, blocks.LOWER)
            ids, sizes = batch.column(0).to_pylist(), np.diff(words.first).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(words)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))], schema=_INDEX)
            if len(words):
                indices, terms = words.encoded()
                data, offsets, counts = _pack(indices, len(terms))
                postings = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block)), terms, pa.array(counts.astype(np.int32)), postings, pa.nulls(len(terms), pa.list_(pa.int64())), pa.nulls(len(terms), pa.list_(pa.int32()))], schema=_INDEX)
                for at in range(0, len(terms), 50_000):
                    yield rows.slice(at, 50_000)
            block += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(index, INDEX), "postings")


def _phrases(items: DataFrame, size: int | None) -> tuple[DataFrame, DataFrame]:
    """((phrase long, terms array<binary>) of the distinct phrases, (phrase, item string) of the items that have them).

    A phrase is any ``size`` consecutive words of an item, or all words of a shorter one, or of every item without a size.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 1 << 20):
            words = blocks.split(batch.column(1), blocks.ALNUM, blocks.LOWER)
            n = np.diff(words.first)
            length = n if size is None else np.minimum(n, size)
            count = np.where(n > 0, n - length + 1, 0)
            start, own, length = blocks.ragged(words.first[:-1], count), np.repeat(np.arange(len(n)), count), np.repeat(length, count)
            terms = words.array()
            for at in range(0, len(start), _PHRASES):
                part = slice(at, at + _PHRASES)
                bounds = np.concatenate([[0], np.cumsum(length[part])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(bounds, terms.take(pa.array(blocks.ragged(start[part], length[part]))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[part])), lists], names=["item", "terms"])

    texts = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    windows = stored(texts.mapInArrow(cut, "item string, terms array<binary>"), "windows")
    phrases = stored(windows.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owners = windows.filter(F.col("item").isNotNull()).distinct().join(phrases, "terms").select("phrase", "item")
    return phrases, owners


class _Phrases:
    """The phrases of one block as rows of term numbers (-1 after the end)."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("phrase").to_numpy()
        lists = table.column("terms").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).cast(pa.binary()).dictionary_encode() if len(lists) else pa.array([], pa.binary()).dictionary_encode()
        self.terms = coded.dictionary
        self.rows = np.full((len(self.ids), max(self.lengths, default=1)), -1, np.int64)
        self.rows[np.arange(self.rows.shape[1]) < self.lengths[:, None]] = coded.indices.to_numpy(zero_copy_only=False)


class _Block:
    """The postings of the test terms in one block."""

    def __init__(self, table: pa.Table, terms: pa.Array):
        at = table.column("doc_ids").is_valid()
        directory, rows = table.filter(at), table.filter(pc.invert(at))
        self.number = directory.column("block")[0].as_py()
        self.doc_ids = directory.column("doc_ids")[0].as_py()
        self.sizes = np.array(directory.column("doc_words")[0].as_py(), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        numbers = pc.index_in(rows.column("term").cast(pa.binary()), terms.cast(pa.binary())).to_pylist()
        self.counts = np.zeros(len(terms), np.int64)
        lists: dict[int, np.ndarray] = {}
        for t, n, postings in zip(numbers, rows.column("n").to_pylist(), rows.column("postings").to_pylist()):
            lists[t], self.counts[t] = _unpack(postings, n), n
        self.first = np.cumsum(self.counts) - self.counts
        self.at = np.concatenate([lists[t] for t in sorted(lists)]) if lists else np.zeros(0, np.int64)
        self.keys = (np.repeat(np.arange(len(terms)), self.counts) << 32) | self.at

    def has(self, terms: np.ndarray, addresses: np.ndarray) -> np.ndarray:
        keys = (terms << 32) | addresses
        k = np.searchsorted(self.keys, keys)
        return (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == keys)

    def document(self, addresses: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, addresses, side="right") - 1

    def exact(self, p: _Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, address) of all occurrences, from the rarest term of each phrase to its most frequent one."""
        counts = np.where(p.rows >= 0, self.counts[p.rows], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = counts[np.arange(len(order)), order[:, 0]]
        alive = np.flatnonzero(rarest > 0)
        bounds = np.cumsum(rarest[alive])
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + _AT_ONCE, side="right")))
            few = alive[at:to]
            at = to
            offset = order[few, 0]
            phrase = np.repeat(few, rarest[few])
            start = self.at[blocks.ragged(self.first[p.rows[few, offset]], rarest[few])] - np.repeat(offset, rarest[few])
            fits = start >= 0
            phrase, start = phrase[fits], start[fits]
            for k in range(1, p.rows.shape[1]):
                offset = order[phrase, k]
                term = p.rows[phrase, offset]
                fits = (term < 0) | self.has(term, start + offset)
                phrase, start = phrase[fits], start[fits]
            fits = self.document(start) == self.document(start + p.lengths[phrase] - 1)
            yield phrase[fits], start[fits]

    def near(self, p: _Phrases, slop: int) -> Iterator[tuple[int, int, int]]:
        """(phrase, first, last address) of the shortest spans, at most ``slop`` words longer than the phrase, that hold all its terms."""
        for k, row in enumerate(p.rows):
            terms = np.unique(row[row >= 0])
            terms = terms[np.argsort(self.counts[terms], kind="stable")]
            if not len(terms) or not self.counts[terms[0]]:
                continue
            reach = int(p.lengths[k]) + slop
            lists = [self.at[self.first[t] : self.first[t] + self.counts[t]] for t in terms]
            anchors = lists[0]
            for other in lists[1:]:
                i = np.searchsorted(other, anchors)
                gap = np.minimum(np.abs(other[np.minimum(i, len(other) - 1)] - anchors), np.abs(other[np.maximum(i - 1, 0)] - anchors)) if len(other) else np.full(len(anchors), reach)
                anchors = anchors[gap < reach]
            found = set()
            for a in anchors.tolist():
                doc = self.document(np.array([a]))[0]
                low, high = max(a - reach + 1, self.starts[doc]), min(a + reach, self.starts[doc + 1])
                spots = sorted((int(x), t) for t, own in enumerate(lists) for x in own[np.searchsorted(own, low) : np.searchsorted(own, high)])
                last: dict[int, int] = {}
                for x, t in spots:
                    last[t] = x
                    if len(last) == len(lists) and x - (s := min(last.values())) < reach and s <= a <= x:
                        found.add((s, x))
            yield from ((k, s, e) for s, e in sorted(found) if not any(s <= s2 and e2 <= e and (s2, e2) != (s, e) for s2, e2 in found))


def _by_block(index: DataFrame, phrases: DataFrame, function, schema: str) -> DataFrame:
    """``function(phrases, block)`` of each block: its ``_Phrases`` and their postings."""
    in_phrases = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    terms = stored(in_phrases.select("term").distinct(), "terms")
    held = stored(index.filter(F.col("term").isNotNull()).join(terms, "term", "left_semi").select(index.columns), "test-postings")
    counts = held.groupBy("term").agg(F.sum("n").alias("n"))
    # of each phrase whose terms are all there, the rarest one
    rarest = in_phrases.join(counts, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("least"))
    rarest = rarest.filter("least.n > 0").select("phrase", F.col("least.term").alias("term"))
    sent = stored(held.select("block", "term").join(rarest, "term").select("block", "phrase").join(phrases, "phrase").select("block", "phrase", "terms"), "phrases-of-blocks")
    needed = sent.select("block", F.explode("terms").alias("term")).distinct()
    postings = held.join(needed, ["block", "term"], "left_semi").select(index.columns).unionByName(index.filter(F.col("term").isNull()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Phrases(left)
        return function(own, _Block(right, own.terms))

    return sent.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(lambda left, right: run(left, right), schema)


def contamination(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document of the index.

    A phrase is any ``window`` consecutive words of an item, or all words of a shorter one.  n_hit counts the words
    inside at least one occurrence; items are the sorted ids of the items with one.
    """
    phrases, owners = _phrases(items, window)

    def hits(p: _Phrases, block: _Block) -> pa.Table:
        n = len(block.doc_ids)
        edge, pairs = np.zeros(block.starts[-1] + 1, np.int64), [np.zeros(0, np.int64)]
        for phrase, start in block.exact(p):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + p.lengths[phrase], -1)
            pairs.append(np.unique(block.document(start) * len(p.ids) + phrase))
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[block.starts]
        pairs, width = np.unique(np.concatenate(pairs)), max(len(p.ids), 1)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=n))]).astype(np.int32)
        return pa.table(
            {
                "block": pa.array(np.full(n, block.number)),
                "doc": pa.array(np.arange(n, dtype=np.int32)),
                "doc_id": pa.array(block.doc_ids, pa.int64()),
                "n_words": pa.array(block.sizes),
                "n_hit": pa.array(np.diff(covered).astype(np.int64)),
                "phrases": pa.ListArray.from_arrays(bounds, pa.array(p.ids[pairs % width].astype(np.int64))),
            }
        )

    found = stored(_by_block(index, phrases, hits, "block long, doc int, doc_id long, n_words long, n_hit long, phrases array<bigint>"), "hits")
    listed = found.select("block", "doc", F.explode("phrases").alias("phrase")).join(owners, "phrase").groupBy("block", "doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.join(listed, ["block", "doc"], "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _matches(index: DataFrame, items: DataFrame, size: int | None, found) -> DataFrame:
    """(doc_id, item_id, first, last) of the spans that ``found`` gives as (phrase, first address, last address) of a block."""
    phrases, owners = _phrases(items, size)

    def rows(p: _Phrases, block: _Block) -> pa.Table:
        out = [(int(p.ids[k]), int(s), int(e)) for k, s, e in found(block, p)]
        phrase, s, e = (np.array(c, np.int64) for c in (zip(*out) if out else ([], [], [])))
        doc = block.document(s)
        ids = pa.array(block.doc_ids, pa.int64()).take(pa.array(doc))
        return pa.table({"phrase": pa.array(phrase), "doc_id": ids, "first": pa.array(s - block.starts[doc]), "last": pa.array(e - block.starts[doc])})

    spans = _by_block(index, phrases, rows, "phrase long, doc_id long, first long, last long")
    return spans.join(owners, "phrase").select("doc_id", F.col("item").alias("item_id"), "first", "last")


def exact_matches(index: DataFrame, items: DataFrame, window: int | None = None) -> DataFrame:
    """(doc_id, item_id, first, last): every occurrence of an item's whole text, or of each of its windows, by word numbers."""
    return _matches(index, items, window, lambda block, p: ((k, s, s + p.lengths[k] - 1) for phrase, start in block.exact(p) for k, s in zip(phrase, start)))


def near_matches(index: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, first, last): the shortest spans of words, counted from the document's start, that hold every
    distinct word of an item's text in any order and are at most ``slop`` words longer than it."""
    return _matches(index, items, None, lambda block, p: block.near(p, slop))


def report(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of ``contamination`` for every document."""
    found = contamination(build_index(docs), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no phrase of the items occurs."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    hit = contamination(build_index(keyed), items).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("key")).distinct()
    # a clean row goes if it shares 64 bits with a contaminated one: one in 2 ** 64 for each pair of the two kinds
    rows = packed(docs).withColumn("key", F.col("key.a"))
    return unpacked(rows.join(stored(hit, "contaminated"), "key", "left_anti"), docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = " UNION ALL ".join(
    f"SELECT r, pos, {n} AS n, concat_ws(' ', {', '.join(f'w{k}' for k in range(n))}) AS p FROM led WHERE pos + {n - 1} <= size AND {n} IN (SELECT n FROM phrases)" for n in range(1, 11)
)
#: ``report`` in SQL: runs of 1 to 10 words of each text, joined to those of the items.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
owned AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS p FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
phrases AS (SELECT DISTINCT n, p FROM owned),
words AS (SELECT r, len(w) AS size, unnest(w) AS w0, generate_subscripts(w, 1) AS pos FROM d),
led AS (SELECT *, {", ".join(f"lead(w0, {k}) OVER s AS w{k}" for k in range(1, 10))} FROM words WINDOW s AS (PARTITION BY r ORDER BY pos)),
hits AS (SELECT r, pos, n, p FROM ({_GRAMS}) SEMI JOIN phrases USING (n, p)),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + n)) AS x FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits JOIN owned USING (n, p) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
