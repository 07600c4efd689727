"""Token-id output in a binary format with random access to any token.

``encode`` turns texts into ids with the tokenizers library, each distinct part of a word of a block once.  ``write`` takes
documents in ascending order of ids over the cluster and writes segments, each a directly addressable code (see ``dac``) of
the ids of a run of documents; a manifest gives each segment its place in the whole.  ``read`` gives the documents back,
``tokens_at`` single tokens by their place among all tokens, opening no more than their segments.

A segment is a row of Parquet whose ``image`` column holds the bytes of one DAC image, so that any store that Spark
writes to can hold the files, commits of lost tasks are undone by Spark, and readers prune by the segments' places.  The
files are neither compressed nor dictionary-encoded: an image stands in them byte for byte.

Defined cases: null and empty texts have no ids but the end id; null doc_ids come first; equal doc_ids are ordered by a
hash of the text, then by the text, and may span partitions; texts of any length are encoded whole, as a block and a segment
of their own; strings of added tokens in a text become those tokens, as in the library; other columns, whatever their names,
are ignored; an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import blocks, dac
from millrace.llm.scratch import new_path, partitions

SEGMENTS = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens long, image binary"
MANIFEST = "part int, segment int, start long, n_tokens long, n_docs int"
#: Bytes of text that are encoded at once, and tokens of a segment (a longer document is one of its own).
BLOCK, SEGMENT = 3 << 20, 1 << 18
#: Bytes of plain words: ASCII, and the two bytes of U+00C0 to U+023F, all of which are Latin letters but those in _ODD.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LATIN = np.array([b < 128 or 0xC3 <= b <= 0xC8 or 0x80 <= b < 0xC0 for b in range(256)])
#: The multiplication and division signs, and a capital that becomes two characters in small letters.
_ODD = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: Units to a text of the library's model.
_TOGETHER = 500


class _Tokenizer:
    """A tokenizer of the library, and a shorter way for words of Latin letters, digits and ASCII punctuation.

    Most of the library's time goes into normalising texts and finding the parts of words.  For such words both are known
    beforehand: parts are runs of letters, single digits and runs of other characters, put in small letters and byte symbols
    here for all words of a block at once, and the library's model gets the distinct parts with blanks between, to be cut at
    the blanks only.  Words with an apostrophe, with characters beyond those, or with the text of an added token go to the
    library alone.  Some texts go both ways first; if any ids differ, the tokenizer is of another kind, and the library gets
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.short = Tokenizer(self.whole.model)
        self.short.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, k in self.whole.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        added = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        # the symbols of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in shown]
        symbol = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.symbol = np.array([list(symbol[b].encode().ljust(2, b"\0")) for b in range(256)], np.uint8)
        # letters beyond ASCII in small letters; in U+0100 to U+023F some stay as they are and some change by more than one
        self.lower = {c: chr(c).lower().encode() for c in range(0xC0, 0x240) if chr(c).lower() != chr(c)}
        self.fits = not any(t.lstrip or t.rstrip or t.single_word or set(t.content) & set(" \t\r\n\v\f") for t in added) and self._same()

    def _same(self) -> bool:
        stems = ["The", "qu\u00e9", "\u00c0\u00c9\u00ce", "stra\u00dfe", "\u00dcberm\u00e4\u00dfig", "na\u00efve", "x", "Internationalisation", "\u00f8re", "\u010cESK\u00dd", "12", "a1b", "\u65e5\u672c", "it's", "\u0130", "\u00d7"]
        tails = ["", ".", ",", "!!", "***", "&&&", ")", "...", "</w>", "|", "?!", ":", "-x", "=1.5", *(t.decode() for t in self.added)]
        texts = [f"{s}{t}\n {t}  {s}" for s in stems for t in tails]
        texts.append(" ".join(chr(c) + "x" for c in range(0xA0, 0x250)))
        ids, n = self.by_words(pa.array(texts))
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [c.ids for c in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) from the library."""
        lists = [np.array(c.ids, "<u4") for c in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *lists]), np.array([len(x) for x in lists], np.int64)

    def together(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of ids of each), many parts to a text, told apart by the ids that end a word."""
        data, offsets = blocks.raw(units)
        two = self.symbol[data]
        wide = two[:, 1] > 0
        size = np.concatenate([[0], np.cumsum(1 + wide, dtype=np.int64)])[offsets] + np.arange(len(offsets))
        text = np.full(int(size[-1]), 32, np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(len(units)), np.diff(offsets))
        place[1:] += np.cumsum(wide[:-1])
        text[place] = two[:, 0]
        text[place[wide] + 1] = two[wide, 1]
        text = text.tobytes()
        cuts = np.append(np.arange(0, len(units), _TOGETHER), len(units))
        groups = [text[a : b - 1].decode() for a, b in zip(size[cuts[:-1]].tolist(), size[cuts[1:]].tolist())]
        lists = [np.array(c.ids, "<u4") for c in self.short.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *lists])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(units) or any(len(x) and not self.ends[x[-1]] for x in lists):
            raise ValueError("a part of a word has no end of its own in this vocabulary")
        return ids, np.diff(ends, prepend=0)

    def _small(self, units: list[bytes]) -> list[bytes]:
        return [b"".join(self.lower.get(ord(c), c.encode()) for c in u.decode()) for u in units]

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), each distinct part of a word encoded once."""
        words = blocks.split(texts, blocks.NON_SPACE, blocks.LOWER)
        data, bounds, n = words.data, words.offsets, len(words)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        odd = ~_LATIN[data] | (data == 0x27)
        for a, b in _ODD:
            odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
        spots = [np.flatnonzero(odd)]
        for token in self.added:  # found by its first two bytes, which is more than enough
            low = np.frombuffer(token, np.uint8)
            low = blocks.LOWER[low]
            spots.append(np.flatnonzero((data[:-1] == low[0]) & (data[1:] == low[1])) if len(low) > 1 else np.flatnonzero(data == low[0]))
        hard = np.zeros(n, bool)
        hard[np.searchsorted(bounds, np.concatenate(spots), side="right") - 1] = True
        # parts begin at the start of a word, at a digit, and where the kind of character changes
        kind = np.where(_DIGIT[data], 2, _LETTER[data]).astype(np.uint8)
        begins = kind == 2
        begins[1:] |= kind[1:] != kind[:-1]
        begins[bounds[:-1]] = True
        if hard.any():  # an odd word is one part
            inner = np.repeat(hard, np.diff(bounds))
            inner[bounds[:-1]] = False
            begins &= ~inner
        start = np.flatnonzero(begins)
        parts = blocks.Words(data, np.append(start, len(data)), np.searchsorted(start, bounds))
        of_part = np.repeat(hard, np.diff(parts.first))
        which, distinct = blocks.Words(*_some(parts, ~of_part), np.zeros(1)).encoded()
        tall = pc.not_equal(pc.binary_length(distinct), pc.utf8_length(distinct.cast(pa.string()))).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(tall)
        small = distinct.cast(pa.binary())
        if len(at):
            small = pc.replace_with_mask(small, pa.array(tall), pa.array(self._small(small.take(pa.array(at)).to_pylist()), pa.binary()))
        ids, sizes = self.together(small)
        number = np.empty(len(of_part), np.int64)
        number[~of_part] = which
        if of_part.any():
            # odd words as they stand in the texts, not in small letters
            own = blocks.split(texts, blocks.NON_SPACE, blocks.SAME)
            which, distinct = blocks.Words(*_some(own, hard), np.zeros(1)).encoded()
            more, counts = self.alone([w.decode() for w in distinct.to_pylist()])
            number[of_part] = which + len(sizes)
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, counts])
        first, lengths = np.cumsum(sizes) - sizes, sizes[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])[parts.first[words.first]]
        return ids[blocks.ragged(first[number], lengths)], np.diff(ends)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        return self.by_words(texts) if self.fits else self.alone([t or "" for t in texts.to_pylist()])


def _some(words: blocks.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of some of the words."""
    size = np.diff(words.offsets)
    return words.data[np.repeat(chosen, size)], np.concatenate([[0], np.cumsum(size[chosen])])


_tokenizer = lru_cache(maxsize=1)(_Tokenizer)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks.slices(batches, "text", block_bytes):
        flat, n = _tokenizer(path).ids(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(n)])
        if end_id is not None:
            flat, ends = np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, end_id: int | None, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers) of each row; ``end_id`` is put after each document."""
    return _texts(docs).mapInArrow(lambda batches: _encoded(batches, path, end_id, block_bytes), "doc_id long, ids binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """Documents in ascending doc_id order, over partitions and within them; equal ids by a hash of the text, so that they
    may be split.

    The texts are what is moved: they are smaller than their ids, and an exchange of encoded rows would encode them twice,
    once to find the ranges.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    rows = _texts(docs).withColumn("hash", F.xxhash64("text"))
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")


def _packed(batches: Iterator[pa.RecordBatch], segment_tokens: int, width: int | None) -> Iterator[pa.RecordBatch]:
    """Segments from (doc_id, ids), in their order."""
    part, segment, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

    def made() -> pa.RecordBatch:
        counts = [len(ids) // 4 for ids in held]
        image = dac.build(np.frombuffer(b"".join(held), "<u4"), width)
        row = {"part": part, "segment": segment, "doc_ids": docs, "doc_tokens": counts, "n_tokens": sum(counts), "image": image}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("image", pa.binary())])
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = ids.as_py() or b""
            docs.append(doc)
            held.append(ids)
            size += len(ids) // 4
            if size >= segment_tokens:
                yield made()
                segment, docs, held, size = segment + 1, [], [], 0
    if docs:
        yield made()


def write(encoded: DataFrame, path: str, segment_tokens: int = SEGMENT, width: int | None = None) -> None:
    """Writes (doc_id, ids), which must be ``in_order``, under ``path``: segments in ``path/segments``, ``path/manifest``."""
    _write(encoded.mapInArrow(lambda batches: _packed(batches, segment_tokens, width), SEGMENTS), path)


def write_texts(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, segment_tokens: int = SEGMENT, width: int | None = None) -> None:
    """Encodes and writes documents that are ``in_order``: as ``encode`` and ``write``, in one worker for each task."""
    _write(_texts(docs).mapInArrow(lambda batches: _packed(_encoded(batches, tokenizer, end_id, BLOCK), segment_tokens, width), SEGMENTS), path)


def _write(segments: DataFrame, path: str) -> None:
    spark = segments.sparkSession
    plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
    segments.write.options(**plain).parquet(f"{path}/segments")
    sizes = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").select("part", "segment", F.col("n_tokens"), F.size("doc_ids").alias("n_docs"))
    # one row for each part, of which there are as many as shuffle partitions
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = Window.partitionBy("part").orderBy("segment")
    placed = sizes.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts.select("part", "base"), "part")
    placed.select("part", "segment", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "n_docs").write.parquet(f"{path}/manifest")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(manifest.select("part", "segment", "start"), ["part", "segment"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, first_id, last_id): each document as it stands in the files under ``path``.

    The checksum is of all its ids; the first and the last one are looked up by their places (null without ids).
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, sizes, start, image in zip(*(batch.column(k) for k in range(4))):
                reader, n = dac.Reader(image.as_buffer()), np.array(sizes.as_py(), np.int64)
                ids, ends = reader.all(np.uint32).astype("<u4", copy=False).data.cast("B"), np.cumsum(n)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                has, bounds = np.flatnonzero(n), []
                for places in ((ends - n)[has], ends[has] - 1):
                    found = np.zeros(len(n), np.int64)
                    found[has] = reader.get(places).astype(np.int64)
                    bounds.append(pa.array(found, mask=n == 0))
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64()), *bounds], names=names)
            blocks.give_back()

    rows = _segments(spark, path).select("doc_ids", "doc_tokens", "start", "image")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for places (column ``place``) among all tokens of the files; each is read alone from its segment.

    Places and segments meet by equal ranges of ``step`` tokens, so neither side is sent whole to any task.
    """
    step = SEGMENT
    spans = F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / step))
    segments = _segments(spark, path).select("start", "n_tokens", "image", F.explode(spans).alias("range"))
    asked = places.select("place", F.floor(F.col("place") / step).alias("range"))
    met = asked.join(segments.select("range", "start", "n_tokens"), "range").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_tokens")))
    # the places of one segment are gathered in runs of bounded length before its image joins them
    runs = met.groupBy("start", "range", F.pmod(F.col("place"), F.lit(64)).alias("run")).agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, start, image in zip(*(batch.column(k) for k in range(3))):
                at = np.array(wanted.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dac.Reader(image.as_buffer()).get(at - start.as_py()).astype(np.int64))], names=["place", "id"])

    return runs.join(segments.select("start", "range", "image"), ["start", "range"]).select("places", "start", "image").mapInArrow(run, "place long, id long")


def files_and_back(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes, writes and reads the documents."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_texts(in_order(docs), path, tokenizer, end_id)
    return read(spark, path)
