"""Statistics of whole texts, computed a block of texts at a time.

Words are maximal runs of anything but ASCII white space.  A null text counts as empty and has zeros everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks

#: Name and meaning of every count.
COUNTS = {
    "n_words": "words",
    "word_chars": "code points in words",
    "n_symbols": "characters of #*$%&|<>",
    "n_dup_lines": "lines with a word that equal an earlier line",
    "n_repeat_words": "words in windows of five words that occur twice or more in the text",
    "n_lines": "lines with a word",
    "n_upper": "ASCII capitals",
    "n_digits": "ASCII digits",
    "n_marks": "characters of ! and ?",
    "n_stops": "characters of . , ; and :",
    "n_distinct": "distinct words",
    "n_again": "words equal to the word before",
}
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), list(b"!?"))
_STOP = np.isin(np.arange(256), list(b".,;:"))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[first])


def _distinct_per(keys: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    pairs = np.sort(owner * width + keys)
    fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
    return np.bincount(pairs[fresh] // width, minlength=n)


def _repeated(word: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each text inside a window of ``size`` words that the text holds at least twice."""
    n = len(first) - 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    start = blocks.ragged(first[:-1], counts)
    if not len(start):
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), counts)
    key = blocks.mix(owner)
    for k in range(size):
        key = blocks.mix(key ^ word[start + k].astype(np.uint64)) if k % 2 else (key * np.uint64(0x9E3779B97F4A7C15)) ^ word[start + k].astype(np.uint64)
    key = blocks.mix(key)
    order = np.argsort(key, kind="stable")
    a, b = start[order[:-1]], start[order[1:]]
    same = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    for k in range(size):
        same &= word[a + k] == word[b + k]
    twice = np.zeros(len(word) + 1, np.int64)
    hit = np.unique(np.concatenate([a[same], b[same]]))
    twice[hit] += 1
    np.subtract.at(twice, hit + size, 1)
    return _per(np.cumsum(twice)[:-1] > 0, first)


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = blocks.raw(texts)
    n = len(offsets) - 1
    inside = blocks.NON_SPACE[data]
    words = blocks.split(texts, blocks.NON_SPACE, blocks.SAME)
    which, distinct = words.encoded()
    which = which.astype(np.int64)
    owner = words.text_of_word()
    again = np.zeros(len(which), bool)
    again[1:] = (which[1:] == which[:-1]) & (owner[1:] == owner[:-1])
    # lines: cut after line feeds and at the ends of texts
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([offsets[1:], feeds]))
    # a text's end and the next one's start fall together: pair them in order, empty texts have one empty line
    line_of = np.repeat(np.arange(n), 1 + _per(data == 10, offsets))
    solid = np.concatenate([[0], np.cumsum(inside)])
    has = solid[ends] > solid[starts]
    kept_s, kept_e, line_of = starts[has], ends[has], line_of[has]
    body = data[blocks.ragged(kept_s, kept_e - kept_s)]
    lines, _ = blocks.Words(body, np.concatenate([[0], np.cumsum(kept_e - kept_s)]), np.zeros(1)).encoded()
    n_lines = np.bincount(line_of, minlength=n)
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per(inside & _LEAD[data], offsets),
        "n_symbols": _per(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - _distinct_per(lines.astype(np.int64), line_of, n, max(len(lines), 1)),
        "n_repeat_words": _repeated(which, words.first),
        "n_lines": n_lines,
        "n_upper": _per(_UPPER[data], offsets),
        "n_digits": _per(_DIGIT[data], offsets),
        "n_marks": _per(_MARK[data], offsets),
        "n_stops": _per(_STOP[data], offsets),
        "n_distinct": _distinct_per(which, owner, n, max(len(distinct), 1)),
        "n_again": _per(again, words.first),
    }


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and all COUNTS of the column ``text`` of each row."""
    kept = docs.select(F.col("text").cast("string").alias("text"), *keep)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"{k} long" for k in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 4 << 20):
            found = counts_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(found[k].astype(np.int64)) for k in COUNTS)], names=[*keep, *COUNTS])

    return kept.mapInArrow(run, schema)


def ratios() -> dict[str, object]:
    """Columns that compare texts of any length, from the counts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "capital_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "stops_per_word": F.col("n_stops") / words,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_share": F.col("n_repeat_words") / words,
        "again_share": F.col("n_again") / words,
        "distinct_share": F.col("n_distinct") / words,
        "mean_word_length": F.col("word_chars") / words,
        "words": F.col("n_words").cast("double"),
    }
