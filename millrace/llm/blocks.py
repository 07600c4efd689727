"""Word splitting over Arrow batches: whole texts in, flat numpy word arrays out.

Every operator that works on words shares these helpers, so that a word means the same thing everywhere.
Nulls count as empty texts.  Nothing here cuts a text: long texts make their block longer.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The C library where it has malloc_trim.
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_BYTES = np.arange(256, dtype=np.uint8)
#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.copy()
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing: digits, a-z and every non-ASCII character).
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Words of [^\x20\x09-\x0D]+.
NON_SPACE = ~np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])


@dataclass
class Words:
    """Words of the texts of one block, in order; ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # uint8, the words' bytes without anything between them
    offsets: np.ndarray  # int64, n_words + 1
    first: np.ndarray  # int64, n_texts + 1

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        offsets = self.offsets.astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each word in the distinct words, the distinct words)."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each text in them); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def split(texts: pa.Array, is_word: np.ndarray, fold: np.ndarray) -> Words:
    """Words (maximal runs of bytes of ``is_word`` within a text), each byte mapped by ``fold``."""
    data, offsets = raw(texts)
    if not len(data):
        return Words(data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(fold[data[inside]], np.concatenate([[0], np.cumsum(ends - starts)]), np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows into pieces of about ``most`` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps workers for later stages, whose needs would add up to these."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
