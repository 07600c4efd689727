"""Directly addressable codes: lists of integers in chunk levels, any of which is found without decoding others.

A value is cut into chunks, lowest bits first.  Level k holds the k-th chunk of every value that has one, beside a bitmap
that says which of those values go on in level k + 1, and a rank directory with the number of set bits before each group
of 512.  The place of a value in the next level is the rank of its bit; so value i is read with one look-up per level.
Widths of the levels are those that make the whole smallest, found from how many values need how many bits, unless given.

An image is little-endian: magic "DAC2", u32 levels, u64 number of values; then for each level: u32 chunk width in bits,
u32 zero, u64 entries, the chunks one after the other without gaps (entry i at bit i * width) in u64 words with a word of
zeros after them, the bitmap in u64 words, bit i % 64 of word i / 64 for entry i, and u64 counts of set bits before each
group of 8 words.  The last level has an all-zero bitmap.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC2"
_GROUP = 8
#: Bits that an entry costs beside its chunk: one of the bitmap, and its share of the rank directory.
_BESIDE = 1 + 1 / 8
_ONE = np.uint64(1)


def widths_for(values: np.ndarray) -> list[int]:
    """The widths of levels, lowest first, of the smallest image of these values."""
    bits = int(values.max()).bit_length() if len(values) else 0
    if not bits:
        return [1]
    over = [len(values), *(int((values >> np.uint64(k) > 0).sum()) for k in range(1, bits))]  # values with bits from k on
    best: list[tuple[float, int]] = [(0.0, 0)] * (bits + 1)  # cost of levels from bit k on, width of the first of them
    for k in range(bits - 1, -1, -1):
        best[k] = min((over[k] * (w + _BESIDE) + best[k + w][0], w) for w in range(1, min(32, bits - k) + 1))
    out, k = [], 0
    while k < bits:
        out.append(best[k][1])
        k += best[k][1]
    return out


def _pack(chunks: np.ndarray, width: int) -> bytes:
    size = 8 * (1 if width <= 8 else 2 if width <= 16 else 4)
    bits = np.unpackbits(chunks.astype(f"<u{size // 8}").view(np.uint8).reshape(len(chunks), size // 8), axis=1, bitorder="little")[:, :width]
    data = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return data + b"\0" * (-len(data) % 8 + 8)


def build(values: np.ndarray, width: int | None = None) -> bytes:
    """The image of non-negative integers; ``width`` makes all levels of that width (1 to 32)."""
    if width is not None and not 1 <= width <= 32:
        raise ValueError("width must be 1 to 32")
    rest = np.asarray(values)
    rest = rest if rest.dtype in (np.uint32, np.uint64) else rest.astype(np.uint64)
    widths, levels, n = widths_for(rest) if width is None else None, [], len(rest)
    kind = rest.dtype.type
    while True:
        w = widths[min(len(levels), len(widths) - 1)] if widths else width
        chunks = rest & kind((1 << w) - 1)
        rest = rest >> kind(w) if w < 8 * rest.itemsize else np.zeros_like(rest)
        more = rest > 0
        data = np.packbits(more, bitorder="little").tobytes()
        words = np.frombuffer(data + b"\0" * (-len(data) % 8), "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        groups = np.add.reduceat(ones, np.arange(0, len(ones), _GROUP)) if len(ones) else ones
        before = (np.cumsum(groups) - groups).astype("<u8")
        levels.append(struct.pack("<IIQ", w, 0, len(chunks)) + _pack(chunks, w) + words.tobytes() + before.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    return MAGIC + struct.pack("<IQ", len(levels), n) + b"".join(levels)


class Reader:
    """Random access to the values of an image (bytes, a memory map or any other buffer)."""

    def __init__(self, image):
        view = memoryview(image)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a DAC image")
        n_levels, self.n = struct.unpack_from("<IQ", view, 4)
        at, self.levels = 16, []
        for _ in range(n_levels):
            width, _, n = struct.unpack_from("<IIQ", view, at)
            at += 16
            chunks = np.frombuffer(view, "<u8", -(-n * width // 64) + 1, at)
            at += chunks.nbytes
            words = np.frombuffer(view, "<u8", -(-n // 64), at)
            at += words.nbytes
            before = np.frombuffer(view, "<u8", -(-len(words) // _GROUP), at)
            at += before.nbytes
            self.levels.append((width, n, chunks, words, before))

    def __len__(self) -> int:
        return self.n

    def get(self, places) -> np.ndarray:
        """The values at these places, each read on its own."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError("place out of range")
        out = np.zeros(len(places), np.uint64)
        on, shift = np.arange(len(places)), 0
        for width, _, chunks, words, before in self.levels:
            word, low = places * width >> 6, (places * width & 63).astype(np.uint64)
            # the part in the next word: none of it if the chunk begins at a word's start
            high = np.where(low > 0, chunks[word + 1] << (np.uint64(64) - np.maximum(low, _ONE)), np.uint64(0))
            out[on] |= (((chunks[word] >> low) | high) & np.uint64((1 << width) - 1)) << np.uint64(shift)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            more = (words[word] >> bit) & _ONE == 1
            on, word, bit = on[more], word[more], bit[more]
            if not len(on):
                break
            rank = before[word // _GROUP].astype(np.int64) + np.bitwise_count(words[word] & ((_ONE << bit) - _ONE))
            for k in range(1, _GROUP):  # whole words of the group before this one
                inside = word % _GROUP >= k
                rank[inside] += np.bitwise_count(words[word[inside] - k])
            places, shift = rank, shift + width
        return out

    def all(self, kind: type = np.uint64) -> np.ndarray:
        """Every value, in order: each level's chunks go to the entries whose bits say so."""
        out = np.zeros(self.n, kind)
        on, shift = None, 0
        for width, n, chunks, words, _ in self.levels:
            size = 1 if width <= 8 else 2 if width <= 16 else 4
            bits = np.unpackbits(chunks.view(np.uint8), count=n * width, bitorder="little").reshape(n, width)
            filled = np.zeros((n, 8 * size), np.uint8)
            filled[:, :width] = bits
            part = np.packbits(filled, axis=1, bitorder="little").view(f"<u{size}").ravel().astype(kind) << kind(shift)
            if on is None:
                out |= part
            else:
                out[on] |= part
            more = np.unpackbits(words.view(np.uint8), count=n, bitorder="little").view(bool)
            on = np.flatnonzero(more) if on is None else on[more]
            shift += width
        return out
