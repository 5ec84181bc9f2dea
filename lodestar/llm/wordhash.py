"""Vectorised word splitting and polynomial (Rabin-Karp) hashing of UTF-8 text batches.

Everything works on the raw buffers of an Arrow string column: one uint8 array that holds
all texts of a slice back to back, and the offsets of each text.  A *word* is a maximal run
of bytes that a 256-entry table marks as word bytes; all word definitions used in this
package are decidable byte by byte because every non-ASCII code point counts as a letter.

Hashes are arithmetic modulo 2**64 with odd bases, so a hash of any span is
``(prefix[end] - prefix[start]) * base**-start`` and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK64 = (1 << 64) - 1
#: Text bytes handled by one vectorised step; a longer single text is a step of its own.
SLICE_BYTES = 1 << 18

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x41:0x5B] = True
    table[0x80:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche (splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=3)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, U64(b), dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; tables are cached by rounded-up size."""
    size = 1 << max(12, int(n - 1).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(_BYTE_BASE))
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


@dataclass
class Words:
    """Words of a slice of texts.  ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes.

    Null rows have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool) -> Words:
    """Words and their 64-bit hashes.  ``lower`` makes A-Z count as a-z."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.empty(0, U64))
    inside = word_byte[data]
    cut = np.zeros(n + 1, dtype=bool)  # a text begins or the slice ends here
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets)
    up, down = powers(_BYTE_BASE | 1, n)
    prefix = np.empty(n + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum(_byte_values(lower)[data] * up, out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts])
    return Words(data, starts, ends, first, hashes)


def span_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values (not yet aware of text ends)."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=U64)
    up, down = powers(_WORD_BASES[which], n)
    prefix = np.empty(n + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum(values * up, out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * down[: n - width + 1])


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each range ``values[begin:end]``; the length takes part."""
    n = len(values)
    up, down = powers(_WORD_BASES[which], max(n, 1))
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * up[:n], out=prefix[1:])
    at = np.minimum(begin, max(n - 1, 0))
    return mix(((prefix[end] - prefix[begin]) * down[at]) ^ mix((end - begin).astype(U64)))


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ``width``-word windows that lie in one text, and the index of that text."""
    per_text = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    done = np.cumsum(per_text) - per_text
    return np.arange(len(text)) + (first[:-1] - done)[text], text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of each text's kept words joined by one space, and the bounds of the texts."""
    n_texts = len(words.first) - 1
    if not len(words.starts):
        return np.empty(0, np.uint8), np.zeros(n_texts + 1, np.int64)
    kept = np.flatnonzero(keep)
    text = np.searchsorted(words.first, kept, side="right") - 1
    follows = np.zeros(len(kept), bool)  # another kept word of the same text follows
    follows[:-1] = text[1:] == text[:-1]
    size = words.ends[kept] - words.starts[kept] + follows
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.starts[kept]] += 1
    stop = words.ends[kept] + follows
    np.subtract.at(edge, stop, 1)
    data = words.data.copy()
    data[words.ends[kept[follows]]] = 0x20
    out = data[np.cumsum(edge[:-1]) > 0]
    per_text = np.bincount(text, weights=size, minlength=n_texts).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_text)])


class HashIndex:
    """Finds the few values that are in a fixed sorted list among many."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes
        self.bits = min(24, max(10, int(len(sorted_hashes) * 16).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(sorted_hashes >> U64(64 - self.bits)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that are listed, and their places in the list."""
        if not len(self.hashes) or not len(values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.filter[(values >> U64(64 - self.bits)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, values[maybe]), len(self.hashes) - 1)
        true = self.hashes[at] == values[maybe]
        return maybe[true], at[true]
