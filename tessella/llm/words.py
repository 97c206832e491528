"""Word hashing over Arrow string batches without a Python loop over words.

A slice of texts is looked at as one byte array; words are maximal runs of word
bytes, and hashes of words and of word windows are computed with NumPy on all
texts of the slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space. UTF-8 keeps such bytes out of longer code points.
WHITESPACE_WORDS = np.ones(256, dtype=bool)
WHITESPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False

#: ASCII letters and digits and all that is not ASCII; ASCII punctuation and control characters separate.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    ALNUM_WORDS[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text, or of one longer text, and of at most ``max_rows``."""
    _, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte range and hash of each; ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(column: pa.Array, word_bytes: np.ndarray) -> Words:
    data, offsets = utf8(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U64))
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]  # first byte of each text that has any
    begins[at] = inside[at]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, offsets, start, end, first, np.zeros(0, U64))
    length = end - start
    powers = np.cumprod(np.full(int(length.max()) + 1, _BASE, dtype=U64))
    spans = np.diff(np.append(start, len(data)))
    at_in_word = np.arange(start[0], len(data)) - np.repeat(start, spans)
    inside = inside[start[0] :]
    values = np.where(inside, _BYTE_VALUES[data[start[0] :]] * powers[np.minimum(at_in_word, len(powers) - 1)], U64(0))
    return Words(data, offsets, start, end, first, mix(np.add.reduceat(values, start - start[0]) + length.astype(U64)))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive word hashes, of which there are ``len(hashes) - n + 1``.

    Built by doubling, so that it takes about ``2 log2(n)`` passes.
    """
    if len(hashes) < n:
        return np.zeros(0, U64)
    done, have, part, width, left = None, 0, hashes, 1, n
    power = _BASE
    while left:
        if left & 1:
            if done is None:
                done = part
            else:
                k = min(len(done), len(part) - have)
                done = done[:k] * power + part[have : have + k]
            have += width
        left >>= 1
        if left:
            part = part[:-width] * power + part[width:]
            width, power = 2 * width, U64(int(power) ** 2 % 2**64)
    return mix(done[: len(hashes) - n + 1] + U64(n))


def windows_inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows that ``window_hashes`` gives lie within one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(total - n + 1) + n <= end[: total - n + 1]
