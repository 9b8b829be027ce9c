"""Hashes of words and substrings of whole batches of texts, in numpy, without a Python object for each word.

The hash of a substring is a polynomial in its bytes modulo 2^64. With the powers of an odd base, and of its inverse,
one running sum over the batch gives the hash of any substring. mix() spreads it over all bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once: a dozen arrays of eight bytes for each of them are alive together.
STRETCH = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        out.append(powers)
    return out[0], out[1]


class Substrings:
    """Hashes of substrings of one array of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(1 << 20, 1 << int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the len + 1 places where its rows start; null is empty."""
    column = column.cast(pa.binary()) if not pa.types.is_large_binary(column.type) and not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(starts: np.ndarray, size: int):
    """Ranges of rows of about so many bytes; a longer row is a range of its own."""
    a, rows = 0, len(starts) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + size, "right")) - 1)
        yield a, b
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each word's hash, start and end (bytes), and the len + 1 places where the texts'
    words start. Words are runs of what is not ASCII white space; A-Z count as a-z."""
    black = ~_WHITE[data]
    begins = black.copy()
    begins[1:] &= ~black[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = black
    ends[1:-1] &= ~black[1:] if len(data) > 1 else True
    inner = starts[(starts > 0) & (starts < len(data))]
    both = inner[black[inner] & black[inner - 1]]
    begins[both] = True
    ends[both] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    hashes = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):  # a bounded stretch of bytes at once, however long the texts are
        b = max(a + 1, int(np.searchsorted(last, first[a] + STRETCH, "right")))
        part = data[first[a] : last[b - 1]]
        hashes[a:b] = Substrings(_LOWER[part] if lower else part).between(first[a:b] - first[a], last[a:b] - first[a])
        a = b
    return mix(hashes), first, last, np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row."""
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(BASE) + words[j : j + n])
    return out
