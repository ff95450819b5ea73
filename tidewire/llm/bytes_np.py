"""Vectorised word and shingle hashing over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of 64-bit numbers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


with np.errstate(over="ignore"):
    _INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
    BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * _BASE)


def ascii_lower() -> np.ndarray:
    """A table of bytes that lower-cases A-Z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Words are what no ASCII white space is in.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are lower-case ASCII letters, digits and all bytes beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 numbers).

    ``data`` holds the rows' bytes and begins at offsets[0] == 0.
    """
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    first[inner] = w[inner]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = inner[inner > 0] - 1
    last[cut] = w[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """64-bit hashes of spans of a sequence of codes: a span's polynomial, shifted to its start, and mixed."""

    _powers = (np.ones(1, U64), np.ones(1, U64))

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if len(Spans._powers[0]) <= n:
            Spans._powers = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 1 << 20), b, U64)])) for b in (_BASE, _INVERSE))
        self.total = np.zeros(n + 1, U64)
        np.cumsum(codes * Spans._powers[0][:n], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[ends] - self.total[starts]) * Spans._powers[1][starts] + (ends - starts).astype(U64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; fewer than k words give one, of the whole sequence."""
    with np.errstate(over="ignore"):
        k = min(k, len(h))
        out = np.full(len(h) - k + 1, U64(k), U64)
        for i in range(k):
            out = mix64(out * _BASE + h[i : len(h) - k + 1 + i])
        return out


def shingle_sets(column: pa.Array, k: int, is_word: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; none for a row without words."""
    codes = BYTE_CODES[ascii_lower()]
    data, offsets = text_bytes(column)
    lower = is_word.copy()
    lower[65:91] = is_word[97:123]
    for i, j in pieces(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, at, lower)
        h = Spans(codes[part])(starts, ends)
        for r in range(j - i):
            own = h[first[r] : first[r + 1]]
            yield np.unique(shingle_hashes(own, k)) if len(own) else own
