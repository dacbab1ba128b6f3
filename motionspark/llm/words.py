"""Vectorised words over UTF-8 bytes: spans, 64-bit word hashes and n-gram hashes.

A slice of texts is one byte buffer plus offsets. Word characters are given by a 256-entry byte table,
so a class such as ``[^\\x20\\x09-\\x0D]`` costs one table lookup per byte. A word's hash is a polynomial
over its bytes (A-Z folded where asked), taken from one running sum, so it does not depend on position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=U64) * _BASE)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _BYTES[_FOLD]

BYTE = np.arange(256)
#: [^\x20\x09-\x0D]
NOT_SPACE = ~((BYTE == 32) | ((BYTE >= 9) & (BYTE <= 13)))
#: letters, digits and everything outside ASCII
ALNUM = (BYTE >= 128) | ((BYTE >= 48) & (BYTE <= 57)) | ((BYTE >= 65) & (BYTE <= 90)) | ((BYTE >= 97) & (BYTE <= 122))
#: first bytes of code points
LEADS = (BYTE & 0xC0) != 0x80


class _Powers:
    """Powers of the base and of its inverse, extended as longer slices come."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            steps = np.full(size, _BASE, U64)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=U64)
            steps[1:] = _BASE_INVERSE
            cls.down = np.cumprod(steps, dtype=U64)
        return cls.up, cls.down


@dataclass
class Slice:
    """Some rows' texts: ``data`` bytes, ``offsets`` (rows + 1), and the index of the first row in its batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words in order: byte spans, row of each, and for each row its first word's index (rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of about ``limit`` bytes each; a longer text is a slice of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(part: Slice, table: np.ndarray) -> Words:
    n = len(part.data)
    inside = table[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True  # words do not run from one text into the next
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, part.offsets)
    return Words(start, end, np.repeat(np.arange(part.rows), np.diff(first)), first)


def hashes(part: Slice, found: Words, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``fold``: A-Z count as a-z."""
    n = len(part.data)
    up, down = _Powers.upto(n + 1)
    running = np.zeros(n + 1, U64)
    np.cumsum((_FOLDED if fold else _BYTES)[part.data] * down[:n], out=running[1:])
    return mix((running[found.end] - running[found.start]) * up[found.start] + (found.end - found.start).astype(U64))


def hash_word(word: str) -> int:
    """The folded hash of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    part = Slice(0, data, np.array([0, len(data)]))
    whole = Words(np.array([0]), np.array([len(data)]), np.array([0]), np.array([0, 1]))
    return int(hashes(part, whole)[0])


def text_hashes(part: Slice) -> np.ndarray:
    """A hash of each row's whole text, case kept."""
    whole = Words(part.offsets[:-1], part.offsets[1:], np.arange(part.rows), np.arange(part.rows + 1))
    return hashes(part, whole, fold=False)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a row, and the index of each run's first word."""
    size = max(0, len(h) - n + 1)
    at = np.flatnonzero(row[:size] == row[n - 1 :][:size])
    out = np.zeros(size, U64)
    for i in range(n):
        out = out * _BASE + h[i : i + size]
    return mix(out[at]), at


def shingles(h: np.ndarray, found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words and their rows; a row of one to ``n`` - 1 words gives one shingle of them all."""
    grams, at = ngrams(h, found.row, n)
    rows = found.row[at]
    short = np.flatnonzero((found.per_row > 0) & (found.per_row < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(n - 1):
            has = found.per_row[short] > i
            extra[has] = extra[has] * _BASE + h[found.first[short[has]] + i]
        grams = np.concatenate([grams, mix(extra ^ U64(0x5851F42D4C957F2D))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        grams, rows = grams[order], rows[order]
    return grams, rows
