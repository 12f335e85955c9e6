"""Vectorised word kernels over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Every hash is a
function of the word's bytes alone, so it is the same on every executor.  Operators that
work on hashes tell words (shingles) apart by 64 (63) bits; the word hash is a polynomial
modulo 2**64, for which pairs of words of a thousand characters and more with one hash
can be constructed on purpose, but do not come about by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text hashed at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        p = np.full(size, _BASE, dtype=U)
        p[0] = 1
        q = np.full(size, pow(_BASE, -1, 1 << 64), dtype=U)
        q[0] = 1
        built = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > CHUNK_BYTES:
            return built
        _powers["p"], _powers["q"] = built
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def string_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay under ``limit`` (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation.
WHITE_OR_PUNCTUATION = WHITE.copy()
WHITE_OR_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in bytes, and the first word of each row (one longer)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = white[1:]
    ends = np.flatnonzero(~white & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, and the first word of each row (one longer)."""
    starts, ends, first = word_spans(data, offsets, separators)
    if len(starts) == 0:
        return np.zeros(0, U), first
    b = data.astype(U)
    if lower:
        b[(data >= 65) & (data <= 90)] += U(32)
    b += U(1)
    p, q = _power_tables(len(data))
    b *= p[: len(data)]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(b, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93))), first


def rows_of_words(
    col: pa.Array, lower: bool = True, separators: np.ndarray = WHITE
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Over chunks of a column: (first row, word hashes, first word of each row)."""
    data, offsets = string_column(col)
    for a, b in chunks(offsets):
        lo, hi = offsets[a], offsets[b]
        h, first = word_hashes(data[lo:hi], offsets[a : b + 1] - lo, lower, separators)
        yield a, h, first


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k-1 positions are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * U(0x2545F4914F6CDD1D) + h[j : j + n])
    return out


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct 63-bit hashes of its k-word shingles.

    With fewer than k words the whole sequence is one shingle; without words the
    set is empty.
    """
    for _, h, first in rows_of_words(col):
        every = shingles(h, k) >> U(1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(every[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                one = h[a : a + 1]
                for j in range(a + 1, b):
                    one = mix(one * U(0x2545F4914F6CDD1D) + h[j : j + 1])
                yield mix(one ^ U(b - a)) >> U(1)
            else:
                yield np.zeros(0, U)
