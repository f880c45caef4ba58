"""Vectorised word hashing over the UTF-8 buffers of Arrow string columns.

All functions work on whole texts.  Rows are taken in runs of about ``CHUNK`` bytes, so the
extra memory is a small multiple of ``CHUNK`` (or of the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow: dict[str, np.ndarray] = {}

#: Blank characters of the word definition ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters, digits and multi-byte characters.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _pow[key] = np.cumprod(run, dtype=np.uint64)
    return _pow["p"][:n], _pow["i"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null takes no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def runs(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _pieces(raw: np.ndarray, gap: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long buffer that never split a word."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + limit)
        while b < len(raw) and not gap[raw[b - 1]]:
            more = np.flatnonzero(gap[raw[b : b + limit]])
            b = b + int(more[0]) + 1 if len(more) else min(len(raw), b + limit)
        yield a, b
        a = b


def _words(raw: np.ndarray, bounds: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``bounds``: positions where a text begins."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~gap[raw]
    first = np.ones(len(raw), bool)
    first[1:] = ~inside[:-1]
    first[bounds[bounds < len(raw)]] = True
    start = np.flatnonzero(inside & first)
    if not len(start):
        return np.zeros(0, np.uint64), start
    stop_here = np.ones(len(raw), bool)
    stop_here[:-1] = first[1:] | ~inside[1:]
    end = np.flatnonzero(inside & stop_here) + 1
    p, inv = _powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64)), start


def fold_case(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (two bytes each)."""
    low = LOWER[raw]
    if len(raw) > 1:
        big = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[big] += 32
    return low


def word_hashes(column: pa.Array, gap: np.ndarray = BLANK, latin: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, 64-bit hashes of the words, offsets of the rows in them) for runs of rows."""
    raw, offs = buffers(column)
    for i, j in runs(offs):
        part = raw[offs[i] : offs[j]]
        part = fold_case(part) if latin else LOWER[part]
        own = offs[i : j + 1] - offs[i]
        if len(part) <= 2 * CHUNK:
            h, at = _words(part, own[:-1], gap)
            yield i, h, np.searchsorted(at, own)
        else:  # one long text
            got = [_words(part[a:b], np.zeros(0, np.int64), gap)[0] for a, b in _pieces(part, gap, CHUNK)]
            h = np.concatenate(got)
            yield i, h, np.array([0, len(h)])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words as one if there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for q in range(width):
        h = mix(h * _P + words[q : q + len(h)])
    return np.unique(h)
