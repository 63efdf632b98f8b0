"""Vectorised word hashing over UTF-8 columns, shared by the operators that work on words.

Words are the runs of bytes that are no ASCII white space (x20, x09-x0D), which splits a
UTF-8 text exactly as ``[^\\x20\\x09-\\x0D]+`` splits its code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 400_000
CHUNK_ROWS = 256
PIECE_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words whose output bits look independent."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text and ``most_rows`` rows at most (a longer text has a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit or i - start >= most_rows:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and number of words before each row (rows+1 entries)."""
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers
    if len(held[0]) < n:
        held = [np.full(n, base, np.uint64) for base in (_BASE, _INVERSE)]
        for steps in held:
            steps[0] = 1
            np.cumprod(steps, out=steps)
        if n <= PIECE_BYTES + 1:
            _powers[:] = held
    return held[0][:n], held[1][:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial prefix hash, shifted to the word's start and mixed.

    The prefix starts again every PIECE_BYTES, so that what is held for it doesn't grow with the text.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(data) > PIECE_BYTES and end[-1] - start[0] > PIECE_BYTES and len(start) > 1:
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
            low, high = int(start[i]), int(end[j - 1])
            out[i:j] = word_hashes(data[low:high], start[i:j] - low, end[i:j] - low)
            i = j
        return out
    power, inverse = _grown(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * power[:-1], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words before each row; long texts are gone through in pieces cut at white space."""
    cuts = [0]
    while cuts[-1] < len(data):
        at = min(cuts[-1] + PIECE_BYTES, len(data))
        while at < len(data) and not SPACE[data[at]]:
            ahead = np.flatnonzero(SPACE[data[at : at + 4096]])
            at = at + int(ahead[0]) if len(ahead) else min(at + 4096, len(data))
        cuts.append(at)
    bounds, found, total = np.zeros(len(offsets), np.int64), [np.zeros(0, np.uint64)], 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        i, j = np.searchsorted(offsets, (a, b))
        part = lower_ascii(data[a:b]) if lower else data[a:b]
        start, end, before = word_bounds(part, np.concatenate(([0], offsets[i:j] - a, [b - a])))
        found.append(word_hashes(part, start, end))
        bounds[i:j] = total + before[1:-1]
        total += len(start)
    bounds[offsets == len(data)] = total
    return np.concatenate(found), bounds


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    last = len(hashes) - n + 1
    h = hashes[:last].copy()
    for k in range(1, n):
        h *= np.uint64(0xA0761D6478BD642F)
        h += hashes[k : last + k]
    h += np.uint64(n)
    for at in range(0, last, PIECE_BYTES):
        h[at : at + PIECE_BYTES] = mix(h[at : at + PIECE_BYTES])
    return h


def windows(hashes: np.ndarray, row_of_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n consecutive words of one row, and the position of each run's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row_of_word[n - 1 :] == row_of_word[: len(hashes) - n + 1])
    return runs(hashes, n)[at], at


def rows_of_words(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
