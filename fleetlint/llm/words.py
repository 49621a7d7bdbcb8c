"""Vectorised hashing of words and shingles over the byte buffers of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
STEP_BYTES = 2_000_000
_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``size`` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from one running polynomial sum."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray | None = None,
                lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows in order, and the number of words of each row.

    ``in_word`` says for each byte value whether it belongs to words.
    """
    base = int(offsets[0])
    data, ends = data[base:int(offsets[-1])], offsets - base
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    inside = ~IS_SPACE[data] if in_word is None else in_word[data]
    edge = np.zeros(len(data) + 1, bool)  # a word also begins and ends where its row does
    edge[ends] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = span_hashes(lower[data], starts, stops)
    counts = np.diff(np.searchsorted(starts, ends))
    return hashes, counts


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each row; a shorter row is one shingle."""
    factors = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(n)]
    out, at = [], 0
    if len(hashes) >= n:
        size = len(hashes) - n + 1
        rolled = np.zeros(size, np.uint64)
        for k in range(n):
            rolled += hashes[k:k + size] * factors[k]
        rolled = mix(rolled)
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(rolled[at:at + count - n + 1]))
        elif count:
            whole = count
            for word in hashes[at:at + count].tolist():
                whole = (whole * int(factors[0]) + word) % 2**64
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
