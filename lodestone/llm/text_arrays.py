"""Whole texts as flat numpy arrays: word spans, word hashes and word windows.

Texts arrive as Arrow string columns. They are handled in slices of a quarter of a megabyte (a longer
text is a slice of its own), so the memory of a task doesn't depend on the size of its batch.
A word is a run of bytes other than 0x20 and 0x09 to 0x0D; words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A to Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(20240301).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the SplitMix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows within them) of each slice; a null is an empty text."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (and the end) the index of its first word."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, by differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(_powers[0]) < len(data):
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(max(len(data), SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    total = (_BYTE_VALUE[LOWER] if lower else _BYTE_VALUE)[data]
    total *= _powers[0][: len(data)]
    np.cumsum(total, out=total)
    h = total[ends - 1]
    h[starts > 0] -= total[starts[starts > 0] - 1]
    h *= _powers[1][starts]
    return mix(h)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` words, and for each text (and the end) the index of its first window."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    count = len(hashes) - size + 1
    rolled = np.zeros(count, np.uint64)
    for j in range(size):
        rolled += hashes[j : j + count] * _STEP[j]
    inside = np.zeros(count + 1, np.int64)
    np.add.at(inside, np.minimum(first[:-1], count), 1)
    text_of = np.cumsum(inside[:-1]) - 1
    whole = np.arange(count) + size <= first[1:][text_of]
    return mix(rolled[whole]), np.searchsorted(np.flatnonzero(whole), first)


def whole_sequences(hashes: np.ndarray, first: np.ndarray, size: int) -> dict[int, np.uint64]:
    """For the texts of 1 to size - 1 words: row and one hash of the whole sequence."""
    counts = np.diff(first)
    return {int(k): mix((hashes[first[k] : first[k + 1]] * _STEP[: counts[k]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(counts[k]))[0] for k in np.flatnonzero((counts > 0) & (counts < size))}


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text, A to Z lowered; a text of fewer words is one shingle."""
    for row, data, offsets in slices(column):
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        rolled, at = windows(hashes, first, size)
        short = whole_sequences(hashes, first, size)
        for k in range(len(offsets) - 1):
            if k in short:
                yield row + k, np.array([short[k]], np.uint64)
            else:
                yield row + k, np.unique(rolled[at[k] : at[k + 1]])
