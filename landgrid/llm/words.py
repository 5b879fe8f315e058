"""Words and shingles of a whole Arrow column of texts at once.

Every function works on the UTF-8 bytes of many texts together, so a batch costs a few
numpy passes, whatever the number of words. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; temporary arrays are about sixty times as large.
CHUNK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random value per byte; A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    values[65:91] = values[97:123]
    return values


LOWERED = _byte_values()
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
#: Everything but space and the control characters 9 to 13 belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Only digits, letters and characters beyond ASCII belong to a word.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: As above without digits.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False

_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2 to the 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.full(size, np.uint64(base & ((1 << 64) - 1)))
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row: first, last (exclusive), bytes, offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def pieces(column: pa.Array | pa.ChunkedArray, inside: Callable[[np.ndarray], np.ndarray], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of ranges of rows, as ``chunks``; a longer text comes in pieces that cut no word.

    ``inside`` tells which bytes belong to words.
    """
    for first, last, data, offsets in chunks(column, limit):
        if last - first > 1 or len(data) <= limit:
            yield first, data, offsets
            continue
        at = 0
        while at < len(data):
            size = limit
            while at + size < len(data):
                gaps = np.flatnonzero(~inside(data[at : at + size]))
                if len(gaps):
                    size = int(gaps[-1]) + 1
                    break
                size *= 2
            part = data[at : at + size]
            yield first, part, np.array([0, len(part)], np.int64)
            at += size


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE, values: np.ndarray = LOWERED):
    """Hash, first byte, end byte of every word, and the word offsets of the texts."""
    rows = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, none, np.zeros(rows + 1, np.int64)
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begins[borders] = inside[borders]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    closing = borders[borders > 0] - 1
    ends[closing] = inside[closing]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=total[1:])
    hashes = (total[stops] - total[starts]) * _power(_BACK, len(data))[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * _STEP)
    return hashes, starts, stops, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, over the borders of texts too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        factor = factor * _BASE & ((1 << 64) - 1)
        total += hashes[k : k + n] * np.uint64(factor)
    return mix(total + np.uint64(size))


def shingles(column, size: int, member: np.ndarray = NOT_SPACE, values: np.ndarray = LOWERED) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles, repeated ones included.

    A text of fewer than ``size`` words is one shingle; one without words has none.
    """
    for first, last, data, offsets in chunks(column):
        hashes, _, _, at = word_hashes(data, offsets, member, values)
        whole = windows(hashes, size)
        for row in range(last - first):
            begin, end = at[row], at[row + 1]
            if end - begin >= size:
                yield whole[begin : end - size + 1]
            elif end > begin:
                yield windows(hashes[begin:end], int(end - begin))
            else:
                yield whole[:0]
