"""Helpers inside Arrow tasks: texts as flat byte arrays, words, and their 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; a longer text is one chunk of its own.
CHUNK_BYTES = 2_000_000
# The white space that separates words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def texts_of(column: pa.Array) -> pa.Array:
    """Null becomes empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row begins (with the end)."""
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices with about ``size`` bytes of text each: (rows, bytes, row offsets)."""
    for batch in batches:
        data, off = flat(texts_of(batch.column(batch.schema.get_field_index(column))))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a]:off[b]], off[a:b + 1] - off[a]
            a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, int(n).bit_length()))[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte span, the same wherever the span stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row how many words stand before it (with the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` words of every row, sorted by row and fingerprint: (row, fingerprint).
    A row with fewer words is one shingle of all its words; a row without words has none."""
    count = np.diff(at)
    rows, keys = [], []
    if len(hashes) >= n:
        h = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            h += hashes[j:len(hashes) - n + 1 + j] * np.uint64(pow(_BASE, j + 3, 1 << 64))
        row = np.repeat(np.arange(len(count)), count)[:len(h)]
        whole = np.arange(len(h)) + n <= at[row + 1]
        rows.append(row[whole])
        keys.append(mix(h[whole]))
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = hashes[at[i]:at[i + 1]]
        k = (own * powers(_BASE, len(own) + 3)[3:]).sum(dtype=np.uint64) + np.uint64(len(own))
        rows.append(np.array([i]))
        keys.append(mix(np.array([k], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + counts[i] - 1`` for all i, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))
