"""Words of Arrow text batches as numpy arrays.

A batch is handled in slices of about a megabyte of text (``slices``), so the
arrays stay small; a longer single text makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
#: bytes of a batch after which a worker's unused memory is released
LARGE = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: bytes 0x20 and 0x09-0x0D part words
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and everything above 0x7F are word characters
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False
#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about ``size`` bytes."""
    data, offsets = buffers(column)
    i, n, large = 0, len(offsets) - 1, len(data) > LARGE
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
    if large:
        del data, offsets
        release()


def release() -> None:
    """Gives memory that this process no longer uses back to the system: Python
    workers are reused, and what one stage leaves allocated is missing in the next."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0.. and P**-0.. modulo 2**64, at least ``n`` of each."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        if size > 1 << 21:           # of one very long text: not kept
            return _table(size)
        _powers[size] = _table(size)
    return _powers[size]


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, _P_INV):
        a = np.full(size, p, U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Starts, ends and document index of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span: a polynomial in its bytes, then mixed."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def hash_of(word: bytes) -> int:
    a = np.frombuffer(word, np.uint8)
    return int(hashes(a, np.zeros(1, np.int64), np.array([len(a)]))[0]) if len(a) else int(mix(np.zeros(1, U))[0])


def per_document(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by document."""
    return np.bincount(doc, values, n) if len(doc) else np.zeros(n)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in a sorted array, and which of them are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys
