"""Words, word hashes and shingles of UTF-8 texts, in bounded memory.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()``
yields.  Words get 64-bit hashes; a run of words gets the Rabin-Karp polynomial of theirs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_LIBC = ctypes.CDLL(None)
RADIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT_A, _SHIFT_B, _MIX = np.uint64(29), np.uint64(32), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """word -> 64-bit hash, emptied whenever it holds ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> _SHIFT_A)
    values = values * _MIX
    return values ^ (values >> _SHIFT_B)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, mixed, of each run of ``width`` consecutive words (none if there are fewer words).

    Prefix sums of ``hash[i] * RADIX**i`` modulo 2**64 give a run as a difference, which the
    inverse power of its start makes independent of its place.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if width <= 8:
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * RADIX + hashes[k : n + k]
        return mixed(total)
    power, inverse = _powers(len(hashes))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    return mixed((prefix[width:] - prefix[:-width]) * inverse[:n])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        unit = np.uint64(pow(int(RADIX), -1, 1 << 64))
        for k, base in enumerate((RADIX, unit)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs; fewer words than ``width`` make one run, none make none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(hashes, min(width, len(hashes))))


def release() -> None:
    """Gives memory that is free in this Python worker back to the system: workers serve one stage after another."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # where the C library is not glibc there is none
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of ``column`` (binary), one row at least."""
    release()
    yield from _slices(batch, column, most)


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    sizes = np.fromiter((0 if x is None else len(x) for x in (v.as_buffer() if v.is_valid else None for v in batch.column(column))), np.int64, batch.num_rows)
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
