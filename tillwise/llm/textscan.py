"""Words of many texts at once, as numpy arrays over an Arrow string column.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. Those are single bytes in UTF-8, so words are
found in the column's byte buffer without decoding it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are scanned in runs of about so many bytes, which bounds the scratch arrays.
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All of ASCII but letters and digits.
SPACE_OR_SIGN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """One random 64-bit value per byte; A-Z get those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
    values[65:91] = values[97:123]
    return values


_BYTES = _byte_values()


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


class Words(NamedTuple):
    """Words of the texts first .. first + len(counts) - 1 of a column."""

    first: int
    hashes: np.ndarray  # of each word, A-Z lower-cased
    counts: np.ndarray  # words of each text
    starts: np.ndarray  # byte of each word's start, from the chunk's start
    ends: np.ndarray
    data: np.ndarray  # the chunk's bytes

    @property
    def offsets(self) -> np.ndarray:
        """Where each text's words begin in ``hashes``; one entry more than texts."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: Spark uses workers again,
    and one that waits should hold no more than it needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows, whose values in a text or binary
    column have about ``size`` bytes together, more only where one row has more."""
    length = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    before = np.concatenate(([0], np.cumsum(length)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(before, before[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + rows)
        yield batch.slice(first, last - first)
        first = last


def scan_words(column: pa.Array, between: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of every text, in chunks of whole texts. ``between`` marks the bytes
    that end a word: white space, or ``SPACE_OR_SIGN``."""
    at, data = string_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield _scan(first, at[first:last + 1] - at[first], data[at[first]:at[last]], between)
        first = last


def _scan(first: int, at: np.ndarray, data: np.ndarray, between: np.ndarray) -> Words:
    word = ~between[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    finishes = word.copy()
    finishes[:-1] &= ~word[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = word[edges]  # two texts that touch are two words
    finishes[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_PRIME, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])
    counts = np.diff(np.searchsorted(starts, at))
    return Words(first, hashes, counts, starts, ends, data)
