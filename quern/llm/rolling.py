"""Vectorised word splitting and Rabin-Karp hashes over Arrow string buffers.

A polynomial hash of a run is taken from prefix sums: with odd base ``b``,
``S[i] = sum(x[j] * b**j for j < i)`` modulo 2**64 and
``hash(s, e) = (S[e] - S[s]) * b**-s``. All windows of all rows come from a
few passes over flat arrays, with no loop over bytes or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        have = np.empty(size, U64)
        have[0] = 1
        have[1:] = U64(base)
        np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 2**64)
    return (sums[end] - sums[start]) * powers(inverse, len(sums))[start]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def text_slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most ``most`` bytes each, or one row."""
    sizes = string_offsets(column)
    sizes = sizes - sizes[0]
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def string_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64)


def flat(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows lo..hi as one array, and the rows' offsets into it (nulls must be filled)."""
    offsets = string_offsets(column)[lo : hi + 1]
    buffer = column.buffers()[2]
    if buffer is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row: index of its first word; one more entry at the end


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes with ``inside`` set, cut at row borders."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(rows + 1, np.int64))
    mask = inside[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = mask
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a row starts or ends here
    start = np.flatnonzero(mask & (~before[:-1] | edge[:-1]))
    after = np.empty(n, bool)
    after[:-1] = mask[1:]
    after[-1] = False
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, np.searchsorted(row, np.arange(rows + 1)))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    sums = prefix_sums(byte_values(data), BYTE_BASE)
    return mix(span_hash(sums, words.start, words.end, BYTE_BASE))


def windows(hashes: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and Rabin-Karp hash of every window of ``length`` words within one row."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    start = np.flatnonzero(row[:n] == row[length - 1 :])
    sums = prefix_sums(hashes, WORD_BASE)
    return start, mix(span_hash(sums, start, start + length, WORD_BASE))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
