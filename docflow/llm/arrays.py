"""Words, word hashes and shingles of UTF-8 texts as numpy arrays, for use inside tasks.

A text is a view of its bytes. White space is ASCII, so cutting bytes and cutting characters agree.
Hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of one text that are hashed at a time; a longer text is cut at white space.
SEGMENT = 1 << 20

_MASK = (1 << 64) - 1


def _is(*codes: int) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(codes)] = True
    return flags


SPACES = _is(*range(9, 14), 32)
#: Everything but ASCII letters and the bytes of other scripts.
NON_LETTERS = ~_is(*range(65, 91), *range(97, 123), *range(128, 256))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_SLOT = _rng.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        back = pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, dtype=np.uint64)])
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, back, dtype=np.uint64)])
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Hash of any slice of one byte string in constant time."""

    def __init__(self, data: np.ndarray):
        powers, self._back = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=self._sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of an Arrow column; a null text is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:  # a column without any value has the null type
        yield from (np.empty(0, dtype=np.uint8) for _ in range(len(column)))
        return
    _, offsets, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    present = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield content[at[i] : at[i + 1]] if present[i] else content[:0]


def fixed_rows(column: pa.Array, width: int) -> np.ndarray:
    """Byte strings of one length without nulls as rows of a matrix, a view of the column's own bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    if not len(column):
        return np.empty((0, width), dtype=np.uint8)
    first, last = at[column.offset], at[column.offset + len(column)]
    return np.frombuffer(data, dtype=np.uint8)[first:last].reshape(len(column), width)


def token_bounds(data: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def segments(data: np.ndarray, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int]]:
    """Cut a long text after separators, about ``SEGMENT`` bytes at a time, so that no token is cut."""
    start = 0
    while len(data) - start > SEGMENT:
        cuts = np.flatnonzero(separators[data[start : start + SEGMENT]])
        if len(cuts):
            end = start + int(cuts[-1]) + 1
        else:
            after = np.flatnonzero(separators[data[start + SEGMENT :]])
            if not len(after):
                break
            end = start + SEGMENT + int(after[0]) + 1
        yield start, end
        start = end
    yield start, len(data)


def word_hashes(data: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES) -> np.ndarray:
    """One hash for each word of a text, in order."""
    parts = []
    for start, end in segments(data, separators):
        part = data[start:end]
        starts, ends = token_bounds(part, separators)
        parts.append(PrefixHash(LOWER[part] if lower else part).slices(starts, ends))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one run; no words give nothing. Not distinct."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width * 0x51ED270B0F4C11D5 & _MASK, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * _SLOT[k]
    return mix(total)


def shingle_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, words lower-cased over A-Z."""
    return np.unique(shingle_hashes(word_hashes(data, lower=True)))
