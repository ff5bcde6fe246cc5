"""Whole texts of an Arrow batch as flat byte arrays: words, hashes and slices.

Every helper works on one slice of bounded size, so that a task's memory does not grow
with its input (a single longer text is a slice of its own). Texts are UTF-8 bytes; a
null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    with np.errstate(over="ignore"):
        x = values.astype(_U, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    """256 fixed pseudo-random values, the same in every process."""
    return mix(np.arange(1, 257, dtype=_U) * _U(_MULTIPLIER) + _U(seed))


class RangeHash:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""

    def __init__(self, seed: int = 1):
        self._bytes = byte_values(seed)
        self._factor = int(mix(np.array([seed * 2 + 1], dtype=_U))[0]) | 5
        self._inverse = pow(self._factor, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=_U)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            for name, factor in (("_up", self._factor), ("_down", self._inverse)):
                powers = np.full(n, factor, dtype=_U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=sums[1:])
        return sums

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._down[starts])


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of binaries without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    return array.cast(pa.large_binary())


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and the offset of every text, last end included."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[
        array.offset : array.offset + len(array) + 1
    ]
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = array.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) with about `most` bytes each."""
    array = plain(column)
    data, offsets = flat(array)
    row = 0
    while row < len(array):
        after = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        after = min(max(after, row + 1), len(array))
        yield row, after, data[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row]
        row = after


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACES[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and where each text's words begin."""
    inside = ~_SPACES[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sequences(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of `k` words, by its first word."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.full(n, k, dtype=_U)
    for i in range(k):
        total = (total * _U(0xD6E8FEB86659FD93)) + word_hashes[i : i + n]
    return mix(total)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` (one for each byte) over every text."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
