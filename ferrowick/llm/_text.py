"""Vectorised byte-level text primitives shared by the operators (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time: arrays of eight bytes for each stay within the processor's cache and a worker's memory.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the process."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        kept = _powers[str(base)] = np.multiply.accumulate(steps)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and its n + 1 offsets. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and at.size else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes. A longer text is a run of its own."""
    data, offsets = as_bytes(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't white space (or for which ``word`` is true)."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = ~SPACE[data] if word is None else word[data]
    rise = inside[:-1] == 1
    rise[1:] &= inside[:-2] == 0
    fall = np.zeros(len(data) + 1, bool)
    fall[1:] = (inside[:-1] == 1) & (inside[1:] == 0)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[(inside[edges] == 1) & (inside[edges - 1] == 1)]
    rise[cut] = True
    fall[cut] = True
    starts, ends = np.flatnonzero(rise), np.flatnonzero(fall)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def window_hashes(data: np.ndarray, lower: bool = False):
    """A function from starts and ends to 64-bit hashes of these slices of the bytes, equal for equal slices wherever they lie."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data] * _power(_BASE, len(data)), out=sums[1:])
    back = _power(_INVERSE, len(data) + 1)
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def code_hashes(codes: np.ndarray):
    """As window_hashes, over an array of code points."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)) * _power(_BASE, len(codes)), out=sums[1:])
    back = _power(_INVERSE, len(codes) + 1)
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def first_of_runs(x: np.ndarray) -> np.ndarray:
    """True where a sorted array has another value than before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new
