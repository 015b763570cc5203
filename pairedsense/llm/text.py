"""Byte-level text helpers on Arrow string columns, used inside tasks.

An Arrow string column is one UTF-8 buffer and its offsets. ``slices`` walks a
column in pieces of bounded size (one long text is a piece of its own), and the
hash functions work on a whole piece with numpy, so that no Python object is
made per word. Hashes are 64-bit and depend on the bytes only: every task of
every run gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes of text looked at together: temporaries are 8 times that

_random = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def factor(i: int) -> np.uint64:
    return _FACTORS[i]


@dataclass
class Piece:
    """Consecutive rows ``first .. first + len(bounds) - 2`` of a column; row i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    if not len(column):
        return
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Piece(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def segments(kinds: np.ndarray, bounds: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal kind that cross no row: (starts, ends, rows' first run and one past the last); runs of kind ``skip`` are left out."""
    n = len(kinds)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    change = np.empty(n + 1, dtype=bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change[bounds] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kinds[starts] != skip
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for every span; spans are ascending and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    place = inside - np.repeat(starts, lengths)
    values = _BYTE[codes[inside]] * powers(int(lengths.max()))[place]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums ^ (lengths.astype(np.uint64) * _BASE))


def words(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the rows' word bounds."""
    starts, ends, rows = segments(SPACE[piece.data].view(np.uint8), piece.bounds, 1)
    return hash_spans(LOWER[piece.data], starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``size`` words; a shorter row gives one."""
    n = len(hashes)
    if n >= size:
        every = hashes[: n - size + 1] * _FACTORS[0]
        for i in range(1, size):
            every += hashes[i : n - size + 1 + i] * _FACTORS[i]
        every = mix(every)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if hi - lo >= size:
            found = np.sort(every[lo : hi - size + 1])
            fresh = np.empty(len(found), dtype=bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif hi > lo:
            out.append(mix(np.add.reduce(hashes[lo:hi] * _FACTORS[: hi - lo], keepdims=True) + U64(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
