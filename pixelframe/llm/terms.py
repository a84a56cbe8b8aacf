"""Runs of bytes in texts, their distinct values exactly, and their strings, for the operators that count words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import span_hashes


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes of the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of flagged bytes; no run crosses rows."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _bytes_of(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the runs, one run after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(starts - before, length)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): equal runs have equal codes from 0, first is a run of each code. Hashes find them, their bytes are compared."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, codes = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    length, like = ends - starts, first[codes]
    if (length == length[like]).all() and (data[_bytes_of(starts, length)] == data[_bytes_of(starts[like], length)]).all():
        return codes, first
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    codes = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return codes, np.unique(codes, return_index=True)[1]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as strings."""
    length = ends - starts
    raw = np.ascontiguousarray(data[_bytes_of(starts, length)])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.string())
