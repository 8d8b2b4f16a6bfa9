"""Vectorised word hashing over Arrow text columns.

A column slice is seen as one byte array. Words are maximal runs of bytes other than space and 0x09-0x0D; as these bytes
are ASCII, cutting UTF-8 there never splits a code point. A word's hash comes from prefix sums of byte values times powers
of an odd base modulo 2**64, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text per vectorised step; a longer text makes a step of its own.
STEP_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    hashes: np.ndarray  #: uint64 per word
    starts: np.ndarray  #: byte offset of each word in data
    ends: np.ndarray
    bounds: np.ndarray  #: word offsets per row, rows + 1
    data: np.ndarray  #: bytes of all rows
    offsets: np.ndarray  #: byte offsets per row, rows + 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Words of each row with 64-bit hashes. fold: A-Z count as a-z."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    inside = np.empty(n + 1, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[:n])
    inside[n] = False
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    rows = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    first[rows] = inside[rows]  # words don't run over row bounds
    starts = np.flatnonzero(first)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:] = ~inside[1:]
    cut[rows] = True
    cut[n] = True
    last = np.zeros(n + 1, dtype=bool)
    last[1:] = inside[:n] & cut[1:]
    ends = np.flatnonzero(last)
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_codes(fold)[data] * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64), data, offsets)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and their offsets per row. A row of fewer words has one, of all of them."""
    h, b = words.hashes, words.bounds
    count = np.diff(b)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_bounds = np.zeros(len(b), np.int64)
    np.cumsum(many, out=out_bounds[1:])
    if len(h) == 0:
        return np.zeros(0, np.uint64), out_bounds
    with np.errstate(over="ignore"):
        runs = max(0, len(h) - k + 1)  # none where the step holds under k words in all
        rolled = np.zeros(runs, dtype=np.uint64)
        for j in range(k):
            rolled = rolled * U64(0xC2B2AE3D27D4EB4F) + h[j : j + runs]
        rolled = mix(rolled + U64(k))
        row = np.repeat(np.arange(len(count)), many)
        at = b[:-1][row] + (np.arange(out_bounds[-1]) - out_bounds[:-1][row])
        out = np.zeros(len(at), dtype=np.uint64)
        whole = (count >= k)[row]
        out[whole] = rolled[at[whole]]
        for i in np.flatnonzero((count > 0) & (count < k)):
            x = U64(0)
            for v in h[b[i] : b[i + 1]]:
                x = x * U64(0xC2B2AE3D27D4EB4F) + v
            out[out_bounds[i]] = mix(np.array([x + U64(count[i])], dtype=np.uint64))[0]
    return out, out_bounds


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text has about limit bytes at most, or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    _, offsets = text_bytes(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
