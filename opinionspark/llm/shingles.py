"""Words and word shingles of many texts at once, as numpy arrays of hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
SHINGLE_WORDS = 5

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = max(1 << (n - 1).bit_length(), SLICE_BYTES * 2)
    if size > SLICE_BYTES * 2:
        return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _UNBASE))
    if size not in _powers:
        _powers[size] = (np.cumprod(np.full(size, _BASE)), np.cumprod(np.full(size, _UNBASE)))
    return _powers[size]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of consecutive rows of a string column without nulls."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and where they end; the ends of rows end words."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return word_edges(data, offsets)[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and, last, the number of words)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_edges(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end, wherever they stand."""
    n = len(data)
    powers, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles(
    words: np.ndarray, rows: np.ndarray, idf: Callable[[np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, first of each row) of the distinct shingles of each row, sorted by hash within a row.

    A shingle is five words in a row; a text of fewer words is one shingle. Its
    weight is tf * idf: how often the row has it times the mean idf of its
    words, which ``idf`` gives by their hashes.
    """
    counts = np.diff(rows)
    per_row = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), per_row)
    first = np.concatenate(([0], np.cumsum(per_row)))
    at = rows[:-1][row] + np.arange(len(row)) - first[:-1][row]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(rows), np.int64)
    own = idf(words)
    size = np.minimum(counts[row], SHINGLE_WORDS)
    hashes, weights = np.zeros(len(at), np.uint64), np.zeros(len(at))
    for k in range(SHINGLE_WORDS):
        here = np.minimum(at + k, len(words) - 1)
        has = k < size
        hashes = hashes * _STEP + np.where(has, words[here], _U(k + 1))
        weights += np.where(has, own[here], 0.0)
    hashes = mixed(hashes)
    weights /= size
    order = np.lexsort((hashes, row))
    hashes, weights, row = hashes[order], weights[order], row[order]
    new = np.empty(len(row), bool)
    new[0] = True
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(row)))
    return hashes[at], weights[at] * times, np.searchsorted(row[at], np.arange(len(counts) + 1))
