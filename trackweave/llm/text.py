"""Vectorised byte work shared by the operators: blocks of rows, words, hashes, shingles, lookups.

Everything runs inside tasks on Arrow batches. A block is a run of whole rows of about
``BLOCK_BYTES`` of text, so memory follows the block and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: the separators of words: space and the control characters 09 to 0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _DRAW.integers(0, 1 << 64, 256, dtype=np.uint64) | U(1)
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * _C3
    return x ^ (x >> U(31))


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_binary():
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole rows of at most ``limit`` bytes of text, a longer single row alone."""
    for batch in batches:
        data, offs = bytes_of(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bytes without separators, word offsets in them, first word of each row and the end)."""
    solid = ~IS_SPACE[data]
    edge = np.empty(len(data) + 1, bool)  # between two bytes: a word begins or ends there
    edge[0] = edge[-1] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[offs] = True
    cut = np.flatnonzero(edge)
    starts = cut[:-1][solid[cut[:-1]]] if len(data) else cut[:0]
    length = np.diff(cut)[solid[cut[:-1]]] if len(data) else cut[:0]
    return data[solid], np.concatenate(([0], np.cumsum(length))), np.searchsorted(starts, offs)


def word_hashes(solid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch and process."""
    if len(at) < 2:
        return np.zeros(0, U)
    length = np.diff(at)
    pos = (np.arange(len(solid), dtype=np.int64) - np.repeat(at[:-1], length)).astype(U)
    pos = (pos + U(1)) * _C1
    pos = (pos ^ (pos >> U(29))) * _C2 | U(1)
    return mix(np.add.reduceat(_BYTE_VALUE[solid] * pos, at[:-1]) + length.astype(U) * _C1)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each row and the end); a row of fewer than k words is one shingle, of none has none."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(at[-1], U)
    long = np.flatnonzero(count >= k)
    begin = np.repeat(first[:-1][long] - at[:-1][long], n[long])
    to = _spread(at[:-1][long], n[long])
    if len(to):
        src = to + begin
        h = hashes[src]
        for j in range(1, k):
            h = mix(h * _C1 + hashes[src + j])
        out[to] = h
    for m in range(1, k):
        rows = np.flatnonzero(count == m)
        h = hashes[first[:-1][rows]]
        for j in range(1, m):
            h = mix(h * _C1 + hashes[first[:-1][rows] + j])
        out[at[:-1][rows]] = mix(h * _C2 + U(m))
    return out, at


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] times each."""
    total = int(n.sum())
    shift = np.repeat(start - (np.cumsum(n) - n), n)
    return np.arange(total, dtype=np.int64) + shift


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts, n = [], np.zeros(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        if at[i] < at[i + 1]:
            v = np.sort(values[at[i] : at[i + 1]])
            keep = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            parts.append(v[keep])
            n[i] = len(parts[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate(([0], np.cumsum(n)))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n universal hash permutations of 32-bit values."""
    g = np.random.Generator(np.random.PCG64(seed))
    return g.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), g.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, tile: int = 1 << 15) -> np.ndarray:
    """[rows, permutations] least a*x+b mod 2^32 over each row's values; rows without values hold 2^32-1.

    Works in tiles that stay in cache; a row cut by a tile border is joined by the minimum.
    """
    x = (values >> U(32)).astype(np.uint32)
    out = np.full((len(a), len(at) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out.T
    begin = at[:-1][full]
    for lo in range(0, len(x), tile):
        hi = min(lo + tile, len(x))
        i, j = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
        cut = np.maximum(begin[i:j], lo) - lo
        rows, part = full[i:j], x[lo:hi]
        for p in range(len(a)):
            got = np.minimum.reduceat(part * a[p] + b[p], cut)
            out[p, rows] = np.minimum(out[p, rows], got)
    return out.T


class Lookup:
    """Sorted 64-bit keys to row numbers: a direct slot first, binary search for the few that share one."""

    def __init__(self, keys: np.ndarray, bits: int | None = None):
        self.keys = np.ascontiguousarray(keys, U)
        bits = bits or max(10, min(24, int(len(keys)).bit_length() + 2))
        self.shift = U(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[(self.keys * _C1) >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        row = self.slot[(keys * _C1) >> self.shift]
        off = np.flatnonzero(self.keys[row] != keys)
        if len(off):
            at = np.minimum(np.searchsorted(self.keys, keys[off]), len(self.keys) - 1).astype(np.int32)
            row[off] = np.where(self.keys[at] == keys[off], at, -1)
        return row


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values).cast(kind))
