"""Periodic runs of words, by maximal pairs.

A run is a stretch of words with a smallest period that fits into it ``repeats`` times, of at
least ``least`` words, that no neighbouring word extends. Two occurrences of a stretch of L words
that are p apart, followed by different words and preceded by different words, are a maximal pair:
they span a stretch of p + L words of period p that cannot be extended. So the maximal
pairs with L >= (repeats - 1) * p and p + L >= least are the runs; a run whose exponent is large is
met again at multiples of its period, of which the smallest counts.

Words get numbers within a block of texts, exact ones. Only texts in which some stretch of the
least possible L occurs twice (by hash) are looked at. Their suffixes are sorted by
prefix doubling, neighbours' common prefixes come from the names of each level, and the tree of
LCP intervals is walked from the bottom with lists of positions by preceding word. Of all
partners of a position only those nearer than L / (repeats - 1) are touched: so near, the occurrences of a
stretch lie at equal distances, so a position is the first of them or is preceded
by the same word as its neighbour, and one look tells.

Nothing is shuffled: a text is worked on where it is read. Null and empty texts have no words and
no runs. Rows are kept one by one, repeated ids too; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.text import blocks, mix, words

U = np.uint64


def word_numbers(solid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(solid))])
    return col.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def least_match(least: int, repeats: int) -> int:
    """The shortest L of a maximal pair that is a run."""
    return min(max((repeats - 1) * p, least - p) for p in range(1, least + 1))


def repeating(number: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Which texts surely or probably hold some ``length`` words twice; none that does is left out."""
    n = len(number) - length + 1
    found = np.zeros(len(first) - 1, bool)
    if n <= 0:
        return found
    name, size = mix(number.astype(U) + U(1)), 1
    while size < length:  # overlapping halves cover any length
        step = min(size, length - size)
        name = mix(name[: len(name) - step] * U(0x9E3779B97F4A7C15) + name[step:])
        size += step
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(own[:n] == own[length - 1 : length - 1 + n])
    key, text = name[start], own[start]
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    found[text[1:][(key[1:] == key[:-1]) & (text[1:] == text[:-1])]] = True
    return found


def suffixes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it) of one text."""
    n = len(number)
    _, name = np.unique(number, return_inverse=True)
    levels, size = [], 1
    while True:
        levels.append((size, name))
        after = np.full(n, -1, np.int64)
        if size < n:
            after[: n - size] = name[size:]
        order = np.lexsort((after, name))
        new = np.ones(n, bool)
        new[1:] = (name[order][1:] != name[order][:-1]) | (after[order][1:] != after[order][:-1])
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(new) - 1
        size *= 2
        if new.all():
            break
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for size, name in reversed(levels):
        fits = np.flatnonzero(np.maximum(a, b) + size <= n)
        same = fits[name[a[fits]] == name[b[fits]]]
        a[same] += size
        b[same] += size
        common[1:][same] += size
    return order, common


class _Node:
    """Positions of one LCP interval: all of them, and by preceding word, each list ascending."""

    __slots__ = ("all", "by")

    def __init__(self, position: int, left: int):
        self.all, self.by = [position], {left: [position]}


def _pairs_of(small: _Node, large: _Node, before: list[int], length: int, near: int, least: int, out: dict) -> None:
    """The maximal pairs of a position of each whose distance allows a run; ``out`` maps (start, end) to the smallest period."""
    near = min(near, length)

    def add(a: int, b: int) -> None:
        end, period = b + length, b - a
        if end - a >= least and out.get((a, end), period) >= period:
            out[a, end] = period

    spots = large.all
    for left, own in small.by.items():
        for x in own:
            at = bisect_right(spots, x)
            if at < len(spots) and spots[at] <= x + near and before[spots[at]] != left:
                theirs = large.by[before[spots[at]]]
                for y in theirs[bisect_left(theirs, spots[at]) : bisect_right(theirs, x + near)]:
                    add(x, y)
            # to the left only the first of those at equal distances may be preceded otherwise
            at = bisect_left(spots, x - near)
            if at < len(spots) and spots[at] < x and before[spots[at]] != left:
                add(spots[at], x)


def _merge(small: _Node, large: _Node) -> None:
    if len(small.all) > 64:
        large.all = sorted(large.all + small.all)
    else:
        for x in small.all:
            insort(large.all, x)
    for left, own in small.by.items():
        theirs = large.by.get(left)
        if theirs is None:
            large.by[left] = own
        elif len(own) > 64:
            large.by[left] = sorted(theirs + own)
        else:
            for x in own:
                insort(theirs, x)


def runs_of(number: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of one text, by start, then period."""
    floor = least_match(least, repeats)
    order, common = suffixes(number)
    # a word before the text is like no other; -1 also ends the last interval
    before = [-1, *number[:-1].tolist()]
    out: dict[tuple[int, int], int] = {}
    starts, ends = _groups(common, floor)
    for lo, hi in zip(starts, ends):
        spots, lcp = order[lo:hi].tolist(), [*common[lo + 1 : hi].tolist(), floor - 1]
        stack: list[tuple[int, _Node]] = []  # open intervals: how deep, what they hold so far
        for x, following in zip(spots, lcp):
            node = _Node(x, before[x])
            # close what is deeper than the next common prefix; children of one interval meet there
            depth = following
            while stack and stack[-1][0] >= depth:
                length, held = stack.pop()
                small, large = (node, held) if len(node.all) <= len(held.all) else (held, node)
                _pairs_of(small, large, before, length, length // (repeats - 1), least, out)
                _merge(small, large)
                node = large
            stack.append((following, node))
    return sorted((a, end - a, p) for (a, end), p in out.items())


def _groups(common: np.ndarray, floor: int) -> tuple[list[int], list[int]]:
    """Bounds of the stretches of the suffix array whose neighbours have ``floor`` words in common."""
    deep = np.concatenate((common >= floor, [False]))
    starts = np.flatnonzero(~deep[:-1] & deep[1:])
    ends = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    return starts.tolist(), ends.tolist()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay once each run keeps only its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of each row.

    ``collapsed`` has the words, one space between them, less those that some run holds after its first period.
    """
    if repeats < 3 or least < 1:
        raise ValueError("a run repeats at least three times")
    floor = least_match(least, repeats)
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, text_col):
            solid, at, first = words(data, offs)
            number = word_numbers(solid, at)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            raw = data.tobytes()
            texts: list[str] = []
            busy = repeating(number, first, floor)
            for i in range(batch.num_rows):
                tokens = raw[offs[i] : offs[i + 1]].split()  # bytes are split at 20 and 09 to 0D
                if busy[i]:
                    found[i] = runs_of(number[first[i] : first[i + 1]], least, repeats)
                    if found[i]:
                        tokens = [t for t, k in zip(tokens, kept_words(len(tokens), found[i]).tolist()) if k]
                texts.append(b" ".join(tokens).decode())
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(runs, item), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(work, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
