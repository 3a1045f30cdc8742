"""Removing byte strings that an earlier document has, by maximal repeats of an enhanced suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Such a string
belongs to a maximal repeat, so it is enough to find those of at least that length with all their occurrences: in
the tree of LCP intervals of a suffix array, the intervals whose occurrences are preceded by different bytes.

The suffix array of a corpus is cut into parts that never meet: a window of ``length`` bytes is named after the least
hash of the ``anchor``-byte strings in it, so equal windows have equal names wherever they occur, and neighbouring windows
mostly share a name. First the names are counted, one row for each name and block of documents: a name that
one document alone has cannot hold a repeat. Then the windows of the other names are sent to their name's
task as strings, a run of windows in one string; there their suffixes are sorted and the tree is scanned with a stack. Of equal strings in one block
the smallest document's is sent and the others are covered at once. A name that very many documents
have (a common line) is divided by the windows' own hashes, its windows sent one by one.

Names and hashes only bring windows together; bytes are compared before anything is removed. A hidden clash costs time, never a byte.

Documents travel as blocks of compressed texts. Null and empty texts have no bytes. Rows with one id are not
earlier than each other, so a repeat between them alone removes nothing; a null id is neither earlier nor later
than any, and its text stays whole. Repeated rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tables import written
from trackweave.llm.text import blocks, mix

U = np.uint64
_ODD, _START = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: windows of a string at most
RUN = 64
#: documents with a common name beyond which its windows are divided
CROWD = 50_000
TILE = 1 << 18


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each ``length`` bytes."""
    piece, size, factor = mix(data.astype(U) + _START), 1, np.array([_ODD])  # arrays wrap without a word
    out, have = None, 0
    rest = length
    while rest:
        if rest & 1:
            n = len(data) - have - size + 1
            out = piece[:n] if out is None else out[:n] * factor + piece[have : have + n]
            have += size
        rest >>= 1
        if rest:
            n = len(piece) - size
            piece = piece[:n] * factor + piece[size : size + n]
            factor, size = factor * factor, size * 2
    return mix(out)


def names_of(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The name of each window of ``length`` bytes: the least hash of the ``anchor`` bytes within."""
    total = len(data) - length + 1
    if total <= 0:
        return np.zeros(0, U)
    out = np.empty(total, U)
    for lo in range(0, total, TILE):
        hi = min(total, lo + TILE)
        least, size, width = window_hashes(data[lo : hi + length - 1], anchor), 1, length - anchor + 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        out[lo:hi] = least
    return out


def strings(data: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows, text) of each run of windows of one name within a text."""
    name = names_of(data, length, anchor)
    if not len(name):
        return name, *[np.zeros(0, np.int64)] * 3
    new = np.ones(len(name), bool)
    np.not_equal(name[1:], name[:-1], out=new[1:])
    inside = np.ones(len(name), bool)
    begins = offs[:-1][offs[:-1] < len(name)]
    new[begins] = True
    for end in offs[1:-1]:  # windows that reach over the end of a text
        inside[max(0, end - length + 1) : end] = False
    new[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(name)))
    ok = inside[at]
    at, count = at[ok], count[ok]
    if len(count) and count.max() > RUN:  # periodic text: strings stay short
        times = -(-count // RUN)
        shift = RUN * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        at, count = np.repeat(at, times) + shift, np.minimum(np.repeat(count, times) - shift, RUN)
    return name[at], at, count, np.searchsorted(offs, at, "right") - 1


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number of the same order."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return eight.view(">u8").ravel().astype(U)


def _spans(data: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, covered bytes) of the windows that start a string which a smaller ``doc`` has.

    ``at`` holds where each window starts, ``end`` where its text or known context ends, ``first`` whether the byte before it is unknown.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(at) < 2:
        return none
    key = _hashes_at(data, at, length)
    order = np.argsort(key)
    key = key[order]
    tied = np.zeros(len(at) + 1, bool)
    np.equal(key[1:], key[:-1], out=tied[1:-1])
    keep = tied[:-1] | tied[1:]
    order, key = order[keep], key[keep]
    if not len(order):
        return none
    # a group of one document removes nothing; one preceded by the same byte throughout is not maximal. A clash of
    # hashes can only make a group look livelier than it is
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    left, d = np.where(first[order], -1 - order, data[at[order] - 1].astype(np.int64)), doc[order]
    live = (np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head)) & (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head))
    keep = np.repeat(live, np.diff(np.append(head, len(order))))
    order, left, d = order[keep], left[keep], d[keep]
    if not len(order):
        return none
    # from here on bytes decide: suffixes in order, as far as their context goes
    room = end[order] - at[order]
    padded = np.concatenate((data, np.zeros(int(room.max()) + 16, np.uint8)))
    deep = -(-int(room.max()) // 8)
    words = []
    for i in range(deep):
        have = np.clip(room - 8 * i, 0, 8)
        words.append(_words(padded, np.minimum(at[order] + 8 * i, len(padded) - 8)) & np.where(have == 0, U(0), ~U(0) << (U(8) * (U(8) - np.maximum(have, 1).astype(U)))))
    sort = np.lexsort((room, *words[::-1]))
    order, left, d, room = order[sort], left[sort], d[sort], room[sort]
    common, going = np.zeros(len(order), np.int64), np.ones(len(order) - 1, bool)
    for w in words:
        w = w[sort]
        differ = w[1:] ^ w[:-1]
        lead = sum((differ < U(1 << (8 * j))).astype(np.int64) for j in range(8))
        common[1:] += np.where(going, lead, 0)
        going &= differ == 0
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    hit, size = interval_scan(np.where(common >= length, common, 0), left, d, length)
    return order[hit], size


#: the depth of a single suffix: below every common prefix
_LEAF = 1 << 62


class _Interval:
    """An open LCP interval: its depth, smallest document, the byte before all its occurrences (None if they differ), and occurrences not yet covered."""

    __slots__ = ("depth", "least", "before", "open")

    def __init__(self, depth: int, least: int, before: int | None, open_: list[int]):
        self.depth, self.least, self.before, self.open = depth, least, before, open_


def interval_scan(lcp: np.ndarray, left: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, bytes) of each suffix that a maximal repeat with a smaller document covers, by the longest such.

    ``lcp`` is each suffix's common prefix with the one before it, ``left`` the byte before it (a number of its own where unknown).
    An interval that is left-diverse covers all its occurrences outside its smallest document; what is covered leaves the lists, so each occurrence is handled once.
    """
    where, size = [], []
    stack: list[_Interval] = []

    def close(top: _Interval) -> None:
        if top.depth >= length and top.before is None:
            rest = []
            for s in top.open:
                if docs[s] > top.least:
                    where.append(s)
                    size.append(top.depth)
                else:
                    rest.append(s)
            top.open = rest

    docs, lefts = doc.tolist(), left.tolist()
    for s, shared in enumerate([*lcp.tolist(), 0]):
        done = None
        while stack and stack[-1].depth > shared:
            top = stack.pop()
            if done is not None:
                _join(top, done)
            close(top)
            done = top
        if shared and done is not None:
            if stack and stack[-1].depth == shared:
                _join(stack[-1], done)
            else:
                done.depth = shared
                stack.append(done)
        if s < len(docs):
            stack.append(_Interval(_LEAF, docs[s], lefts[s], [s]))
    return np.array(where, np.int64), np.array(size, np.int64)


def _join(into: _Interval, other: _Interval) -> None:
    into.least = min(into.least, other.least)
    if into.before != other.before:
        into.before = None
    if len(other.open) > len(into.open):
        into.open, other.open = other.open, into.open
    into.open.extend(other.open)


def _packed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, ends, texts): whole rows as blocks, the texts compressed; a null id is marked by ``known``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=6)
        for batch, data, offs in blocks(batches, text_col, block_bytes):
            ids = batch.column(id_col)
            known = np.array(ids.is_valid())
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 33) + n], pa.int64()), pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                pa.array([known.astype(np.uint8).tobytes()], pa.binary()), pa.array([np.diff(offs).astype("<i8").tobytes()], pa.binary()), pa.array([press.compress(data.tobytes())], pa.binary()),
            ], names=["block", "ids", "known", "sizes", "texts"])
            n += 1

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(work, "block long, ids binary, known binary, sizes binary, texts binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids, known) of a block."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    offs = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(offs[-1]))), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
    return data, offs, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], np.uint8).astype(bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _press(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed value."""
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def _opened(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    sizes = np.frombuffer(data, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places in order) of each part that has any."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


#: entries, and bytes of strings, that a task gathers before it packs them by destination
ENTRIES, GATHERED = 1 << 20, 16 << 20
_NAME_KINDS = ("<u4", "<u2", "<i8", "<i8", "<i4", "<u1")
_STRING_KINDS = ("<u1", "<u4", "<i8", "<i4", "<i8", "<i8", "<u1")


def _short(name: np.ndarray) -> np.ndarray:
    """48 bits of a name, evenly spread."""
    return mix(name + U(1)) >> U(16)


def _names(packed: DataFrame, length: int, anchor: int, parts: int) -> DataFrame:
    """(part, entries): packed, one entry for each name and block: the name, the block, its document, how often, whether several documents have it."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        short, block, doc, many, several = (np.concatenate(x) for x in zip(*held))
        out = [(p, _press((short[at] >> U(16)).astype("<u4"), (short[at] & U(0xFFFF)).astype("<u2"), block[at], doc[at], many[at], several[at])) for p, at in _by_part((short % U(parts)).astype(np.int64), parts)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["part", "entries"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _rows(batches):
            data, offs, ids, known = _unpacked(row)
            name, _, _, text = strings(data, offs, length, anchor)
            fine = known[text]
            name, doc = name[fine], ids[text[fine]]
            if not len(name):
                continue
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            lo, hi = doc[head], doc[np.append(head[1:], len(doc)) - 1]
            many = np.diff(np.append(head, len(name)))
            # in the order of documents: what repeats from entry to entry is stored small
            by_doc = np.argsort(lo, kind="stable")
            held.append((_short(name[head])[by_doc], np.full(len(lo), row["block"], "<i8"), lo[by_doc], many[by_doc].astype("<i4"), (lo != hi)[by_doc].astype("<u1")))
            size += len(lo)
            if size >= ENTRIES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return packed.mapInArrow(work, "part int, entries binary")


def _shared(names: DataFrame, parts: int) -> DataFrame:
    """(block, names): for each block, packed, those of its names that several documents have, and into how many parts each is divided."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_opened(row["entries"], *_NAME_KINDS) for row in _rows(batches)]
        if not held:
            return
        high, low, block, doc, many, several = (np.concatenate(x) for x in zip(*held))
        del held
        name = (high.astype(U) << U(16)) | low.astype(U)
        order = np.argsort(name, kind="stable")
        name, block, doc, many, several = name[order], block[order], doc[order], many[order].astype(np.int64), several[order]
        head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        shared = (np.maximum.reduceat(several, head) > 0) | (np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head))
        size = np.diff(np.append(head, len(name)))
        keep = np.repeat(shared, size)
        name, block, cut = name[keep], block[keep], np.repeat(-(-np.add.reduceat(many, head) // CROWD), size)[keep]
        order = np.argsort(block, kind="stable")
        name, block, cut = name[order], block[order], cut[order].astype("<i4")
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
        out = [(int(block[lo]), _press((name[lo:hi] >> U(16)).astype("<u4"), (name[lo:hi] & U(0xFFFF)).astype("<u2"), cut[lo:hi])) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(block)])]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "names"])

    return names.repartition(parts, "part").mapInArrow(work, "block long, names binary")


def _sent(packed: DataFrame, shared: DataFrame, length: int, anchor: int, parts: int) -> DataFrame:
    """(part, strings) for the windows of shared names, (part, block, spans) for bytes known to be covered already; all packed."""
    lists = shared.groupBy(F.col("block").alias("b")).agg(F.collect_list("names").alias("lists"))
    both = packed.join(lists, packed["block"] == lists["b"]).drop("b")
    fields = ["part", "strings", "block", "spans"]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        to, size, block, row, start, doc = (np.concatenate(x) for x in zip(*[h[:-1] for h in held]))
        raw = np.frombuffer(b"".join(h[-1] for h in held), np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))
        out = []
        for p, own in _by_part((to % U(parts)).astype(np.int64), parts):
            n = size[own]
            places = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((p, _press((to[own] >> U(56)).astype("<u1"), n.astype("<u4"), block[own], row[own].astype("<i4"), start[own], doc[own], raw[places])))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.binary())], names=fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for source in _rows(batches):
            data, offs, ids, known = _unpacked(source)
            lists = [_opened(x, "<u4", "<u2", "<i4") for x in source["lists"]]
            wanted = np.concatenate([(x[0].astype(U) << U(16)) | x[1].astype(U) for x in lists])
            order = np.argsort(wanted)
            wanted, cuts = wanted[order], np.concatenate([x[2] for x in lists])[order]
            name, at, count, text = strings(data, offs, length, anchor)
            short = _short(name)
            spot = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
            keep = (wanted[spot] == short) & known[text]
            name, at, count, text, cut = name[keep], at[keep], count[keep], text[keep], cuts[spot[keep]]
            if not len(name):
                continue
            part = np.zeros(len(name), U)
            if (cut > 1).any():
                times = np.where(cut > 1, count, 1)
                shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                name, text, cut, at = np.repeat(name, times), np.repeat(text, times), np.repeat(cut, times), np.repeat(at, times) + shift
                count = np.where(cut > 1, 1, np.repeat(count, times))
                part = np.where(cut > 1, _hashes_at(data, at, length) % cut.astype(U), U(0))
            # of equal strings only the smallest document's is sent
            doc, begins, ends = ids[text], _hashes_at(data, at, length), _hashes_at(data, at + count - 1, length)
            order = np.lexsort((at, doc, ends, begins, count))
            same = (count[order[1:]] == count[order[:-1]]) & (begins[order[1:]] == begins[order[:-1]]) & (ends[order[1:]] == ends[order[:-1]])
            new = np.concatenate(([True], ~same))
            lead = np.empty(len(order), np.int64)
            lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            copy = np.flatnonzero(doc > doc[lead])
            copy = copy[_same_bytes(data, at[copy], at[lead[copy]], count[copy] + length - 1)]
            size, start, block = count + length - 1, at - offs[text], source["block"]
            rest = np.ones(len(name), bool)
            rest[copy] = False
            rest = np.flatnonzero(rest)
            raw = data.tobytes()
            held.append((
                mix(name[rest] + mix(part[rest] + U(1))), size[rest], np.full(len(rest), block, "<i8"), text[rest], start[rest], doc[rest],
                b"".join([raw[a : a + n] for a, n in zip(at[rest].tolist(), size[rest].tolist())]),
            ))
            gathered += len(held[-1][-1])
            begin, stop, own = _union(text[copy], start[copy], start[copy] + size[copy])
            if len(own):
                yield pa.RecordBatch.from_arrays([
                    pa.array([block % parts], pa.int32()), pa.nulls(1, pa.binary()), pa.array([block], pa.int64()), pa.array([_press(np.stack((own, begin, stop), axis=1).astype("<i8"))], pa.binary()),
                ], names=fields)
            if gathered >= GATHERED:
                yield from flush(held)
                held, gathered = [], 0
        if held:
            yield from flush(held)

    return both.mapInArrow(work, "part int, strings binary, block long, spans binary")


def _hashes_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at the given places, a tile at a time."""
    out = np.empty(len(at), U)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(0, len(data) + TILE, TILE))
    for n in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[n] : bounds[n + 1]]
        out[own] = window_hashes(data[n * TILE : (n + 1) * TILE + length - 1], length)[at[own] - n * TILE]
    return out


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at x and at y are equal."""
    out = np.ones(len(x), bool)
    for lo in range(0, len(x), 1 << 15):
        a, b, n = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)], size[lo : lo + (1 << 15)]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(a, n) + step] != data[np.repeat(b, n) + step]
        out[lo : lo + len(a)] = np.bincount(np.repeat(np.arange(len(a)), n), differ, len(a)) == 0
    return out


def _union(row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, stop, row) of the maximal stretches; input ordered by row, then begin."""
    if not len(row):
        return begin, stop, row
    base = np.int64(stop.max() + 2)
    a, b = row * base + begin, row * base + stop
    far = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > far[:-1]))
    head = np.flatnonzero(new)
    end = far[np.append(head[1:], len(a)) - 1]
    return begin[head], end - row[head] * base, row[head]


def _found(sent: DataFrame, length: int, parts: int, batch_bytes: int) -> DataFrame:
    """(block, spans): packed (row, start, stop) of covered bytes."""

    def solve(tag: np.ndarray, size: np.ndarray, block: np.ndarray, row: np.ndarray, start: np.ndarray, doc: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        # one tag has all windows of its names: tags are worked on apart
        order = np.argsort(tag, kind="stable")
        at = np.concatenate(([0], np.cumsum(size)))
        room = np.cumsum(size[order])
        border = np.flatnonzero(np.concatenate((tag[order[1:]] != tag[order[:-1]], [True]))) + 1
        lo, done = 0, 0
        for n, hi in enumerate(border.tolist()):
            if room[hi - 1] - done < batch_bytes and n < len(border) - 1:
                continue
            own = order[lo:hi]
            lo, done = hi, room[hi - 1]
            many = size[own]
            ends = np.cumsum(many)
            text = data[np.repeat(at[own] - (ends - many), many) + np.arange(many.sum())]
            count = many - length + 1
            of = np.repeat(np.arange(len(own)), count)
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit, covers = _spans(text, (ends - many)[of] + shift, ends[of], shift == 0, doc[own][of], length)
            which = own[of[hit]]
            yield from spans_of(block[which], row[which].astype(np.int64), start[which] + shift[hit], covers)

    def spans_of(block: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, row, block))
        block, row, start, size = block[order], row[order], start[order], size[order]
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(block)]):
            begin, stop, own = _union(row[lo:hi], start[lo:hi], start[lo:hi] + size[lo:hi])
            out.append((int(block[lo]), _press(np.stack((own, begin, stop), axis=1).astype("<i8"))))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _rows(batches):
            if row["strings"] is None:
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["spans"]], pa.binary())], names=["block", "spans"])
            else:
                tag, *rest = _opened(row["strings"], *_STRING_KINDS)
                held.append((tag.astype(np.int64) + (row["part"] << 8), rest[0].astype(np.int64), *rest[1:]))
        if held:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            yield from solve(*columns)

    return sent.repartition(parts, "part").mapInArrow(work, "block long, spans binary")


def without_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 20, block_bytes: int = 2 << 20, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop; the maximal removed stretches) and kept (the other bytes) of each row."""
    if not 1 <= anchor <= length:
        raise ValueError("an anchor lies within a window")
    packed = written(_packed(docs, id_col, text_col, block_bytes))
    volume = packed.agg(F.sum(F.length("texts"))).first()[0]
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # tasks of some megabytes of compressed text whatever the input
    parts = max(least, int((volume or 0) // (4 << 20)) + 1)
    shared = _shared(_names(packed, length, anchor, parts), parts)
    spans = _found(_sent(packed, shared, length, anchor, parts), length, parts, batch_bytes)
    lists = spans.groupBy(F.col("block").alias("b")).agg(F.collect_list("spans").alias("lists"))
    both = packed.join(lists, packed["block"] == lists["b"], "left").drop("b")
    item = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, offs, ids, known = _unpacked(row)
            n = len(ids)
            raw = [_opened(x, "<i8")[0].reshape(-1, 3) for x in row["lists"] or []]
            s = np.concatenate(raw) if raw else np.zeros((0, 3), np.int64)
            s = s[np.lexsort((s[:, 1], s[:, 0]))]
            begin, stop, own = _union(s[:, 0], s[:, 1], s[:, 2])
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, offs[own] + begin, 1)
            np.add.at(edge, offs[own] + stop, -1)
            stays = np.cumsum(edge[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(stays)))[offs]
            text = data[stays].tobytes()
            at = np.searchsorted(own, np.arange(n + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(begin), pa.array(stop)], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=~known), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(at), runs).cast(item),
                pa.array([text[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())], pa.binary()),
            ], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
