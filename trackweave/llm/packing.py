"""Packing token streams into fixed windows by multiway differencing.

A document is its token ids and an end id. Whole windows are cut off a long document first;
what remains is cut into pieces of at most ``piece`` ids. Groups of pieces are dealt over
windows by Karmarkar-Karp differencing: the two partial partitions with the largest
imbalance are merged, the fullest window of one with the emptiest of the other, until one
partition is left. Its windows are nearly equal; if the fullest exceeds the capacity the
group is dealt again over one window more.

Groups are formed within a task, so ids are never shuffled and a task holds one block of
text, one group and a table of words of bounded size. A group's shape depends only on the rows of its input partition, which
a lost task reads again in the same order.

Null and empty texts are documents of the end id alone. Repeated rows are packed as often
as they occur; a null id is carried as null. Columns other than the two named are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackweave.llm.tables import by_bytes
from trackweave.llm.text import IS_SPACE, LOWER, blocks, list_array

#: classes of bytes: 0 white space, 1 letter (or part of one), 2 digit, 3 other; digits stand alone
_KIND = np.full(256, 3, np.uint8)
_KIND[IS_SPACE] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[39] = False  # an apostrophe can begin a unit of its own
_UNIT = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z|[0-9]\Z|[!-/:-`{-~]+\Z")


def unit_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, is a unit) of lower-cased texts: runs of letters, single digits, runs of other signs.

    Only words of printable ASCII and Latin-1 letters are split; any other word stays one unit
    and the tokenizer itself splits it.
    """
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    digit = np.flatnonzero(kind == 2)
    edge[digit] = edge[digit + 1] = True
    edge[offs] = True
    high = np.flatnonzero(data >= 128)
    nxt, prv = data[np.minimum(high + 1, len(data) - 1)], data[high - 1]
    letter = np.where(data[high] == 0xC3, (nxt >= 0x80) & (nxt < 0xC0) & (nxt != 0x97) & (nxt != 0xB7), (prv == 0xC3) & (data[high] < 0xC0) & (data[high] != 0x97) & (data[high] != 0xB7))
    bar = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # may open the name of a special token
    odd = np.unique(np.concatenate((high[~letter], np.flatnonzero(~_PLAIN[data] & (kind != 0) & (data < 128)), bar)))
    if len(odd):
        space = kind == 0
        wall = np.empty(len(data) + 1, bool)
        wall[0] = wall[-1] = True
        np.not_equal(space[1:], space[:-1], out=wall[1:-1])
        wall[offs] = True
        walls = np.flatnonzero(wall)
        for i in np.unique(np.searchsorted(walls, odd, "right") - 1):
            edge[walls[i] + 1 : walls[i + 1]] = False
    cut = np.flatnonzero(edge)
    return cut, kind[cut[:-1]] != 0


def tokenizer_file(name: str) -> str:
    """A path as given, or the installed public file of that name (looked up where the task runs)."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts from a tokenizer that drops white space and marks word ends.

    No unit of such a tokenizer crosses white space, so a text's ids are those of its units in
    order. Units are tokenized when they first come and kept in a table; one of more than ``room`` is
    emptied before the next block, so a worker's memory does not grow with its texts.
    """

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for units that are lower-case ASCII letters already
        self.bare.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.room = room
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.ids, self.upto, self.used, self.count = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int32), 0, 0

    def _put(self, names: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words to the table; word i takes the next sizes[i] ids."""
        if self.count + len(sizes) >= len(self.upto):
            self.upto = np.resize(self.upto, 2 * (self.count + len(sizes)))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.upto[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.row.update(zip(names, range(self.count, self.count + len(sizes))))
        self.used += len(ids)
        self.count += len(sizes)

    def _learn(self, new: list[bytes]) -> None:
        """Tokenize new units; those that are surely one unit go together, word ends tell them apart."""
        ascii_letters, latin, odd = [], [], []
        for w in new:
            (ascii_letters if w.isalpha() else latin if _UNIT.match(w) else odd).append(w)
        for names, tokenizer in ((ascii_letters, self.bare), (latin, self.tokenizer)):
            for i in range(0, len(names), 4096):
                part = names[i : i + 4096]
                ids = np.array(tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) == len(part):
                    self._put(part, ids, np.diff(ends, prepend=0))
                else:  # this tokenizer splits in another way
                    odd += part
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)]
            self._put(odd, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts, each followed by ``end_id``."""
        if not self.count or len(self.row) > self.room:
            self._clear()
            self._put([b""], np.array([end_id], np.uint32), np.ones(1, np.int64))  # the empty unit stands for the end
        data = LOWER[data]
        first, unit = np.zeros(len(offs), np.int64), np.zeros(0, np.int32)
        if len(data):
            cut, real = unit_spans(data, offs)
            at = np.concatenate(([0], np.cumsum(np.diff(cut)[real])))
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[~IS_SPACE[data]])]).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            rows = np.array(list(map(self.row.get, distinct, repeat(-1))), np.int32)
            missing = np.flatnonzero(rows < 0)
            if len(missing):
                self._learn([distinct[i] for i in missing])
                rows[missing] = [self.row[distinct[i]] for i in missing]
            unit = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(rows) else unit
            first = np.searchsorted(cut[:-1][real], offs)
        unit = np.insert(unit, first[1:], 0)
        table = pa.ListArray.from_arrays(pa.array(self.upto[: self.count + 1]), pa.array(self.ids[: self.used]))
        lists = table.take(pa.array(unit))
        upto = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        return lists.flatten().to_numpy(), upto[np.append(0, first[1:] + np.arange(1, len(first)))].astype(np.int64)


def deal(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of ``sizes`` over ``windows`` sets: the numbers of the sizes in each set.

    A partial partition is its non-empty sets in falling order of their sum. Merging puts the
    fullest set of one next to the emptiest of the other, so imbalances cancel.
    """
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(b)  # of the sets of b, the empty ones meet the fullest of a
        meets = b[::-1]
        pairs = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[free:], meets)]
        merged = sorted([*a[:free], *pairs, *meets[len(pairs) :]], key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        turn += 1
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
    return [list(members) for _, members in heap[0][2]] if heap else []


def windows_of(sizes: list[int], length: int) -> list[list[int]]:
    """Near-equal windows of at most ``length``; the count rises while the fullest does not fit."""
    k = max(1, -(-sum(sizes) // length))
    while True:
        dealt = deal(sizes, k)
        if all(sum(sizes[i] for i in w) <= length for w in dealt):
            return dealt
        k += 1


_TOKENS: dict[str, WordTokens] = {}


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
    piece: int = 512, group: int = 512, end_id: int = 1, ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids (or their crc32 only), doc_tokens, sequence_id, offset.

    ``sequence_id`` names a window of at most ``length`` ids; the pieces of a window follow one
    another without gaps. With ``ids=False`` the ids themselves stay in the task and only the
    checksum of their little-endian 32-bit form is returned.
    """
    if not 0 < piece <= length:
        raise ValueError("piece must lie between 1 and length")
    kind = docs.schema[id_col].dataType
    by_bytes(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file(tokenizer)
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))
        number = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            arrays = []
            for values, field in zip(zip(*found), schema):
                if field.name == "ids":
                    at = np.concatenate(([0], np.cumsum([len(v) for v in values])))
                    arrays.append(list_array(np.concatenate(values).view(np.int32), at, pa.int32()).cast(field.type))
                else:
                    arrays.append(pa.array(values, type=field.type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def close() -> list[tuple]:
            nonlocal number
            out = []
            for window in windows_of([p[2] for p in waiting], length):
                at = 0
                for i in sorted(window):
                    out.append((*waiting[i], number, at))
                    at += waiting[i][2]
                number += 1
            waiting.clear()
            return out

        for batch, data, offs in blocks(batches, text_col):
            flat, at = tokens.encode(data, offs, end_id)
            raw = memoryview(flat.astype("<u4")).cast("B")
            ready: list[tuple] = []
            for key, a, b in zip(batch.column(id_col).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                lo, n = 0, b - a
                while lo < n:
                    size = length if n - lo >= length else min(piece, n - lo)
                    row = (key, lo, size, zlib.crc32(raw[4 * (a + lo) : 4 * (a + lo + size)]), n)
                    if ids:
                        row = (*row, flat[a + lo : a + lo + size])
                    if size == length:
                        ready.append((*row, number, 0))
                        number += 1
                    else:
                        waiting.append(row)
                        if len(waiting) == group:
                            ready += close()
                    lo += size
            if ready:
                yield rows(ready)
        if waiting:
            yield rows(close())

    out = T.StructType([
        T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    schema = to_arrow_schema(out)
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, out)


def sequences(pieces: DataFrame, *, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves: sequence_id, n_ids, ids. A window whose fill is a power of two is left as it is."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    short = (F.col("n_ids") < length) & (F.bit_count(F.col("n_ids")) != 1)
    pad = F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_ids")).cast("int"))
    return rows.withColumn("ids", F.when(short, F.concat("ids", pad)).otherwise(F.col("ids")))
