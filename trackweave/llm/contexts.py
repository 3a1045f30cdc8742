"""Language-model scoring by context-tree weighting over bytes.

A text is modelled as its words joined by single spaces and one end sign, A-Z lower-cased. A byte
is eight binary choices; each choice, named by the bits before it, has a tree of contexts of 0 to
``depth`` preceding bytes. A node estimates its choice by Krichevsky-Trofimov from its counts
and weighs its own estimate against its children's: with P the KT probability of the
training choices at a node and Q the product of its children's weighted probabilities, the
weighted probability is (P + Q) / 2, and a choice is predicted as
(P * own + Q * child's prediction) / (P + Q). A child that training never reached
leaves the prediction to its parent. The statistics are frozen; the predictions of a
choice add up to one, so scores are log probabilities of texts.

The corpus is reduced to counts of distinct grams (context and byte) before it is shuffled. The
nodes of a gram's deeper contexts lie in one group, the grams with the same last two context
bytes; only the two shallow levels (65,792 nodes at most) are collected. A gram's code length
is computed once, whatever its number of occurrences. For scoring, the ``hot`` most frequent
grams and words are broadcast (a fixed number of rows); the other ones of a document are
joined with their table, so nothing is cut off.

Null text counts as empty: the end sign alone. Rows are kept one by one, repeated ones
too; other columns are not read. Nothing to learn from: every choice is even.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tables import written
from trackweave.llm.text import LOWER, Lookup, blocks, word_hashes, words

U = np.uint64
END = 10  # not a byte of any word
WORD, GRAM = 0, 1


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words joined by spaces with an end sign, offsets, word hashes, first words)."""
    solid, at, first = words(LOWER[data], offs)
    size = np.diff(at)
    n = np.diff(first)
    # a word is followed by a space, the last of a text by the end sign; a text without words is the end sign
    row_len = np.add.reduceat(np.append(size + 1, 0), np.minimum(first[:-1], len(size))) * (n > 0) + (n == 0)
    out_at = np.concatenate(([0], np.cumsum(row_len)))
    out = np.full(out_at[-1], 32, np.uint8)
    out[out_at[1:] - 1] = END
    lead = np.cumsum(size + 1) - (size + 1) + np.repeat(np.cumsum(n == 0), n)
    where = np.arange(len(solid)) + np.repeat(lead - at[:-1], size)
    out[where] = solid
    return out, out_at, word_hashes(solid, at), first


def keys_of(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Gram of each byte: the preceding ``depth`` bytes, nearest first, and the byte; a text begins after end signs."""
    key = np.zeros(len(text), U)
    start = np.repeat(at[:-1], np.diff(at))
    pos = np.arange(len(text)) - start
    for i in range(1, depth + 1):
        before = np.full(len(text), END, np.uint8)
        before[i:] = text[:-i]
        before[pos < i] = END
        key = (key << U(8)) | before
    return (key << U(8)) | text


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of any order of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: (context, choice) names, counts, KT and the children's weighted probability."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.names, self.zeros, self.ones = names, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.children = self.kt if children is None else children
        self.weighted = self.kt if children is None else np.logaddexp(self.kt, children) - np.log(2)
        self.own = (np.exp(-np.logaddexp(0, children - self.kt)) if children is not None else np.ones(len(names)))


def choices(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[8, grams] choice names (1 and the bits before it) and bits of each gram's byte."""
    byte = (gram & U(255)).astype(np.int64)
    k = np.arange(8)[:, None]
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def levels(gram: np.ndarray, count: np.ndarray, depth: int, top: int) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """The levels from ``depth`` up to ``top`` and each gram's [8, grams] rows in them."""
    choice, bit = choices(gram)
    out: dict[int, Level] = {}
    rows: dict[int, np.ndarray] = {}
    weight = np.broadcast_to(count, choice.shape)
    below = None
    for d in range(depth, top - 1, -1):
        context = gram >> U(8 * (depth - d + 1))
        names, at = np.unique((context << U(8))[None, :] | choice.astype(U), return_inverse=True)
        at = at.reshape(choice.shape)
        ones = np.bincount(at.ravel(), (weight * bit).ravel(), len(names))
        zeros = np.bincount(at.ravel(), (weight * (1 - bit)).ravel(), len(names))
        children = None
        if below is not None:
            parent = (below.names >> U(16) << U(8)) | (below.names & U(255))
            children = np.bincount(np.searchsorted(names, parent), below.weighted, len(names))
        below = out[d] = Level(names, zeros, ones, children)
        rows[d] = at
    return out, rows


def blend(found: dict[int, Level], rows: dict[int, np.ndarray], bit: np.ndarray) -> np.ndarray:
    """Probability of each choice, from the deepest level that training reached upwards."""
    p = None
    for d in sorted(found, reverse=True):
        level, at = found[d], rows[d]
        zeros, ones = level.zeros[at], level.ones[at]
        seen = zeros + ones > 0
        own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if p is None:
            p = np.where(seen, own, np.nan)
        else:
            w = level.own[at]
            p = np.where(seen, np.where(np.isnan(p), own, w * own + (1 - w) * p), p)
    return p


def _whole_groups(frames: Iterator[pd.DataFrame], key: str, least: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """Runs of whole groups from frames sorted by ``key``, of about ``least`` rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size < least:
            continue
        both = pd.concat(held, ignore_index=True)
        cut = int(np.searchsorted(both[key].to_numpy(), both[key].iloc[-1]))
        if cut:
            yield both.iloc[:cut]
        held = [both.iloc[cut:]]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def tallies(docs: DataFrame, train: Column, *, text_col: str, depth: int, room: int = 1 << 21) -> DataFrame:
    """(kind, key, trained, total): occurrences of each word and gram in training rows and in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros(0, U), np.zeros((0, 2), np.int64)) for k in (WORD, GRAM)}

        def put(kind: int, key: np.ndarray, trains: np.ndarray) -> Iterator[pa.RecordBatch]:
            both = []
            for part, t in ((key[trains], 1), (key[~trains], 0)):
                names, n = np.unique(part, return_counts=True)
                both.append((names, np.stack([n * t, n], axis=1)))
            names, n = zip(held[kind], *both)
            name, at = np.unique(np.concatenate(names), return_inverse=True)
            n = np.concatenate(n)
            held[kind] = name, np.stack([np.bincount(at, n[:, i], len(name)).astype(np.int64) for i in (0, 1)], axis=1)
            if len(name) > room:
                yield from flush(kind)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            name, n = held[kind]
            held[kind] = np.zeros(0, U), np.zeros((0, 2), np.int64)
            for i in range(0, len(name), 1 << 18):
                part, c = name[i : i + (1 << 18)], n[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["kind", "key", "trained", "total"])

        for batch, data, offs in blocks(batches, text_col):
            text, at, hashes, first = canonical(data, offs)
            trains = np.array(batch.column("train"), bool)
            yield from put(GRAM, keys_of(text, at, depth), np.repeat(trains, np.diff(at)))
            yield from put(WORD, hashes, np.repeat(trains, np.diff(first)))
        yield from flush(WORD)
        yield from flush(GRAM)

    rows = docs.select(F.col(text_col).cast("string").alias(text_col), F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(work, "kind int, key long, trained long, total long").groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def code_lengths(grams: DataFrame, depth: int) -> DataFrame:
    """(key, total, log10p) of each gram."""
    parts = written(grams.withColumn("group", F.shiftright("key", 8 * (depth - 1)).cast("int")).repartition("group").sortWithinPartitions("group", "key"))

    def deep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "group"):
            found, _ = levels(f["key"].to_numpy().view(U), f["trained"].to_numpy().astype(float), depth, 2)
            top = found[2]
            yield pd.DataFrame({"last": (top.names >> U(16)).astype(np.int64), "choice": (top.names & U(255)).astype(np.int64), "zeros": top.zeros, "ones": top.ones, "weighted": top.weighted})

    groups = parts.select("group", "key", "trained").repartition("group").sortWithinPartitions("group", "key")
    sums = groups.mapInPandas(deep, "last long, choice long, zeros double, ones double, weighted double").groupBy("last", "choice").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    got = sums.toPandas().sort_values(["last", "choice"])
    one = Level((got["last"].to_numpy(np.int64).astype(U) << U(8)) | got["choice"].to_numpy(np.int64).astype(U), got["zeros"].to_numpy(float), got["ones"].to_numpy(float), got["weighted"].to_numpy(float))
    flat, at = np.unique(one.names & U(255), return_inverse=True)
    root = Level(flat, np.bincount(at, one.zeros, len(flat)), np.bincount(at, one.ones, len(flat)), np.bincount(at, one.weighted, len(flat)))
    shallow = grams.sparkSession.sparkContext.broadcast((one, root))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, root = shallow.value
        for f in _whole_groups(frames, "group"):
            gram = f["key"].to_numpy().view(U)
            found, rows = levels(gram, f["trained"].to_numpy().astype(float), depth, 2)
            choice, bit = choices(gram)
            found |= {1: one, 0: root}
            rows[1] = np.searchsorted(one.names, ((gram >> U(8 * depth)) << U(8))[None, :] | choice.astype(U))
            rows[0] = np.searchsorted(root.names, choice.astype(U))
            p = blend(found, rows, bit)
            yield pd.DataFrame({"key": f["key"].to_numpy(), "total": f["total"].to_numpy(), "log10p": np.log10(np.where(np.isnan(p), 0.5, p)).sum(axis=0)})

    coded = parts.repartition("group").sortWithinPartitions("group", "key")
    return coded.mapInPandas(code, "key long, total long, log10p double")


def score(
    docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, hot: int = 1 << 20,
) -> DataFrame:
    """id, n_bytes, n_tokens, n_known, train_tokens, base_score and score of each row; ``train`` marks the rows to learn from.

    ``base_score`` is the add-one unigram log10 probability of the words and the end, ``score`` the model's.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth lies between 2 and 7")
    spark = docs.sparkSession
    counts = written(tallies(docs, train, text_col=text_col, depth=depth))
    ends = docs.agg(F.count(F.when(train, 1))).first()[0]
    known = counts.filter(f"kind = {WORD} AND trained > 0")
    n, v = known.agg(F.sum("trained"), F.count(F.lit(1))).first()
    n, v = (n or 0) + ends, v + (1 if ends else 0)
    floor = float(np.log10(n + v + 1))
    coded = written(code_lengths(counts.filter(f"kind = {GRAM}").select("key", "trained", "total"), depth))
    value = written(
        counts.filter(f"kind = {WORD}").select("kind", "key", "total", F.col("trained").cast("double").alias("value"))
        .unionByName(coded.select(F.lit(GRAM).alias("kind"), "key", "total", F.col("log10p").alias("value"))))

    def hottest(kind: int) -> tuple[np.ndarray, np.ndarray]:
        # by rounds of ten: the least total that still leaves at most ``hot`` rows
        rows = value.filter(F.col("kind") == kind)
        steps = rows.groupBy(F.floor(F.log2("total") * 4).alias("step")).count().orderBy(F.desc("step")).collect()
        least, left = None, hot
        for r in steps:
            if r["count"] > left:
                break
            least, left = r["step"], left - r["count"]
        if least is None:
            return np.zeros(0, U), np.zeros(0, np.float32)
        top = rows.filter(F.floor(F.log2("total") * 4) >= least).select("key", "value").toArrow()
        key, val = top.column("key").to_numpy().view(U), top.column("value").to_numpy()
        order = np.argsort(key)
        return key[order], val[order]

    tables = spark.sparkContext.broadcast({k: hottest(k) for k in (WORD, GRAM)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {k: (Lookup(key), val) for k, (key, val) in tables.value.items()}
        for batch, data, offs in blocks(batches, text_col, 2 << 20):
            text, at, hashes, first = canonical(data, offs)
            rows = batch.num_rows
            cold, sums = [], []
            for kind, key, upto in ((WORD, hashes, first), (GRAM, keys_of(text, at, depth), at)):
                table, val = look[kind]
                row = table(key)
                if kind == WORD:
                    c = np.where(row >= 0, np.append(val, 0.0)[row], 0.0)
                    per = ((c > 0).astype(np.int64), np.where(row >= 0, np.log10(c + 1) - floor, 0.0))
                else:
                    per = (np.where(row >= 0, np.append(val, 0.0)[row], 0.0),)
                own = np.repeat(np.arange(rows), np.diff(upto))
                sums += [np.bincount(own, x, rows).astype(float) for x in per]  # of nothing it counts in integers
                miss = np.flatnonzero(row < 0)
                cold.append((kind, key[miss], own[miss]))
            kinds = np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in cold])
            keys, doc = np.concatenate([k for _, k, _ in cold]), np.concatenate([d for _, _, d in cold])
            order = np.lexsort((kinds, keys, doc))
            kinds, keys, doc = kinds[order], keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            where = np.flatnonzero(new)
            times = np.diff(np.append(where, len(keys)))
            list_at = np.searchsorted(doc[where], np.arange(rows + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(kinds[where]), pa.array(keys[where].view(np.int64)), pa.array(times.astype(np.int64))], names=["kind", "key", "times"])
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array(np.diff(at)), pa.array(np.diff(first) + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                pa.ListArray.from_arrays(pa.array(list_at), rest),
            ], names=["doc_id", "n_bytes", "n_tokens", "known", "base", "bits", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        work, f"doc_id {kind}, n_bytes long, n_tokens long, known long, base double, bits double, rest array<struct<kind:int,key:long,times:long>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.inline("rest")).join(value.select("kind", "key", "value"), ["kind", "key"], "left")
    c = F.coalesce("value", F.lit(0.0))
    is_word = F.col("kind") == WORD
    rest = rest.groupBy("row").agg(
        F.sum(F.when(is_word & (c > 0), F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.when(is_word, F.col("times") * (F.log10(c + 1) - floor)).otherwise(0.0)).alias("base2"),
        F.sum(F.when(is_word, 0.0).otherwise(F.col("times") * c)).alias("bits2"))
    end = float(np.log10(ends + 1) - floor)
    out = rows.drop("rest").join(rest, "row", "left")
    return out.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0)) + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) + end).alias("base_score"), (F.col("bits") + F.coalesce("bits2", F.lit(0.0))).alias("score"))
