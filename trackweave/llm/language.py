"""Language identification by prediction by partial matching.

For each language a context tree of bytes up to ``order`` deep is counted on labelled text and
then frozen. A byte's code length is -log2 n / (t + m) in the longest context that has
it (n: its count, t: the context's count, m: its distinct bytes) after -log2 m / (t + m)
for each longer context that lacks it; below all contexts a byte takes 8 bits. A text goes to
the language that codes it shortest (ties: the first by name).

The trees are fitted on a sample of about ``sample`` documents of each language, drawn by a hash
of the id; the sample is halved, down to ``LEAST_SAMPLE`` a language, while its trees hold more
than ``max_nodes`` entries. So the sample alone bounds the model that is broadcast; the order is
fixed, and counts are never cut. Every text is scored whole.

Letters are folded to lower case, digits and white space to one sign each. Null texts and texts
without a letter are ``und`` with score 0, as is everything if there is nothing to learn from.
Other columns are not read; rows are kept one by one, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.text import IS_SPACE, LOWER, Lookup, blocks

U = np.uint64
FOLD = LOWER.copy()
FOLD[IS_SPACE] = 32
FOLD[48:58] = 48
#: documents a language that the sample is not halved below: at an expected 32, a language without any is all but impossible
LEAST_SAMPLE = 32
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = 1


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, Latin-1 capitals included."""
    out = FOLD[data]
    lead = np.flatnonzero(out[:-1] == 0xC3)
    second = out[lead + 1]
    out[lead + 1] = np.where((second >= 0x80) & (second < 0x9F) & (second != 0x97), second + 32, second)
    return out


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of ``order`` context bytes and the byte, rows' offsets); a text begins after spaces."""
    n = np.diff(offs)
    at = np.concatenate(([0], np.cumsum(n)))
    wide = np.full(len(data) + order * len(n), 32, np.uint8)
    into = np.ones(len(wide), bool)
    gap = (offs[:-1][:, None] + np.arange(len(n))[:, None] * order + np.arange(order)[None, :]).ravel()
    into[gap] = False
    wide[into] = data
    key = np.zeros(len(wide) - order, U) if len(wide) > order else np.zeros(0, U)
    for i in range(order + 1):
        key = (key << U(8)) | wide[i : len(wide) - order + i]
    return key[into[order:]], at


@dataclass
class Trees:
    """Frozen code lengths: ``cost[d]`` [language, gram] of the grams of order d, ``escape[d]`` of contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def freeze(cls, languages: list[str], key: np.ndarray, lang: np.ndarray, count: np.ndarray, order: int) -> Trees:
        keys, cost, contexts, escape = [], [], [], []
        for d in range(order + 1):
            low = key & U((1 << 8 * (d + 1)) - 1)
            names, at = np.unique(low, return_inverse=True)
            n = np.zeros((len(languages), len(names)))
            np.add.at(n, (lang, at), count)
            ctx, own = np.unique(names >> U(8), return_inverse=True)
            total = np.stack([np.bincount(own, x, len(ctx)) for x in n])
            kinds = np.stack([np.bincount(own, x > 0, len(ctx)) for x in n])
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[:, own])
            below = cost[-1][:, np.searchsorted(keys[-1], names & U((1 << 8 * d) - 1))] if d else np.full(n.shape, 8.0)
            keys.append(names)
            cost.append(np.where(n > 0, seen, out[:, own] + below))
            contexts.append(ctx)
            escape.append(out)
        return cls(languages, keys, cost, contexts, escape)

    def scorer(self):
        """A function (keys, offsets) -> code lengths [language, text]."""
        tables, ctx_tables = [Lookup(k) for k in self.keys], [Lookup(k) for k in self.contexts]
        top = len(self.keys) - 1

        def below(key: np.ndarray, d: int) -> np.ndarray:
            """Cost of keys that order d lacks."""
            own = ctx_tables[d]((key & U((1 << 8 * (d + 1)) - 1)) >> U(8))
            cost = np.where(own >= 0, self.escape[d][:, own], 0.0)
            if d == 0:
                return cost + 8.0
            row = tables[d - 1](key & U((1 << 8 * d) - 1))
            less = self.cost[d - 1][:, row]
            miss = np.flatnonzero(row < 0)
            if len(miss):
                less[:, miss] = below(key[miss], d - 1)
            return cost + less

        def score(key: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.zeros((len(self.languages), len(at) - 1))
            full = np.flatnonzero(np.diff(at))
            if len(full):
                row = tables[top](key)
                miss = np.flatnonzero(row < 0)
                rest = below(key[miss], top)
                for i in range(len(self.languages)):
                    bits = self.cost[top][i][row]
                    bits[miss] = rest[i]
                    out[i, full] = np.add.reduceat(bits, at[:-1][full])
            return out

        return score


def learn(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, order: int = 3, sample: int = 4000, max_nodes: int = 1 << 21, max_languages: int = 512) -> Trees | None:
    """Fit the trees on the rows given; None if none has a text and a language.

    Of more than ``max_languages`` values those with most rows are learned (ties by name), the others never predicted: a column of that many is dirty.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)

    def drawn(sample: int) -> DataFrame:
        share = F.create_map(*[x for v in languages for x in (F.lit(v), F.lit(min(1.0, sample / sizes[v])))])
        return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "text"):
            key, at = grams(fold(data), offs, order)
            number = np.array([languages.index(v) for v in batch.column("lang").to_pylist()], U)
            found, n = np.unique(key | np.repeat(number, np.diff(at)) << U(8 * (order + 1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    while True:
        counts = drawn(sample).select("lang", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        got = (counts.limit(max_nodes + 1) if sample > LEAST_SAMPLE else counts).toArrow()
        if got.num_rows <= max_nodes or sample <= LEAST_SAMPLE:
            break
        # a sample above every language's size draws all: go on from the largest
        sample = max(LEAST_SAMPLE, min(sample, max(sizes.values())) // 2)
    key, n = got.column("key").to_numpy().view(U), got.column("n").to_numpy()
    bits = U(8 * (order + 1))
    return Trees.freeze(languages, key & ((U(1) << bits) - U(1)), (key >> bits).astype(np.int64), n, order)


def _letters(texts: pa.Array, folded: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    upto = np.concatenate(([0], np.cumsum(_LETTER[folded])))
    letter = upto[offs[1:]] > upto[offs[:-1]]
    for i in np.flatnonzero(~letter):
        letter[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return letter


def lettered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and lettered (whether the text has a letter) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(_letters(batch.column(text_col), fold(data), offs))], names=["doc_id", "lettered"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"doc_id {kind}, lettered boolean")


def predict(docs: DataFrame, trees: Trees | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior under equal priors) and bits_per_byte of each row."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        score = trees.scorer() if trees else None
        for batch, data, offs in blocks(batches, text_col, 1 << 20):
            rows = batch.num_rows
            folded = fold(data)
            letter = _letters(batch.column(text_col), folded, offs)
            name, sure, rate = ["und"] * rows, np.zeros(rows), np.zeros(rows)
            if score:
                key, at = grams(folded, offs, len(trees.keys) - 1)
                bits = score(key, at)
                best = bits.argmin(0)
                low = bits.min(0)
                sure = np.where(letter, 1.0 / np.exp2(low - bits).sum(0), 0.0)
                rate = low / np.maximum(np.diff(offs), 1)
                name = [trees.languages[b] if ok else "und" for b, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(name), pa.array(sure), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
