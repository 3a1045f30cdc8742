"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a byte n-gram of the lower-cased text that occurs at all in a document. Its value
is the log of the ratio in which toxic and other training documents hold it, so that what
one class never holds weighs most; a logistic regression is then fitted on the scaled features.
The ``features`` grams of the largest |ratio| * sqrt(document count) are kept.

Fitting uses a sample of about ``sample`` labelled documents of each class, drawn by a hash of the
id, so at most ``2 * sample`` rows of ``features`` numbers reach the driver; the intercept is
then moved to the shares of the classes among all labelled rows. Every text is scored whole.

Null text counts as empty; empty texts get the score of no feature at all. If a document has
several labels the largest counts. Without labels of both classes the score is the share of
toxic ones (0 without any). Other columns are not read; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.language import fold, grams
from trackweave.llm.text import Lookup, blocks, list_array

U = np.uint64
SIZES = (4, 5)


def gram_keys(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each byte; the size is part of a key."""
    key, at = grams(data, offs, size - 1)
    return key | U(size << 56), at


@dataclass
class Linear:
    keys: np.ndarray
    weight: np.ndarray
    intercept: float

    def scorer(self):
        table = Lookup(self.keys)

        def score(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
            out = np.full(len(offs) - 1, self.intercept)
            row, doc = present(table, data, offs)
            return 1 / (1 + np.exp(-np.clip(out + np.bincount(doc, self.weight[row], len(out)), -60, 60)))

        return score


def present(table: Lookup, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) once for each feature that a text holds."""
    found = []
    for size in SIZES:
        key, at = gram_keys(data, offs, size)
        row = table(key)
        hit = np.flatnonzero(row >= 0)
        doc = np.searchsorted(at, hit, "right") - 1
        found.append(np.unique(doc * len(table.keys) + row[hit]))
    both = np.concatenate(found)
    return both % max(1, len(table.keys)), both // max(1, len(table.keys))


def _fit(feature: np.ndarray, doc: np.ndarray, ratio: np.ndarray, label: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by accelerated gradient steps."""
    n, value = len(label), ratio[feature]
    # the norm of the longest row bounds the curvature
    rate = 1 / (0.25 * (np.bincount(doc, value * value, n).mean() * 4 + 1) + l2)
    w = look = np.zeros(len(ratio) + 1)
    for t in range(steps):
        margin = np.bincount(doc, value * look[feature], n) + look[-1]
        slope = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - label) / n
        grad = np.append(np.bincount(feature, value * slope[doc], len(ratio)) + l2 * look[:-1], slope.sum())
        new = look - rate * grad
        look = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1] * ratio, float(w[-1])


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 4000, features: int = 8192, l2: float = 1e-4, steps: int = 200,
) -> Linear:
    """Fit on the labelled rows given."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(count) < 2:
        share = 1.0 if count.get(1) else 0.0
        return Linear(np.zeros(0, U), np.zeros(0), 60.0 if share else -60.0)
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, sample / count[1]))).otherwise(F.lit(min(1.0, sample / count[0])))
    drawn = marks.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < rate * (1 << 20))
    # bounded by the sample, so broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("y", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "text", 1 << 20):
            data, y = fold(data), np.array(batch.column("y"), np.int64)
            keys, toxic = [], []
            for size in SIZES:
                key, at = gram_keys(data, offs, size)
                for i in range(len(y)):
                    own = np.unique(key[at[i] : at[i + 1]])
                    keys.append(own)
                    toxic.append(np.full(len(own), y[i]))
            key, toxic = np.concatenate(keys), np.concatenate(toxic)
            names, at = np.unique(key, return_inverse=True)
            n, t = np.bincount(at, minlength=len(names)), np.bincount(at, toxic, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(t), pa.array(n - t)], names=["key", "t", "o"])

    sums = rows.mapInArrow(tally, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    seen = drawn.groupBy("y").count()
    held = {r["y"]: r["count"] for r in seen.collect()}
    ratio = F.log((F.col("t") + 1) / F.lit(held.get(1, 0) + 2.0)) - F.log((F.col("o") + 1) / F.lit(held.get(0, 0) + 2.0))
    best = sums.withColumn("r", ratio).filter("t + o > 2").orderBy(F.desc(F.abs("r") * F.sqrt(F.col("t") + F.col("o"))), "key").limit(features).toArrow()
    keys, r = best.column("key").to_numpy().view(U), best.column("r").to_numpy()
    order = np.argsort(keys)
    keys, r = keys[order], r[order]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(keys)
        for batch, data, offs in blocks(batches, "text", 1 << 20):
            row, doc = present(table, fold(data), offs)
            at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))))
            yield pa.RecordBatch.from_arrays([batch.column("y"), list_array(row[np.argsort(doc, kind="stable")].astype(np.int32), at, pa.int32())], names=["y", "f"])

    got = rows.mapInArrow(rows_of, "y int, f array<int>").toArrow().combine_chunks()
    label = got.column("y").to_numpy().astype(float)
    if not 0 < label.sum() < len(label):
        return Linear(np.zeros(0, U), np.zeros(0), math.log(count[1] / count[0]))
    lists = got.column("f").combine_chunks() if isinstance(got.column("f"), pa.ChunkedArray) else got.column("f")
    doc = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    weight, intercept = _fit(lists.flatten().to_numpy().astype(np.int64), doc, r, label, l2, steps)
    moved = math.log(count[1] / count[0]) - math.log(label.sum() / (len(label) - label.sum()))
    return Linear(keys, weight, intercept + moved)


def score(docs: DataFrame, model: Linear, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch, data, offs in blocks(batches, text_col, 1 << 20):
            p = of(fold(data), offs)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"doc_id {kind}, score double, predicted int")
