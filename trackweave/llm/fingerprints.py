"""MinHash document fingerprints.

A text's universal hashes over its word shingles give the least value of each, its samples. One byte
of each of the first ``permutations`` samples makes the fingerprint (hex), and the share of equal bytes, less what chance
gives, estimates the Jaccard similarity. Bands of all samples are joined: band-mates are confirmed
on their full shingle sets, and equal sets, not equal fingerprints, are one from the start. One pass makes both.

Texts are ordered by id as compressed values; those that share a band are shingled again where they are
read, behind a filter of fixed size, so no text is shuffled a second time.

Null text counts as empty. Texts without words share one fingerprint and are each their own
class. A text of fewer words than a shingle is one shingle. Rows are kept one by one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.neardup import SKETCH_BITS, band_keys, digests, odd_sketches, set_classes, shingle_sets
from trackweave.llm.tables import BATCH_CONF, written
from trackweave.llm.text import bytes_of, list_array, minima, mix, permutations

U = np.uint64
PERMUTATIONS, SHINGLE, PERCENT = 128, 5, 80
#: with it, Spark drops the files of a shuffle once the job that needed them has ended; each step here ends in a written table
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: what a Python worker is given at once: texts come by bytes, not by thousands of rows
BATCH_BYTES = 2 << 20
BANDS, ROWS = 40, 6


def samples(data: np.ndarray, offs: np.ndarray, n: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([texts, n] least hashes, shingles and their bounds in each text)."""
    a, b = permutations(BANDS * ROWS, 6)
    values, at = shingle_sets(data, offs, k)
    return minima(values, at, a[:n], b[:n]), values, at


def prints(signature: np.ndarray) -> np.ndarray:
    """[texts, permutations] bytes of the fingerprint."""
    return (mix(signature[:, :PERMUTATIONS].astype(U) + U(1)) >> U(56)).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of fingerprints, 0 to 1."""
    return np.maximum(((x == y).mean(axis=1) * 256 - 1) / 255, 0.0)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sign(texts: list[str]) -> np.ndarray:
    data, offs = bytes_of(pa.array(texts, pa.large_string()))
    return prints(samples(data, offs, PERMUTATIONS)[0])


_FOUND = ["n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"]
_OWN = ["digest", "n_shingles", "bands", "sketch"]
_FOUND_TYPES = "n_chars long, edited_sha256 binary, print binary, edited_print binary, near_edited double, near_next double"


def _against(texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> list[pa.Array]:
    """The columns of ``_FOUND``: each text against its edited form and the next text."""
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    changed = _sign(edited)
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        pa.array([p.tobytes() for p in own], pa.binary()), pa.array([p.tobytes() for p in changed], pa.binary()), pa.array(likeness(own, changed)), pa.array(likeness(own, theirs)),
    ]


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, turn, packed): texts compressed, over range partitions by id (null first) and, within an id, by text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("turn"), pa.array(packed, pa.binary())], names=["doc_id", "turn", "packed"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("turn"), text.alias("text")).mapInArrow(pack, f"doc_id {kind}, turn long, packed binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("turn")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "packed")


def signed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """A written table: doc_id, the columns of ``_OWN`` and, but for the last row of each partition, those of ``_FOUND``; such a row has part, head and tail instead."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    names = ["doc_id", *_OWN, *_FOUND, "part", "head", "tail"]

    def own_columns(sample: np.ndarray, values: np.ndarray, at: np.ndarray) -> list[list]:
        full = np.flatnonzero(np.diff(at))
        keys, sketch = band_keys(sample[full], BANDS, ROWS), odd_sketches(sample[full])
        upto = np.zeros(len(at) - 1, np.int64)
        upto[full] = 1
        upto = np.concatenate(([0], np.cumsum(upto)))
        return [pa.array(digests(values, at), pa.binary()), pa.array(np.diff(at)), list_array(keys.view(np.int64).ravel(), upto * BANDS, pa.int64()), list_array(sketch.ravel(), upto * (SKETCH_BITS // 64), pa.int64())]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, held = TaskContext.get().partitionId(), None, None
        opened = zstandard.ZstdDecompressor()

        def blocks() -> Iterator[tuple[list, list[bytes]]]:
            keys, raws, size = [], [], 0
            for batch in batches:
                for key, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
                    keys.append(key)
                    raws.append(opened.decompress(packed))
                    size += len(raws[-1])
                    if size >= block_bytes:
                        yield keys, raws
                        keys, raws, size = [], [], 0
            if keys:
                yield keys, raws

        def rows(keys: list, own: list[pa.Array], found: list[pa.Array], edge: list[pa.Array] | None = None) -> pa.RecordBatch:
            n = len(keys)
            edge = edge or [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), *own, *found, *edge], names=names)

        for keys, raws in blocks():
            texts = [r.decode() for r in raws]
            data, offs = np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raws])))
            sample, values, at = samples(data, offs, BANDS * ROWS)
            own, mine = own_columns(sample, values, at), prints(sample)
            if held:
                key, text, before, columns = held
                yield rows([key], columns, _against([text], before, texts[:1], mine[:1]))
            else:
                head = texts[0]
            n = len(texts) - 1
            if n:
                yield rows(keys[:-1], [c.slice(0, n) for c in own], _against(texts[:-1], mine[:-1], texts[1:], mine[1:]))
            held = keys[-1], texts[-1], mine[-1:], [c.slice(n) for c in own]
        if held:
            key, text, _, columns = held
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            yield rows([key], columns, blank, [pa.array([part], pa.int64()), pa.array([head], pa.string()), pa.array([text], pa.string())])

    own_types = "digest binary, n_shingles long, bands array<long>, sketch array<long>"
    return written(_ordered(docs, id_col, text_col).mapInArrow(stream, f"doc_id {kind.simpleString()}, {own_types}, {_FOUND_TYPES}, part long, head string, tail string"))


def compared(done: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and digest of each row of ``signed``.

    The edited text has its last half of code points replaced by as many of the next row's first.
    Rows are ordered by id (null first; rows of one id by a hash of the text); the last row is followed by the first.
    """
    kind = done.schema["doc_id"].dataType.simpleString()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, following = batch.column("tail")[i].as_py(), batch.column("next")[i].as_py()
                both = _sign([text, following])
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("digest"), *_against([text], both[:1], [following], both[1:])], names=["doc_id", "digest", *_FOUND])

    # numbers of partitions alone are put in order; texts are joined to them
    edges = done.filter(F.col("part").isNotNull())
    by = Window.orderBy("part")
    first = F.first("part").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = edges.select("part").select("part", F.coalesce(F.lead("part").over(by), first).alias("after"))
    heads = edges.select(F.col("part").alias("after"), F.col("head").alias("next"))
    last = edges.select("doc_id", "digest", "part", "tail").join(order, "part").join(heads, "after").select("doc_id", "digest", "tail", "next")
    rows = done.filter(F.col("part").isNull()).select("doc_id", "digest", *_FOUND).unionByName(last.mapInArrow(close, f"doc_id {kind}, digest binary, {_FOUND_TYPES}"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_chars", text("edited_sha256").alias("edited_sha256"), text("print").alias("fingerprint"), text("edited_print").alias("edited_fingerprint"), "near_edited", "near_next", "digest")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``compared`` and class_id, the smallest id reachable over confirmed band-mates.

    Rows with one id and different texts keep the class of each text; a null id has none.
    """
    conf = docs.sparkSession.conf
    conf.set(CLEANUP_CONF, "true")
    before = conf.get(BATCH_CONF, None)
    conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:  # both end in written tables
        done = signed(docs, id_col=id_col, text_col=text_col)
        classes = set_classes(done.select("doc_id", "n_shingles", "digest", "bands", "sketch"), docs, id_col=id_col, text_col=text_col, k=SHINGLE, percent=PERCENT, bands=BANDS, rows=ROWS)
    finally:
        conf.unset(BATCH_CONF) if before is None else conf.set(BATCH_CONF, before)
    found = compared(done).join(classes, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", own)
