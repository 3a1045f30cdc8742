"""MinHash near-duplicates with odd sketches.

Each distinct shingle set gets ``bands`` x ``rows`` MinHash samples. The samples are also folded
into a parity bitmap: sample i with value v flips one bit, so the bits in which two bitmaps
differ count the samples in which the documents differ. Documents that share a band are
candidates; the population count of the XOR of their bitmaps drops those whose similarity
is surely below the threshold; what is left is confirmed on full shingle sets.

No pairs within a group are written out. Equal sets are one class from the start. Within a
band's bucket every class is compared with the bucket's smallest, and in a crowded bucket with
the smallest of one of its divisions, which differ from band to band; after components
are known, buckets that still span several components compare the members outside the
smallest's component with the rest, as far as their sets overlap with others at all: a text
with many shingles of its own is like no other. Pairs inside one component need no comparison, so the
components are those of all candidate pairs.

A pair of similarity s shares no band with probability (1 - s^rows)^bands: 5e-6 for 0.8
at the defaults, and a component usually holds many pairs. The sketch limit lies six
standard deviations below the threshold.

A document is its id: rows with one id belong together whatever their texts. Null text
counts as empty, empty documents are linked with nothing, a null id is its own
component (null). Repeated rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.components import PARITY_LONGS, bits_apart, buckets, linked
from trackweave.llm.tables import written
from trackweave.llm.text import BLOCK_BYTES, LOWER, blocks, distinct, list_array, minima, mix, permutations, shingles, word_hashes, words

U = np.uint64
SKETCH_BITS = 512


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, A-Z lower-cased."""
    solid, at, first = words(LOWER[data], offs)
    return distinct(*shingles(word_hashes(solid, at), first, k))


def digests(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """One name for each set; none for an empty one."""
    raw = memoryview(values.astype("<u8")).cast("B")
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if a < b else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """[rows, bits / 64] parity bitmaps of the samples and their numbers."""
    n, k = samples.shape
    spot = mix(samples.astype(U) + (np.arange(1, k + 1, dtype=U) << U(32))) % U(bits)
    flips = np.zeros(n * bits, np.uint8)
    np.bitwise_xor.at(flips, (np.arange(n)[:, None] * bits + spot.astype(np.int64)).ravel(), 1)
    return np.packbits(flips.reshape(n, bits), axis=1, bitorder="little").view("<i8")


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[rows, bands] a key of each band's ``rows`` samples."""
    key = np.zeros((len(samples), bands), U)
    salt = np.arange(1, bands + 1, dtype=U) << U(48)
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + samples[:, r::rows] + salt)
    return key


def sketch_limit(threshold: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """Differing bits beyond which a pair is surely below the threshold."""
    differ = samples * (1 - threshold) + 6 * math.sqrt(samples * threshold * (1 - threshold))
    share = (1 - math.exp(-4 * differ / bits)) / 2
    return math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def signatures(docs: DataFrame, *, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest, bands, sketch) of each row."""
    a, b = permutations(bands * rows, 6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, text_col):
            values, at = shingle_sets(data, offs, k)
            full = np.flatnonzero(np.diff(at))
            sample = minima(values, at, a, b)[full]
            key = band_keys(sample, bands, rows)
            where = np.zeros(len(at) - 1, np.int64)
            where[full] = 1
            upto = np.concatenate(([0], np.cumsum(where)))
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array(np.diff(at)), pa.array(digests(values, at), pa.binary()),
                list_array(key.view(np.int64).ravel(), upto * bands, pa.int64()),
                list_array(odd_sketches(sample).ravel(), upto * (SKETCH_BITS // 64), pa.int64()),
            ], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, *, id_col: str, text_col: str, k: int, by_set: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, shingles, parity) of each row that has any; parity holds for each of its bits whether an odd number of shingles fall on it.

    The node is the id, or the digest of the set if ``by_set``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, text_col, block_bytes):
            values, at = shingle_sets(data, offs, k)
            n, bits = batch.num_rows, 64 * PARITY_LONGS
            spot = np.repeat(np.arange(n) * bits, np.diff(at)) + (mix(values) % U(bits)).astype(np.int64)
            odd = (np.bincount(spot, minlength=n * bits) % 2).astype(np.uint8).reshape(n, bits)
            parity = np.packbits(odd, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([
                pa.array(digests(values, at), pa.binary()) if by_set else batch.column(id_col), list_array(values.view(np.int64), at, pa.int64()), list_array(parity.ravel(), np.arange(n + 1) * PARITY_LONGS, pa.int64()),
            ], names=["node", "shingles", "parity"])

    kind = "binary" if by_set else docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"node {kind}, shingles array<long>, parity array<long>").filter(F.size("shingles") > 0)


def _parts(first: DataFrame, banded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], limit: int, percent: int, extra: DataFrame | None = None, bounded: bool = True) -> DataFrame:
    """(node, component) of the nodes of ``first`` (node, n, sketch) that are linked; ``banded`` has (node, bands), ``sets_of`` gives the full sets of nodes.

    If ``first`` has a column name, the sets come under it in place of the node.
    """
    named = "name" in first.columns
    light = first.select("node", "n", "sketch", *["name"] * named)
    bucket = written(buckets(banded.select(F.explode("bands").alias("key"), "node")))
    # the full sets of classes that share a bucket. A text is as large as its set: the joins of both
    # are always merged, so that what they move is in proportion to the input at any size
    sets = written(sets_of(bucket.select("node").distinct()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of (a, b), those alike by sketch and then by full sets."""
        x = light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), *[F.col("name").alias("ka")] * named)
        y = light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), *[F.col("name").alias("kb")] * named)
        ka, kb = ("ka", "kb") if named else ("a", "b")
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        likely = written(pairs.distinct().join(x, "a").join(y, "b").filter(sizes & (bits_apart("sa", "sb", SKETCH_BITS // 64) <= limit)).select("a", "b", *["ka", "kb"] * named))
        if likely.isEmpty():
            return likely.select("a", "b")
        va, vb = sets.select(F.col("node").alias(ka), F.col("shingles").alias("va")), sets.select(F.col("node").alias(kb), F.col("shingles").alias("vb"))
        both = likely.hint("merge").join(va, ka).hint("merge").join(vb, kb)
        inter = F.size(F.array_intersect("va", "vb"))
        return both.filter(100 * inter >= percent * (F.size("va") + F.size("vb") - inter)).select("a", "b")

    def support(nodes: DataFrame) -> DataFrame:
        """(node, n, c, parity): the size of a node's set, how much of it occurs in other nodes' sets at all, its bitmap."""
        if named:
            own = sets.withColumnRenamed("node", "name").join(light.join(nodes, "node", "left_semi").select("node", "name"), "name")
        else:
            own = sets.join(nodes, "node", "left_semi")
        alone = own.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        if named:
            # sets are counted before they are joined by number, else they would move again
            sizes = sets.select(F.col("node").alias("name"), F.size("shingles").alias("n"), "parity")
            return sizes.join(light.select("node", "name"), "name").join(nodes, "node", "left_semi").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"), "parity")
        n = F.size("shingles")
        return own.join(alone, "node", "left").select("node", n.alias("n"), (n - F.coalesce("alone", F.lit(0))).alias("c"), "parity")

    return linked(bucket, confirmed, extra, bound=support if bounded else None, percent=percent)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row; linked are sets with at least ``percent`` % of the union in common."""
    limit = sketch_limit(percent / 100, bands * rows)
    sig = written(signatures(docs, id_col=id_col, text_col=text_col, k=k, bands=bands, rows=rows))
    named = sig.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min_by(F.struct(F.col("n_shingles").alias("n"), "sketch", "bands"), "doc_id").alias("one")
    first = written(named.groupBy("digest").agg(F.min("doc_id").alias("node"), one).select("digest", "node", "one.*"))
    # rows that share an id
    again = written(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"))
    repeats = not again.isEmpty()
    extra = None
    if repeats:
        several = named.join(again, "doc_id").join(first.select("digest", "node"), "digest")
        extra = several.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        need = nodes.select(F.col("node").alias(id_col))
        sets = full_sets(docs.join(need.hint("merge"), id_col, "left_semi"), id_col=id_col, text_col=text_col, k=k)
        return sets.dropDuplicates(["node", "shingles"]) if repeats else sets

    part = _parts(first, first, sets_of, limit, percent, extra, bounded=not repeats)
    ids = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    out = sig.select("doc_id", "n_shingles", "digest").join(first.select("digest", "node"), "digest", "left").join(part, "node", "left")
    out = out.withColumn("component_id", F.coalesce(ids, F.when(F.col("doc_id").isNotNull(), F.least("node", "doc_id")))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: bits of the filter behind which sets are made: 8 MB whatever the input; what passes it wrongly is made in vain
FILTER_BITS = 1 << 26


def _filter_places(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]


def id_filter(ids: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of the ids, built by the cluster and of fixed size."""
    place = F.explode(F.array(*_filter_places(key))).alias("p")
    words = ids.select(place).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def passing(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (column ``key`` of both), and a few others; no row is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(ids, key))
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.ones(batch.num_rows, bool)
            for i in range(3):
                p = batch.column(f"_p{i}").to_numpy()
                fine &= (held.value[p >> 6] >> (p & 63)) & 1 == 1
            yield batch.select(names).filter(pa.array(fine))

    return docs.select(*names, *[p.alias(f"_p{i}") for i, p in enumerate(_filter_places(key))]).mapInArrow(work, docs.schema)


def set_classes(
    sig: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6,
) -> DataFrame:
    """digest, class_id for each shingle set that a row with an id has: the smallest id of all rows whose sets are linked.

    ``sig`` is a table of (doc_id, n_shingles, digest, bands, sketch) of the rows of ``docs``. Sets are the nodes, so different texts under one id keep their own classes.
    """
    limit = sketch_limit(percent / 100, bands * rows)
    named = sig.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min_by(F.struct(F.col("n_shingles").alias("n"), "sketch"), "doc_id").alias("one")
    # every band of a node carries its name: a number is a third of a digest. Bands stay in ``sig``, where they are written already
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), one).select(F.col("digest").alias("name"), "doc_id", "one.*")
    first = written(first.withColumn("node", F.monotonically_increasing_id()))
    # rows of one id and one set give a band twice, which joins nothing new
    banded = named.select(F.col("digest").alias("name"), "doc_id", "bands").hint("merge").join(first.select("name", "doc_id", "node"), ["name", "doc_id"]).select("node", "bands")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # a set that is made in vain or twice joins nothing new
        need = first.join(nodes, "node", "left_semi").select(F.col("doc_id").alias(id_col))
        few = passing(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), need, id_col)
        return full_sets(few, id_col=id_col, text_col=text_col, k=k, by_set=True, block_bytes=1 << 20)

    part = _parts(first, banded, sets_of, limit, percent)
    found = written(first.select("node", "name", "doc_id").join(part, "node", "left").select("name", "doc_id", F.coalesce("component", "node").alias("component")))
    least = found.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "component").select(F.col("name").alias("digest"), "class_id")
