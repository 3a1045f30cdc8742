"""Hard negatives by Fagin's threshold algorithm.

Vectors become whole numbers, so scores are exact inner products. Rows are dealt into blocks of
bounded size by a hash of their number. A block keeps its rows in one list per dimension, sorted
by that component. An anchor reads all lists in step, from the end that its own component's sign
favours; a row met in any list is scored at once in all dimensions (random access). No
row still unseen scores more than the threshold, the sum of the anchor's components times those last
read. A search ends once the threshold falls strictly below the worst that each of its windows still has
to hold, so equal scores are never cut off.

First each anchor's best rows of its own label are found, then for each of these positives the best rows of
other labels whose scores lie in the window that the positive's score sets. Blocks answer on their own with
at most ``positives`` and ``negatives`` rows, and the best of the answers are kept. Anchors meet every block: a query set
against all rows, whose rows move once and whose anchors once a block.

Rows with a null id, label or vector or a null or non-finite component take no part. A shorter vector counts as
ended by zeros. Rows that share an id are rows of their own; equal scores go by id. A component of 2^28 or more stops
the run, since scores would leave 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.tables import written

BLOCK_ROWS, LARGEST = 16_384, 1 << 28
_ROW, _ANCHOR = 0, 1


def quantised(df: DataFrame, *, id_col: str, label_col: Column, vector_col: str, scale: float) -> DataFrame:
    """(row, id, label, vector): one number per row, components as floor(scale * x) in 32-bit integers of one length."""
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & label_col.isNotNull()
    rows = df.filter(usable).select(F.col(id_col).cast("long").alias("id"), label_col.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, offs = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            x = np.floor(flat.to_numpy(zero_copy_only=False).astype(float) * scale)  # null reads as nan
            own = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            fine = np.bincount(own, ~np.isfinite(x), batch.num_rows) == 0
            if len(x) and (np.abs(x[fine[own]]) >= LARGEST).any():
                raise ValueError("a component of 2^28 or more: scores would not fit into 64 bits")
            out = np.zeros((batch.num_rows, dims), "<i4")
            out[own, np.arange(len(x)) - offs[:-1][own]] = np.where(fine[own], x, 0)
            keep = np.flatnonzero(fine)
            raw = out[keep].tobytes()
            size = 4 * dims
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(keep)), batch.column("label").take(pa.array(keep)), pa.array([raw[i * size : i * size + size] for i in range(len(keep))], pa.binary()),
            ], names=["id", "label", "vector"])

    return rows.mapInArrow(work, "id long, label long, vector binary").withColumn("row", F.monotonically_increasing_id())


class Lists:
    """A block's rows and, for each dimension, their order by that component."""

    def __init__(self, x: np.ndarray):
        # sums of products stay exact as doubles below 2^53; beyond that 64-bit integers
        top = float(np.abs(x).max(initial=0)) ** 2 * max(x.shape[1], 1)
        self.x = x.astype(float if top < 2**53 else np.int64)
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.by_dim = np.ascontiguousarray(self.x.T)

    def search(self, anchor: np.ndarray, needed, *, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that ``needed`` may want.

        ``needed(rows, scores)`` gives the score below which an unseen row is of no use,
        None if every row must be seen.
        """
        n, a = len(self.x), anchor.astype(self.x.dtype)
        use = np.flatnonzero(a)
        up, down = use[a[use] > 0], use[a[use] < 0]
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        depth = 0
        while depth < n:
            to = min(n, depth + max(first, depth))
            met = np.concatenate((self.order[up, n - to : n - depth].ravel(), self.order[down, depth:to].ravel())) if len(use) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.x[new] @ a))
            if len(rows) == n:
                break
            threshold = a[up] @ self.by_dim[up, self.order[up, n - to]] + a[down] @ self.by_dim[down, self.order[down, to - 1]]
            least = needed(rows, scores)
            if least is not None and threshold < least:
                break
            depth = to
        return rows, scores.astype(np.int64)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id."""
    if len(rows) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        place = np.arange(len(rows))
    return place[np.lexsort((rows[place], ids[rows[place]], -scores[place]))[:k]]


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, work, schema: str) -> DataFrame:
    """Every anchor against every block, one block at a time: ``work(block)`` is called with a block's rows, what it returns with batches of anchors."""
    names = [c for c in anchors.columns if c not in ("row", "id", "label", "vector")]
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(_ROW).alias("kind"), "row", "id", "label", "vector", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in names])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(_ANCHOR).alias("kind"), "row", "id", "label", "vector", *names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, answer = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero(np.diff(block) | np.diff(kind)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(block)]):
                part = batch.slice(lo, hi - lo)
                if block[lo] != current:
                    current, held, answer = block[lo], [], None
                if kind[lo] == _ROW:
                    held.append(part)
                elif held:
                    if answer is None:
                        answer = work(pa.Table.from_batches(held).combine_chunks())
                    yield answer(part)

    both = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(stream, schema)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = col.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64) if values else np.zeros((0, 0), np.int64)


def _positives(k: int):
    def work(held: pa.Table):
        rows, ids, labels, x = (held.column("row").to_numpy(), held.column("id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("vector")))
        lists: dict[int, tuple[np.ndarray, Lists]] = {}

        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for number, name, label, a in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("label").to_pylist(), _matrix(batch.column("vector"))):
                if label not in lists:
                    own = np.flatnonzero(labels == label)
                    lists[label] = own, Lists(x[own])
                own, same = lists[label]
                if not len(own):
                    continue

                def needed(met: np.ndarray, scores: np.ndarray):
                    return _kth(scores[rows[own[met]] != number], k)

                met, scores = same.search(a, needed)
                other = rows[own[met]] != number
                met, scores = own[met[other]], scores[other]
                for p in best(met, scores, ids, k).tolist():
                    out.append((number, int(rows[met[p]]), int(ids[met[p]]), int(scores[p])))
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "row", "id", "score"])

        return answer

    return work


def _negatives(k: int, low: int, high: int):
    def work(held: pa.Table):
        ids, labels = held.column("id").to_numpy(), held.column("label").to_numpy()
        lists = Lists(_matrix(held.column("vector")))

        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for number, label, found, a in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), batch.column("found").to_pylist(), _matrix(batch.column("vector"))):
                # whole scores s with low * positive <= 100 * s <= high * positive
                windows = [(-(-low * f["score"] // 100), high * f["score"] // 100) for f in found]
                live = [w for w in set(windows) if w[0] <= w[1]]
                if not live:
                    continue

                def needed(met: np.ndarray, scores: np.ndarray):
                    other = scores[labels[met] != label]
                    worst = []
                    for lo, hi in live:
                        kth = _kth(other[(other >= lo) & (other <= hi)], k)
                        worst.append(lo if kth is None else kth)
                    return min(worst)

                met, scores = lists.search(a, needed)
                other = labels[met] != label
                met, scores = met[other], scores[other]
                for n, (lo, hi) in enumerate(windows):
                    inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                    for p in inside[best(met[inside], scores[inside], ids, k)].tolist():
                        out.append((number, n, int(ids[met[p]]), int(scores[p])))
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "place", "negative_id", "negative_score"])

        return answer

    return work


def hard_negatives(
    df: DataFrame, anchor: Column, *, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows that ``anchor`` (over id, label) marks.

    A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = written(quantised(df, id_col=id_col, label_col=label, vector_col=vector_col, scale=scale))
    total = rows.count()
    # small tables still make work for all cores
    blocks = max(1, -(-total // block_rows), min(df.sparkSession.sparkContext.defaultParallelism, total // 1024))
    asked = rows.filter(anchor).select("row", "id", "label", "vector")
    found = _met(rows, asked, blocks, _positives(positives), "anchor long, row long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    item = F.struct("place", F.col("id").alias("positive_id"), "score")
    first = first.groupBy("anchor").agg(F.array_sort(F.collect_list(item)).alias("found"))
    windows = written(asked.join(first, asked["row"] == first["anchor"]).select("row", "id", "label", "vector", "found"))
    hits = _met(rows, windows, blocks, _negatives(negatives, low, high), "anchor long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = windows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.posexplode("found").alias("at", "one"))
    named = named.select("anchor", "anchor_id", F.col("at").cast("long").alias("place"), F.col("one.positive_id").alias("positive_id"), F.col("one.score").alias("positive_score"))
    return hits.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
         row_number() OVER () AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE id % 50 = 0),
s AS MATERIALIZED (SELECT a.n AS an, a.id AS anchor_id, a.lab = r.lab AS same, r.id, r.n, list_dot_product(a.v, r.v)::BIGINT AS score FROM a JOIN r ON a.n <> r.n),
p AS (SELECT an, anchor_id, id AS positive_id, n AS pn, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, id, n) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.an, p.pn ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.an = s.an AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.an, p.pn ORDER BY s.score DESC, s.id) <= 3"""
