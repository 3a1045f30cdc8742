"""Streaming jobs whose state is kept by key in the state store, on disk (RocksDB) and not in rewritten tables.

A micro-batch reads and writes the state of the keys that it holds and of those whose timers fire,
whatever the number of keys known. What a batch changes goes to the sink under the batch's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(spark: SparkSession) -> None:
    """State of streams started from now on lives in RocksDB; ``transformWithState`` needs it."""
    spark.conf.set(PROVIDER_CONF, ON_DISK)


def latest(stream: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key so far, given out by the batches that change it (output mode ``update``)."""
    on_disk(stream.sparkSession)
    cols = [c for c in stream.columns if c not in key]
    return stream.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def newest(changes: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table that the changes of all batches amount to: a key's newest row."""
    cols = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, "_r.*")


class _LastSeen(StatefulProcessor):
    """Keeps a key's newest cycle and forgets the key once the watermark has left that cycle behind."""

    def __init__(self, key: str, cycle: str, order: Sequence[str], shape: str):
        self.key, self.cycle, self.order, self.shape = key, cycle, list(order), shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.shape)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.row.get() if self.row.exists() else None
        place = tuple(known) if known is not None else None
        best = place
        for r in rows:
            now = tuple(r[c] for c in self.order)
            if best is None or now > best:
                best = now
        if best == place:
            return
        at = self.order.index(self.cycle)
        if place is None or place[at] != best[at]:
            if place is not None:
                self.handle.deleteTimer(_instant(place[at]))
            self.handle.registerTimer(_instant(best[at]))
        self.row.update(best)
        yield Row(**{self.key: key[0], **dict(zip(self.order, best)), "gone": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = tuple(self.row.get())
        self.row.clear()
        yield Row(**{self.key: key[0], **dict(zip(self.order, last)), "gone": True})

    def close(self) -> None:
        pass


def _instant(cycle: int) -> int:
    """The timer of a cycle in milliseconds; cycles are a second apart on their own clock."""
    return 1000 * (int(cycle) + 1)


def cycle_changes(stream: DataFrame, *, key: str, cycle: str, order: Sequence[str]) -> DataFrame:
    """A key's newest row when it changes, and ``gone`` once its cycle lies two or more behind the running one.

    Cycles are whole numbers, one more for each poll. ``order`` holds the cycle first, of long and double columns. Rows
    more than two cycles late say nothing about a key that is still there and are dropped.
    """
    on_disk(stream.sparkSession)
    kinds = dict(stream.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in order)
    # the watermark stays two cycles behind: what it has passed is stale
    at = F.timestamp_millis((F.col(cycle) + 1).cast("long") * 1000)
    rows = stream.select(key, *order, at.alias("_at")).withWatermark("_at", "2 seconds")
    return rows.groupBy(key).transformWithState(_LastSeen(key, cycle, order, shape), f"{key} {kinds[key]}, {shape}, gone boolean", "update", "EventTime")


def present(changes: DataFrame, *, key: str, order: Sequence[str]) -> DataFrame:
    """Keys of ``cycle_changes`` that have not gone: a later row of the same key counts more than its going."""
    cols = [*order, "gone"]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order, "gone")).alias("_r")).select(key, "_r.*")
    return last.filter("NOT gone").drop("gone")


#: seconds that the event clock runs ahead of ``time``: a stream's first watermark is the epoch, and what lies before it is late
_AHEAD = 1 << 33


class _OrderedSums(StatefulProcessor):
    """Two-sided page sums over slices of time that are complete, in order of time; only the sums are kept between batches.

    A batch may complete many slices of a key. Beyond ``most`` rows they are parked in the state store, so memory holds
    that many rows.
    """

    def __init__(self, entity: str, slack: float, max_gap_s: float, most: int):
        self.entity, self.slack, self.max_gap_s, self.most = entity, slack, max_gap_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "prev double, up double, down double")
        self.parked = handle.getMapState("parked", "slice long, piece int", "times array<double>, positions array<long>, values array<double>, evaluable array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, away, n = {}, set(), 0
        for _, part, piece, *lists in rows:
            held[part, piece] = tuple(lists)
            n += len(lists[0])
            if n > self.most:
                for at, kept in held.items():
                    self.parked.updateValue(at, kept)
                away.update(held)
                held, n = {}, 0
        prev, up, down = self.sums.get() if self.sums.exists() else (None, 0.0, 0.0)
        for at in sorted(away.union(held)):
            if at in held:
                lists = held.pop(at)
            else:
                lists = tuple(self.parked.getValue(at))
                self.parked.removeKey(at)
            reset, score = [], []
            for t, v, ok in zip(lists[0], lists[2], lists[3]):
                cut = prev is None or not ok or t - prev <= 0 or t - prev > self.max_gap_s
                if cut:
                    up = down = 0.0
                elif v is not None and math.isfinite(v):
                    up, down = max(0.0, up + v - self.slack), max(0.0, down - v - self.slack)
                prev = t
                reset.append(cut)
                score.append(max(up, down))
            yield Row(**{self.entity: key[0], "positions": lists[1], "times": lists[0], "reset": reset, "cusum_score": score})
        self.sums.update((prev, up, down))

    def close(self) -> None:
        pass


#: rows that travel to a task and back as one, and those of one key that a task holds
_PIECE, _HELD = 256, 262_144


def page_sums(
    stream: DataFrame, *, entity: str, time: str, position: str, value: str, evaluable: str, slack: float, max_gap_s: float, delay: str, slice_s: float = 3600.0,
) -> DataFrame:
    """Row-by-row two-sided page sums with the state kept per entity between micro-batches.

    The same recurrence as ``decide.simple_page_sums``: reset at a start, a non-positive or long
    step and a non-evaluable row. ``time`` is in seconds. Rows may come in any order within ``delay``: those of an entity and a slice
    of ``slice_s`` seconds are collected by a streaming aggregation, and once the watermark has passed the slice they are
    folded by (time, position); rows without a finite time are left out.
    """
    on_disk(stream.sparkSession)
    at = F.timestamp_micros(((F.col(time) + _AHEAD) * 1e6).cast("long"))
    rows = stream.filter(F.abs(F.col(time)) < float("inf")).select(
        F.col(entity).cast("string").alias(entity), F.col(time).cast("double").alias("time"), F.col(position).cast("long").alias("position"),
        F.col(value).cast("double").alias("value"), F.coalesce(F.col(evaluable), F.lit(False)).alias("evaluable"), at.alias("_at"),
    ).withWatermark("_at", delay)
    whole = rows.groupBy(entity, F.window("_at", f"{round(slice_s * 1e6)} microseconds").alias("w")).agg(F.sort_array(F.collect_list(F.struct("time", "position", "value", "evaluable"))).alias("rows"))
    # a slice goes on in pieces, so that a batch of rows for Python has a bounded size
    first = F.sequence(F.lit(1), F.size("rows"), F.lit(_PIECE))
    pieces = whole.select(entity, F.unix_micros("w.start").alias("slice"), "rows", F.posexplode(first).alias("piece", "first")).withColumn("rows", F.slice("rows", F.col("first"), F.lit(_PIECE)))
    pieces = pieces.select(entity, "slice", "piece", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("time", "position", "value", "evaluable")])
    out = f"{entity} string, positions array<long>, times array<double>, reset array<boolean>, cusum_score array<double>"
    folded = pieces.groupBy(entity).transformWithState(_OrderedSums(entity, slack, max_gap_s, _HELD), out, "append", "None")
    each = folded.select(entity, F.explode(F.arrays_zip("positions", "times", "reset", "cusum_score")).alias("r"))
    return each.select(entity, F.col("r.positions").alias(position), F.col("r.times").alias(time), "r.reset", "r.cusum_score")


def closing_time(rows: Column, *, days: int = 36_525) -> Column:
    """A time far after all others: one row that carries it, of no entity of interest, lets a finished stream give out all that still waits."""
    return rows + F.make_dt_interval(F.lit(days))
