"""Ordered work per entity without ever putting one entity into one task.

A window partitioned by the entity alone sends a hot entity (one aircraft, one
feed) to a single task. Here rows are partitioned by ``(entity, chunk)`` where a
chunk is a fixed slice of the order axis. Everything a row needs from earlier or
later chunks is a *carry*: one small row per chunk, built with a partial
aggregate, combined along the chunk axis and joined back on ``(entity, chunk)``.
The rows keep their partitioning across that join, so several sweeps in a row
shuffle them once.

Three shapes are covered, all exact:

``sweep``       lag, lead, running sums/extremes, last or next matching row, totals
``row_frame``   frames counted in rows, by numbered blocks with a halo of copied rows
``time_frame``  frames measured on the order axis, by slices with a halo of copied rows

``runs``, ``since`` and ``accumulate`` do in one step what would take several sweeps:
numbering runs, sums since a mark, and floored sums with resets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackweave.plans.durable import durable

CHUNK = "_chunk"
BLOCK = "_block"
LAST_CHUNK = 1 << 62  # rows whose order value is missing sort after all others


@dataclass(frozen=True)
class Track:
    """Entity columns, order columns (the first one numeric) and slice width on the first one."""

    keys: tuple[str, ...] = ("source_id",)
    order: tuple[str, ...] = ("t", "row_pos")
    chunk: float = 86400.0

    def __post_init__(self) -> None:
        if not self.keys or not self.order:
            raise ValueError("keys and order must name at least one column")
        if not self.chunk > 0:
            raise ValueError("chunk must be > 0")

    def by(self, *keys: str) -> "Track":
        return replace(self, keys=tuple(keys))

    def sorts(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.order]

    def position(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def slice_of(self, value: Column) -> Column:
        return F.floor(value / F.lit(self.chunk)).cast("long")

    def open(self, df: DataFrame) -> DataFrame:
        if CHUNK in df.columns:
            return df
        return df.withColumn(CHUNK, F.coalesce(self.slice_of(F.col(self.order[0])), F.lit(LAST_CHUNK)))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.sorts())


def close(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK)


@dataclass(frozen=True)
class Lag:
    """Value of the previous row."""

    expr: Column


@dataclass(frozen=True)
class Lead:
    """Value of the next row."""

    expr: Column


@dataclass(frozen=True)
class Running:
    """Sum, min or max from the first row to this one (``inclusive``) or to the one before."""

    expr: Column
    fn: str = "sum"
    inclusive: bool = True


@dataclass(frozen=True)
class Carry:
    """Value of the latest row meeting ``when``, this row counted if ``inclusive``."""

    expr: Column
    when: Column | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class Ahead:
    """Value of the next row meeting ``when``, this row counted if ``inclusive``."""

    expr: Column
    when: Column | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class Whole:
    """Sum, min or max over all rows of the entity."""

    expr: Column
    fn: str = "sum"


Spec = Lag | Lead | Running | Carry | Ahead | Whole
_FN = {"sum": F.sum, "min": F.min, "max": F.max}
_LO, _HI = Window.unboundedPreceding, Window.unboundedFollowing


def sweep(df: DataFrame, track: Track, specs: Mapping[str, Spec]) -> DataFrame:
    """Add one column per spec; see the module text for how the rows are split."""
    had_chunk = CHUNK in df.columns
    src = track.open(df)
    w = track.window()
    along = Window.partitionBy(*track.keys).orderBy(CHUNK)
    before, after = along.rowsBetween(_LO, -1), along.rowsBetween(1, _HI)
    pos = track.position()

    local: dict[str, Column] = {}
    part: list[Column] = []
    carry: list[Column] = []
    final: dict[str, Column] = {}
    for name, s in specs.items():
        p, c, o = f"_p_{name}", f"_c_{name}", f"_l_{name}"
        boxed = F.struct(s.expr.alias("v"))
        if isinstance(s, Lag):
            local[o] = F.lag(boxed).over(w)
            part.append(F.max_by(boxed, pos).alias(p))
            carry.append(F.lag(p).over(along).alias(c))
            final[name] = F.coalesce(F.col(o), F.col(c))["v"]
        elif isinstance(s, Lead):
            local[o] = F.lead(boxed).over(w)
            part.append(F.min_by(boxed, pos).alias(p))
            carry.append(F.lead(p).over(along).alias(c))
            final[name] = F.coalesce(F.col(o), F.col(c))["v"]
        elif isinstance(s, Running):
            fn = _FN[s.fn]
            local[o] = fn(s.expr).over(w.rowsBetween(_LO, 0 if s.inclusive else -1))
            part.append(fn(s.expr).alias(p))
            carry.append(fn(p).over(before).alias(c))
            a, b = F.col(o), F.col(c)
            if s.fn == "sum":
                final[name] = F.coalesce(a + b, a, b)
            else:
                final[name] = (F.least if s.fn == "min" else F.greatest)(a, b)
        elif isinstance(s, Carry):
            hit = boxed if s.when is None else F.when(s.when, boxed)
            at = pos if s.when is None else F.when(s.when, pos)
            local[o] = F.last(hit, ignorenulls=True).over(w.rowsBetween(_LO, 0 if s.inclusive else -1))
            part.append(F.max_by(boxed, at).alias(p))
            carry.append(F.last(p, ignorenulls=True).over(before).alias(c))
            final[name] = F.coalesce(F.col(o), F.col(c))["v"]
        elif isinstance(s, Ahead):
            hit = boxed if s.when is None else F.when(s.when, boxed)
            at = pos if s.when is None else F.when(s.when, pos)
            local[o] = F.first(hit, ignorenulls=True).over(w.rowsBetween(0 if s.inclusive else 1, _HI))
            part.append(F.min_by(boxed, at).alias(p))
            carry.append(F.first(p, ignorenulls=True).over(after).alias(c))
            final[name] = F.coalesce(F.col(o), F.col(c))["v"]
        elif isinstance(s, Whole):
            fn = _FN[s.fn]
            part.append(fn(s.expr).alias(p))
            carry.append(fn(p).over(along.rowsBetween(_LO, _HI)).alias(c))
            final[name] = F.col(c)
        else:
            raise TypeError(f"unknown spec for {name}: {s!r}")

    on = [*track.keys, CHUNK]
    carries = src.groupBy(*on).agg(*part).select(*on, *carry)
    rows = src.withColumns(local) if local else src
    keep = [F.col(c) for c in src.columns if c not in specs]
    joined = rows.join(carries, on, "left").select(*keep, *[v.alias(k) for k, v in final.items()])
    return joined if had_chunk else joined.drop(CHUNK)


Frame = Callable[[WindowSpec], Column]


def row_frame(
    df: DataFrame,
    track: Track,
    frames: Mapping[str, Frame],
    *,
    before: int,
    after: int = 0,
    block_rows: int = 100_000,
    number: str | None = None,
) -> DataFrame:
    """Add columns computed over ``[before rows back, after rows ahead]`` of each row.

    Each callable receives the window positioned on that frame's entity and order;
    it sets its own ``rowsBetween`` within the declared reach. ``number`` names an
    existing 1-based row number of the entity, otherwise one is computed.
    """
    rn = number or "_rn"
    src = df if number else sweep(df, track, {rn: Running(F.lit(1).cast("long"))})
    size = max(block_rows, before + after, 1)
    own = F.floor((F.col(rn) - 1) / size).cast("long")
    at = (F.col(rn) - 1) % size
    homes = F.array_compact(
        F.array(own, F.when(at >= size - before, own + 1), F.when(at < after, own - 1))
    )
    spread = src.withColumn("_own", own).withColumn(BLOCK, F.explode(homes))
    w = Window.partitionBy(*track.keys, BLOCK).orderBy(rn)
    out = spread.withColumns({k: f(w) for k, f in frames.items()})
    out = out.filter(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")
    return out if number else out.drop(rn)


def time_frame(
    df: DataFrame,
    track: Track,
    frames: Mapping[str, Frame],
    *,
    before: int,
    after: int = 0,
) -> DataFrame:
    """Like ``row_frame`` with the reach measured in units of the (integer) first order column.

    Rows without a value on that axis lie in no frame: they stay, with null frames.
    """
    axis = track.order[0]
    size = max(int(track.chunk), before, after, 1)
    sliced = lambda c: F.floor(c / F.lit(size)).cast("long")
    src = df.drop(CHUNK).filter(F.col(axis).isNotNull()).withColumn("_own", sliced(F.col(axis)))
    # a copied row helps the frames of rows up to `before` later and `after` earlier
    spread = src.withColumn(
        BLOCK, F.explode(F.sequence(sliced(F.col(axis) - after), sliced(F.col(axis) + before)))
    )
    w = Window.partitionBy(*track.keys, BLOCK).orderBy(F.col(axis))
    out = spread.withColumns({k: f(w) for k, f in frames.items()})
    out = out.filter(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")
    unplaced = df.drop(CHUNK).filter(F.col(axis).isNull())
    return out.unionByName(unplaced.withColumns({k: F.lit(None).cast(out.schema[k].dataType) for k in frames}))


def fit_chunk(df: DataFrame, track: Track, *, rows_per_chunk: int = 2_000_000) -> Track:
    """Narrow the slice until the densest (entity, slice) should hold about ``rows_per_chunk`` rows.

    Reads one number from one aggregate; worth its scan when a single entity may
    dominate the table.
    """
    opened = track.open(df.drop(CHUNK)).groupBy(*track.keys, CHUNK).count()
    densest = opened.agg(F.max("count")).first()[0] or 0
    if densest <= rows_per_chunk:
        return track
    return replace(track, chunk=track.chunk * rows_per_chunk / densest)


def settle(df: DataFrame, track: Track) -> DataFrame:
    """Shuffle and sort the rows by (entity, chunk) once and keep them in the shared folder.

    The checkpoint remembers its partitioning, so every later sweep on the same track
    reads it without shuffling the rows again. Use it ahead of a chain of sweeps, whose
    plan would otherwise evaluate the earlier ones again for every carry.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan does not report how its output is partitioned, a fixed one does
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        laid = track.open(df).repartition(*track.keys, CHUNK).sortWithinPartitions(*track.keys, CHUNK, *track.sorts())
        return durable(laid)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def _end(df: DataFrame, had_chunk: bool, keep: list[str], new: Mapping[str, Column]) -> DataFrame:
    out = df.select(*[F.col(c) for c in keep if c not in new], *[v.alias(k) for k, v in new.items()])
    return out if had_chunk else out.drop(CHUNK)


def runs(
    df: DataFrame,
    track: Track,
    fields: Mapping[str, Column],
    breaks: Callable[[Column, Column], Column],
    *,
    out: str,
    prev: str | None = None,
) -> DataFrame:
    """Number the runs (from 1) that ``breaks(previous, current)`` separates.

    Both arguments are structs of ``fields``; a null verdict counts as no break and the
    entity's first row always opens a run. ``prev`` keeps the previous row's struct.
    """
    had_chunk = CHUNK in df.columns
    src = track.open(df)
    w, along = track.window(), Window.partitionBy(*track.keys).orderBy(CHUNK)
    cur = F.struct(*[v.alias(k) for k, v in fields.items()])
    verdict = lambda p, c: F.coalesce(breaks(p, c), F.lit(False)).cast("long")
    rows = src.withColumn("_cur", cur).withColumn("_lp", F.lag("_cur").over(w))
    rows = rows.withColumn("_brk", F.when(F.col("_lp").isNotNull(), verdict(F.col("_lp"), F.col("_cur"))).otherwise(0))
    pos, on = track.position(), [*track.keys, CHUNK]
    ends = rows.groupBy(*on).agg(
        F.min_by("_cur", pos).alias("_a"), F.max_by("_cur", pos).alias("_z"), F.sum("_brk").alias("_n")
    ).withColumn("_pz", F.lag("_z").over(along))
    edge = F.when(F.col("_pz").isNull(), F.lit(1)).otherwise(verdict(F.col("_pz"), F.col("_a"))).cast("long")
    ends = ends.withColumn("_edge", edge).select(
        *on, "_pz",
        (F.sum("_edge").over(along.rowsBetween(_LO, 0))
         + F.coalesce(F.sum("_n").over(along.rowsBetween(_LO, -1)), F.lit(0))).alias("_off"),
    )
    rows = rows.withColumn("_loc", F.sum("_brk").over(w.rowsBetween(_LO, 0))).join(ends, on, "left")
    new = {out: F.col("_loc") + F.col("_off")}
    if prev:
        new[prev] = F.coalesce(F.col("_lp"), F.col("_pz"))
    return _end(rows, had_chunk, src.columns, new)


def since(df: DataFrame, track: Track, sums: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``{out: (mark, add)}``: sum of ``add`` from the latest row meeting ``mark`` to this row, both counted."""
    had_chunk = CHUNK in df.columns
    src = track.open(df)
    on, pos = [*track.keys, CHUNK], track.position()
    along = Window.partitionBy(*track.keys).orderBy(CHUNK)
    rows, w = src, track.window()
    for k, (mark, add) in sums.items():
        rows = rows.withColumns({f"_m_{k}": F.coalesce(mark, F.lit(False)).cast("long"), f"_a_{k}": F.coalesce(add, F.lit(0.0))})
    for k in sums:
        rows = rows.withColumn(f"_g_{k}", F.sum(f"_m_{k}").over(w.rowsBetween(_LO, 0)))
    for k in sums:
        inner = Window.partitionBy(*on, f"_g_{k}").orderBy(*track.sorts()).rowsBetween(_LO, 0)
        rows = rows.withColumn(f"_l_{k}", F.sum(f"_a_{k}").over(inner))
    ends = rows.groupBy(*on).agg(
        *[F.max(f"_g_{k}").alias(f"_k_{k}") for k in sums], *[F.max_by(f"_l_{k}", pos).alias(f"_t_{k}") for k in sums]
    )
    for k in sums:
        ends = ends.withColumn(f"_q_{k}", F.sum(F.when(F.col(f"_k_{k}") > 0, 1).otherwise(0)).over(along.rowsBetween(_LO, 0)))
    for k in sums:
        inner = Window.partitionBy(*track.keys, f"_q_{k}").orderBy(CHUNK).rowsBetween(_LO, 0)
        ends = ends.withColumn(f"_e_{k}", F.sum(f"_t_{k}").over(inner))
    ends = ends.select(*on, *[F.lag(f"_e_{k}").over(along).alias(f"_s_{k}") for k in sums])
    rows = rows.join(ends, on, "left")
    new = {
        k: F.when(F.col(f"_g_{k}") == 0, F.col(f"_l_{k}") + F.coalesce(F.col(f"_s_{k}"), F.lit(0.0))).otherwise(F.col(f"_l_{k}"))
        for k in sums
    }
    return _end(rows, had_chunk, src.columns, new)


def accumulate(df: DataFrame, track: Track, steps: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``{out: (reset, inc)}``: S = max(0, S_before + inc), and S = 0 on a reset row.

    Inside a reset segment S = P - min(0, running min P) with P the running sum of
    increments. Over a whole chunk S maps to max(A, S + B), a form closed under
    composition, so chunks are chained by the same closed form over one row per chunk.
    """
    had_chunk = CHUNK in df.columns
    src = track.open(df)
    on, pos = [*track.keys, CHUNK], track.position()
    along = Window.partitionBy(*track.keys).orderBy(CHUNK)
    rows, w = src, track.window()
    # steps given the very same reset Column share its segments and their sort
    shared: dict[int, int] = {}
    seg = {k: shared.setdefault(id(reset), len(shared)) for k, (reset, _) in steps.items()}
    for k, (reset, inc) in steps.items():
        r = F.coalesce(reset, F.lit(False))
        rows = rows.withColumns({f"_r_{seg[k]}": r.cast("long"), f"_i_{k}": F.when(r, 0.0).otherwise(F.coalesce(inc, F.lit(0.0)))})
    rows = rows.withColumns({f"_g_{i}": F.sum(f"_r_{i}").over(w.rowsBetween(_LO, 0)) for i in set(seg.values())})
    inner = {i: Window.partitionBy(*on, f"_g_{i}").orderBy(*track.sorts()).rowsBetween(_LO, 0) for i in set(seg.values())}
    rows = rows.withColumns({f"_p_{k}": F.sum(f"_i_{k}").over(inner[seg[k]]) for k in steps})
    rows = rows.withColumns(
        {f"_z_{k}": F.col(f"_p_{k}") - F.least(F.lit(0.0), F.min(f"_p_{k}").over(inner[seg[k]])) for k in steps}
    )
    ends = rows.groupBy(*on).agg(
        *[F.max(f"_g_{i}").alias(f"_k_{i}") for i in set(seg.values())],
        *[F.max_by(F.struct(f"_z_{k}", f"_p_{k}"), pos).alias(f"_f_{k}") for k in steps],
    )
    ends = ends.withColumns(
        {f"_q_{i}": F.sum(F.when(F.col(f"_k_{i}") > 0, 1).otherwise(0)).over(along.rowsBetween(_LO, 0)) for i in set(seg.values())}
    )
    outer = {i: Window.partitionBy(*track.keys, f"_q_{i}").orderBy(CHUNK).rowsBetween(_LO, 0) for i in set(seg.values())}
    ends = ends.withColumns({f"_C_{k}": F.sum(F.col(f"_f_{k}._p_{k}")).over(outer[seg[k]]) for k in steps})
    ends = ends.withColumns(
        {f"_E_{k}": F.col(f"_C_{k}") + F.max(F.col(f"_f_{k}._z_{k}") - F.col(f"_C_{k}")).over(outer[seg[k]]) for k in steps}
    )
    ends = ends.select(*on, *[F.lag(f"_E_{k}").over(along).alias(f"_s_{k}") for k in steps])
    rows = rows.join(ends, on, "left")
    new = {
        k: F.when(
            F.col(f"_g_{seg[k]}") == 0,
            F.greatest(F.col(f"_z_{k}"), F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)) + F.col(f"_p_{k}")),
        ).otherwise(F.col(f"_z_{k}"))
        for k in steps
    }
    return _end(rows, had_chunk, src.columns, new)
