"""Sliding windows and time-frame features of ordered rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.track import BLOCK, Ahead, Carry, Frame, Lag, Lead, Running, Track, Whole, row_frame, runs, sweep, time_frame


def trailing_median(df: DataFrame, track: Track, *, value: str, rows: int, out: str) -> DataFrame:
    """Median of the ``rows`` rows before this one (at least one value), this row excluded."""
    return row_frame(
        df, track, {out: lambda w: F.percentile(F.col(value), F.lit(0.5)).over(w.rowsBetween(-rows, -1))}, before=rows
    )


def _numbered(df: DataFrame, track: Track, extra: Mapping[str, object] | None = None) -> DataFrame:
    return sweep(df, track, {"_rn": Running(F.lit(1).cast("long")), **(extra or {})})


def _spread(rows: DataFrame, *, window: int, stride: int) -> DataFrame:
    """Rows, numbered by ``_rn`` from 1, once for each window they lie in: ``_win`` and their place ``_at`` in it from 0."""
    first = F.greatest(F.ceil((F.col("_rn") - window) / stride), F.lit(0)).cast("long")
    last = F.floor((F.col("_rn") - 1) / stride).cast("long")
    homes = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("_win", F.explode(homes)).withColumn("_at", F.col("_rn") - 1 - F.col("_win") * stride)


def _whole(window: int, max_gap_s: float) -> Column:
    """Windows with all their rows and no inner gap above the limit."""
    return (F.col("_n") == window) & (F.coalesce(F.col("_gap"), F.lit(0.0)) <= max_gap_s)


def sliding_windows(
    df: DataFrame, track: Track, *, features: Sequence[str], window: int, stride: int, max_gap_s: float,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per window of ``window`` rows starting every ``stride`` rows: x, mask, t_start, t_end.

    A window with an inner gap above ``max_gap_s`` is rejected. ``x`` holds missing cells
    as 0 and ``mask`` is 1 where a cell is finite. ``extra`` columns are gathered as lists.
    A row goes to the windows that hold it, so lists are built for windows alone.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be >= 1")
    t, more = track.order[0], dict(extra or {})
    rows = _numbered(df, track, {"_pt": Lag(F.col(t))}).withColumn("_dt", F.col(t) - F.col("_pt"))
    cells = [sc.finite(F.col(f)).cast("float") for f in features]
    item = F.struct(
        F.col("_at"), F.array(*[F.coalesce(c, F.lit(0.0).cast("float")) for c in cells]).alias("x"), F.array(*[c.isNotNull().cast("float") for c in cells]).alias("m"),
        *[c.alias(f"e_{name}") for name, c in more.items()],
    )
    rows = _spread(rows, window=window, stride=stride).withColumn("_item", item)
    wins = rows.groupBy(*track.keys, "_win").agg(
        F.min_by(F.col(t), F.col("_at")).alias("t_start"), F.max_by(F.col(t), F.col("_at")).alias("t_end"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_at") > 0, F.col("_dt"))).alias("_gap"), F.collect_list("_item").alias("_items"),
    ).filter(_whole(window, max_gap_s)).withColumn("_items", F.array_sort("_items"))
    return wins.select(*track.keys, "t_start", "t_end", F.col("_items.x").alias("x"), F.col("_items.m").alias("mask"), *[F.col(f"_items.e_{name}").alias(name) for name in more])


def history_windows(
    df: DataFrame, track: Track, *, inputs: Sequence[str], targets: Sequence[str], history: int, max_gap_s: float,
    context: Sequence[str] = (), block_rows: int = 100_000,
) -> DataFrame:
    """The ``history`` rows before a row predict that row; time must strictly increase, steps stay within the gap."""
    t = track.order[0]
    rows = _numbered(df, track, {"_pt": Lag(F.col(t))}).withColumn("_dt", F.col(t) - F.col("_pt"))
    rows = rows.withColumn("_x", F.array(*[sc.finite(F.col(f)) for f in inputs]))
    inner = lambda w: w.rowsBetween(1 - history, 0)
    frames = {
        "history": lambda w: F.collect_list("_x").over(w.rowsBetween(-history, -1)),
        "_lo": lambda w: F.min("_dt").over(inner(w)), "_hi": lambda w: F.max("_dt").over(inner(w)),
    }
    out = row_frame(rows, track, frames, before=history, number="_rn", block_rows=block_rows)
    ok = (F.col("_rn") > history) & (F.col("_lo") > 0) & (F.col("_hi") <= max_gap_s)
    return out.filter(ok).select(
        *track.keys, *track.order, "history",
        F.array(*[sc.finite(F.col(c)) for c in targets]).alias("target"),
        F.array(*[sc.finite(F.col(c)).isNotNull().cast("int") for c in targets]).alias("target_mask"), *context,
    )


def run_window_scores(
    df: DataFrame, track: Track, *, penalty: str, observed: Column, n_channels: int, window: int, stride: int, max_gap_s: float,
) -> DataFrame:
    """Mean penalty and observed-cell share per window inside gap-free runs; a window is dated at its last row.

    Runs break where dt <= 0 or dt > max_gap_s; windows start at every ``stride``-th row of a run.
    """
    t = track.order[0]
    bad = lambda p, c: (c["t"] - p["t"] <= 0) | (c["t"] - p["t"] > max_gap_s)
    rows = runs(df.withColumn("_obs", observed), track, {"t": F.col(t)}, bad, out="_run")
    inner = track.by(*track.keys, "_run")
    rows = _numbered(rows, inner)
    span = lambda w: w.rowsBetween(1 - window, 0)
    out = row_frame(
        rows, inner,
        {"score": lambda w: F.avg(penalty).over(span(w)), "_cells": lambda w: F.sum("_obs").over(span(w)),
         "t_start": lambda w: F.first(F.col(t)).over(span(w))},
        before=window - 1, number="_rn",
    )
    ok = (F.col("_rn") >= window) & ((F.col("_rn") - window) % stride == 0) & (F.col("_cells") > 0)
    return out.filter(ok).select(
        *track.keys, "t_start", F.col(t).alias("t_end"), "score",
        (F.col("_cells") / float(window * n_channels)).alias("support"),
    )


def window_truth(
    df: DataFrame, track: Track, *, changed: Column, evaluable: Column, window: int, stride: int, max_gap_s: float,
    support_rows: int | None = None,
) -> DataFrame:
    """q_w = changed share of evaluable rows on the scored part of each window, with its strata.

    The scored part is the whole window or its last ``support_rows`` rows; changed rows
    before it only mark the history as contaminated.
    """
    r = window if support_rows is None else support_rows
    if not 0 < r <= window:
        raise ValueError("support_rows must be in 1..window")
    t = track.order[0]
    rows = _numbered(df, track, {"_pt": Lag(F.col(t))}).withColumns({
        "_dt": F.col(t) - F.col("_pt"),
        "_e": F.coalesce(evaluable, F.lit(False)).cast("int"),
        "_c": F.coalesce(evaluable & changed, F.lit(False)).cast("int"),
    })
    scored = F.col("_at") >= window - r
    out = _spread(rows.select(*track.keys, F.col(t), "_rn", "_dt", "_e", "_c"), window=window, stride=stride).groupBy(*track.keys, "_win").agg(
        F.min_by(F.col(t), F.col("_at")).alias("t_start"), F.max_by(F.col(t), F.col("_at")).alias("t_end"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_at") > 0, F.col("_dt"))).alias("_gap"),
        F.sum(F.when(scored, F.col("_e"))).alias("_den"), F.sum(F.when(scored, F.col("_c"))).alias("_num"), F.sum(F.when(~scored, F.col("_c"))).alias("_old"),
    ).filter(_whole(window, max_gap_s))
    q = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))
    out = out.withColumn("q_w", q)
    steady = F.coalesce(F.col("q_w").isin(0.0, 1.0), F.lit(False))
    return out.select(
        *track.keys, "t_start", "t_end", "q_w", F.col("q_w").isNotNull().alias("truth_scoreable"),
        (F.col("q_w") > 0).alias("y_any"), steady.alias("steady_subset"), F.when(steady, F.col("q_w") == 1.0).alias("steady_label"),
        (F.col("_old") > 0 if r < window else F.lit(False)).alias("history_contaminated"),
    )


def lag_summary(
    df: DataFrame, track: Track, *, value: str, unit: int = 1_000_000,
    ages: Sequence[tuple[float, float]] = ((0.0, 0.25), (0.25, 0.5), (0.5, 1.0)),
) -> DataFrame:
    """Last value, triangular-weighted means over age intervals (in units) and last minus oldest mean.

    ``track.order[0]`` is an integer clock with ``unit`` ticks per unit. An interval holds
    ages low <= a < high (the first also a = high); weight is 1 + (high - a)/(high - low).
    """
    axis, reach = track.order[0], math.ceil(max(h for _, h in ages) * unit)
    v = F.col("_v")
    # times count from the start of a row's slice: sums of products keep their digits
    rel = lambda: (F.col(axis) - F.col(BLOCK) * max(int(track.chunk), reach, 1)) / float(unit)
    frames: dict[str, Frame] = {}
    for i, (low, high) in enumerate(ages):
        old = math.floor(high * unit) if low == 0 else math.ceil(high * unit) - 1
        over = lambda c, w, o=old, y=math.ceil(low * unit): c.over(w.rangeBetween(-o, -y))
        frames |= {
            f"_n{i}": lambda w, f=over: f(F.count(v), w), f"_v{i}": lambda w, f=over: f(F.sum(v), w),
            f"_t{i}": lambda w, f=over: f(F.sum(F.when(v.isNotNull(), rel())), w), f"_p{i}": lambda w, f=over: f(F.sum(v * rel()), w),
        }
    frames["_now"] = lambda w: F.max(rel()).over(w.rangeBetween(0, 0))
    rows = time_frame(df.withColumn("_v", sc.finite(F.col(value))), track, frames, before=reach)
    names = [f"{value}__tri_{i}" for i in range(len(ages))]

    def mean(i: int, low: float, high: float) -> Column:
        # weight 1 + (high - now + t) / (high - low) is a line in t: its sums need the sums of v, t and t v alone
        flat, slope = 1.0 + (high - F.col("_now")) / (high - low), 1.0 / (high - low)
        return F.when(F.col(f"_n{i}") > 0, (flat * F.col(f"_v{i}") + slope * F.col(f"_p{i}")) / (flat * F.col(f"_n{i}") + slope * F.col(f"_t{i}")))

    rows = rows.withColumns({name: mean(i, low, high) for i, (name, (low, high)) in enumerate(zip(names, ages))})
    last = sc.finite(F.col(value))
    return rows.withColumns({f"{value}__last": last, f"{value}__delta": last - F.col(names[-1])}).drop("_v", "_now", *[f"_{c}{i}" for c in "nvtp" for i in range(len(ages))])


def future_mean(df: DataFrame, track: Track, *, value: str, horizon: int, out: str) -> DataFrame:
    """Mean of finite values in (t, t + horizon] ticks of the integer clock."""
    v = "_fin"
    rows = df.withColumn(v, sc.finite(F.col(value)))
    return time_frame(rows, track, {out: lambda w: F.avg(v).over(w.rangeBetween(1, horizon))}, before=0, after=horizon).drop(v)


def finite_difference(df: DataFrame, track: Track, *, value: str, width: int, unit: int = 1_000_000, out: str) -> DataFrame:
    """(x_right - x_left)/(t_right - t_left) over the samples within +-width/2 ticks.

    A sample alone in its frame uses its neighbours: both inside, the one available at an edge.
    """
    axis, half = track.order[0], width // 2
    pair = F.struct(F.col(axis).alias("t"), sc.finite(F.col(value)).alias("v"))
    rows = sweep(df.withColumn("_pair", pair), track, {"_b": Lag(pair), "_a": Lead(pair)})
    rows = time_frame(
        rows, track,
        {"_l": lambda w: F.first("_pair").over(w.rangeBetween(-half, half)), "_r": lambda w: F.last("_pair").over(w.rangeBetween(-half, half))},
        before=half, after=half,
    )
    alone = F.col("_l.t") == F.col("_r.t")
    left = F.when(alone, F.coalesce("_b", "_pair")).otherwise(F.col("_l"))
    right = F.when(alone, F.coalesce("_a", "_pair")).otherwise(F.col("_r"))
    rows = rows.withColumns({"_l2": left, "_r2": right})
    dt = (F.col("_r2.t") - F.col("_l2.t")) / float(unit)
    rows = rows.withColumn(out, F.when(dt > 0, (F.col("_r2.v") - F.col("_l2.v")) / dt))
    return rows.drop("_pair", "_a", "_b", "_l", "_r", "_l2", "_r2")


def no_response_score(
    df: DataFrame, track: Track, *, command: str, response: str, command_threshold: float, response_threshold: float,
    width: int, out: str,
) -> DataFrame:
    """max(0, range(command)/threshold - range(response)/threshold) over the trailing frame.

    Needs at least two rows and no missing cell in the frame, otherwise null.
    """
    c, r = sc.finite(F.col(command)), sc.finite(F.col(response))
    rows = df.withColumns({"_c": c, "_r": r, "_ok": (c.isNotNull() & r.isNotNull()).cast("int")})
    f = lambda w: w.rangeBetween(-width, 0)
    rows = time_frame(rows, track, {
        "_cs": lambda w: F.max("_c").over(f(w)) - F.min("_c").over(f(w)),
        "_rs": lambda w: F.max("_r").over(f(w)) - F.min("_r").over(f(w)),
        "_n": lambda w: F.count(F.lit(1)).over(f(w)), "_k": lambda w: F.sum("_ok").over(f(w)),
    }, before=width)
    score = F.greatest(F.lit(0.0), F.col("_cs") / command_threshold - F.col("_rs") / response_threshold)
    rows = rows.withColumn(out, F.when((F.col("_n") >= 2) & (F.col("_k") == F.col("_n")), score))
    return rows.drop("_c", "_r", "_ok", "_cs", "_rs", "_n", "_k")


def turn_points(
    df: DataFrame, track: Track, *, distance: str, window: int, max_distance: float, min_approach: float,
    min_departure: float, separation: int, buffer: int,
) -> DataFrame:
    """Flag V-turns of a distance signal and the rows within ``buffer`` ticks of one.

    A candidate is near enough, has both legs of ``window`` ticks inside the track and drops
    by the required excursions against the maximum on either side. Candidates at most
    ``separation`` apart are one event, placed at the smallest distance (the middle of ties).
    """
    axis = track.order[0]
    rows = df.withColumn("_d", sc.finite(F.col(distance)))
    rows = sweep(rows, track, {"_t0": Whole(F.col(axis), "min"), "_t1": Whole(F.col(axis), "max")})
    rows = time_frame(rows, track, {
        "_past": lambda w: F.max("_d").over(w.rangeBetween(-window, -1)),
        "_next": lambda w: F.max("_d").over(w.rangeBetween(1, window)),
    }, before=window, after=window)
    x, d = F.col(axis), F.col("_d")
    cand = (
        (d <= max_distance) & (x - F.col("_t0") >= window) & (F.col("_t1") - x >= window)
        & (F.col("_past") - d >= min_approach) & (F.col("_next") - d >= min_departure)
    )
    rows = rows.withColumn("_cand", F.coalesce(cand, F.lit(False))).drop("_past", "_next", "_t0", "_t1")
    hits = rows.filter("_cand").select(*track.keys, *track.order, "_d")
    hits = runs(hits, track, {"t": x}, lambda p, c: c["t"] - p["t"] > separation, out="_cl")
    inner = track.by(*track.keys, "_cl")
    hits = sweep(hits, inner, {"_min": Whole(F.col("_d"), "min")})
    tie = F.when(F.col("_d") == F.col("_min"), 1).otherwise(0)
    hits = sweep(hits.withColumn("_tie", tie), inner, {"_k": Running(F.col("_tie")), "_n": Whole(F.col("_tie"))})
    picked = hits.filter((F.col("_tie") == 1) & (F.col("_k") == F.floor(F.col("_n") / 2) + 1))
    on = [*track.keys, *track.order]
    rows = rows.join(picked.select(*on, F.lit(True).alias("turn_event")), on, "left")
    rows = rows.withColumn("turn_event", F.coalesce("turn_event", F.lit(False)))
    rows = sweep(rows, track, {"_b": Carry(x, when=F.col("turn_event")), "_a": Ahead(x, when=F.col("turn_event"))})
    near = F.coalesce(x - F.col("_b") <= buffer, F.lit(False)) | F.coalesce(F.col("_a") - x <= buffer, F.lit(False))
    return rows.withColumn("turn_boundary", near).drop("_d", "_cand", "_b", "_a")


def moving_blocks(
    df: DataFrame, track: Track, *, score: str, evaluable: Column, candidates: Sequence[float], block_s: float,
    stride_s: float, merge_gap_s: float, max_gap_s: float,
) -> DataFrame:
    """Overlapping time blocks per entity: exposure and, for each threshold, episode onsets.

    Output is long: (entity, block, h, exposure_s, onsets). Onsets belong to the entity's
    whole timeline, so a continuing alarm is not counted again by the next block. Blocks are
    half-open; the last one is anchored at the end and closed.
    """
    t = track.order[0]
    x = F.col(t)
    rows = df.withColumn("_ok", F.coalesce(evaluable, F.lit(False))).filter(x.isNotNull())
    on = lambda h: F.coalesce(F.col("_ok") & (F.col(score) > h), F.lit(False))
    rows = sweep(rows, track, {
        "_pt": Lag(x), "_first": Whole(x, "min"), "_last": Whole(x, "max"),
        **{f"_pa{i}": Carry(x, when=on(h), inclusive=False) for i, h in enumerate(candidates)},
    })
    dt = x - F.col("_pt")
    rows = rows.withColumn("_exp", F.when(F.col("_ok") & (dt > 0) & (dt <= max_gap_s), dt).otherwise(0.0))
    onset = [
        F.when(on(h) & (F.col(f"_pa{i}").isNull() | (x - F.col(f"_pa{i}") > merge_gap_s)), 1).otherwise(0)
        for i, h in enumerate(candidates)
    ]
    span = F.greatest(F.col("_last") - block_s - F.col("_first"), F.lit(0.0))
    # regular starts 0..k-1 stay half-open, the block anchored at the end is number k
    k = F.ceil(span / stride_s - 1e-9).cast("long")
    rel = x - F.col("_first")
    lo = F.greatest(F.floor((rel - block_s) / stride_s).cast("long") + 1, F.lit(0).cast("long"))
    hi = F.least(F.floor(rel / stride_s).cast("long"), k - 1)
    regular = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    homes = F.when(rel >= span, F.concat(regular, F.array(k))).otherwise(regular)
    rows = rows.select(*track.keys, "_exp", F.array(*onset).alias("_on"), F.explode(homes).alias("block"))
    blocks = rows.groupBy(*track.keys, "block").agg(
        F.sum("_exp").alias("exposure_s"), *[F.sum(F.col("_on")[i]).alias(f"_h{i}") for i in range(len(candidates))]
    )
    per_h = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(f"_h{i}").alias("onsets")) for i, h in enumerate(candidates)])
    return blocks.select(*track.keys, "block", "exposure_s", F.inline(per_h))
