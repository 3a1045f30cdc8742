"""Sequential detectors: page sums, persistence, accumulation, k-of-n, refractory policies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.durable import durable
from trackweave.plans.track import Ahead, Lag, Running, Track, accumulate, close, row_frame, runs, settle, since, sweep


@dataclass(frozen=True)
class Calibration:
    """Centre, scale and slack of one channel."""

    center: float
    scale: float
    slack: float


def page_sums(
    df: DataFrame, track: Track, channels: Mapping[str, Calibration], *, time: str, on_ground: str, threshold: float,
    max_gap_s: float = 60.0, missing_reset_s: float = 60.0, z_clip: float = 8.0,
) -> DataFrame:
    """Two-sided page sums per channel with joint score, alarm and reset reason.

    All states reset at a track start, on or leaving the ground, on an unknown ground
    status, an invalid or backward time and a long gap; an equal time changes nothing. A
    missing channel holds its state until it has been missing for ``missing_reset_s``.
    The joint score is the largest of all states; a row with no observed channel is not
    evaluable and never alarms.
    """
    if not channels:
        raise ValueError("no calibrated channel")
    g, t = F.col(on_ground), F.col(time)
    rows = settle(df, track)
    rows = sweep(rows, track, {"_pt": Lag(t), "_pg": Lag(g), "_had": Lag(F.lit(1))})
    dt = t - F.col("_pt")
    bad_time = sc.finite(t).isNull() | sc.finite(F.col("_pt")).isNull()
    reason = (
        F.when(F.col("_had").isNull(), "flight_start")
        .when(g.isNull() | F.col("_pg").isNull(), "unknown_ground_status")
        .when(g, "on_ground").when(F.col("_pg"), "ground_transition").when(bad_time, "invalid_time")
        .when(dt < 0, "negative_dt").when(dt > max_gap_s, "long_gap").when(dt == 0, "zero_dt").otherwise("none")
    )
    rows = rows.withColumns({"cusum_reset_reason": reason, "cusum_dt_s": dt})
    rows = rows.withColumn("cusum_dt_s", F.when(F.col("cusum_reset_reason").isin("negative_dt", "long_gap", "zero_dt", "none"), F.col("cusum_dt_s")))
    live = F.col("cusum_reset_reason") == "none"
    reset = ~F.col("cusum_reset_reason").isin("none", "zero_dt")
    step = F.col("cusum_dt_s")
    seen = {c: live & sc.finite(F.col(c)).isNotNull() for c in channels}
    lost = {c: live & sc.finite(F.col(c)).isNull() for c in channels}
    rows = since(rows, track, {f"_el_{c}": (reset | seen[c], F.when(lost[c], step).otherwise(0.0)) for c in channels})
    steps: dict[str, tuple[Column, Column]] = {}
    for c, cal in channels.items():
        z = (F.col(c) - cal.center) / cal.scale
        rows = rows.withColumns({
            f"{c}_robust_z": F.when(seen[c], z), f"{c}_observed": seen[c],
            f"{c}_missing_reset": lost[c] & (F.col(f"_el_{c}") >= missing_reset_s),
        })
        clipped = F.greatest(F.lit(-z_clip), F.least(F.col(f"{c}_robust_z"), F.lit(z_clip)))
        clear = reset | F.col(f"{c}_missing_reset")
        inc = lambda s, c=c, v=clipped, k=cal.slack: F.when(F.col(f"{c}_observed"), s * v - k).otherwise(0.0)
        steps[f"{c}_cusum_positive"] = (clear, inc(1))
        steps[f"{c}_cusum_negative"] = (clear, inc(-1))
    rows = accumulate(rows, track, steps)
    states = [F.col(s) for s in steps]
    observed = sum((F.col(f"{c}_observed").cast("int") for c in channels), F.lit(0))
    rows = rows.withColumns({"cusum_joint_score": F.greatest(*states), "cusum_observed_channels": observed})
    rows = rows.withColumn("cusum_evaluable", F.col("cusum_observed_channels") > 0)
    rows = rows.withColumn("cusum_joint_alarm", F.col("cusum_evaluable") & (sc.settled(F.col("cusum_joint_score")) > threshold))
    return close(rows.drop("_pt", "_pg", "_had", *[f"_el_{c}" for c in channels]))


def simple_page_sums(
    df: DataFrame, track: Track, z: Mapping[str, Column], *, slack: float, max_gap_s: float, evaluable: Column, z_clip: float | None = None,
) -> DataFrame:
    """Page sums that reset at a track start, a non-positive or long step and a non-evaluable row."""
    t = track.order[0]
    rows = df.withColumns({"_ok": F.coalesce(evaluable, F.lit(False)), **{f"_z_{k}": c for k, c in z.items()}})
    rows = sweep(track.open(rows), track, {"_pt": Lag(F.col(t))})
    dt = F.col(t) - F.col("_pt")
    rows = rows.withColumn("_rs", ~F.col("_ok") | dt.isNull() | (dt <= 0) | (dt > max_gap_s))
    steps, cut = {}, F.col("_rs")
    for k in z:
        v = F.col(f"_z_{k}")
        if z_clip is not None:
            v = F.when(v.isNotNull(), F.greatest(F.lit(-z_clip), F.least(v, F.lit(z_clip))))
        steps[f"{k}_pos"] = (cut, F.coalesce(v - slack, F.lit(0.0)))
        steps[f"{k}_neg"] = (cut, F.coalesce(-v - slack, F.lit(0.0)))
    rows = accumulate(rows, track, steps)
    rows = rows.withColumn("cusum_score", F.greatest(*[F.col(s) for s in steps]))
    return close(rows.drop("_ok", "_pt", *[f"_z_{k}" for k in z])).withColumnRenamed("_rs", "reset")


def k_of_n(df: DataFrame, track: Track, *, hit: Column, k: int, n: int, out: str = "state") -> DataFrame:
    """True when at least k of the last n rows (fewer at the start) are hits."""
    if not 0 < k <= n:
        raise ValueError("need 0 < k <= n")
    rows = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    rows = row_frame(rows, track, {out: lambda w: F.sum("_hit").over(w.rowsBetween(1 - n, 0)) >= k}, before=n - 1)
    return rows.drop("_hit")


def onsets(df: DataFrame, track: Track, *, state: Column, out: str = "onset") -> DataFrame:
    """True on the first row of each stretch of true states."""
    s = F.coalesce(state, F.lit(False))
    rows = sweep(df, track, {"_ps": Lag(s)})
    return rows.withColumn(out, s & ~F.coalesce(F.col("_ps"), F.lit(False))).drop("_ps")


def temporal_evidence(
    df: DataFrame, track: Track, *, p_value: str, alpha: float | Column, mode: str, max_gap_s: float,
    persistence_s: float | None = None, reference_surprisal: float | None = None, accumulation_threshold: float | None = None,
) -> DataFrame:
    """Evidence and alarm of one channel's p-values.

    ``instant``: p <= alpha. ``persistence``: time spent at p <= alpha. ``accumulation``:
    max(0, e + dt (-ln p - reference)). A non-positive or long step restarts the evidence.
    """
    if not isinstance(alpha, Column) and not 0 < alpha < 1:
        raise ValueError("alpha must be inside (0, 1)")
    wanted = {"instant": (), "persistence": (persistence_s,), "accumulation": (reference_surprisal, accumulation_threshold)}
    given = [v for v in (persistence_s, reference_surprisal, accumulation_threshold) if v is not None]
    if mode not in wanted or any(v is None or not v > 0 for v in wanted[mode]) or len(given) != len(wanted[mode]):
        raise ValueError(f"wrong parameters for mode {mode!r}")
    t, p = track.order[0], F.col(p_value)
    rows = sweep(track.open(df), track, {"_pt": Lag(F.col(t))})
    dt = F.col(t) - F.col("_pt")
    rows = rows.withColumns({
        "_dt": dt,
        "reset_reason": F.when(F.col("_pt").isNull(), "flight_start").when((dt <= 0) | (dt > max_gap_s), "invalid_or_large_gap").otherwise(""),
    })
    cut = F.col("reset_reason") != ""
    if mode == "persistence":
        mark = cut | (p > alpha)
        rows = since(rows, track, {"temporal_evidence": (mark, F.when(mark, 0.0).otherwise(F.col("_dt")))})
        rows = rows.withColumn("alarm", F.col("temporal_evidence") >= persistence_s)
    elif mode == "accumulation":
        rows = accumulate(rows, track, {"temporal_evidence": (cut, F.col("_dt") * (-F.log(p) - reference_surprisal))})
        rows = rows.withColumn("alarm", F.col("temporal_evidence") >= accumulation_threshold)
    else:
        rows = rows.withColumns({"temporal_evidence": F.lit(0.0), "alarm": p <= alpha})
    return close(rows.drop("_pt", "_dt"))


Fold = Callable[[pd.DataFrame, dict], np.ndarray]


def fold_groups(df: DataFrame, groups: list[str], order: list[str], fold: Fold, *, out: str) -> DataFrame:
    """Boolean column from a sequential rule run over each group in order.

    Groups stream through Arrow batches with a small state, so no group is ever gathered.
    ``fold(batch rows of one group, state)`` returns the flags and updates the state.
    """
    schema = df.select("*", F.lit(False).alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in batches:
            flags = np.zeros(len(pdf), dtype=bool)
            # groups in the order of their rows: the last one may go on in the next batch
            here, before = pdf[groups], pdf[groups].shift()
            new = ((here != before) & ~(here.isna() & before.isna())).any(axis=1).to_numpy()
            new[:1] = True
            starts = np.flatnonzero(new)
            for a, b, k in zip(starts, [*starts[1:], len(pdf)], here.iloc[starts].itertuples(index=False, name=None)):
                k = tuple(None if pd.isna(v) else v for v in k)
                if k != key:
                    key, state = k, {}
                flags[a:b] = fold(pdf.iloc[a:b], state)
            yield pdf.assign(**{out: flags})

    laid = df.repartition(*groups).sortWithinPartitions(*groups, *order)
    return laid.mapInPandas(run, schema)


def spaced(hits: DataFrame, track: Track, *, apart: float) -> DataFrame:
    """The rows of each track that fire if the first does and then always the first at least ``apart`` after the one that fired last.

    Rows further apart do not influence each other, so the first of each stretch of close
    rows fires. Inside a stretch every row points at the first one ``apart`` later; following
    the pointers from its head reaches the rows that fire. Pointers are doubled: what two rounds reach
    one jump reaches next, so a stretch of n fires takes about log2(n) joins on row numbers, however dense it is.
    """
    t = track.order[0]
    rows = runs(hits, track, {"t": F.col(t)}, lambda p, c: c["t"] - p["t"] >= apart, out="_isle")
    line = track.by(*track.keys, "_isle")
    rows = durable(sweep(rows, line, {"_n": Running(F.lit(1).cast("long"))}))
    on = [*line.keys, "_n"]
    span = rows.groupBy(*line.keys).agg((F.max(t) - F.min(t)).alias("_span")).filter(F.col("_span") >= apart).drop("_span")
    inner = durable(rows.join(span, list(line.keys), "left_semi").select(*on, *track.order))
    reached = rows.filter("_n = 1").select(*on)
    if not inner.isEmpty():
        # a question at each row's time plus the gap is answered by the next row at or after it
        asked = inner.select(*line.keys, "_n", (F.col(t) + apart).alias(t), *[F.lit(None).cast(inner.schema[c].dataType).alias(c) for c in track.order[1:]], F.lit(0).alias("_side"))
        both = asked.unionByName(inner.withColumn("_side", F.lit(1)))
        ahead = Track(line.keys, (t, "_side", *track.order[1:]), track.chunk)
        row = F.col("_side") == 1
        jump = sweep(both, ahead, {"_to": Ahead(F.col("_n"), when=row)}).filter("_side = 0 AND _to IS NOT NULL").select(*on, "_to")
        jump = durable(jump)
        while True:
            further = reached.join(jump, on).select(*line.keys, F.col("_to").alias("_n"))
            reached = durable(reached.unionByName(further))
            # where a jump lands the same jump goes on
            after = jump.select(*line.keys, F.col("_n").alias("_to"), F.col("_to").alias("_then"))
            jump = durable(jump.join(after, [*line.keys, "_to"]).select(*on, F.col("_then").alias("_to")))
            if jump.isEmpty():
                break
    return rows.join(reached, on, "left_semi").drop("_isle", "_n")


def crossings(df: DataFrame, track: Track, *, score: str, reset: Column) -> DataFrame:
    """Add ``_now``, the settled score, and ``_was``, that of the row before, 0 at a reset and at a start."""
    rows = sweep(df.withColumn("_now", sc.settled(F.col(score))), track, {"_ps": Lag(F.col("_now"))})
    was = F.when(F.coalesce(reset, F.lit(False)), 0.0).otherwise(F.coalesce(F.col("_ps"), F.lit(0.0)))
    return rows.withColumn("_was", was).drop("_ps")


def crossing_alarms(
    df: DataFrame, track: Track, *, score: str, reset: Column, threshold: float, refractory_s: float,
) -> DataFrame:
    """Rows where the score rises through ``threshold``, at least ``refractory_s`` after the last one emitted."""
    if threshold <= 0 or refractory_s <= 0:
        raise ValueError("threshold and refractory_s must be positive")
    hits = crossings(df, track, score=score, reset=reset).filter((F.col("_was") < threshold) & (F.col("_now") >= threshold)).drop("_was", "_now")
    return spaced(hits, track, apart=refractory_s)


def refractory_page_alarms(
    df: DataFrame, track: Track, *, z: Column, slack: float, threshold: float, refractory_rows: int, out: str = "onset",
) -> DataFrame:
    """One-sided page sum that fires above ``threshold``, restarts at 0 and then skips rows; null z adds 0.

    The sum without restarts bounds the one with them from above, so the process renews at a
    row where it is zero with no exceedance in the skipped reach. Only stretches between
    renewals that exceed the threshold at all need the sequential rule.
    """
    v = F.coalesce(sc.finite(z), F.lit(0.0))
    rows = settle(df.withColumn("_v", v), track)
    rows = accumulate(rows, track, {"_free": (F.lit(False), F.col("_v") - slack)})
    # a little below the threshold, so that no rounding of the running sums hides a row that may fire
    near = threshold - 1e-6
    over = F.col("_free") > near
    rows = since(rows, track, {"_age": (over, F.when(over, 0).otherwise(1)), "_any": (F.lit(False), over.cast("int"))})
    renew = (F.col("_free") <= 0) & ((F.col("_any") == 0) | (F.col("_age") > refractory_rows))
    rows = sweep(rows.withColumn("_renew", renew), track, {"_pr": Lag(F.col("_renew"))})
    rows = sweep(rows, track, {"_isle": Running(F.coalesce(F.col("_pr"), F.lit(False)).cast("long"))})
    rows = close(rows.drop("_pr", "_renew", "_age", "_any"))
    keys = [*track.keys, "_isle"]
    hot = rows.groupBy(*keys).agg(F.max("_free").alias("_top")).filter(F.col("_top") > near).select(*keys)

    def fold(rows: pd.DataFrame, state: dict) -> np.ndarray:
        s, skip = state.get("s", 0.0), state.get("skip", 0)
        flags = np.zeros(len(rows), dtype=bool)
        for i, value in enumerate(rows["_v"].to_numpy(float)):
            if skip:
                skip, s = skip - 1, 0.0
                continue
            s = max(0.0, s + value - slack)
            if s > threshold:
                flags[i], s, skip = True, 0.0, refractory_rows
        state.update(s=s, skip=skip)
        return flags

    slim = rows.select(*keys, *track.order, "_v").join(hot, keys, "left_semi")
    fired = fold_groups(slim, keys, list(track.order), fold, out=out).filter(out).select(*track.keys, *track.order, out)
    joined = rows.drop("_v", "_free", "_isle").join(fired, [*track.keys, *track.order], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))
