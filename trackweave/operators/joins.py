"""As-of joins, clock alignment, interval masks and paired-table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.plans.track import Carry, Lag, Running, Track, Whole, sweep
from trackweave.operators.episodes import interval_union


def asof_join(
    left: DataFrame, right: DataFrame, track: Track, *, right_time: str, values: Sequence[str], tolerance: float | None = None,
    matched_time: str | None = None,
) -> DataFrame:
    """Attach the latest right row with t_r <= t_l (within ``tolerance``) per entity; else nulls.

    Both sides are unioned and swept once: no inequality join. Among right rows of one time
    the last in ``values`` order wins.
    """
    t = track.order[0]
    keys = list(track.keys)
    typ = left.schema[t].dataType
    boxed = F.struct(F.col(right_time).cast(typ).alias("_rt"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_time).cast(typ).alias(t), F.lit(0).alias("_side"), boxed.alias("_r"))
    l = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(r.schema["_r"].dataType)})
    both = l.unionByName(r.filter(F.col(t).isNotNull()), allowMissingColumns=True)
    line = Track(track.keys, (t, "_side", *track.order[1:], "_r"), track.chunk)
    rows = sweep(both, line, {"_hit": Carry(F.col("_r"), when=F.col("_side") == 0)}).filter(F.col("_side") == 1)
    ok = F.col("_hit").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col(t) - F.col("_hit._rt") <= tolerance)
    out = {v: F.when(ok, F.col(f"_hit.{v}")) for v in values}
    if matched_time:
        out[matched_time] = F.when(ok, F.col("_hit._rt"))
    return rows.withColumns(out).drop("_side", "_r", "_hit")


def align_to_clock(
    clock: DataFrame, topics: Mapping[str, tuple[DataFrame, Sequence[str]]], track: Track, *, tolerances: Mapping[str, float],
    stale: DataFrame | None = None,
) -> DataFrame:
    """As-of join of every topic to the clock rows in one union and one sweep.

    Each attached column gets ``<column>_staleness_ms`` (infinite when unmatched); a name
    already on the clock becomes ``<topic>__<column>``; the clock's own columns have
    staleness 0. ``stale(entity.., name, start, end)`` blanks a topic or column in closed intervals.
    """
    t = track.order[0]
    keys = list(track.keys)
    own = [c for c in clock.columns if c not in (*keys, *track.order)]
    base = clock.withColumns({"_side": F.lit(1), **{f"{c}_staleness_ms": F.lit(0.0) for c in own}})
    taken, names = set(clock.columns), {}
    both = base
    for topic, (df, cols) in topics.items():
        if topic not in tolerances or not tolerances[topic] > 0:
            raise ValueError(f"no positive tolerance for topic {topic}")
        names[topic] = {c: (c if c not in taken else f"{topic}__{c}") for c in cols}
        taken |= set(names[topic].values())
        box = F.struct(F.col("t" if t not in df.columns else t).alias("_rt"), *[F.col(c) for c in cols]).alias(f"_r_{topic}")
        both = both.unionByName(df.select(*keys, F.col(t), F.lit(0).alias("_side"), box), allowMissingColumns=True)
    line = Track(track.keys, (t, "_side", *track.order[1:]), track.chunk)
    rows = sweep(both, line, {f"_h_{k}": Carry(F.col(f"_r_{k}"), when=F.col(f"_r_{k}").isNotNull()) for k in topics})
    rows = rows.filter(F.col("_side") == 1)
    add: dict[str, Column] = {}
    for topic, cols in names.items():
        hit = F.col(f"_h_{topic}")
        ok = hit.isNotNull() & (F.col(t) - hit["_rt"] <= tolerances[topic])
        for c, name in cols.items():
            add[name] = F.when(ok, hit[c])
            add[f"{name}_staleness_ms"] = F.when(ok, (F.col(t) - hit["_rt"]) * 1000.0).otherwise(F.lit(float("inf")))
    rows = rows.withColumns(add).drop("_side", *[f"_r_{k}" for k in topics], *[f"_h_{k}" for k in topics])
    if stale is not None:
        for topic, cols in names.items():
            for c, name in cols.items():
                marked = interval_member(rows, stale.filter(F.col("name").isin(topic, c)), track, start="start", end="end", out="_st")
                rows = marked.withColumns({
                    name: F.when(~F.col("_st"), F.col(name)),
                    f"{name}_staleness_ms": F.when(F.col("_st"), F.lit(float("inf"))).otherwise(F.col(f"{name}_staleness_ms")),
                }).drop("_st")
    return rows


def interval_member(df: DataFrame, intervals: DataFrame, track: Track, *, start: str, end: str, out: str) -> DataFrame:
    """True where the row's time lies in any closed interval of its entity.

    The furthest end among intervals starting at or before the row decides, so this is a
    running maximum over the union and not a range join.
    """
    t = track.order[0]
    iv = intervals.select(*track.keys, F.col(start).alias(t), F.lit(0).alias("_side"), F.col(end).cast("double").alias("_end"))
    both = df.withColumns({"_side": F.lit(1), "_end": F.lit(None).cast("double")}).unionByName(iv, allowMissingColumns=True)
    line = Track(track.keys, (t, "_side", *track.order[1:]), track.chunk)
    rows = sweep(both, line, {"_reach": Running(F.col("_end"), "max")}).filter(F.col("_side") == 1)
    return rows.withColumn(out, F.coalesce(F.col("_reach") >= F.col(t), F.lit(False))).drop("_side", "_end", "_reach")


def observed_tolerances(df: DataFrame, track: Track, *, topic: str, registered: Mapping[str, float], periods: float = 1.5) -> DataFrame:
    """Per entity and topic: max(registered tolerance, periods x median positive step)."""
    from trackweave.plans.select import exact_quantiles

    line = track.by(*track.keys, topic)
    t = F.col(track.order[0])
    steps = sweep(df, line, {"_pt": Lag(t)}).withColumn("_dt", t - F.col("_pt")).filter(F.col("_dt") > 0)
    med = exact_quantiles(steps, [*track.keys, topic], "_dt", {"median_dt": 0.5})
    base = F.coalesce(*[F.when(F.col(topic) == k, F.lit(float(v))) for k, v in registered.items()], F.lit(0.0))
    return med.select(*track.keys, topic, F.greatest(base, F.col("median_dt") * periods).alias("tolerance"))


def paired_rows(clean: DataFrame, corrupt: DataFrame, *, on: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Full pairing of two tables row by row: raises on a missing partner or a different time.

    ``changed`` tells whether any listed column differs (null equals null).
    """
    a = clean.select(*on, F.struct(F.col(time).alias("t"), *[F.col(c) for c in columns]).alias("_a"))
    b = corrupt.select(*on, F.struct(F.col(time).alias("t"), *[F.col(c) for c in columns]).alias("_b"))
    both = a.join(b, list(on), "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a.t").eqNullSafe(F.col("_b.t")))
    diff = F.lit(False)
    for c in columns:
        diff = diff | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    checked = F.when(same, diff).otherwise(F.raise_error(F.lit("paired tables differ in rows or time")).cast("boolean"))
    return both.withColumn("changed", checked).select(*on, "changed")


def identity_join(a: DataFrame, b: DataFrame, *, on: Sequence[str], time: str, tolerance: float = 1e-9) -> DataFrame:
    """Join of two tables that must hold the same rows; a missing row or a time further apart raises."""
    right = b.select(*on, F.col(time).alias("_tb"), *[c for c in b.columns if c not in a.columns])
    both = a.withColumn("_ina", F.lit(True)).join(right.withColumn("_inb", F.lit(True)), list(on), "full")
    ok = F.col("_ina").isNotNull() & F.col("_inb").isNotNull() & (F.abs(F.col(time) - F.col("_tb")) <= tolerance)
    checked = F.when(ok, F.col(time)).otherwise(F.raise_error(F.lit("tables do not hold the same rows")).cast("double"))
    return both.withColumn(time, checked).drop("_ina", "_inb", "_tb")


def metadata_join(df: DataFrame, meta: DataFrame, *, on: str, column: str) -> DataFrame:
    """Left join whose every row must find metadata."""
    out = df.join(meta.select(on, column), on, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {column} for "), F.col(on).cast("string"))).cast(meta.schema[column].dataType)
    return out.withColumn(column, F.coalesce(F.col(column), missing))


def first_alarm(events: DataFrame, alarms: DataFrame, track: Track, *, event_id: str, onset: str, end: str, deadline_s: float | None = None) -> DataFrame:
    """Per event: first alarm with onset <= t <= min(end, onset + deadline) and its delay.

    Events and alarms of an entity are swept together backwards: the next alarm at or after
    the onset is all that matters.
    """
    from trackweave.plans.track import Ahead

    t = track.order[0]
    limit = F.col(end).cast("double")
    if deadline_s is not None:
        limit = F.least(limit, F.col(onset) + deadline_s)
    ev = events.select(*track.keys, event_id, F.col(onset).alias(t), F.lit(0).alias("_side"), limit.alias("_limit"))
    al = alarms.filter(F.col(t).isNotNull()).select(*track.keys, F.col(t), F.lit(1).alias("_side"))
    both = ev.unionByName(al, allowMissingColumns=True)
    line = Track(track.keys, (t, "_side"), track.chunk)
    rows = sweep(both, line, {"_next": Ahead(F.col(t), when=F.col("_side") == 1)}).filter(F.col("_side") == 0)
    hit = F.coalesce(F.col("_next") <= F.col("_limit"), F.lit(False))
    return rows.select(*track.keys, event_id, hit.alias("detected"), F.when(hit, F.col("_next") - F.col(t)).alias("first_alarm_delay_s"))


def interval_coverage(events: DataFrame, alerted: DataFrame, track: Track, *, event_id: str, onset: str, end: str, start: str = "t_start", stop: str = "t_end") -> DataFrame:
    """Per event: seconds covered by the union of alerted windows, and their share of its duration.

    With the windows merged, covered(onset, end) = C(end) - C(onset) where C is the covered
    length up to a time: two as-of lookups per event instead of an overlap join.
    """
    t = track.order[0]
    line = Track(track.keys, (t,), track.chunk)
    merged = interval_union(alerted, track, start=start, end=stop).withColumnRenamed(start, t)
    merged = sweep(merged, line, {"_before": Running(F.col(stop) - F.col(t), inclusive=False)})
    merged = merged.select(*track.keys, F.col(t).alias("_s"), F.col(stop).alias("_e"), F.coalesce("_before", F.lit(0.0)).alias("_before"))
    probes = events.select(
        *track.keys, event_id, F.inline(F.array(
            F.struct(F.lit("onset").alias("which"), F.col(onset).cast("double").alias(t)),
            F.struct(F.lit("end").alias("which"), F.col(end).cast("double").alias(t)),
        ))
    )
    seen = asof_join(probes, merged, line, right_time="_s", values=["_e", "_before"], matched_time="_s")
    upto = F.coalesce(F.col("_before") + F.least(F.col(t), F.col("_e")) - F.col("_s"), F.lit(0.0))
    at = lambda k, v: F.max(F.when(F.col("which") == k, v))
    out = seen.groupBy(*track.keys, event_id).agg(
        F.greatest(F.lit(0.0), at("end", F.col(t)) - at("onset", F.col(t))).alias("duration_s"),
        (at("end", upto) - at("onset", upto)).alias("covered_s"),
    )
    return out.withColumn("fraction", F.when(F.col("duration_s") > 0, F.col("covered_s") / F.col("duration_s")))
