"""Alarm emissions and state reasons merged into episodes; exposure of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.plans.track import Lag, Running, Track, Whole, runs, settle, sweep


def alarm_episodes(df: DataFrame, track: Track, *, alarm: Column, merge_gap_s: float) -> DataFrame:
    """Alarm rows of an entity closer than or equal to ``merge_gap_s`` form one episode."""
    t = track.order[0]
    rows = df.filter(alarm & F.col(t).isNotNull()).select(*track.keys, *track.order)
    rows = runs(rows, track, {"t": F.col(t)}, lambda p, c: c["t"] - p["t"] > merge_gap_s, out="_ep")
    return rows.groupBy(*track.keys, "_ep").agg(
        F.min(t).alias("episode_start"), F.max(t).alias("episode_end"), F.count(F.lit(1)).alias("n_emissions")
    ).drop("_ep")


def interval_union(
    df: DataFrame, track: Track, *, start: str = "t_start", end: str = "t_end", gap_s: float = 0.0
) -> DataFrame:
    """Union of possibly overlapping intervals per entity; intervals with a missing or reversed end are ignored."""
    rows = df.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*track.keys, start, end)
    line = Track(track.keys, (start, end), track.chunk)
    rows = sweep(line.open(rows), line, {"_reach": Running(F.col(end), "max", inclusive=False)})
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap_s), 1).otherwise(0))
    rows = sweep(rows, line, {"_isle": Running(F.col("_new"))})
    return rows.groupBy(*track.keys, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def exposure_of_intervals(df: DataFrame, track: Track, **kw) -> DataFrame:
    """Seconds covered per entity, overlaps counted once."""
    start, end = kw.get("start", "t_start"), kw.get("end", "t_end")
    merged = interval_union(df, track, **kw)
    return merged.groupBy(*track.keys).agg(F.sum(F.col(end) - F.col(start)).alias("seconds"))


def row_exposure(df: DataFrame, track: Track, *, evaluable: Column, max_gap_s: float) -> DataFrame:
    """Seconds per entity of steps with 0 < dt <= max_gap_s that end in an evaluable row."""
    t = track.order[0]
    rows = sweep(df.withColumn("_ev", evaluable), track, {"_pt": Lag(F.col(t))})
    dt = F.col(t) - F.col("_pt")
    step = F.when((dt > 0) & (dt <= max_gap_s) & F.col("_ev"), dt).otherwise(0.0)
    return rows.groupBy(*track.keys).agg(F.sum(step).alias("exposure_s"))


def block_exposure(df: DataFrame, track: Track, *, block_s: float, origin: Column | None = None) -> DataFrame:
    """Observed seconds of every time block holding at least two rows, blocks counted from the entity's start."""
    t = track.order[0]
    rows = sweep(df, track, {"_t0": Whole(F.col(t), "min")})
    zero = origin if origin is not None else F.col("_t0")
    return (
        rows.groupBy(*track.keys, F.floor((F.col(t) - zero) / block_s).alias("block"))
        .agg((F.max(t) - F.min(t)).alias("exposure_s"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= 2)
    )


def alert_burden(
    rows: DataFrame, track: Track, *, alarm: Column, merge_gap_s: float, start: str = "t_start", end: str = "t_end"
) -> DataFrame:
    """Episodes per scoreable hour and the share of scoreable entities with an alarm (one row)."""
    keys = list(track.keys)
    episodes = alarm_episodes(rows, track, alarm=alarm, merge_gap_s=merge_gap_s).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes")
    )
    exposure = rows.groupBy(*keys).agg(F.lit(0.0).alias("_z")).join(
        exposure_of_intervals(rows, track, start=start, end=end), keys, "left"
    )
    both = exposure.join(episodes, keys, "left").agg(
        F.coalesce(F.sum("episodes"), F.lit(0)).alias("n_alert_episodes"),
        F.count(F.lit(1)).alias("n_scoreable_flights"),
        F.count("episodes").alias("n_alerted_flights"),
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) / 3600).alias("scoreable_flight_hours"),
    )
    return both.withColumns({
        "alerted_flight_fraction": F.try_divide(F.col("n_alerted_flights"), F.col("n_scoreable_flights")),
        "episodes_per_hour": F.try_divide(F.col("n_alert_episodes").cast("double"), F.col("scoreable_flight_hours")),
    })


def reason_channel(code: Column) -> Column:
    """The channel that a code's prefix names."""
    return (
        F.when(code.startswith("DECLARED_"), "declared_status")
        .when(code.startswith("POSITION_QUALITY_"), "position_quality")
        .when(code.startswith("ALTITUDE_AVAILABILITY_"), "altitude_availability")
        .when(code == "MESSAGE_GAP", "message_gap")
        .otherwise("unknown")
    )


def explode_reasons(df: DataFrame, *, identity: Sequence[str], codes: str = "reason_codes") -> DataFrame:
    """One row per reason code with its channel."""
    return df.select(*identity, F.explode(codes).alias("reason_code")).withColumn("channel", reason_channel(F.col("reason_code")))


def reason_episodes(
    reasons: DataFrame, *, entity: str, position: str, time: str, chunk: float = 1_000_000.0,
    point_reasons: Sequence[str] = ("MESSAGE_GAP",),
) -> DataFrame:
    """Runs of one reason over consecutive row positions; point reasons are an episode per row."""
    keys = (entity, "channel", "reason_code")
    line = Track(keys, (position,), chunk)
    apart = lambda p, c: (c["p"] != p["p"] + 1) | c["r"].isin(*point_reasons)
    laid = settle(reasons.select(*keys, position, time), line)
    rows = runs(laid, line, {"p": F.col(position), "r": F.col("reason_code")}, apart, out="_ep")
    pos = F.col(position)
    return rows.groupBy(*keys, "_ep").agg(
        F.min_by(time, pos).alias("episode_start"), F.max_by(time, pos).alias("episode_end"),
        F.count(F.lit(1)).alias("n_rows"),
    ).drop("_ep")
