"""Splitting ordered rows into segments: gaps, runs, phases, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.plans.track import Ahead, Carry, Lag, Lead, Running, Track, Whole, close, runs, sweep


def diff_columns(df: DataFrame, track: Track, columns: dict[str, str]) -> DataFrame:
    """``{out: column}``: value minus the entity's previous value, null on the first row."""
    prev = {f"_d_{o}": Lag(F.col(c)) for o, c in columns.items()}
    out = sweep(df, track, prev)
    return out.withColumns({o: F.col(c) - F.col(f"_d_{o}") for o, c in columns.items()}).drop(*prev)


def gap_segments(
    df: DataFrame,
    track: Track,
    *,
    gap_s: float,
    out: str = "flight_id",
    number: str | None = None,
    first: int = 0,
    prefix: Column | None = None,
) -> DataFrame:
    """Start a new segment on the first row, on a missing time and after a gap above ``gap_s``.

    ``out`` is ``<entity>_<seq>`` with at least three digits (``<prefix>_`` before it
    when given); ``number`` also keeps the plain sequence number, counted from ``first``.
    """
    time = track.order[0]
    far = lambda p, c: (c["t"] - p["t"]).isNull() | (c["t"] - p["t"] > gap_s)
    rows = runs(df, track, {"t": F.col(time)}, far, out="_seq")
    seq = (F.col("_seq") - 1 + first).cast("long")
    digits = F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))
    parts = ([prefix] if prefix is not None else []) + [F.col(k).cast("string") for k in track.keys] + [digits]
    rows = rows.withColumn(out, F.concat_ws("_", *parts))
    if number:
        rows = rows.withColumn(number, seq)
    return rows.drop("_seq")


def last_segment(df: DataFrame, track: Track, *, gap_s: float) -> DataFrame:
    """Rows after the entity's last gap."""
    rows = gap_segments(df, track, gap_s=gap_s, out="_seg", number="_no")
    rows = sweep(rows, track, {"_top": Whole(F.col("_no"), "max")})
    return rows.filter(F.col("_no") == F.col("_top")).drop("_seg", "_no", "_top")


def segment_summary(df: DataFrame, track: Track, *, segment: str = "flight_id") -> DataFrame:
    """Rows, duration and start per segment."""
    t = F.col(track.order[0])
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max(t) - F.min(t)).alias("duration_s"), F.min(t).alias("start_time")
    )


def sessions(df: DataFrame, track: Track, *, gap_s: float = 1200.0, min_points: int = 3) -> DataFrame:
    """Segments with enough points: start, end, duration, points; newest first."""
    t = F.col(track.order[0])
    rows = gap_segments(df, track, gap_s=gap_s, out="segment_id", number="segment_no", first=1)
    out = rows.groupBy(*track.keys, "segment_no").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count(F.lit(1)).alias("points")
    )
    out = out.withColumn("duration_s", F.col("end_t") - F.col("start_t"))
    return out.filter(F.col("points") >= min_points).orderBy(F.desc("start_t"), *track.keys)


def boundary_agreement(df: DataFrame, track: Track, *, segment: str, flag: str) -> DataFrame:
    """Share of segment starts (an entity's very first row aside) carrying ``flag``; null without any."""
    rows = sweep(df, track, {"_pseg": Lag(F.col(segment))})
    edge = F.col("_pseg").isNotNull() & (F.col("_pseg") != F.col(segment))
    hit = F.when(edge, F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    return rows.agg(F.count(hit).alias("n_boundaries"), F.sum(hit).alias("n_agreed")).select(
        "n_boundaries", (F.col("n_agreed") / F.col("n_boundaries")).alias("agreement")
    )


def legs(df: DataFrame, track: Track, *, segment: str, lat: str = "lat", lon: str = "lon", min_points: int = 3) -> DataFrame:
    """First and last fix, times and size of every segment with at least ``min_points`` rows."""
    pos, fix = track.position(), F.struct(F.col(lat), F.col(lon), F.col(track.order[0]).alias("t"))
    out = df.groupBy(*track.keys, segment).agg(
        F.min_by(fix, pos).alias("a"), F.max_by(fix, pos).alias("b"), F.count(F.lit(1)).alias("n_points")
    )
    return out.filter(F.col("n_points") >= min_points).select(
        *track.keys, segment, "n_points",
        F.col(f"a.{lat}").alias("start_lat"), F.col(f"a.{lon}").alias("start_lon"), F.col("a.t").alias("start_t"),
        F.col(f"b.{lat}").alias("end_lat"), F.col(f"b.{lon}").alias("end_lon"), F.col("b.t").alias("end_t"),
    )


def message_intervals(df: DataFrame, track: Track, *, time: str, threshold_s: float) -> DataFrame:
    """Status of each row against the previous *valid* time; ``track.order`` is the source order."""
    valid = F.col(time).isNotNull() & ~F.isnan(F.col(time))
    rows = sweep(df, track, {"_pt": Carry(F.col(time), when=valid, inclusive=False)})
    delta = F.col(time) - F.col("_pt")
    status = (
        F.when(~valid, "TIMESTAMP_MISSING")
        .when(F.col("_pt").isNull(), "FIRST_OBSERVATION")
        .when(delta < 0, "NON_MONOTONIC_TIMESTAMP")
        .when(delta > threshold_s, "MESSAGE_GAP")
        .otherwise("CONTIGUOUS")
    )
    rows = rows.withColumn("message_interval_status", status)
    gap = F.col("message_interval_status") == "MESSAGE_GAP"
    return rows.withColumns(
        {
            "message_gap": gap,
            "message_gap_s": F.when(gap, delta),
            "message_gap_interval_start": F.when(gap, F.col("_pt")),
            "message_gap_interval_end": F.when(gap, F.col(time)),
        }
    ).drop("_pt")


def drop_non_monotonic(df: DataFrame, track: Track, *, time: str) -> DataFrame:
    """Drop rows whose time does not advance on the row before them (source order in ``track``)."""
    rows = sweep(df, track, {"_pt": Lag(F.col(time))})
    return rows.filter(F.col("_pt").isNull() | (F.col(time) > F.col("_pt"))).drop("_pt")


def equal_runs(df: DataFrame, track: Track, *, value: str, min_duration_s: float = 2.0) -> DataFrame:
    """Runs of one repeated value lasting at least ``min_duration_s``: start, end, rows."""
    t = track.order[0]
    differs = lambda p, c: ~F.coalesce(p["v"] == c["v"], F.lit(False))
    rows = runs(df, track, {"v": F.col(value)}, differs, out="_run")
    out = rows.filter(F.col(value).isNotNull()).groupBy(*track.keys, "_run").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count(F.lit(1)).alias("n_rows")
    )
    return out.filter(F.col("end_t") - F.col("start_t") >= min_duration_s).drop("_run")


def sign_continuity(df: DataFrame, track: Track, parts: list[str]) -> DataFrame:
    """Flip quaternions so that each has a non-negative dot product with the one emitted before.

    The sign is the parity of negative dots of the raw vectors; a zero dot emits the
    raw value and restarts the parity. Rows with a missing part pass unchanged and do
    not count as predecessor.
    """
    ok = F.lit(True)
    for p in parts:
        ok = ok & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    vec = F.struct(*[F.col(p) for p in parts])
    rows = sweep(track.open(df), track, {"_pq": Carry(vec, when=ok, inclusive=False)})
    dot = F.lit(0.0)
    for p in parts:
        dot = dot + F.col(p) * F.col(f"_pq.{p}")
    rows = rows.withColumns({
        "_neg": F.when(ok & (dot < 0), 1).otherwise(0),
        "_zero": F.when(ok & (dot == 0), 1).otherwise(0),
    })
    rows = sweep(rows, track, {"_cn": Running(F.col("_neg"))})
    rows = sweep(rows, track, {"_base": Carry(F.col("_cn"), when=F.col("_zero") == 1)})
    odd = (F.col("_cn") - F.coalesce(F.col("_base"), F.lit(0))) % 2 == 1
    rows = rows.withColumns({p: F.when(ok & odd, -F.col(p)).otherwise(F.col(p)) for p in parts})
    return close(rows.drop("_pq", "_neg", "_zero", "_cn", "_base"))


def path_pieces(df: DataFrame, track: Track, *, lat: str = "lat", lon: str = "lon", alt: str = "alt") -> DataFrame:
    """Consecutive point pairs; altitude is the mean of the known ends."""
    nxt = F.struct(F.col(lat), F.col(lon), F.col(alt))
    rows = sweep(df, track, {"_n": Lead(nxt)}).filter(F.col("_n").isNotNull())
    a, b = F.col(alt), F.col(f"_n.{alt}")
    return rows.withColumns({
        "to_lat": F.col(f"_n.{lat}"), "to_lon": F.col(f"_n.{lon}"),
        "piece_alt": F.coalesce((a + b) / 2, a, b),
    }).drop("_n")


def exposure_bounds(df: DataFrame, track: Track) -> DataFrame:
    """``t_start`` is the previous row's time (own time on the first row), ``t_end`` the own time."""
    t = track.order[0]
    rows = sweep(df, track, {"_pt": Lag(F.col(t))})
    return rows.withColumns({"t_start": F.coalesce("_pt", t), "t_end": F.col(t)}).drop("_pt")


def even_rows(df: DataFrame, track: Track, *, max_points: int) -> DataFrame:
    """At most ``max_points`` observed rows per entity, evenly spaced, ends included.

    Keeps row i (0-based of n) when some j in [0, max_points) has floor(j (n-1)/(max_points-1)) = i.
    """
    if max_points < 2:
        raise ValueError("max_points must be at least 2")
    one = F.lit(1).cast("long")
    rows = sweep(df, track, {"_rn": Running(one), "_n": Whole(one)})
    i, n, m = F.col("_rn") - 1, F.col("_n"), F.lit(max_points - 1).cast("long")
    j = F.ceil(i * m / F.greatest(n - 1, F.lit(1)))
    keep = (n <= max_points) | (F.floor(j * (n - 1) / m) == i)
    return rows.filter(keep).drop("_rn", "_n")


def label_phases(
    df: DataFrame,
    track: Track,
    *,
    on_ground: Column,
    maneuver: Column,
    takeoff: Column,
    landing: Column,
    buffer_s: float,
) -> DataFrame:
    """Phase by priority ground > maneuver > takeoff > landing > cruise, and a boundary flag.

    A row is a boundary when a phase change lies within ``buffer_s`` before or after it;
    the change is dated at the first row of the new phase. Rules are Columns, so any
    threshold set can be expressed; a null rule counts as not met.
    """
    t = track.order[0]
    met = lambda c: F.coalesce(c, F.lit(False))
    phase = (
        F.when(met(on_ground), "ground").when(met(maneuver), "maneuver")
        .when(met(takeoff), "takeoff").when(met(landing), "landing").otherwise("cruise")
    )
    rows = sweep(track.open(df.withColumn("phase", phase)), track, {"_pp": Lag(F.col("phase"))})
    rows = rows.withColumn("_chg", F.col("_pp").isNotNull() & (F.col("_pp") != F.col("phase")))
    rows = sweep(rows, track, {"_back": Carry(F.col(t), when=F.col("_chg")), "_fwd": Ahead(F.col(t), when=F.col("_chg"))})
    near = met(F.col(t) - F.col("_back") <= buffer_s) | met(F.col("_fwd") - F.col(t) <= buffer_s)
    rows = rows.withColumn("boundary", near)
    return close(rows.drop("_pp", "_chg", "_back", "_fwd"))
