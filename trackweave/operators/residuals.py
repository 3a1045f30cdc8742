"""Physics residuals and causal context of consecutive rows, all from one ordered pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.functions import scalars as sc
from trackweave.operators.windows import trailing_median
from trackweave.plans.track import Lag, Track, sweep

# fixed values: default column names of a track table
COLUMNS = {
    "time": "timestamp_utc", "lat": "lat", "lon": "lon", "alt": "alt", "alt_geom": "alt_geom_m",
    "speed": "ground_speed_ms", "track": "track_deg", "vrate": "vertical_rate_ms", "roll": "roll_deg",
}
_USED = {
    "vertical_rate_residual": ("alt", "vrate", "time"),
    "speed_residual": ("lat", "lon", "speed", "time"),
    "east_velocity_residual": ("lat", "lon", "speed", "track", "time"),
    "north_velocity_residual": ("lat", "lon", "speed", "track", "time"),
    "heading_residual": ("lat", "lon", "track"),
    "turn_bank_residual": ("track", "roll", "speed", "time"),
    "altitude_source_residual": ("alt", "alt_geom", "time"),
}


def residuals(
    df: DataFrame, track: Track, *, columns: Mapping[str, str] | None = None,
    which: Sequence[str] = tuple(_USED), gravity: float = sc.GRAVITY, radius: float = geo.EARTH_RADIUS_M,
) -> DataFrame:
    """Add the residuals named in ``which``; one needing an absent column comes out null.

    The first row of a track has none; a zero time step has no rate, and the velocity
    components also need a positive one.
    """
    names = {**COLUMNS, **(columns or {})}
    present = {k: v for k, v in names.items() if v in df.columns}
    before = F.struct(*[F.col(v).cast("double").alias(k) for k, v in present.items()])
    rows = sweep(df, track, {"_q": Lag(before)})
    cur = {k: F.col(v).cast("double") for k, v in present.items()}
    prv = {k: F.col(f"_q.{k}") for k in present}

    def one(name: str) -> Column:
        if any(c not in present for c in _USED[name]):
            return F.lit(None).cast("double")
        step = F.nullif(cur["time"] - prv["time"], F.lit(0.0)) if "time" in present else None
        place = lambda f, **kw: f(prv["lat"], prv["lon"], cur["lat"], cur["lon"], **kw)
        if name == "vertical_rate_residual":
            return cur["vrate"] - (cur["alt"] - prv["alt"]) / step
        if name == "speed_residual":
            return cur["speed"] - place(geo.haversine, radius=radius) / step
        if name in ("east_velocity_residual", "north_velocity_residual"):
            moved = place(geo.haversine, radius=radius) / F.when(step > 0, step)
            part = F.sin if name.startswith("east") else F.cos
            return cur["speed"] * part(F.radians(cur["track"])) - moved * part(F.radians(place(geo.bearing)))
        if name == "heading_residual":
            return geo.circular_diff(cur["track"], place(geo.bearing))
        if name == "turn_bank_residual":
            speed = F.nullif(cur["speed"], F.lit(0.0))
            turn = geo.circular_diff(cur["track"], prv["track"]) / step
            return turn - F.degrees(F.lit(gravity) * F.tan(F.radians(cur["roll"])) / speed)
        return ((cur["alt_geom"] - cur["alt"]) - (prv["alt_geom"] - prv["alt"])) / step

    return rows.withColumns({n: one(n) for n in which}).drop("_q")


def causal_context(
    df: DataFrame, track: Track, *, time: str = "timestamp_utc", on_ground: str = "on_ground",
    vrate: str = "vertical_rate_ms", heading: str = "track_deg", history_rows: int = 5, level_rate: float = 1.0,
    edges: Sequence[float] = (5.0, 15.0), max_gap_s: float = 60.0,
) -> DataFrame:
    """dt, log1p(dt), phase from the trailing median rate, cadence bucket, heading sin/cos, evaluable flag."""
    rows = trailing_median(df, track, value=vrate, rows=history_rows, out="_hist")
    rows = sweep(rows, track, {"_pt": Lag(F.col(time))})
    dt, hist, air = F.col(time) - F.col("_pt"), F.col("_hist"), ~F.col(on_ground)
    phase = (
        F.when(F.col(on_ground), "ground")
        .when(air & (hist > level_rate), "climb").when(air & (hist < -level_rate), "descent")
        .when(air & hist.isNotNull(), "level").otherwise("unknown")
    )
    angle = F.radians(F.when((F.col(heading) >= 0) & (F.col(heading) < 360), F.col(heading)))
    rows = rows.withColumns({
        "context_dt_s": dt, "context_log1p_dt_s": F.log1p(F.when(dt >= 0, dt)), "context_phase": phase,
        "context_cadence": sc.cadence_bucket(dt, edges, max_gap_s), "track_sin": F.sin(angle), "track_cos": F.cos(angle),
    })
    ok = (F.col("context_phase") != "unknown") & F.col("context_cadence").startswith("cadence_")
    return rows.withColumn("context_evaluable", ok).drop("_hist", "_pt")


def context_vector(
    signals: Sequence[str], *, log_dt: str = "context_log1p_dt_s", sin: str = "track_sin", cos: str = "track_cos",
    phase: str = "context_phase", cadence: str = "context_cadence",
    phases: Sequence[str] = ("climb", "descent", "ground", "level", "unknown"),
    cadences: Sequence[str] = ("cadence_0", "cadence_1", "cadence_2", "gap", "initial_or_invalid"),
) -> Column:
    """Fixed-order numeric vector: value-or-0 and 0/1 mask per signal, log dt, sin, cos, one-hot phase and cadence."""
    parts: list[Column] = []
    for s in signals:
        v = sc.finite(F.col(s))
        parts += [F.coalesce(v, F.lit(0.0)), v.isNotNull().cast("double")]
    parts += [F.coalesce(sc.finite(F.col(c)), F.lit(0.0)) for c in (log_dt, sin, cos)]
    for col, levels in ((phase, phases), (cadence, cadences)):
        parts += [F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in levels]
    return F.array(*parts)


def transition_valid(dt: Column, columns: Sequence[str], *, max_gap_s: float = 60.0) -> dict[str, Column]:
    """Columns blanked unless 0 < dt <= max_gap_s."""
    return {c: F.when((dt > 0) & (dt <= max_gap_s), F.col(c)) for c in columns}
