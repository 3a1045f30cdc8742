"""Row predicates and filters of the live map, the history API and the feature builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.ladder import long_form


def in_box(min_lat: float, max_lat: float, min_lon: float, max_lon: float, *, lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon)


def map_filter(
    *, civil: bool, military: bool, ground: bool, low: float, high: float, is_military: str = "is_military", on_ground: str = "on_ground", alt: str = "alt"
) -> Column:
    """Civil/military and ground toggles plus an altitude range that a missing altitude passes; missing flags count as false."""
    m, g = F.coalesce(F.col(is_military), F.lit(False)), F.coalesce(F.col(on_ground), F.lit(False))
    kind = (m & F.lit(military)) | (~m & F.lit(civil))
    return kind & (~g | F.lit(ground)) & (F.col(alt).isNull() | F.col(alt).between(low, high))


def is_stale(age: Column, threshold_s: float) -> Column:
    """Older than the threshold; an unknown age counts as fresh."""
    return F.coalesce(age > threshold_s, F.lit(False))


def is_emergency(squawk: Column, emergency: Column) -> Column:
    return F.coalesce(squawk.isin(*sc.SQUAWK_TYPE), F.lit(False)) | sc.normalise_emergency(emergency).isNotNull()


def share_by(df: DataFrame, groups: Sequence[str], hit: Column) -> DataFrame:
    h = F.count_if(F.coalesce(hit, F.lit(False)))
    return df.groupBy(*groups).agg(h.alias("n"), (h / F.count(F.lit(1))).alias("share"))


def complete_rows(features: Sequence[str], *, target: str, phase: Column, boundary: Column) -> Column:
    """All features and the target present, not on the ground, not at a boundary."""
    ok = sc.finite(F.col(target)).isNotNull() & (phase != "ground") & ~F.coalesce(boundary, F.lit(False))
    for f in features:
        ok = ok & sc.finite(F.col(f)).isNotNull()
    return ok


def time_range(df: DataFrame, *, ts: str, start: str, end: str) -> DataFrame:
    """Closed range given in ISO 8601; literals, so the scan can prune."""
    at = lambda s: F.lit(s).cast("timestamp")
    return df.filter(F.col(ts).between(at(start), at(end)))


def last_hours(df: DataFrame, *, ts: str, hours: float, retention: float = 168.0, now: Column | None = None) -> DataFrame:
    """The last N hours, capped at the retention."""
    span = min(max(hours, 0.0), retention)
    return df.filter(F.col(ts) >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL '{int(span * 3600)}' SECOND"))


def first_failing(gates: Mapping[str, Column]) -> Column:
    """Name of the first gate that fires, empty when none does."""
    out = None
    for name, c in gates.items():
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise("")


def range_violations(df: DataFrame, spec: DataFrame, *, channels: Sequence[str], flight: str, limit: float = 0.01) -> DataFrame:
    """Values outside the registered range per flight and channel; quarantine above ``limit`` of the valid ones."""
    rows = long_form(df, [flight], channels).join(spec.select(F.col("name").alias("channel"), "low", "high"), "channel")
    bad = F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")))
    out = rows.groupBy(flight, "channel").agg(bad.alias("violations"), F.count("v").alias("valid"))
    return out.withColumn("quarantine", F.coalesce(F.try_divide(F.col("violations").cast("double"), F.col("valid")) > limit, F.lit(False)))


def exclude(df: DataFrame, names: DataFrame, *, on: str) -> DataFrame:
    return df.join(names.select(on).distinct(), on, "left_anti")


def airline_prefix(df: DataFrame, *, callsign: str, prefixes: Sequence[str], total: str | None = None) -> DataFrame:
    """Rows whose first three callsign letters are in the set (an empty set keeps all); ``total`` observes the unfiltered count."""
    rows = df.observe(total, F.count(F.lit(1)).alias("rows")) if total else df
    if not prefixes:
        return rows
    return rows.filter(F.substring(F.upper(F.trim(callsign)), 1, 3).isin(*[p.upper() for p in prefixes]))
