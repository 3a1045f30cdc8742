"""Data-quality states of track rows: declared status, position quality, altitude, freshness, gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.episodes import reason_channel
from trackweave.operators.segments import message_intervals
from trackweave.plans.track import Lag, Track, sweep

# fixed values: largest valid code and reference code per quality field
QUALITY_FIELDS = {"nic": (11, 7), "nac_p": (11, 8), "sil": (3, 3)}
FRESH_FIELDS = ("squawk", "emergency", "nic", "nac_p", "sil", "adsb_version")
CRITICAL = ("unlawful", "nordo", "general")


@dataclass(frozen=True)
class QualityRules:
    max_age_s: float = 60.0
    gap_s: float = 60.0
    scope: str = "faa_reference_scope"
    versions: tuple[int, ...] = (2,)


def _present(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def freshness(df: DataFrame, field: str, *, max_age_s: float) -> Column:
    """fresh, stale, never_observed, invalid_update_metadata or freshness_unknown (also for absent columns)."""
    names = [f"{field}_updated", f"{field}_update_timestamp_utc", f"{field}_update_age_s"]
    if any(n not in df.columns for n in names):
        return F.lit("freshness_unknown")
    updated, at, age = F.col(names[0]), sc.finite(F.col(names[1])), sc.finite(F.col(names[2]))
    return (
        F.when(updated.isNull(), "freshness_unknown").when(updated, "fresh").when(age < 0, "invalid_update_metadata")
        .when(age <= max_age_s, "fresh").when(age.isNotNull(), "stale").when(at.isNull(), "never_observed").otherwise("freshness_unknown")
    )


def _code(c: Column) -> Column:
    v = sc.finite(c)
    return F.when(v == F.floor(v), v)


def version_status(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")), "missing").when(_code(c).between(0, 2), "valid").otherwise("schema_invalid")


def scope_status(df: DataFrame, rules: QualityRules) -> Column:
    """First rule met: ground, source, version, then the asserted scope."""
    source, version = _present(df, "ads_source_type"), _present(df, "adsb_version", "double")
    state = version_status(version)
    ladder = (
        F.when(_present(df, "on_ground", "boolean"), "ground_not_applicable")
        .when(source.isNull() | ~F.lower(F.trim(source)).startswith("adsb"), "not_adsb_source")
        .when(state == "missing", "version_missing").when(state == "schema_invalid", "version_schema_invalid")
        .when(~_code(version).isin(*[float(v) for v in rules.versions]), "version_ineligible")
    )
    if rules.scope not in df.columns:
        return ladder.otherwise("scope_not_asserted")
    scope = F.col(rules.scope)
    return ladder.when(scope.isNull(), "scope_unknown").when(~scope, "outside_asserted_scope").otherwise("eligible")


def value_status(field: str, c: Column, eligible: Column) -> Column:
    top, reference = QUALITY_FIELDS[field]
    code = _code(c)
    return (
        F.when(c.isNull() | F.isnan(c.cast("double")), "missing").when(code.isNull() | ~code.between(0, top), "schema_invalid")
        .when(code == 0, "reported_unknown_or_unavailable").when(~eligible, "reported_valid_outside_faa_reference_scope")
        .when(code < reference, "below_faa_reference").otherwise("meets_faa_reference")
    )


def altitude_availability(df: DataFrame) -> Column:
    baro, geom = sc.finite(_present(df, "alt", "double")), sc.finite(_present(df, "alt_geom_m", "double"))
    return (
        F.when(_present(df, "on_ground", "boolean"), "GROUND_ALT_NOT_APPLICABLE").when(baro.isNull() & geom.isNotNull(), "BARO_ALT_DROPOUT")
        .when(baro.isNull(), "ALL_ALTITUDE_UNAVAILABLE").otherwise("AVAILABLE")
    )


def classify(df: DataFrame, track: Track, *, time: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """All states of a row plus the ordered ``reason_codes`` array; ``track`` holds the source order."""
    rows = df.withColumns({f"{f}_freshness": freshness(df, f, max_age_s=rules.max_age_s) for f in FRESH_FIELDS})
    squawk, emergency = sc.squawk_type(_present(df, "squawk")), sc.normalise_emergency(_present(df, "emergency"))
    rows = rows.withColumns({"declared_squawk_type": squawk, "declared_emergency_type": emergency})
    s, e = F.col("declared_squawk_type"), F.col("declared_emergency_type")
    both = s.isNotNull() & e.isin(*CRITICAL) & (F.col("squawk_freshness") == "fresh") & (F.col("emergency_freshness") == "fresh")
    consistency = (
        F.when(s.isNull() & e.isNull(), "not_applicable").when(both & (s == e), "corroborated").when(both, "contradictory").otherwise("not_corroborated")
    )
    rows = rows.withColumns({
        "declared_status_consistency": consistency, "declared_status_active": s.isNotNull() | e.isNotNull(),
        "position_quality_scope": scope_status(df, rules), "adsb_version_status": version_status(_present(df, "adsb_version", "double")),
        "altitude_availability": altitude_availability(df),
    })
    eligible = F.col("position_quality_scope") == "eligible"
    rows = rows.withColumns({f"position_quality_{f}_status": value_status(f, _present(df, f, "double"), eligible) for f in QUALITY_FIELDS})
    rows = message_intervals(rows, track, time=time, threshold_s=rules.gap_s)
    advisory = F.lit(False)
    for f in QUALITY_FIELDS:
        advisory = advisory | (F.col(f"position_quality_{f}_status") == "below_faa_reference")
    bad = ("schema_invalid", "missing", "reported_unknown_or_unavailable", "below_faa_reference")
    codes = [
        F.when(s.isNotNull(), F.concat(F.lit("DECLARED_SQUAWK_"), sc.token(s))), F.when(e.isNotNull(), F.concat(F.lit("DECLARED_EMERGENCY_"), sc.token(e))),
        F.when(F.col("declared_status_active"), F.concat(F.lit("DECLARED_STATUS_"), F.upper("declared_status_consistency"))),
        F.when(F.col("adsb_version_status") == "schema_invalid", "POSITION_QUALITY_ADSB_VERSION_SCHEMA_INVALID"),
    ]
    for f in QUALITY_FIELDS:
        state = F.col(f"position_quality_{f}_status")
        codes.append(F.when(state.isin(*bad), F.concat(F.lit(f"POSITION_QUALITY_{f.upper()}_"), F.upper(state))))
    codes += [F.concat(F.lit("ALTITUDE_AVAILABILITY_"), F.col("altitude_availability")), F.when(F.col("message_gap"), "MESSAGE_GAP")]
    return rows.withColumns({"position_quality_advisory": advisory, "reason_codes": F.array_compact(F.array(*codes))})


def reason_summary(classified: DataFrame, *, entity: str, position: str, codes: str = "reason_codes", chunk: float = 1_000_000.0, point_reasons: Sequence[str] = ("MESSAGE_GAP",)) -> DataFrame:
    """Rows, episodes and entities per reason. Partial tables of disjoint parts add up with ``merge_summaries``.

    An episode begins at a row whose predecessor in position lacks the reason, and at every row of
    a point reason. Beginnings are found on the rows as they are, with one look back; reasons
    are only spread out into partial counts.
    """
    slim = classified.select(entity, position, codes)
    back = sweep(slim, Track((entity,), (position,), chunk), {"_prev": Lag(F.struct(F.col(position).alias("p"), F.col(codes).alias("c")))})
    fresh = F.array_except(codes, F.col("_prev.c"))
    points = F.array_intersect(codes, F.array(*[F.lit(r) for r in point_reasons]))
    begins = F.when(F.col("_prev.p") == F.col(position) - 1, F.array_union(fresh, points)).otherwise(F.col(codes))
    marked = back.select(entity, F.col(codes).alias("_c"), begins.alias("_b"))
    long = marked.select(entity, F.inline(F.transform("_c", lambda c: F.struct(c.alias("reason_code"), F.array_contains("_b", c).cast("long").alias("_e")))))
    per = long.groupBy("reason_code", entity).agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("_e"))
    one = per.groupBy("reason_code").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("flights"), F.sum("_e").alias("episodes"))
    return one.select(reason_channel(F.col("reason_code")).alias("channel"), "reason_code", "rows", "flights", "episodes")


def state_counts(classified: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, state, rows) of several status columns in one pass."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("state")) for c in columns]))
    return classified.select(pairs).groupBy("field", "state").agg(F.count(F.lit(1)).alias("rows"))


def altitude_exposure(classified: DataFrame, track: Track, *, max_gap_s: float) -> DataFrame:
    """Seconds per altitude state: each step belongs to the state of the row it ends in."""
    t = F.col(track.order[0])
    rows = sweep(classified, track, {"_pt": Lag(t)})
    dt = t - F.col("_pt")
    return rows.groupBy("altitude_availability").agg(F.sum(F.when((dt > 0) & (dt <= max_gap_s), dt).otherwise(0.0)).alias("exposure_s"))


def merge_summaries(parts: DataFrame, *, keys: Sequence[str] = ("channel", "reason_code"), contract: str | None = None, exposure: str | None = None) -> DataFrame:
    """Counters of disjoint parts summed; parts made under different contracts raise. Rates are recomputed."""
    counters = [c for c in ("rows", "episodes", "flights", exposure) if c and c in parts.columns]
    aggs = [F.sum(c).alias(c) for c in counters]
    if contract:
        one = F.min(contract).eqNullSafe(F.max(contract))
        aggs.append(F.when(one, F.min(contract)).otherwise(F.raise_error(F.lit("parts follow different contracts")).cast("string")).alias(contract))
    out = parts.groupBy(*keys).agg(*aggs)
    if exposure:
        out = out.withColumn("episodes_per_hour", F.try_divide(F.col("episodes").cast("double"), F.col(exposure) / 3600))
    return out
