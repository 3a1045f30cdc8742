"""Live feeds: provider records to one schema, landing lines to typed rows, topic archive and publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc

FLIGHT_SCHEMA = (
    "icao24 string, ts string, cycle_id long, signal_age_sec double, source string, lat double, lon double, alt double, velocity double, track double, "
    "vertical_rate double, is_ground boolean, is_military boolean, callsign string, category string, squawk string, emergency string"
)
ALERT_SCHEMA = "icao24 string, alert_type string, ts string, message string"
RECORD_SCHEMA = (
    "hex string, flight string, lat double, lon double, alt_baro string, alt_geom double, gs double, track double, baro_rate double, category string, "
    "squawk string, emergency string, dbFlags string, seen double, seen_pos double"
)
LANDING_NAME = r"states-(\d{8}T\d{6})"


def from_record(raw: Column) -> Column:
    """Provider with one JSON object per aircraft: feet, knots and feet per minute; "ground" as an altitude text.

    Null when id or position is missing or zero, or when an airborne record has no altitude.
    """
    return _record(F.from_json(raw, RECORD_SCHEMA))


def _record(r: Column) -> Column:
    alt = F.coalesce(r["alt_baro"], r["alt_geom"].cast("string"))
    ground = F.coalesce(F.lower(alt) == "ground", F.lit(False))
    feet = F.when(ground, 0.0).otherwise(alt.try_cast("double"))
    hex_id = F.lower(F.trim(r["hex"]))
    ok = (r["lat"] != 0) & (r["lon"] != 0) & (F.length(hex_id) > 0) & (ground | (feet != 0))
    out = F.struct(
        hex_id.alias("icao24"), F.trim(F.coalesce(r["flight"], F.lit(""))).alias("callsign"), F.round(r["lat"], 6).alias("lat"), F.round(r["lon"], 6).alias("lon"),
        F.round(feet * 0.3048, 1).alias("alt"), F.round(r["gs"] * 0.5144, 1).alias("velocity"), r["track"].alias("track"), F.round(r["baro_rate"] * 0.00508, 2).alias("vertical_rate"),
        F.coalesce(r["category"], F.lit("")).alias("category"), F.coalesce(r["squawk"], F.lit("")).alias("squawk"), F.coalesce(r["emergency"], F.lit("none")).alias("emergency"),
        sc.military_from_flags(r["dbFlags"]).alias("is_military"), F.lit("adsblol").alias("source"), ground.alias("is_ground"),
        F.coalesce(r["seen_pos"], r["seen"]).alias("signal_age_sec"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), out)


def from_state(raw: Column, now: Column) -> Column:
    """Provider with one positional array of at least 17 slots per aircraft, already in SI units; age from the last contact."""
    return _state(F.from_json(raw, "array<string>"), now)


def _state(s: Column, now: Column) -> Column:
    at = lambda i: F.get(s, F.lit(i))
    num = lambda i: at(i).try_cast("double")
    hex_id, squawk = F.lower(F.trim(at(0))), F.coalesce(at(14), F.lit(""))
    ok = (F.size(s) >= 15) & (F.length(hex_id) > 0) & num(5).isNotNull() & num(6).isNotNull()
    out = F.struct(
        hex_id.alias("icao24"), F.trim(F.coalesce(at(1), F.lit(""))).alias("callsign"), F.round(num(6), 6).alias("lat"), F.round(num(5), 6).alias("lon"),
        F.coalesce(F.round(num(7), 1), F.lit(0.0)).alias("alt"), num(9).alias("velocity"), num(10).alias("track"), num(11).alias("vertical_rate"),
        F.lit("").alias("category"), squawk.alias("squawk"), F.coalesce(sc.squawk_type(squawk), F.lit("none")).alias("emergency"), F.lit(False).alias("is_military"),
        F.lit("opensky").alias("source"), F.coalesce(at(8).try_cast("boolean"), F.lit(False)).alias("is_ground"), F.round(now - num(4), 1).alias("signal_age_sec"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), out)


# name -> (normaliser, default polling interval in seconds); fetching itself is outside
PROVIDERS: dict[str, tuple[Callable[[Column, Column], Column], int]] = {
    "adsblol": (lambda raw, now: from_record(raw), 60),
    "opensky": (from_state, 90),
}
# name -> (schema of the text, normaliser of the parsed text)
_PARSED: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "adsblol": (RECORD_SCHEMA, lambda r, now: _record(r)),
    "opensky": ("array<string>", _state),
}


def normalise(df: DataFrame, provider: str, *, raw: str = "value", now: Column | None = None) -> DataFrame:
    """Common records of one provider; unusable records are dropped."""
    if provider not in PROVIDERS:
        raise KeyError(f"unknown provider {provider!r}")
    clock = now if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
    schema, build = _PARSED[provider]
    keep = [c for c in df.columns if c != raw]
    # a generator is evaluated once a row; a plain column would be parsed again for each field and for the filter
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    rows = df.select(*keep, once(F.from_json(F.col(raw), schema), "_raw"))
    rows = rows.select(*keep, once(build(F.col("_raw"), clock), "_rec"))
    return rows.filter(F.col("_rec").isNotNull()).select(*keep, "_rec.*")


def landing_rows(lines: DataFrame, *, file: Column | None = None) -> DataFrame:
    """Landing JSON lines to typed rows; malformed and empty lines are dropped.

    The record's ISO time wins; without one (or with a bad one) the time in the file name counts.
    """
    name = F.col("_metadata.file_name") if file is None else file
    rows = lines.select(F.trim("value").alias("value"), name.alias("_file")).filter(F.col("value").rlike(r"^\{.*\}$"))
    parsed = rows.withColumn("_r", F.from_json("value", FLIGHT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    parsed = parsed.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    own = F.unix_micros(F.try_to_timestamp("_r.ts")) / 1e6
    batch = F.unix_micros(F.try_to_timestamp(F.regexp_extract("_file", LANDING_NAME, 1), F.lit("yyyyMMdd'T'HHmmss"))) / 1e6
    r = lambda c: F.col(f"_r.{c}")
    blank = F.trim(r("callsign"))
    return parsed.select(
        F.lit("adsblol_realtime").alias("source_type"), r("icao24").alias("source_id"), F.coalesce(own, batch).alias("timestamp_utc"), r("lat"), r("lon"), r("alt"),
        F.coalesce(r("is_ground"), F.lit(False)).alias("on_ground"), F.lit(None).cast("string").alias("label"), r("velocity").alias("ground_speed_ms"), r("track").alias("track_deg"),
        r("vertical_rate").alias("vertical_rate_ms"), F.when(blank != "", blank).alias("flight_callsign"), r("category"), r("squawk"), r("emergency"),
        F.coalesce(r("is_military"), F.lit(False)).alias("is_military"), r("signal_age_sec"), r("source"), r("cycle_id"),
    )


def read_topic(spark: SparkSession, servers: str, topic: str, *, max_offsets: int = 500_000) -> DataFrame:
    """Topic as a stream of raw text with its offsets."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = raw.option("maxOffsetsPerTrigger", max_offsets).option("failOnDataLoss", "false").load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def messages(df: DataFrame, *, key: str = "icao24", cycle: Column | None = None) -> DataFrame:
    """Keyed JSON messages, each stamped with its cycle when given."""
    rows = df if cycle is None else df.withColumn("cycle_id", cycle)
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def publish(df: DataFrame, servers: str, topic: str, *, key: str = "icao24", cycle: Column | None = None) -> None:
    messages(df, key=key, cycle=cycle).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
