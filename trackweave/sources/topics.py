"""Per-topic telemetry logs: relative time, renames, units, trims, and what file names tell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators.segments import drop_non_monotonic, sign_continuity
from trackweave.plans.durable import durable
from trackweave.plans.select import exact_quantiles
from trackweave.plans.track import Track, Whole, sweep


def read_topic_csv(spark: SparkSession, path: str, columns: Sequence[str], *, time: str) -> DataFrame:
    """Topic CSV by header name; all wanted cells numeric, others ignored, absent ones null."""
    raw = spark.read.option("header", True).csv(path)
    pick = lambda c: F.col(f"`{c}`").try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    return raw.select(F.col(f"`{time}`").try_cast("long").alias("stamp"), *[pick(c).alias(c) for c in columns], F.col("_metadata.file_path").alias("source_file"))


def relative_time(topics: Mapping[str, DataFrame], *, flight: str = "flight_id", stamp: str = "stamp", position: str = "row_pos", unit: float = 1e9) -> dict[str, DataFrame]:
    """Drop stamps that do not advance, then seconds since the flight's first stamp over all topics."""
    kept = {k: drop_non_monotonic(df, Track((flight,), (position,), 1e6), time=stamp) for k, df in topics.items()}
    firsts = None
    for df in kept.values():
        one = df.groupBy(flight).agg(F.min(stamp).alias("_s"))
        firsts = one if firsts is None else firsts.unionByName(one)
    t0 = firsts.groupBy(flight).agg(F.min("_s").alias("_t0"))
    return {k: df.join(t0, flight).withColumn("t", (F.col(stamp) - F.col("_t0")) / unit).drop("_t0") for k, df in kept.items()}


def normalise_topic(
    df: DataFrame, *, rename: Mapping[str, str], degrees: Sequence[str] = (), trim: Sequence[str] = (), quaternion: Sequence[str] = (),
    mean_of: Mapping[str, tuple[str, str]] = {}, onset: DataFrame | None = None, flight: str = "flight_id", position: str = "row_pos",
    untrimmed: str = "raise",
) -> DataFrame:
    """Renamed numeric channels: degrees to wrapped radians, commands minus their median before the onset, continuous quaternions.

    ``onset(flight, onset_s)`` lists faulty flights; the others trim over all rows. A flight
    without any value to trim by raises, or is left out (``untrimmed="drop"``) so that it does not stop the others.
    """
    if untrimmed not in ("raise", "drop"):
        raise ValueError(f"unknown way with untrimmed flights {untrimmed!r}")
    cols = {v: F.col(k).cast("double") for k, v in rename.items() if k in df.columns}
    rows = df.select(flight, position, "t", *[c.alias(n) for n, c in cols.items()])
    for name, (a, b) in mean_of.items():
        rows = rows.withColumn(name, F.coalesce((F.col(a) + F.col(b)) / 2, F.col(a), F.col(b)))
    rows = rows.withColumns({c: geo.wrap_radians(F.radians(c)) for c in degrees if c in rows.columns})
    trims = [c for c in trim if c in rows.columns]
    if trims:
        base = rows if onset is None else rows.join(onset, flight, "left").filter(F.col("onset_s").isNull() | (F.col("t") < F.col("onset_s")))
        for c in trims:
            mid = exact_quantiles(base, [flight], c, {"_mid": 0.5}).drop("n")
            missing = F.raise_error(F.lit(f"no {c} samples before the onset")).cast("double")
            if untrimmed == "drop":
                rows = rows.join(mid.filter(F.col("_mid").isNotNull()), flight).withColumn(c, F.col(c) - F.col("_mid")).drop("_mid")
            else:
                rows = rows.join(mid, flight, "left").withColumn(c, F.col(c) - F.coalesce("_mid", missing)).drop("_mid")
    if quaternion:
        rows = sign_continuity(rows, Track((flight,), (position,), 1e6), list(quaternion))
    return rows


def first_instances(df: DataFrame, *, topic: str, instance: str, fields: Sequence[str], stamp: str = "timestamp", flight: str = "flight_id") -> DataFrame:
    """Decoded log rows of the lowest instance per topic, seconds since the flight's first stamp over all topics."""
    line = Track((flight,), (stamp,), 60e6)
    rows = sweep(df, line, {"_t0": Whole(F.col(stamp), "min")})
    low = df.groupBy(flight, topic).agg(F.min(instance).alias("_i"))
    rows = rows.join(low, [flight, topic]).filter(F.col(instance) == F.col("_i"))
    return rows.select(flight, topic, ((F.col(stamp) - F.col("_t0")) / 1e6).alias("t"), *fields)


def path_class(path: Column) -> Column:
    """Fault class named by the first folder of a case path."""
    head = F.split(path, "/")[0]
    return F.when(head.isin("Real-NoFault", "Real-No_Fault"), "normal").when(head == "Real-Motor", "motor").when(head == "Real-Sensors", "sensor").otherwise("unknown")


def name_class(name: Column) -> Column:
    """Fault class named by words in a flight name; the first rule met counts."""
    n = F.lower(name)
    has = lambda w: n.contains(w)
    return (
        F.when(has("no_failure"), "normal").when(has("engine"), "engine").when(has("elevator"), "elevator")
        .when(has("aileron") & has("rudder"), "aileron_rudder").when(has("aileron"), "aileron").when(has("rudder"), "rudder").otherwise("unknown")
    )


def path_session(path: Column) -> Column:
    """Session date found in a path (any digit width), else its first folder."""
    part = lambda i: F.regexp_extract(path, r"(20\d{2})-(\d{1,2})-(\d{1,2})", i)
    dated = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", dated).otherwise(F.split(path, "/")[0])


def source_day(path: Column, allowed: Sequence[str]) -> Column:
    """Day in a provenance path; one missing or outside the allowed days raises."""
    day = F.regexp_replace(F.regexp_extract(path, r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-")
    bad = F.raise_error(F.concat(F.lit("source day not allowed: "), path)).cast("string")
    return F.when(day.isin(*allowed), day).otherwise(bad)


def reconcile_class(records: DataFrame, truth: DataFrame, *, flight: str = "flight_id", column: str = "fault_class") -> DataFrame:
    """Records with the current class; ``reclassified`` marks the ones that differed."""
    rows = records.join(truth.select(flight, F.col(column).alias("_now")), flight, "left")
    now = F.coalesce("_now", column)
    return rows.withColumn("reclassified", ~now.eqNullSafe(F.col(column))).withColumn(column, now).drop("_now")


def reconcile_layer(spark: SparkSession, path: str, truth: DataFrame, *, partition: str, flight: str = "flight_id", column: str = "fault_class") -> DataFrame:
    """Bring the records written under ``path`` to the current class; (partition) of each partition that was rewritten.

    Only partitions that hold a differing class are read whole and replaced. New files are staged
    beside the old ones and take their place when the job commits, so a run that dies leaves every
    partition as it was or as it should be, and the next run finds what still differs.
    """
    now = reconcile_class(spark.read.parquet(path), truth, flight=flight, column=column)
    stale = durable(now.filter("reclassified").select(partition).distinct())
    if not stale.isEmpty():
        # a table cannot be overwritten while it is read: the new rows are laid down first
        fresh = durable(now.drop("reclassified").join(stale, partition, "left_semi"))
        rows = fresh.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy(partition).parquet(path)
    return stale
