"""Layers of the lake: provenance, aligned schema, writes and refreshes, scans, index, export."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.plans.durable import checkpoint_dir

# fixed values: the aligned schema, in order
GOLD_SCHEMA = T.StructType([
    T.StructField("timestamp_utc", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("altitude_m", T.DoubleType()), T.StructField("velocity_mps", T.DoubleType()), T.StructField("heading_deg", T.DoubleType()),
    T.StructField("vertical_rate_mps", T.DoubleType()), T.StructField("source_type", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("is_military", T.BooleanType()),
])
_TRACE = {
    "altitude_m": "alt", "velocity_mps": "ground_speed_ms", "heading_deg": "track_deg", "vertical_rate_mps": "vertical_rate_ms", "is_military": "is_military",
}
_LOG = {"altitude_m": "alt", "velocity_mps": "vel_m_s", "heading_deg": "yaw_deg", "vertical_rate_mps": "vertical_rate_mps", "label": "label"}
_RIG = {"altitude_m": "alt", "velocity_mps": "velocity_measured", "heading_deg": "yaw_measured", "vertical_rate_mps": "climb_rate_ms", "label": "label"}
# fixed values: source column behind each aligned column (the five shared ones keep their names)
COLUMN_MAPS: dict[str, dict[str, str]] = {
    "adsblol_historical": _TRACE, "adsblol_hist": _TRACE, "adsblol_realtime": _TRACE, "adsblol_rt": _TRACE,
    "alfa": _RIG, "uav_attack": _LOG, "uav_sead": _LOG,
}
_SHARED = ("timestamp_utc", "lat", "lon", "source_type", "source_id")
_SAFE = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._=-]*$")


def register_source(source_type: str, columns: Mapping[str, str]) -> None:
    """Add a column map for a further source."""
    unknown = set(columns) - set(GOLD_SCHEMA.names)
    if unknown:
        raise ValueError(f"not aligned columns: {sorted(unknown)}")
    COLUMN_MAPS[source_type] = dict(columns)


def safe_name(part: str) -> str:
    if not _SAFE.match(part) or ".." in part:
        raise ValueError(f"unsafe path component {part!r}")
    return part


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{safe_name(name)}-{uuid.uuid4().hex}"


def add_provenance(df: DataFrame, source_type: str, *, source_file: str | Column | None = None, schema_version: str = "silver_v1") -> DataFrame:
    """Four provenance columns; the file defaults to the one each row was read from."""
    if not source_type or not schema_version or source_file == "":
        raise ValueError("source_type, source_file and schema_version must not be empty")
    origin = F.col("_metadata.file_path") if source_file is None else F.lit(source_file) if isinstance(source_file, str) else source_file
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select(
        "*", F.lit(source_type).alias("_source_type"), now.alias("_ingest_ts_utc"), origin.alias("_source_file"), F.lit(schema_version).alias("_schema_version")
    )


def align(df: DataFrame, source_type: str) -> DataFrame:
    """The eleven aligned columns in order; a column the source lacks is null, an unknown source raises."""
    if source_type not in COLUMN_MAPS:
        raise KeyError(f"no column map for source {source_type!r}")
    mapping = {**{c: c for c in _SHARED}, **COLUMN_MAPS[source_type]}
    pick = lambda f: F.col(mapping[f.name]) if mapping.get(f.name) in df.columns else F.lit(None)
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in GOLD_SCHEMA])


def unify(sources: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [align(df, s) for s, df in sources.items()])


def write_layer(df: DataFrame, root: str, *parts: str, partition_by: Sequence[str] = (), mode: str = "errorifexists", rows_per_file: int = 20_000_000) -> str:
    """Snappy Parquet under ``root/parts``; an existing target is never silently replaced."""
    path = "/".join([root, *[safe_name(p) for p in parts]])
    writer = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def full_refresh(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Replace the whole layer, so that a rerun never counts twice."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def refresh_sources(df: DataFrame, path: str, *, by: str = "source_type") -> None:
    """Replace only the partitions present in ``df``; the others stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_layer(spark: SparkSession, path: str, *, schema: T.StructType | None = None) -> DataFrame:
    """Union by name of every part; a layer that does not exist yet is empty with ``schema``."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if schema is not None and e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def read_columns(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """Only the wanted columns of a drifting layer: parts lacking one give null."""
    wanted = T.StructType([schema[c] for c in columns])
    return spark.read.schema(wanted).parquet(path)


def migrate_layout(spark: SparkSession, flat: str, target: str, *, by: str = "source_type") -> None:
    """Flat parts into one folder per source, row by row."""
    spark.read.option("mergeSchema", True).parquet(flat).write.mode("errorifexists").partitionBy(by).parquet(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(conf).getContentSummary(root).getLength()


def compact(spark: SparkSession, source: str, path: str, *, target_bytes: int = 128 << 20, by: Sequence[str] = ()) -> None:
    """Many small Parquet files into files of about ``target_bytes``: their number follows the bytes stored."""
    files = max(1, -(-stored_bytes(spark, source) // target_bytes))
    df = spark.read.parquet(source)
    out = df.repartition(files, *by) if by else df.repartition(files)
    out.write.mode("append").parquet(path)


def pending_files(listing: DataFrame, manifest: DataFrame, *, fresh: bool = False) -> DataFrame:
    """Inputs not recorded as complete; ``fresh`` ignores the manifest."""
    if fresh:
        return listing
    done = manifest.filter(F.col("status") == "complete").select("source_file").distinct()
    return listing.join(done, "source_file", "left_anti")


def drop_partial(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outputs of inputs that were completed; what an interrupted input left behind is discarded."""
    done = manifest.filter(F.col("status") == "complete").select("source_file").distinct()
    return outputs.join(done, "source_file", "left_semi")


def merge_new(lookup: DataFrame, rows: DataFrame, scanned: DataFrame, *, file: str, key: str, value: Column, name: str) -> DataFrame:
    """Lookup extended with keys from files not scanned before; a known key keeps its value."""
    fresh = rows.join(scanned.select(file), file, "left_anti").groupBy(key).agg(F.min(value).alias(name))
    return lookup.unionByName(fresh.join(lookup.select(key), key, "left_anti").select(*lookup.columns))


def expire(spark: SparkSession, path: str, *, day: str, keep_from: str) -> None:
    """Drop day partitions before ``keep_from`` (YYYY-MM-DD) of a layer partitioned by ``day``, and nothing else."""
    if not re.match(r"^\d{4}-\d\d-\d\d$", keep_from):
        raise ValueError("keep_from must be YYYY-MM-DD")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for status in fs.listStatus(root):
        found = re.match(rf"^{re.escape(day)}=(\d{{4}}-\d\d-\d\d)$", status.getPath().getName())
        if found and found.group(1) < keep_from:
            fs.delete(status.getPath(), True)


def part_index(df: DataFrame, *, time: str = "timestamp_utc", source: str = "source_type", file: Column | None = None) -> DataFrame:
    """Per input file: time range, rows with a time and most frequent source (ties: first name)."""
    origin = F.col("_metadata.file_path") if file is None else file
    counts = df.select(origin.alias("object_name"), time, source).groupBy("object_name", source).agg(
        F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.count(time).alias("_n"), F.count(F.lit(1)).alias("_r")
    )
    return counts.groupBy("object_name").agg(
        F.min("_lo").alias("min_ts"), F.max("_hi").alias("max_ts"), F.sum("_n").alias("row_count"),
        F.min_by(source, F.struct(-F.col("_r"), F.col(source))).alias(source),
    ).filter(F.col("min_ts").isNotNull())


def parts_overlapping(index: DataFrame, start: float, end: float) -> DataFrame:
    return index.filter((F.col("max_ts") >= start) & (F.col("min_ts") < end))


def merge_indexes(**layers: DataFrame) -> DataFrame:
    """Index tables of several layers tagged and stacked."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("layer", F.lit(k)) for k, df in layers.items()])


def dataset_totals(index: DataFrame, *, dataset: str = "dataset") -> DataFrame:
    return index.groupBy(dataset).agg(F.sum("row_count").alias("rows")).orderBy(F.desc("rows"), dataset)


def layer_catalog(index: DataFrame) -> DataFrame:
    """Rows and first and last day per (layer, dataset)."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return index.groupBy("layer", "dataset").agg(F.sum("row_count").alias("rows"), day(F.min("min_ts")).alias("first_day"), day(F.max("max_ts")).alias("last_day"))


def estimate_rows(index: DataFrame, start: float, end: float) -> DataFrame:
    """Upper bound of the rows in a range, from the index alone."""
    return parts_overlapping(index, start, end).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("estimated_rows"), F.count(F.lit(1)).alias("parts"))


class TooManyRows(ValueError):
    pass


def export(
    df: DataFrame, path: str | None, *, time: str, start: float, end: float, columns: Sequence[str], fmt: str = "parquet",
    index: DataFrame | None = None, max_rows: int = 5_000_000, only: Column | None = None,
) -> DataFrame:
    """Chosen columns of a closed time range, written as ``fmt`` (or just returned without a path).

    Unknown columns and more than ``max_rows`` rows are refused, never cut off: first by the
    index estimate, then by counting at most one row beyond the limit.
    """
    unknown = sorted(set(columns) - set(df.columns))
    if unknown or not columns:
        raise ValueError(f"unknown columns: {unknown}" if unknown else "no column chosen")
    if end < start or fmt not in ("parquet", "csv"):
        raise ValueError("bad range or format")
    if index is not None and (n := estimate_rows(index, start, end).first()["estimated_rows"]) > max_rows:
        raise TooManyRows(f"estimated {n} rows exceed {max_rows}")
    rows = df.filter(F.col(time).between(start, end))
    rows = (rows.filter(only) if only is not None else rows).select(*columns)
    if rows.limit(max_rows + 1).count() > max_rows:
        raise TooManyRows(f"more than {max_rows} rows")
    if path:
        writer = rows.write.mode("errorifexists")
        writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return rows


def country_count(df: DataFrame, countries: DataFrame, *, time: str, start: float, end: float, entity: str, country: str) -> DataFrame:
    """Exact rows of one country in a closed range."""
    mine = countries.filter(F.col("country") == country).select(entity)
    return df.filter(F.col(time).between(start, end)).join(mine, entity, "left_semi").agg(F.count(F.lit(1)).alias("rows"))


def long_to_wide(df: DataFrame, *, time: str, entity: str, field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """(time, entity, field, value) rows to one row per (time, entity); the smallest value wins among repeats."""
    return df.groupBy(time, entity).pivot(field, list(fields)).agg(F.min(value))


def feature_lines(df: DataFrame, geometry: Column, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON Feature per line; rows without geometry are left out."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))
    return df.filter(geometry.isNotNull()).select(feature.alias("value"))


def polygon(ring: Column) -> Column:
    return F.when(ring.isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def write_features(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def hex_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, country) from a CSV of hexadecimal bounds; quoted commas are kept, bad rows dropped."""
    raw = spark.read.csv(path, schema="a string, b string, c string", mode="PERMISSIVE", quote='"', escape='"')
    from trackweave.operators.routes import hex_value

    out = raw.select(hex_value(F.col("a")).alias("start"), hex_value(F.col("b")).alias("end"), F.trim("c").alias("country"))
    return out.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("country").isNotNull())
