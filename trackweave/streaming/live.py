"""Streaming jobs over live rows: archive, cycle sweep, history, alerts, windows, late rows. State kept by key is in ``keyed``.

Sinks written per micro-batch are keyed by the batch id, so a repeated batch replaces its
own output. A micro-batch is bounded by the source's rate option.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave.plans.track import Lag, Track, sweep

HISTORY_SCHEMA = "icao24 string, ts timestamp, lat double, lon double, alt double, velocity double, track double, vertical_rate double, is_ground boolean, is_military boolean"


def archive(stream: DataFrame, path: str, checkpoint: str, *, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Raw text to one set of files per trigger; ``once`` drains what is there and stops."""
    w = stream.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def per_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False, every: str = "10 seconds", mode: str = "append") -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(job)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def _version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Newest complete version of a table kept as ``path/v=<n>``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    ok = [v for v in found if before is None or v < before]
    return max(ok) if ok else None


def read_state(spark: SparkSession, path: str, *, before: int | None = None) -> DataFrame | None:
    v = _version(spark, path, before)
    return None if v is None else spark.read.parquet(f"{path}/v={v}")


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Drop the versions below the one that a repeat of the running batch would read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    last = _version(spark, path, before)
    for s in fs.listStatus(root) if last is not None else []:
        name = s.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < last:
            fs.delete(s.getPath(), True)


def sweep_cycles(state: DataFrame, *, cycle: str = "cycle_id", source: Sequence[str] = ()) -> DataFrame:
    """Entities seen in the running cycle or the one completed before it (per source); rows without a cycle stay."""
    seen = state.filter(F.col(cycle).isNotNull()).select(*source, cycle).distinct()
    top = seen.groupBy(*source).agg(F.max(cycle).alias("_now")) if source else seen.agg(F.max(cycle).alias("_now"))
    now = state.join(top, list(source)) if source else state.withColumn("_now", top.scalar())
    # distinct cycles are few; the second newest is the largest below the newest
    below = (seen.join(top, list(source)) if source else seen.withColumn("_now", top.scalar())).filter(F.col(cycle) < F.col("_now"))
    prev = below.groupBy(*source).agg(F.max(cycle).alias("_prev")) if source else below.agg(F.max(cycle).alias("_prev"))
    both = now.join(prev, list(source), "left") if source else now.withColumn("_prev", prev.scalar())
    alive = F.col(cycle).isNull() | (F.col(cycle) >= F.coalesce("_prev", "_now"))
    return both.filter(alive).select(*state.columns)


def history_rows(stream: DataFrame) -> DataFrame:
    """Rows in the fixed history types; a missing speed, track or rate stays null, missing flags are false."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(HISTORY_SCHEMA)
    default = {"is_ground": F.lit(False), "is_military": F.lit(False), "lat": F.lit(0.0), "lon": F.lit(0.0), "alt": F.lit(0.0)}
    pick = lambda f: F.col(f.name).cast(f.dataType) if f.name in stream.columns else F.lit(None).cast(f.dataType)
    typed = stream.select(*[(F.coalesce(pick(f), default[f.name]) if f.name in default else pick(f)).alias(f.name) for f in schema])
    return typed.filter(F.length("icao24") > 0)


def alerts(stream: DataFrame, *, required: Sequence[str] = ("icao24", "alert_type")) -> DataFrame:
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.length(c) > 0)
    return stream.filter(ok)


def keep_newest(path: str, *, order: Sequence[str], n: int = 20) -> Callable[[DataFrame, int], None]:
    """Batch job keeping the newest n rows over all batches."""

    def job(batch: DataFrame, batch_id: int) -> None:
        known = read_state(batch.sparkSession, path, before=batch_id)
        rows = batch if known is None else known.unionByName(batch)
        rows.orderBy(*[F.desc(c) for c in order]).limit(n).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        _forget(batch.sparkSession, path, batch_id)

    return job


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Batch job writing each batch under its own id; read the folder to get all of them."""

    def job(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return job


def last_per_poll(df: DataFrame, *, entity: str, order: Sequence[str]) -> DataFrame:
    """Batch form of poll de-duplication: the last record per entity over all query points."""
    cols = [c for c in df.columns if c != entity]
    return df.groupBy(entity).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(entity, "_r.*")


def once_per_poll(stream: DataFrame, *, ts: str, every: str, entity: Sequence[str], fields: Sequence[str], delay: str, tie: str) -> DataFrame:
    """The last row of every entity per poll interval.

    In output mode ``append`` it is given out once the watermark has passed the interval, in mode
    ``update`` by each batch that changes it, the newest interval included; either way passed intervals leave the state.
    """
    last = F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("_r")
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, every), *entity).agg(last).select("window", *entity, "_r.*")


def panes(stream: DataFrame, *, ts: str, slide_s: int, by: Sequence[str], entity: str, delay: str) -> DataFrame:
    """Rows of each key and entity per pane (a slide of time, numbered), given out once when the watermark has passed it."""
    per = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{slide_s} seconds"), *by, entity).agg(F.count(F.lit(1)).alias("points"))
    return per.select(F.floor(F.unix_seconds("window.start") / slide_s).alias("pane"), *by, entity, "points")


def rolling(found: DataFrame, *, by: Sequence[str], entity: str, size_s: int, slide_s: int) -> DataFrame:
    """start_s, key, points and distinct entities of every window of ``size_s`` that slides by ``slide_s``, from its panes.

    An entity is counted in a window at the first pane in which it occurs there: the windows
    that hold a pane but not the entity's pane before. So no set of entities is kept, and counts are exact.
    """
    if size_s % slide_s:
        raise ValueError("a window is a whole number of slides")
    reach = size_s // slide_s
    line = Track((*by, entity), ("pane",), 4096.0 * reach)
    rows = sweep(found, line, {"_last": Lag(F.col("pane"))})
    first = F.col("pane") - reach + 1
    rows = rows.select(*by, "pane", "points", "_last", F.explode(F.sequence(first, F.col("pane"))).alias("_start"))
    fresh = (F.col("_last").isNull() | (F.col("_last") < F.col("_start"))).cast("long")
    out = rows.groupBy("_start", *by).agg(F.sum("points").alias("points"), F.sum(fresh).alias("entities"))
    return out.select((F.col("_start") * slide_s).alias("start_s"), *by, "points", "entities")


def tumbling_last(stream: DataFrame, *, ts: str, every: str, entity: str, fields: Sequence[str], delay: str, tie: str) -> DataFrame:
    """Last row of every entity per time bucket."""
    last = F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("_r")
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, every), entity).agg(last).select("window", entity, "_r.*")


def gap_sessions(stream: DataFrame, *, ts: str, gap: str, by: Sequence[str], delay: str) -> DataFrame:
    """Sessions ending with a gap; a step exactly as long as the gap still belongs."""
    w = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by)
    return w.agg(F.count(F.lit(1)).alias("points"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def signal_age(df: DataFrame, *, ts: str, now: Column | None = None, out: str = "signal_age_sec") -> DataFrame:
    at = now if now is not None else F.current_timestamp()
    return df.withColumn(out, (F.unix_micros(at) - F.unix_micros(F.col(ts))) / 1e6)


def route_late(on_time: str, late: str, clock: str, *, ts: str, delay_s: float) -> Callable[[DataFrame, int], None]:
    """Batch job separating rows older than the newest time of earlier batches minus the delay.

    The newest time is a one-row table versioned by batch id.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = read_state(spark, clock, before=batch_id)
        newest = None if known is None else known.first()["t"]
        limit = None if newest is None else F.lit(newest - delay_s)
        t = F.unix_micros(F.col(ts)) / 1e6
        is_late = F.lit(False) if limit is None else t < limit
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        top = batch.agg(F.max(t).alias("t"))
        top = top if newest is None else top.select(F.greatest(F.coalesce("t", F.lit(newest)), F.lit(newest)).alias("t"))
        top.write.mode("overwrite").parquet(f"{clock}/v={batch_id}")

    return job


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Everything ``append_batches`` wrote; empty when nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
