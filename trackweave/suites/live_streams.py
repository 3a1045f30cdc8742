"""Streaming jobs drained over the event table, read back and compared as batches."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackweave.sources.lake import scratch
from trackweave.streaming import keyed, live
from trackweave.suites.base import query, r6, rounded, table, telemetry
from trackweave.suites.detect import SIMPLE


#: rows of a file of a micro-batch; a larger batch has more files, and as many tasks
FILE_ROWS = 250_000


def stream(spark, d, *, mixed: bool = False, closing: bool = False):
    """The event table as a stream of track rows in four micro-batches.

    Batches follow one another in time, or hold every fourth row each (``mixed``), so that
    rows of one entity and cycle come apart and out of order. A ``closing`` row of no entity, a hundred
    years on, lets the watermark pass all others.
    """
    path = scratch(spark, "live")
    e = table(spark, d, "events")
    third = F.ntile(4).over(Window.orderBy("day"))
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", third - 1)
    if mixed:
        parts = e.withColumn("part", F.lit(3) - F.col("event_id") % 4)
    else:
        parts = e.withColumn("day", F.to_date("ts")).join(days.select("day", "part"), "day").drop("day")
    files = max(2, -(-e.count() // (4 * FILE_ROWS)))
    for i in range(4):
        parts.filter(F.col("part") == i).drop("part").repartition(files).write.mode("append").parquet(f"{path}/in")
    if closing:
        far = {"ts": keyed.closing_time(F.col("ts")), "event_id": F.lit(-1), "user_id": F.lit(None), "event_type": F.lit("closing"), "value": F.lit(None)}
        last = e.orderBy(F.desc("ts"), "event_id").limit(1)
        last.select(*[(far[f.name].cast(f.dataType) if f.name in far else F.col(f.name)).alias(f.name) for f in e.schema]).write.mode("append").parquet(f"{path}/in")
    e = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    return e.select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("row_pos"), F.col("ts").cast("timestamp").alias("ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"), F.col("event_type").alias("kind"),
        F.floor(F.col("event_id") / 500).alias("cycle_id"),
    )


def drain(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def batches(spark, df, *, mode="append"):
    path = scratch(spark, "stream")
    drain(live.per_batch(df, live.append_batches(f"{path}/out"), f"{path}/ckpt", once=True, mode=mode))
    return live.read_batches(spark, f"{path}/out", df.schema)


@query("i1_archive_raw", "SELECT row_pos, source_id FROM tel")
def _(spark, d):
    path = scratch(spark, "archive")
    raw = stream(spark, d, mixed=True).select(F.to_json(F.struct("row_pos", "source_id")).alias("value"))
    drain(live.archive(raw, f"{path}/raw", f"{path}/ckpt", once=True))
    r = F.from_json("value", "row_pos long, source_id string")
    return spark.read.text(f"{path}/raw").select(r["row_pos"].alias("row_pos"), r["source_id"].alias("source_id"))


@query("i2_latest_state", "SELECT source_id, arg_max(row_pos, (t, row_pos)) AS row_pos, arg_max(x, (t, row_pos)) AS x FROM tel GROUP BY source_id")
def _(spark, d):
    how = dict(key=["source_id"], order=["t", "row_pos"])
    changes = batches(spark, keyed.latest(stream(spark, d, mixed=True).select("source_id", "t", "row_pos", "x"), **how), mode="update")
    return keyed.newest(changes, **how).select("source_id", "row_pos", "x")


@query("i3_cycle_sweep", "WITH s AS (SELECT source_id, max(row_pos // 500) AS cycle_id FROM tel GROUP BY source_id), m AS (SELECT max(cycle_id) AS c FROM s), p AS (SELECT coalesce((SELECT max(cycle_id) FROM s, m WHERE cycle_id < c), (SELECT c FROM m)) AS p) SELECT source_id, cycle_id FROM s, p WHERE cycle_id >= p")
def _(spark, d):
    order = ["cycle_id", "t", "row_pos"]
    rows = stream(spark, d, mixed=True).select("source_id", "cycle_id", "t", "row_pos")
    changes = batches(spark, keyed.cycle_changes(rows, key="source_id", cycle="cycle_id", order=order), mode="update")
    # timers go by the watermark, which follows a batch behind: what it has still left is swept from the table
    return live.sweep_cycles(keyed.present(changes, key="source_id", order=order)).select("source_id", "cycle_id")


@query("i4_history_typed", "SELECT source_id AS icao24, t, x AS lat, CAST(NULL AS DOUBLE) AS velocity, CASE WHEN row_pos % 3 = 0 THEN x END AS track, false AS is_ground FROM tel")
def _(spark, d):
    s = stream(spark, d, mixed=True).select(
        F.col("source_id").alias("icao24"), "ts", F.col("x").cast("string").alias("lat"), F.when(F.col("row_pos") % 3 == 0, F.col("x")).alias("track")
    )
    out = batches(spark, live.history_rows(s))
    return out.select("icao24", (F.unix_micros("ts") / 1e6).alias("t"), "lat", "velocity", "track", "is_ground")


@query("i5_alert_stream", "SELECT row_pos, source_id AS icao24 FROM tel WHERE source_type = 'error' ORDER BY t DESC, row_pos DESC LIMIT 20")
def _(spark, d):
    path = scratch(spark, "alerts")
    s = stream(spark, d, mixed=True).select(F.col("source_id").alias("icao24"), F.when(F.col("kind") == "error", F.col("kind")).alias("alert_type"), "t", "row_pos")
    drain(live.per_batch(live.alerts(s), live.keep_newest(f"{path}/state", order=["t", "row_pos"]), f"{path}/ckpt", once=True))
    return live.read_state(spark, f"{path}/state").select("row_pos", "icao24")


@query("i6_poll_dedup", "SELECT CAST(t_us // 86400000000 * 86400 AS BIGINT) AS start_s, source_id, source_type AS kind, arg_max(row_pos, (t, row_pos)) AS row_pos FROM tel GROUP BY ALL")
def _(spark, d):
    s = live.once_per_poll(stream(spark, d, mixed=True), ts="ts", every="1 day", entity=["source_id", "kind"], fields=["t", "row_pos"], delay="31 days", tie="row_pos")
    changes = batches(spark, s, mode="update").withColumn("start_s", F.unix_seconds("window.start"))
    return keyed.newest(changes, key=["start_s", "source_id", "kind"], order=["t", "row_pos"]).select("start_s", "source_id", "kind", "row_pos")


@query("i6_poll_last", "SELECT source_id, arg_max(row_pos, (t, row_pos)) AS row_pos FROM tel GROUP BY source_id")
def _(spark, d):
    return live.last_per_poll(telemetry(spark, d).select("source_id", "t", "row_pos"), entity="source_id", order=["t", "row_pos"]).select("source_id", "row_pos")


MAXT = "(SELECT max(t_us) FROM tel)"


@query("i7_rolling_windows", """WITH w AS (SELECT source_id, source_type, unnest(range((t_us // 21600000000 - 3) * 21600000000, (t_us // 21600000000 + 1) * 21600000000, 21600000000)) AS s FROM tel)
SELECT CAST(s / 1000000 AS BIGINT) AS start_s, source_type AS kind, count(*) AS points, count(DISTINCT source_id) AS entities FROM w GROUP BY ALL""")
def _(spark, d):
    s = live.panes(stream(spark, d, mixed=True, closing=True), ts="ts", slide_s=21_600, by=["kind"], entity="source_id", delay="31 days")
    return live.rolling(batches(spark, s), by=["kind"], entity="source_id", size_s=86_400, slide_s=21_600)


@query("i8_tumbling_last", f"SELECT CAST(t_us // 86400000000 * 86400 AS BIGINT) AS start_s, source_id, arg_max(x, (t, row_pos)) AS x FROM tel WHERE (t_us // 86400000000 + 1) * 86400000000 <= {MAXT} - 3600000000 GROUP BY 1, 2")
def _(spark, d):
    s = live.tumbling_last(stream(spark, d), ts="ts", every="1 day", entity="source_id", fields=["x"], delay="1 hour", tie="row_pos")
    return batches(spark, s).select(F.unix_seconds("window.start").alias("start_s"), "source_id", "x")


@query("i9_gap_sessions", f"""WITH l AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY source_id ORDER BY t_us) AS g FROM tel), k AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t_us) AS s FROM l)
SELECT source_id, min(t) AS first_t, max(t) AS last_t, count(*) AS points FROM k GROUP BY source_id, s HAVING max(t_us) + 21600000000 <= {MAXT} - 3600000000""")
def _(spark, d):
    s = live.gap_sessions(stream(spark, d), ts="ts", gap="6 hours", by=["source_id"], delay="1 hour")
    return batches(spark, s).select("source_id", (F.unix_micros("first_ts") / 1e6).alias("first_t"), (F.unix_micros("last_ts") / 1e6).alias("last_t"), "points")


@query("i10_streaming_cusum", f"WITH {SIMPLE} SELECT row_pos, rst AS reset, round(score, 6) + 0.0 AS cusum_score FROM s")
def _(spark, d):
    s = stream(spark, d, mixed=True, closing=True).withColumns({"z": (F.col("x") - 45) / 30, "ok": F.col("kind") != "signup"})
    out = keyed.page_sums(s, entity="source_id", time="t", position="row_pos", value="z", evaluable="ok", slack=0.25, max_gap_s=86400.0, delay="31 days", slice_s=864000.0)
    return rounded(batches(spark, out).select("row_pos", "reset", "cusum_score"), "cusum_score")


@query("i11_late_rows", "WITH a AS (SELECT max(t) AS m FROM tel WHERE row_pos % 2 = 0) SELECT row_pos, row_pos % 2 = 1 AND t < (SELECT m FROM a) - 864000 AS late FROM tel")
def _(spark, d):
    path = scratch(spark, "late")
    rows = telemetry(spark, d).select("row_pos", F.timestamp_micros("t_us").alias("ts"))
    for part in (0, 1):
        rows.filter(F.col("row_pos") % 2 == part).repartition(4).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    drain(live.per_batch(s, live.route_late(f"{path}/ok", f"{path}/late", f"{path}/clock", ts="ts", delay_s=864000.0), f"{path}/ckpt", once=True))
    ok, late = (live.read_batches(spark, f"{path}/{k}", rows.schema).select("row_pos", F.lit(k == "late").alias("late")) for k in ("ok", "late"))
    return ok.unionByName(late)


@query("i12_signal_age", f"SELECT row_pos, round(({MAXT} - t_us) / 1e6, 6) AS signal_age_sec FROM tel")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    out = live.signal_age(rows, ts="ts", now=rows.agg(F.max("ts")).scalar())
    return rounded(out.select("row_pos", "signal_age_sec"), "signal_age_sec")
