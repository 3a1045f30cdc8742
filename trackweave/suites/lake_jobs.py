"""Sources, sinks and lake upkeep: written from the given tables to the shared folder and read back."""

import io
import tarfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions import geo
from trackweave.sources import lake, topics, traces
from trackweave.sources import live as feed
from trackweave.suites.base import query, r6, rounded, table, telemetry

GOLD = """gold AS (SELECT t AS timestamp_utc, lat, lon, alt AS altitude_m, ground_speed_ms AS velocity_mps, track_deg AS heading_deg, vertical_rate_ms AS vertical_rate_mps, 'adsblol_hist' AS source_type, source_id, CAST(NULL AS VARCHAR) AS label, is_military FROM tel WHERE source_type IN ('view', 'signup', 'purchase')
 UNION ALL SELECT t, lat, lon, alt, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'uav_attack', source_id, 'x', CAST(NULL AS BOOLEAN) FROM tel WHERE source_type IN ('click', 'error'))"""


def silver(spark, d):
    tel = telemetry(spark, d).withColumn("timestamp_utc", F.col("t"))
    a = tel.filter("source_type IN ('view', 'signup', 'purchase')").withColumn("source_type", F.lit("adsblol_hist")).drop("label")
    b = tel.filter("source_type IN ('click', 'error')").select("timestamp_utc", "lat", "lon", "alt", F.lit("uav_attack").alias("source_type"), "source_id", F.lit("x").alias("label"))
    return {"adsblol_hist": a, "uav_attack": b}


def gold(spark, d):
    return lake.unify(silver(spark, d))


@query("b1_align_schema", f"WITH {GOLD} SELECT * FROM gold")
def _(spark, d):
    return gold(spark, d)


@query("a6_provenance", "SELECT row_pos, 'events' AS _source_type, true AS has_file, true AS has_time, 'silver_v1' AS _schema_version FROM tel")
def _(spark, d):
    df = lake.add_provenance(table(spark, d, "events"), "events")
    return df.select(F.col("event_id").alias("row_pos"), "_source_type", F.col("_source_file").endswith("events.parquet").alias("has_file"), F.col("_ingest_ts_utc").endswith("Z").alias("has_time"), "_schema_version")


@query("a7_write_read_layer", f"WITH {GOLD} SELECT * FROM gold")
def _(spark, d):
    path = lake.write_layer(gold(spark, d), lake.scratch(spark, "lake"), "gold", "unified", partition_by=["source_type"])
    return lake.read_layer(spark, path).select(*lake.GOLD_SCHEMA.names)


@query("a8_read_missing_layer", "SELECT row_pos FROM tel WHERE false")
def _(spark, d):
    schema = telemetry(spark, d).select("row_pos").schema
    return lake.read_layer(spark, lake.scratch(spark, "absent"), schema=schema)


@query("a9_full_refresh", f"WITH {GOLD} SELECT source_type, count(*) AS n FROM gold GROUP BY source_type")
def _(spark, d):
    path = lake.scratch(spark, "full")
    for _ in range(2):
        lake.full_refresh(gold(spark, d), path, partition_by=["source_type"])
    return spark.read.parquet(path).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("a10_partial_refresh", f"WITH {GOLD} SELECT source_type, count(*) AS n, count(*) FILTER (WHERE label = 'new') AS renewed FROM (SELECT * REPLACE (CASE WHEN source_type = 'uav_attack' THEN 'new' ELSE label END AS label) FROM gold) GROUP BY source_type")
def _(spark, d):
    path = lake.scratch(spark, "partial")
    lake.full_refresh(gold(spark, d), path, partition_by=["source_type"])
    lake.refresh_sources(gold(spark, d).filter("source_type = 'uav_attack'").withColumn("label", F.lit("new")), path)
    return spark.read.parquet(path).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "new").alias("renewed"))


@query("a11_column_pruned_read", "SELECT event_id, value, CAST(NULL AS VARCHAR) AS missing_later FROM events", tel=False)
def _(spark, d):
    schema = table(spark, d, "events").schema.add("missing_later", T.StringType())
    return lake.read_columns(spark, f"{d}/events.parquet", schema, ["event_id", "value", "missing_later"])


@query("a12_layout_migration", f"WITH {GOLD} SELECT source_type, count(*) AS n FROM gold GROUP BY source_type")
def _(spark, d):
    root = lake.scratch(spark, "layout")
    gold(spark, d).write.parquet(f"{root}/flat")
    lake.migrate_layout(spark, f"{root}/flat", f"{root}/by_source")
    return spark.read.parquet(f"{root}/by_source").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("a5_compact_small_files", "SELECT row_pos, x FROM tel")
def _(spark, d):
    root = lake.scratch(spark, "small")
    telemetry(spark, d).select("row_pos", "x").repartition(16).write.parquet(f"{root}/many")
    lake.compact(spark, f"{root}/many", f"{root}/few", target_bytes=64 << 10)
    return spark.read.parquet(f"{root}/few")


MAN = "m AS (SELECT 'f' || row_pos % 20 AS source_file, CASE WHEN row_pos % 20 < 12 THEN 'complete' WHEN row_pos % 20 < 14 THEN 'started' END AS status FROM tel)"


def manifest(spark, d):
    k = F.col("row_pos") % 20
    rows = telemetry(spark, d).withColumns({"source_file": F.concat(F.lit("f"), k.cast("string")), "status": F.when(k < 12, "complete").when(k < 14, "started")})
    return rows, rows.filter(F.col("status").isNotNull()).select("source_file", "status").distinct()


@query("a13_resume_from_manifest", f"WITH {MAN} SELECT DISTINCT source_file FROM m WHERE status IS DISTINCT FROM 'complete'")
def _(spark, d):
    rows, done = manifest(spark, d)
    return lake.pending_files(rows.select("source_file").distinct(), done)


@query("a13_drop_partial", "SELECT row_pos FROM tel WHERE row_pos % 20 < 12")
def _(spark, d):
    rows, done = manifest(spark, d)
    return lake.drop_partial(rows, done).select("row_pos")


@query("a14_incremental_scan", "WITH o AS (SELECT source_id, min(lat) AS first_lat FROM tel WHERE row_pos % 20 < 6 GROUP BY 1), n AS (SELECT source_id, min(lat) AS first_lat FROM tel WHERE row_pos % 20 >= 6 GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE source_id NOT IN (SELECT source_id FROM o)")
def _(spark, d):
    rows, _ = manifest(spark, d)
    seen = rows.filter("row_pos % 20 < 6")
    lookup = seen.groupBy("source_id").agg(F.min("lat").alias("first_lat"))
    return lake.merge_new(lookup, rows, seen.select("source_file").distinct(), file="source_file", key="source_id", value=F.col("lat"), name="first_lat")


@query("a15_retention", "SELECT CAST(CAST(make_timestamp(t_us) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM tel WHERE CAST(make_timestamp(t_us) AS DATE) >= DATE '2024-01-20' GROUP BY 1")
def _(spark, d):
    path = lake.scratch(spark, "retain")
    rows = telemetry(spark, d).withColumn("day", F.to_date(F.timestamp_micros("t_us")).cast("string"))
    rows.select("row_pos", "day").repartition("day").write.partitionBy("day").parquet(path)
    lake.expire(spark, path, day="day", keep_from="2024-01-20")
    return spark.read.schema("row_pos long, day string").parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("a17_keyed_messages", "SELECT source_id AS key, row_pos, row_pos // 500 AS cycle_id FROM tel")
def _(spark, d):
    m = feed.messages(telemetry(spark, d).select("source_id", "row_pos"), key="source_id", cycle=F.floor(F.col("row_pos") / 500))
    v = F.from_json("value", "row_pos long, cycle_id long")
    return m.select("key", v["row_pos"].alias("row_pos"), v["cycle_id"].alias("cycle_id"))


@query("a16_topic_archive", "SELECT row_pos FROM tel")
def _(spark, d):
    from trackweave.streaming import live
    from trackweave.suites.live_streams import drain, stream

    path = lake.scratch(spark, "bronze")
    msgs = feed.messages(stream(spark, d).select("source_id", "row_pos"), key="source_id")
    drain(live.archive(msgs, f"{path}/bronze", f"{path}/ckpt", once=True))
    return spark.read.text(f"{path}/bronze").select(F.from_json("value", "row_pos long")["row_pos"].alias("row_pos"))


@query("a18_geojson_lines", "SELECT row_pos, 'Feature' AS type, 'Point' AS gtype, lon, lat, x FROM tel WHERE alt IS NOT NULL")
def _(spark, d):
    path = lake.scratch(spark, "geojson")
    where = lake.point(F.when(F.col("alt").isNotNull(), F.col("lat")), F.col("lon"))
    lake.write_features(lake.feature_lines(telemetry(spark, d), where, ["row_pos", "x"]), path)
    f = F.from_json("value", "type string, properties struct<row_pos: long, x: double>, geometry struct<type: string, coordinates: array<double>>")
    return spark.read.text(path).select(
        f["properties"]["row_pos"].alias("row_pos"), f["type"].alias("type"), f["geometry"]["type"].alias("gtype"), f["geometry"]["coordinates"][0].alias("lon"), f["geometry"]["coordinates"][1].alias("lat"), f["properties"]["x"].alias("x"),
    )


@query("a18_cell_polygons")
def _(spark, d):
    c = telemetry(spark, d).groupBy(geo.hex_cell(F.col("lat"), F.col("lon"), 3).alias("cell")).agg(F.count(F.lit(1)).alias("point_count"))
    return lake.feature_lines(c, lake.polygon(geo.hex_polygon(F.col("cell"), 3)), ["cell", "point_count"])


@query("a19_export", "SELECT source_id, t, x FROM tel WHERE t BETWEEN 1704500000 AND 1705500000 AND source_type = 'view'")
def _(spark, d):
    path = lake.scratch(spark, "export")
    lake.export(telemetry(spark, d), path, time="t", start=1704500000.0, end=1705500000.0, columns=["source_id", "t", "x"], fmt="csv", only=F.col("source_type") == "view")
    return spark.read.schema("source_id string, t double, x double").option("header", True).csv(path)


@query("a20_long_to_wide", "SELECT row_pos, source_id, x, alt, CAST(NULL AS DOUBLE) AS gone FROM tel")
def _(spark, d):
    pairs = F.inline(F.array(F.struct(F.lit("x").alias("field"), F.col("x").alias("value")), F.struct(F.lit("alt").alias("field"), F.col("alt").alias("value"))))
    long = telemetry(spark, d).select("row_pos", "source_id", pairs)
    return lake.long_to_wide(long, time="row_pos", entity="source_id", field="field", value="value", fields=["x", "alt", "gone"])


@query("a22_range_csv", "SELECT CAST(n_nationkey * 4096 AS BIGINT) AS start, CAST(n_nationkey * 4096 + 255 AS BIGINT) AS end, 'Land, ' || n_name AS country FROM nation", tel=False)
def _(spark, d):
    path = lake.scratch(spark, "ranges")
    k = F.col("n_nationkey").cast("long") * 4096
    line = F.concat(F.hex(k), F.lit(","), F.hex(k + 255), F.lit(',"Land, '), F.col("n_name"), F.lit('"'))
    bad = F.when(F.col("n_nationkey") % 5 == 0, F.lit("zz,10,broken"))
    table(spark, d, "nation").select(F.explode(F.array_compact(F.array(line, bad))).alias("value")).write.text(path)
    return lake.hex_ranges(spark, path)


# ---------------------------------------------------------------- part index
def parts(spark, d):
    rows = telemetry(spark, d).withColumn("file", F.concat(F.lit("p"), F.floor(F.col("row_pos") / 700).cast("string")))
    return lake.part_index(rows, time="t", source="source_type", file=F.col("file"))


IDX = """c AS (SELECT 'p' || row_pos // 700 AS object_name, source_type, min(t) AS lo, max(t) AS hi, count(*) AS n FROM tel GROUP BY 1, 2),
 ix AS (SELECT object_name, min(lo) AS min_ts, max(hi) AS max_ts, CAST(sum(n) AS BIGINT) AS row_count, arg_min(source_type, (-n, source_type)) AS source_type FROM c GROUP BY object_name)"""


@query("d21_part_index", f"WITH {IDX} SELECT * FROM ix")
def _(spark, d):
    return parts(spark, d)


@query("d21_file_index", "SELECT 'events.parquet' AS file, min(t) AS min_ts, max(t) AS max_ts, count(*) AS row_count FROM tel")
def _(spark, d):
    e = table(spark, d, "events").withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    ix = lake.part_index(e.select("t", F.col("event_type").alias("source_type"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")), time="t", file=F.col("file"))
    return ix.select(F.col("object_name").alias("file"), "min_ts", "max_ts", "row_count")


@query("c16_parts_overlapping", f"WITH {IDX} SELECT object_name FROM ix WHERE max_ts >= 1704600000 AND min_ts < 1705000000")
def _(spark, d):
    return lake.parts_overlapping(parts(spark, d), 1704600000.0, 1705000000.0).select("object_name")


@query("d47_estimate_rows", f"WITH {IDX} SELECT CAST(sum(row_count) AS BIGINT) AS estimated_rows, count(*) AS parts FROM ix WHERE max_ts >= 1704600000 AND min_ts < 1705000000")
def _(spark, d):
    return lake.estimate_rows(parts(spark, d), 1704600000.0, 1705000000.0)


@query("d46_dataset_totals", f"WITH {IDX} SELECT source_type AS dataset, CAST(sum(row_count) AS BIGINT) AS rows FROM ix GROUP BY source_type")
def _(spark, d):
    return lake.dataset_totals(parts(spark, d).withColumnRenamed("source_type", "dataset"))


@query("g6_merge_indexes", f"WITH {IDX} SELECT layer, count(*) AS parts, CAST(sum(row_count) AS BIGINT) AS rows FROM (SELECT *, 'gold' AS layer FROM ix UNION ALL SELECT *, 'silver' FROM ix WHERE row_count < 700) GROUP BY layer")
def _(spark, d):
    p = parts(spark, d)
    return lake.merge_indexes(gold=p, silver=p.filter("row_count < 700")).groupBy("layer").agg(F.count(F.lit(1)).alias("parts"), F.sum("row_count").alias("rows"))


@query("a26_layer_catalog", f"WITH {IDX} SELECT 'gold' AS layer, source_type AS dataset, CAST(sum(row_count) AS BIGINT) AS rows, strftime(make_timestamp(CAST(min(min_ts) * 1e6 AS BIGINT)), '%Y-%m-%d') AS first_day, strftime(make_timestamp(CAST(max(max_ts) * 1e6 AS BIGINT)), '%Y-%m-%d') AS last_day FROM ix GROUP BY source_type")
def _(spark, d):
    return lake.layer_catalog(lake.merge_indexes(gold=parts(spark, d).withColumnRenamed("source_type", "dataset")))


@query("d48_country_count", "SELECT count(*) AS rows FROM tel WHERE t BETWEEN 1704500000 AND 1705500000 AND CAST(source_id AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_nationkey").cast("string").alias("country"))
    return lake.country_count(telemetry(spark, d), c, time="t", start=1704500000.0, end=1705500000.0, entity="source_id", country="3")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("l5_input_manifest")
def _(spark, d):
    from trackweave.operators.contracts import table_manifest

    return table_manifest({t: table(spark, d, t) for t in TABLES})


@query("l5_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES), tel=False)
def _(spark, d):
    from trackweave.operators.contracts import table_manifest

    return table_manifest({t: table(spark, d, t) for t in TABLES}).select("table", "rows")


# ---------------------------------------------------------------- trace archives
def documents(spark, d):
    """Trace documents of at most 100 rows built from the track rows; one per (entity, position range)."""
    i = F.col("row_pos")
    num = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    upd = F.when(i % 4 == 0, F.concat(F.lit('{"squawk":'), F.when(i % 8 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), F.lit(',"category":"A'), (i % 3).cast("string"), F.lit('"}')))
    cells = [F.col("t") - 1704067200, F.col("lat"), F.col("lon"), F.when(F.col("on_ground"), '"ground"').otherwise(num(F.col("alt"))), F.col("ground_speed_ms"), F.col("track_deg"), i % 4, F.col("vertical_rate_ms") * 100]
    row = F.concat(F.lit("["), F.concat_ws(",", *[num(c) for c in cells], F.coalesce(upd, F.lit("null")), F.lit('"adsb_icao"'), num(F.col("alt_geom_m"))), F.lit("]"))
    rows = telemetry(spark, d).withColumn("grp", F.floor(i / 15000)).select("source_id", "grp", i.alias("p"), row.alias("row"))
    docs = rows.groupBy("source_id", "grp").agg(F.array_sort(F.collect_list(F.struct("p", "row"))).alias("rows"))
    head = F.concat(F.lit('{"icao":"'), "source_id", F.lit('","timestamp":1704067200,"dbFlags":"'), F.when(F.col("source_id").cast("long") % 3 == 0, "garbage").otherwise(F.col("source_id")), F.lit('","trace":['))
    text = F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}"))
    return docs.select(F.concat(F.lit("day-"), (F.col("source_id").cast("long") % 4).cast("string")).alias("source_file"), F.concat_ws("-", F.lit("traces/x"), "source_id", F.col("grp").cast("string")).alias("member"), text.alias("json_text"), F.lit(None).cast("string").alias("error"))


DOCS = "td AS (SELECT *, 'day-' || CAST(source_id AS BIGINT) % 4 || '#traces/x-' || source_id || '-' || row_pos // 15000 AS doc_id FROM tel)"


@query("a2_parse_trace", f"""WITH {DOCS} SELECT source_id, t, lat, lon, CASE WHEN NOT on_ground THEN round(alt * 0.3048, 1) END AS alt, round(alt_geom_m * 0.3048, 1) AS alt_geom_m, on_ground, round(ground_speed_ms * 0.5144, 2) AS gs, track_deg,
 round(vertical_rate_ms * 100 * 0.00508, 3) + 0.0 AS vr, row_pos % 4 IN (1, 3) AS stale, row_pos % 4 IN (2, 3) AS new_leg, CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN false ELSE CAST(source_id AS BIGINT) % 2 = 1 END AS mil FROM td""")
def _(spark, d):
    r = traces.trace_rows(documents(spark, d))
    return r.select(
        "source_id", F.col("timestamp_utc").alias("t"), "lat", "lon", "alt", "alt_geom_m", "on_ground", F.col("ground_speed_ms").alias("gs"), "track_deg",
        (F.col("vertical_rate_ms") + 0.0).alias("vr"), F.col("flags_stale").alias("stale"), F.col("flags_new_leg").alias("new_leg"), F.col("is_military").alias("mil"),
    )


@query("a3_sparse_carry_forward", f"""WITH {DOCS}, u AS (SELECT *, row_pos % 4 = 0 AS up, CASE WHEN row_pos % 8 <> 0 THEN CAST(row_pos AS VARCHAR) END AS sq FROM td),
 c AS (SELECT *, last_value(CASE WHEN up THEN row_pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_pos) AS lp FROM u)
SELECT c.source_id, c.t, p.sq AS squawk, c.up AS squawk_updated, p.t AS update_t, c.t - p.t AS age FROM c LEFT JOIN u p ON p.row_pos = c.lp""")
def _(spark, d):
    r = traces.carry_updates(traces.trace_rows(documents(spark, d)), fields={"squawk": "squawk"})
    return r.select("source_id", F.col("timestamp_utc").alias("t"), "squawk", "squawk_updated", F.col("squawk_update_timestamp_utc").alias("update_t"), F.col("squawk_update_age_s").alias("age"))


@query("a1_trace_archive_scan", f"WITH {DOCS} SELECT DISTINCT 'day-' || CAST(source_id AS BIGINT) % 4 || '.tar' AS archive, 'traces/x-' || source_id || '-' || row_pos // 15000 || '.json.gz' AS member FROM td")
def _(spark, d):
    path = archives(spark, d)
    got = traces.read_members(traces.archive_members(spark, f"{path}/*/*.tar")).filter(F.col("json_text").isNotNull())
    return got.select(F.element_at(F.split("source_file", "/"), -1).alias("archive"), "member")


def archives(spark, d):
    """Tars of gzipped documents in the shared folder: each task writes its volume of every source file, plus a corrupt member."""
    path = lake.scratch(spark, "tars")

    def build(batches):
        import gzip

        tar = out = name = None

        def add(member, raw):
            info = tarfile.TarInfo(member)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
            tar.members.clear()

        def close():
            add("traces/bad.json.gz", b"\x1f\x8bbroken")
            add("readme.txt", b"x")
            tar.close()
            out.close()
            return pd.DataFrame({"source_file": [name]})

        for pdf in batches:  # in the order of files and members: one member at a time
            for r in pdf.itertuples():
                if r.source_file != name:
                    if tar is not None:
                        yield close()
                    name = r.source_file
                    filesystem, target = traces.filesystem(f"{path}/{TaskContext.get().partitionId()}/{name}.tar")
                    filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = filesystem.open_output_stream(target)
                    tar = tarfile.open(fileobj=out, mode="w|")
                add(f"{r.member}.json.gz", gzip.compress(r.json_text.encode()))
        if tar is not None:
            yield close()

    documents(spark, d).repartition("source_file", "member").sortWithinPartitions("source_file", "member").mapInPandas(build, "source_file string").count()
    return path


@query("a21_inventory_profile", """WITH l AS (SELECT 'rows' AS metric, 'on_ground' AS key, count(*) AS n FROM tel WHERE on_ground UNION ALL SELECT 'rows', 'all', count(*) FROM tel UNION ALL SELECT 'row_length', '11', count(*) FROM tel UNION ALL
 SELECT 'category', 'A' || row_pos % 3, count(*) FROM tel WHERE row_pos % 4 = 0 GROUP BY 2) SELECT * FROM l""")
def _(spark, d):
    p = traces.profile_documents(documents(spark, d))
    return p.filter(F.col("metric").isin("rows", "row_length", "category"))


@query("a21_evenly_sampled", "WITH m AS (SELECT DISTINCT CAST(source_id AS BIGINT) % 4 AS f, CAST(source_id AS BIGINT) AS o FROM tel), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM m), s AS (SELECT unnest(range(0, 10)) AS k) SELECT DISTINCT f AS source_file, o AS \"offset\" FROM n, s WHERE n <= 10 OR i = (k * n) // 10")
def _(spark, d):
    m = telemetry(spark, d).select((F.col("source_id").cast("long") % 4).alias("source_file"), F.col("source_id").cast("long").alias("offset"), F.col("source_id").alias("member")).distinct()
    return traces.evenly_sampled(m, samples=10).select("source_file", "offset")


# ---------------------------------------------------------------- live records
@query("a4_realtime_jsonl", "SELECT source_id, round(CASE WHEN row_pos % 3 = 0 THEN epoch_us(TIMESTAMP '2026-07-01 12:00:00') / 1e6 ELSE floor(t_us / 1000) / 1000.0 END, 3) AS timestamp_utc, x AS lat, false AS on_ground, CASE WHEN row_pos % 5 <> 0 THEN 'CS' || row_pos END AS flight_callsign FROM tel WHERE row_pos % 11 <> 0")
def _(spark, d):
    i = F.col("row_pos")
    ts = F.when(i % 3 != 0, F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    call = F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" CS"), i.cast("string"), F.lit(" ")))
    good = F.to_json(F.struct(F.col("source_id").alias("icao24"), ts.alias("ts"), F.col("x").alias("lat"), call.alias("callsign")))
    lines = telemetry(spark, d).select(F.when(i % 11 == 0, F.substring(good, 1, 15)).otherwise(good).alias("value"))
    path = lake.scratch(spark, "landing")
    lines.write.text(path)
    rows = feed.landing_rows(spark.read.text(path), file=F.lit("states-20260701T120000Z.jsonl"))
    return rows.select("source_id", r6("timestamp_utc", 3).alias("timestamp_utc"), "lat", "on_ground", "flight_callsign")


@query("h29_record_normaliser", "SELECT row_pos, 'ab' || source_id AS icao24, round(CASE WHEN on_ground THEN 0 ELSE alt * 0.3048 END, 1) AS alt, on_ground AS is_ground, round(x * 0.5144, 1) AS velocity, coalesce(CASE WHEN row_pos % 2 = 0 THEN x END, 5.0) AS signal_age_sec, row_pos % 4 = 1 AS is_military FROM tel WHERE lat <> 0 AND lon <> 0 AND (on_ground OR alt IS NOT NULL)")
def _(spark, d):
    i = F.col("row_pos")
    raw = F.to_json(F.struct(
        F.concat(F.lit(" AB"), "source_id").alias("hex"), "lat", "lon", F.when(F.col("on_ground"), "ground").otherwise(F.col("alt").cast("string")).alias("alt_baro"), F.col("x").alias("gs"),
        F.when(i % 2 == 0, F.col("x")).alias("seen_pos"), F.lit(5.0).alias("seen"), F.when(i % 4 == 3, "bad").otherwise((i % 4).cast("string")).alias("dbFlags"),
    ))
    out = feed.normalise(telemetry(spark, d).select("row_pos", raw.alias("value")), "adsblol")
    return out.select("row_pos", "icao24", "alt", "is_ground", "velocity", "signal_age_sec", "is_military")


@query("h30_state_normaliser", "SELECT row_pos, source_id AS icao24, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(round(alt, 1), 0) AS alt, x AS velocity, CASE WHEN row_pos % 3 = 0 THEN 'general' ELSE 'none' END AS emergency, on_ground AS is_ground, CAST(1000 - row_pos % 100 AS DOUBLE) AS signal_age_sec FROM tel")
def _(spark, d):
    i = F.col("row_pos")
    s = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    slots = [F.concat(F.lit('"'), "source_id", F.lit(' "')), F.lit("null"), F.lit("null"), F.lit("null"), i % 100 + 1704999000 - 0, F.col("lon"), F.col("lat"), F.col("alt"), F.col("on_ground"), F.col("x"), F.lit("null"), F.lit("null"), F.lit("null"), F.lit("null"),
             F.when(i % 3 == 0, '"7700"').otherwise("null"), F.lit("false"), F.lit(0)]
    raw = F.concat(F.lit("["), F.concat_ws(",", *[s(c) for c in slots]), F.lit("]"))
    out = feed.normalise(telemetry(spark, d).select("row_pos", raw.alias("value")), "opensky", now=F.lit(1705000000.0))
    return out.select("row_pos", "icao24", "lat", "lon", "alt", "velocity", "emergency", "is_ground", "signal_age_sec")


# ---------------------------------------------------------------- topic logs
@query("a23_topic_ingest", """WITH r AS (SELECT source_id AS flight_id, row_pos, t_us, t_us - min(t_us) OVER (PARTITION BY source_id) AS rel, roll_deg, track_deg FROM tel WHERE source_type IN ('view', 'click')),
 m AS (SELECT flight_id, quantile_cont(track_deg, 0.5) AS md FROM (SELECT *, row_number() OVER () FROM r) WHERE rel / 1e6 < 1000000 AND row_pos IN (SELECT row_pos FROM tel WHERE source_type = 'view') GROUP BY flight_id)
SELECT row_pos, round(rel / 1e6, 6) AS t, round(radians(roll_deg), 9) + 0.0 AS roll, round(track_deg - md, 6) AS pwm FROM r JOIN m USING (flight_id) WHERE row_pos IN (SELECT row_pos FROM tel WHERE source_type = 'view')""")
def _(spark, d):
    tel = telemetry(spark, d).withColumns({"flight_id": F.col("source_id"), "stamp": F.col("t_us") * 1000})
    rel = topics.relative_time({k: tel.filter(F.col("source_type") == k) for k in ("view", "click")})
    onset = tel.select("flight_id").distinct().withColumn("onset_s", F.lit(1000000.0))
    out = topics.normalise_topic(rel["view"], rename={"roll_deg": "roll", "track_deg": "pwm"}, degrees=["roll"], trim=["pwm"], onset=onset, untrimmed="drop")
    return rounded(rounded(rounded(out.select("row_pos", "t", "roll", "pwm"), "t"), "roll", n=9), "pwm")


@query("a24_log_normalise", """WITH z AS (SELECT *, row_pos % 3 AS inst, t_us - min(t_us) OVER (PARTITION BY source_id) AS rel FROM tel), l AS (SELECT source_id, source_type, min(inst) AS mi FROM z GROUP BY ALL)
SELECT z.source_id AS flight_id, z.source_type AS topic, round(rel / 1e6, 6) AS t, x FROM z JOIN l USING (source_id, source_type) WHERE inst = mi""")
def _(spark, d):
    log = telemetry(spark, d).select(F.col("source_id").alias("flight_id"), F.col("source_type").alias("topic"), (F.col("row_pos") % 3).alias("inst"), F.col("t_us").alias("timestamp"), "x")
    return rounded(topics.first_instances(log, topic="topic", instance="inst", fields=["x"]), "t")


@query("a25_metadata_reconcile", "SELECT DISTINCT source_id AS flight_id, CASE WHEN CAST(source_id AS BIGINT) % 5 = 0 THEN 'motor' ELSE 'normal' END AS fault_class, CAST(source_id AS BIGINT) % 5 = 0 AS reclassified FROM tel")
def _(spark, d):
    path, key = lake.scratch(spark, "records"), F.col("flight_id").cast("long")
    rows = telemetry(spark, d).select(F.col("source_id").alias("flight_id"), "row_pos", F.lit("normal").alias("fault_class"))
    rows.withColumn("part", key % 10).repartition("part").write.partitionBy("part").parquet(path)
    truth = rows.select("flight_id").distinct().filter(key % 5 == 0).withColumn("fault_class", F.lit("motor"))
    topics.reconcile_layer(spark, path, truth, partition="part")
    return spark.read.parquet(path).select("flight_id", "fault_class", (F.col("fault_class") != "normal").alias("reclassified")).distinct()


@query("h31_source_day", "SELECT row_pos, '2024-01-0' || (1 + row_pos % 3) AS day FROM tel")
def _(spark, d):
    path = F.concat(F.lit("bronze/v2024.01.0"), (1 + F.col("row_pos") % 3).cast("string"), F.lit("-planes.tar"))
    return telemetry(spark, d).select("row_pos", topics.source_day(path, ["2024-01-01", "2024-01-02", "2024-01-03"]).alias("day"))


@query("h32_path_class_session", """SELECT row_pos, CASE row_pos % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'motor' WHEN 2 THEN 'sensor' ELSE 'unknown' END AS cls, CASE row_pos % 4 WHEN 3 THEN 'Other' ELSE '2024-0' || (1 + row_pos % 9) || '-07' END AS session,
 CASE row_pos % 3 WHEN 0 THEN 'aileron_rudder' WHEN 1 THEN 'normal' ELSE 'engine' END AS named FROM tel""")
def _(spark, d):
    i = F.col("row_pos")
    head = F.when(i % 4 == 0, "Real-NoFault").when(i % 4 == 1, "Real-Motor").when(i % 4 == 2, "Real-Sensors").otherwise("Other")
    path = F.when(i % 4 == 3, F.concat(head, F.lit("/case"))).otherwise(F.concat(head, F.lit("/2024-"), (1 + i % 9).cast("string"), F.lit("-7/x")))
    name = F.when(i % 3 == 0, "both_Aileron_and_Rudder_failure").when(i % 3 == 1, "No_Failure").otherwise("engine_failure_with_emr")
    return telemetry(spark, d).select("row_pos", topics.path_class(path).alias("cls"), topics.path_session(path).alias("session"), topics.name_class(name).alias("named"))
