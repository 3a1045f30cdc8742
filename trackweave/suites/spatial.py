"""Grids, countries, routes and live-map questions."""

from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators import density as dn
from trackweave.operators import routes as rt
from trackweave.suites.base import TRACK, query, r6, rounded, table, telemetry
from trackweave.suites.sequence import SEG, flights

CELL = "CAST(floor(lat / 5.0) AS BIGINT) || '_' || CAST(floor(lon / 5.0) AS BIGINT)"
BIG = "CAST(floor(lat / 20.0) AS BIGINT) || '_' || CAST(floor(lon / 20.0) AS BIGINT)"
DAY = "CAST(make_timestamp(t_us) AS DATE)"


def cell(size=5.0):
    return geo.square_cell(F.col("lat"), F.col("lon"), size)


def day():
    return F.to_date(F.timestamp_micros("t_us"))


def countries(spark, d):
    """Track rows with a country: the entity number picks a nation, some have none."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    k = F.col("source_id").cast("long") % 29
    return telemetry(spark, d).withColumn("k", k).join(n, F.col("k") == F.col("n_nationkey"), "left").drop("k", "n_nationkey")


CO = "co AS (SELECT tel.*, n_name AS country FROM tel LEFT JOIN nation ON n_nationkey = CAST(source_id AS BIGINT) % 29)"


@query("b2_clean_coordinates", "SELECT row_pos, lat * 1.6 AS la, lon FROM tel WHERE lat * 1.6 BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def _(spark, d):
    df = telemetry(spark, d).withColumn("la", F.col("lat") * 1.6)
    return dn.clean_coordinates(df, lat="la", dropped="clean").select("row_pos", "la", "lon")


@query("d1_grid_density", f"SELECT {CELL} AS cell, count(*) AS point_count FROM tel GROUP BY 1")
def _(spark, d):
    return dn.point_density(telemetry(spark, d), cell())


@query("d2_flight_density", f"""WITH m AS (SELECT source_id, bool_or(is_military) AS mil FROM tel GROUP BY source_id),
g AS (SELECT 'g5' AS grid, {CELL} AS cell, source_id, {DAY} AS dy FROM tel UNION ALL SELECT 'g20', {BIG}, source_id, {DAY} FROM tel)
SELECT grid, cell, CAST(count(*) AS BIGINT) AS point_count, count(DISTINCT source_id || '|' || dy) AS flight_count,
 count(DISTINCT CASE WHEN NOT mil THEN source_id || '|' || dy END) AS flight_count_civil, count(DISTINCT CASE WHEN mil THEN source_id || '|' || dy END) AS flight_count_military,
 count(DISTINCT dy) AS day_count FROM g JOIN m USING (source_id) GROUP BY grid, cell""")
def _(spark, d):
    return dn.flight_density(telemetry(spark, d), {"g5": cell(), "g20": cell(20.0)}, day=day())


@query("d3_military_lookup", "SELECT source_id, bool_or(is_military) AS is_military FROM tel GROUP BY source_id")
def _(spark, d):
    return dn.military_lookup(telemetry(spark, d))


@query("d4_live_density", f"""SELECT {BIG} AS cell, count(*) AS point_count, count(DISTINCT source_id) AS aircraft, count(DISTINCT CASE WHEN NOT alarm THEN source_id END) AS civil,
 count(DISTINCT CASE WHEN alarm THEN source_id END) AS military FROM tel GROUP BY 1""")
def _(spark, d):
    return dn.live_density(telemetry(spark, d), cell(20.0), military="alarm")


@query("d5_country_counts", f"WITH {CO} SELECT country, count(DISTINCT source_id) AS hex_count, count(*) AS row_count FROM co WHERE country IS NOT NULL GROUP BY country")
def _(spark, d):
    return dn.country_counts(countries(spark, d))


@query("d6_mlat_ratio", f"""SELECT {BIG} AS cell, count(*) FILTER (WHERE source_type = 'error') AS mlat_count, count(*) AS total_count,
 round(count(*) FILTER (WHERE source_type = 'error') / count(*), 4) AS ratio FROM tel GROUP BY 1 HAVING count(*) FILTER (WHERE source_type = 'error') > 0""")
def _(spark, d):
    return dn.mlat_ratio(telemetry(spark, d), cell(20.0), is_mlat=F.col("source_type") == "error")


DOM = f"""{CO}, w AS (SELECT *, {BIG} AS cell, 'all' AS time_window FROM co WHERE country IS NOT NULL UNION ALL
 SELECT *, {BIG}, '7d' FROM co WHERE country IS NOT NULL AND t >= (SELECT max(t) FROM co WHERE country IS NOT NULL) - 604800),
p AS (SELECT time_window, cell, country, count(DISTINCT source_id) AS n, count(DISTINCT CASE WHEN NOT is_military THEN source_id END) AS nc, count(DISTINCT CASE WHEN is_military THEN source_id END) AS nm FROM w GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY time_window, cell ORDER BY n DESC, country) AS rk FROM p)"""


@query("d7_dominant_country", f"""WITH {DOM} SELECT time_window, cell, max(CASE WHEN rk = 1 THEN country END) AS dominant_country, max(n) AS dominant_count, CAST(sum(n) AS BIGINT) AS total_count,
 string_agg(country || '=' || n, ',' ORDER BY country) AS per_country, string_agg(country || '=' || nc, ',' ORDER BY country) AS per_country_civil,
 string_agg(country || '=' || nm, ',' ORDER BY country) AS per_country_military, round(max(n) / sum(n), 3) AS dominant_ratio FROM q GROUP BY time_window, cell""")
def _(spark, d):
    out = dn.dominant_country(countries(spark, d), cell(20.0), time="t", windows={"7d": 604800.0, "all": None})
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({c: text(c) for c in ("per_country", "per_country_civil", "per_country_military")})


@query("d8_quantile_breaks", f"""WITH c AS (SELECT {CELL} AS cell, count(*) AS n FROM tel GROUP BY 1)
SELECT greatest(1, CAST(floor(quantile_cont(n, 0.10)) AS BIGINT)) AS p10, greatest(1, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT)) AS p50, greatest(1, CAST(floor(quantile_cont(n, 0.75)) AS BIGINT)) AS p75,
 greatest(1, CAST(floor(quantile_cont(n, 0.9)) AS BIGINT)) AS p90, greatest(1, CAST(floor(quantile_cont(n, 0.99)) AS BIGINT)) AS p99 FROM c""")
def _(spark, d):
    return dn.quantile_breaks(dn.point_density(telemetry(spark, d), cell()), [], "point_count")


@query("d9_daily_snapshots", f"""WITH g AS (SELECT {BIG} AS cell, source_id, date_diff('day', {DAY}, (SELECT max({DAY}) FROM tel)) AS ago FROM tel),
r AS (SELECT * FROM g WHERE ago < 7) SELECT cell, """ + " || ',' || ".join(f"count(DISTINCT CASE WHEN ago = {i} THEN source_id END)" for i in range(6, -1, -1)) + " AS counts FROM r GROUP BY cell")
def _(spark, d):
    out = dn.daily_snapshots(telemetry(spark, d), cell(20.0), day=day())
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda c: c.cast("string")), ","))


RANGES = """rg AS (SELECT n_nationkey * 4000 AS s, n_nationkey * 4000 + 2999 AS e, n_name AS nm FROM nation UNION ALL
 SELECT r_regionkey * 20000, r_regionkey * 20000 + 15999, '(reserved, ' || r_name || ')' FROM region),
ids AS (SELECT DISTINCT source_id, CAST(source_id AS BIGINT) * 1009 % 110000 AS k FROM tel),
best AS (SELECT source_id, arg_min(nm, e - s) AS nm FROM ids LEFT JOIN rg ON k BETWEEN s AND e GROUP BY source_id),
cat AS (SELECT source_id, CASE WHEN nm NOT LIKE '(reserved%' THEN nm END AS country, CASE WHEN nm IS NULL THEN 'no_match' WHEN nm LIKE '(reserved%' THEN 'reserved' ELSE 'country' END AS category FROM best)"""


def ranges(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    a = n.select((F.col("n_nationkey") * 4000).cast("long").alias("start"), (F.col("n_nationkey") * 4000 + 2999).cast("long").alias("end"), F.col("n_name").alias("country"))
    b = r.select((F.col("r_regionkey") * 20000).cast("long").alias("start"), (F.col("r_regionkey") * 20000 + 15999).cast("long").alias("end"),
                 F.concat(F.lit("(reserved, "), "r_name", F.lit(")")).alias("country"))
    return a.unionByName(b)


def with_category(spark, d):
    tel = telemetry(spark, d).withColumn("hex", F.lower(F.hex(F.col("source_id").cast("long") * 1009 % 110000)))
    return rt.country_lookup(tel, ranges(spark, d), hex_id="hex")


@query("c4_country_of_hex", f"WITH {RANGES} SELECT tel.row_pos, country, category FROM tel JOIN cat USING (source_id)")
def _(spark, d):
    return with_category(spark, d).select("row_pos", "country", "category")


@query("d10_category_coverage", f"""WITH {RANGES}, j AS (SELECT source_id, category FROM tel JOIN cat USING (source_id))
SELECT category, count(DISTINCT source_id) AS entities, count(*) AS rows, round(100.0 * count(DISTINCT source_id) / (SELECT count(DISTINCT source_id) FROM tel), 1) AS entity_pct,
 round(100.0 * count(*) / (SELECT count(*) FROM tel), 1) AS row_pct FROM j GROUP BY category""")
def _(spark, d):
    return dn.category_coverage(with_category(spark, d), category="category", entity="source_id")


@query("c5_map_lookup", "WITH m AS (SELECT s_suppkey, s_acctbal > 5000 AS flag FROM supplier) SELECT row_pos, coalesce(flag, false) AS flag FROM tel LEFT JOIN m ON s_suppkey = CAST(source_id AS BIGINT)")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), (F.col("s_acctbal") > 5000).alias("flag"))
    return rt.map_lookup(telemetry(spark, d), s, "source_id", "flag", False).select("row_pos", "flag")


REF = "ref AS (SELECT s_name AS ident, -60 + (s_suppkey * 37 % 1200) / 10.0 AS rlat, -180 + (s_suppkey * 91 % 3600) / 10.0 AS rlon FROM supplier)"
HAV = "2 * {r} * asin(sqrt(greatest(0, least(1, power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"


def airports(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("ident"), (F.lit(-60) + F.pmod(k * 37, F.lit(1200)) / 10.0).alias("ref_lat"), (F.lit(-180) + F.pmod(k * 91, F.lit(3600)) / 10.0).alias("ref_lon"),
    )


@query("c6_nearest_reference", f"""WITH {REF}, p AS (SELECT row_pos, ident, {HAV.format(r=6371.0088, a='lat', b='lon', c='rlat', d='rlon')} AS km FROM tel, ref),
b AS (SELECT row_pos, min(struct_pack(km := km, ident := ident)) AS m FROM p WHERE km <= 400 GROUP BY row_pos)
SELECT tel.row_pos, m.ident AS ident, round(m.km, 4) AS distance_km FROM tel LEFT JOIN b USING (row_pos)""")
def _(spark, d):
    out = rt.nearest_within(telemetry(spark, d), airports(spark, d), key=["lat", "lon"], ident="ident", max_km=400.0)
    return out.select("row_pos", "ident", r6("distance_km", 4).alias("distance_km"))


@query("c18_route_plausible", f"""WITH {REF}, j AS (SELECT row_pos, CASE WHEN row_pos % 10 <> 0 THEN track_deg END AS trk, lat, lon, rlat, rlon FROM tel JOIN (SELECT *, row_number() OVER (ORDER BY ident) AS i FROM ref) ON i = row_pos % 50 + 1),
b AS (SELECT *, (degrees(atan2(sin(radians(rlon - lon)) * cos(radians(rlat)), cos(radians(lat)) * sin(radians(rlat)) - sin(radians(lat)) * cos(radians(rlat)) * cos(radians(rlon - lon)))) + 360) % 360 AS brg FROM j)
SELECT row_pos, CASE WHEN trk IS NULL THEN true ELSE abs((brg - trk + 540) % 360 - 180) <= 90.0 END AS plausible FROM b""")
def _(spark, d):
    ref = airports(spark, d).filter(F.col("ident").isNotNull())
    ids = ref.select("ident", "ref_lat", "ref_lon", (F.regexp_extract("ident", r"(\d+)", 1).cast("long")).alias("no"))
    first = ids.agg(F.min("no")).scalar()
    tel = telemetry(spark, d).withColumns({"no": F.col("row_pos") % 50 + first, "trk": F.when(F.col("row_pos") % 10 != 0, F.col("track_deg"))})
    ok = rt.route_plausible(F.col("lat"), F.col("lon"), F.col("trk"), F.col("ref_lat"), F.col("ref_lon"))
    return tel.join(ids, "no").select("row_pos", ok.alias("plausible"))


ROUTES = f"""{SEG}, {CO.replace('FROM tel', 'FROM fl tel')}, lg2 AS (SELECT flight_id, min(country) AS country, CAST(arg_min(lat, t) > 0 AS VARCHAR) || '->' || CAST(floor(arg_max(lon, t) / 90) AS BIGINT) AS pair
 FROM co WHERE country IS NOT NULL GROUP BY flight_id HAVING count(*) >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY flight_count DESC, pair) AS rank FROM (SELECT country, pair, count(DISTINCT flight_id) AS flight_count FROM lg2 GROUP BY 1, 2 HAVING count(DISTINCT flight_id) >= 2)),
top AS (SELECT *, rank = 1 AS is_top, flight_count < 15 AS low_confidence FROM rk WHERE rank <= 4)"""


def route_legs(spark, d):
    from trackweave.operators.segments import gap_segments, legs

    fl = gap_segments(countries(spark, d).filter(F.col("country").isNotNull()), TRACK, gap_s=21600.0)
    lg = legs(fl, TRACK, segment="flight_id", min_points=2)
    names = fl.groupBy("flight_id").agg(F.min("country").alias("country"))
    pair = F.concat((F.col("start_lat") > 0).cast("string"), F.lit("->"), F.floor(F.col("end_lon") / 90).cast("string"))
    return fl, lg.join(names, "flight_id").withColumn("pair", pair)


@query("f1_rank_routes", f"WITH {ROUTES} SELECT country, pair, flight_count, CAST(rank AS INTEGER) AS rank, is_top, low_confidence FROM top")
def _(spark, d):
    return rt.rank_routes(route_legs(spark, d)[1], keep=4)


@query("d12_route_counts", f"WITH {ROUTES} SELECT country, pair, flight_count FROM rk")
def _(spark, d):
    return rt.rank_routes(route_legs(spark, d)[1], keep=10**9).select("country", "pair", "flight_count")


CORR = f"""WITH {ROUTES}, kp AS (SELECT lg2.* FROM lg2 JOIN top USING (country, pair)),
h AS (SELECT kp.country, kp.pair, {BIG} AS cell, count(DISTINCT flight_id) AS flight_count_cell FROM fl JOIN kp USING (flight_id) GROUP BY 1, 2, 3)
SELECT country, pair, cell, flight_count_cell, round(flight_count_cell / flight_count, 3) AS ratio, is_top FROM h JOIN top USING (country, pair)"""


@query("c9_corridor_join", CORR)
def _(spark, d):
    fl, lg = route_legs(spark, d)
    out = rt.corridors(fl, lg, rt.rank_routes(lg, keep=4), cell(20.0))
    return out.select("country", "pair", "cell", "flight_count_cell", "ratio", "is_top")


@query("d13_corridor_ratio", CORR.replace("flight_count_cell, round", "round").replace(", is_top FROM", " FROM"))
def _(spark, d):
    fl, lg = route_legs(spark, d)
    return rt.corridors(fl, lg, rt.rank_routes(lg, keep=4), cell(20.0)).select("country", "pair", "cell", "ratio")


@query("d16_hourly_unique", "SELECT date_trunc('hour', make_timestamp(t_us))::VARCHAR AS bucket, count(DISTINCT source_id) AS aircraft FROM tel GROUP BY 1")
def _(spark, d):
    df = telemetry(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return dn.hourly_unique(df, ts="ts", entity="source_id").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("d17_replay_frame", """WITH s AS (SELECT min(t) + 864000 AS s FROM tel), f AS (SELECT tel.*, row_number() OVER (PARTITION BY source_id ORDER BY t DESC, row_pos DESC) AS k FROM tel, s WHERE t >= 1705000000 AND t < 1705000000 + 300 AND alt IS NOT NULL)
SELECT source_id, t, row_pos, lat, lon FROM f WHERE k = 1""")
def _(spark, d):
    df = telemetry(spark, d).filter(F.col("alt").isNotNull())
    return dn.replay_frame(df, time="t", start=1705000000.0, step_s=9000.0, entity="source_id", tie="row_pos").select("source_id", "t", "row_pos", "lat", "lon")


@query("d18_step_buckets", "SELECT DISTINCT 1704500000.0 + floor((t - 1704500000.0) / 300) * 300 AS bucket_start FROM tel WHERE t >= 1704500000 AND t < 1704600000")
def _(spark, d):
    return dn.step_buckets(telemetry(spark, d), time="t", start=1704500000.0, end=1704600000.0, step_s=300.0)


@query("d19_downsample_last", """SELECT date_trunc('day', make_timestamp(t_us))::VARCHAR AS bucket, source_id, arg_max(x, t) AS x, arg_max(alt, t) FILTER (WHERE alt IS NOT NULL) AS alt FROM tel GROUP BY 1, 2""")
def _(spark, d):
    df = telemetry(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    out = dn.downsample_last(df, ts="ts", every="1 day", entity="source_id", tie="row_pos", fields=["x", "alt"])
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("h1_haversine", f"SELECT row_pos, round({HAV.format(r=6371000.0, a='lat', b='lon', c='0.0', d='track_deg - 180')}, 3) AS m FROM tel")
def _(spark, d):
    m = geo.haversine(F.col("lat"), F.col("lon"), F.lit(0.0), F.col("track_deg") - 180)
    return telemetry(spark, d).select("row_pos", r6(m, 3).alias("m"))


@query("h2_bearing", "SELECT row_pos, round((degrees(atan2(sin(radians(track_deg - lon)) * cos(radians(10.0)), cos(radians(lat)) * sin(radians(10.0)) - sin(radians(lat)) * cos(radians(10.0)) * cos(radians(track_deg - lon)))) + 360) % 360, 6) AS deg FROM tel")
def _(spark, d):
    b = geo.bearing(F.col("lat"), F.col("lon"), F.lit(10.0), F.col("track_deg"))
    return telemetry(spark, d).select("row_pos", r6(b).alias("deg"))


@query("h3_circular_diff", "SELECT row_pos, round((((track_deg - lon + 180) % 360) + 360) % 360 - 180, 6) AS diff FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(geo.circular_diff(F.col("track_deg"), F.col("lon"))).alias("diff"))


HEX = """h AS (SELECT *, (radians(lon) * (sqrt(3) / 3) - sin(radians(lat)) / 3) / (65.0 / 6371.0088) AS q, (sin(radians(lat)) * (2.0 / 3)) / (65.0 / 6371.0088) AS r FROM tel),
k AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h),
m AS (SELECT *, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - (-q - r)) THEN -rr - rs ELSE rq END AS fq,
 CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - (-q - r)) THEN rr WHEN abs(rr - r) > abs(rs - (-q - r)) THEN -rq - rs ELSE rr END AS fr FROM k)"""


@query("h14_hex_cell", f"WITH {HEX} SELECT row_pos, '3_' || CAST(fq AS BIGINT) || '_' || CAST(fr AS BIGINT) AS cell FROM m")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", geo.hex_cell(F.col("lat"), F.col("lon"), 3).alias("cell"))


@query("h16_hex_center", f"""WITH {HEX} SELECT row_pos, round(degrees(asin(greatest(-1, least(1, fr * 1.5 * (65.0 / 6371.0088))))), 6) AS clat, round(degrees((fq + fr / 2) * sqrt(3) * (65.0 / 6371.0088)), 6) AS clon FROM m""")
def _(spark, d):
    la, lo = geo.hex_center(geo.hex_cell(F.col("lat"), F.col("lon"), 3), 3)
    return telemetry(spark, d).select("row_pos", r6(la).alias("clat"), r6(lo).alias("clon"))


@query("h15_hex_polygon")
def _(spark, d):
    cells = telemetry(spark, d).select(geo.hex_cell(F.col("lat"), F.col("lon"), 3).alias("cell")).distinct()
    return cells.select("cell", F.to_json(geo.hex_polygon(F.col("cell"), 3)).alias("ring"))


@query("h17_great_circle")
def _(spark, d):
    pts = geo.great_circle_points(F.col("lat"), F.col("lon"), F.lit(40.0), F.col("track_deg") - 180, 8)
    return telemetry(spark, d).select("row_pos", F.to_json(F.transform(pts, lambda p: F.array(F.round(p[0], 5), F.round(p[1], 5)))).alias("path"))


def centred(size: float, where: str) -> str:
    """SQL of the cells of a square grid with centre and count."""
    return f"""g AS (SELECT CAST(floor(lat / {size}) AS BIGINT) AS i, CAST(floor(lon / {size}) AS BIGINT) AS j, count(*) AS n FROM tel GROUP BY 1, 2),
 p AS (SELECT i || '_' || j AS cell, (i + 0.5::DOUBLE) * {size} AS lat, (j + 0.5::DOUBLE) * {size} AS lon, n FROM g {where})"""


FAR = HAV.format(r=6371.0088, a="a.lat", b="a.lon", c="b.lat", d="b.lon")
KNN = f"""{centred(5.0, "")}, r AS (SELECT a.cell, b.n, row_number() OVER (PARTITION BY a.cell ORDER BY round({FAR}, 6), b.cell) AS k FROM p a CROSS JOIN p b)"""


def scan_sql(points: str, eps: float, least: int, tag: str) -> str:
    """Clusters of ``points`` (cell, lat, lon) by density, named by their smallest core: (cell, cluster)."""
    return f"""pr{tag} AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM {points} a JOIN {points} b ON {FAR} <= {eps}), co{tag} AS (SELECT a FROM pr{tag} GROUP BY a HAVING count(*) >= {least}),
 e{tag} AS MATERIALIZED (SELECT a, b FROM pr{tag} WHERE a IN (SELECT a FROM co{tag}) AND b IN (SELECT a FROM co{tag})),
 l{tag}(id, label) AS (SELECT a, a FROM co{tag} UNION SELECT e{tag}.b, l{tag}.label FROM l{tag} JOIN e{tag} ON e{tag}.a = l{tag}.id),
 own{tag} AS (SELECT id, min(label) AS label FROM l{tag} GROUP BY id), bd{tag} AS (SELECT a, min(label) AS label FROM pr{tag} JOIN own{tag} ON id = b GROUP BY a),
 cl{tag} AS (SELECT cell, coalesce(own{tag}.label, bd{tag}.label) AS cluster FROM {points} LEFT JOIN own{tag} ON id = cell LEFT JOIN bd{tag} ON a = cell)"""


DENSE = centred(2.0, "WHERE n >= 2")


@query("c7_knn_threshold", f"""WITH {KNN}, q AS (SELECT cell, greatest(quantile_cont(n::DOUBLE, 0.95), 5.0) AS threshold FROM r WHERE k <= 50 GROUP BY cell)
SELECT cell, lat, lon, n::DOUBLE AS flight_count, round(threshold, 6) AS threshold, n >= threshold AS keep FROM p JOIN q USING (cell)""")
def _(spark, d):
    from trackweave.operators.cluster import knn_threshold

    cells = dn.point_density(telemetry(spark, d), cell(5.0))
    la, lo = geo.square_cell_center(F.col("cell"), 5.0)
    cells = cells.select("cell", la.alias("lat"), lo.alias("lon"), F.col("point_count").cast("double").alias("flight_count"))
    return rounded(knn_threshold(cells, key="cell", value="flight_count", k=50, prob=0.95, floor=5.0, start_km=800.0), "threshold")


def dense_cells(spark, d):
    cells = dn.point_density(telemetry(spark, d), cell(2.0))
    la, lo = geo.square_cell_center(F.col("cell"), 2.0)
    return cells.select("cell", la.alias("lat"), lo.alias("lon"), "point_count").filter(F.col("point_count") >= 2)


@query("k1_dbscan", f"WITH RECURSIVE {DENSE}, {scan_sql('p', 450.0, 6, '')} SELECT cell, lat, lon, n AS point_count, cluster FROM p JOIN cl USING (cell)")
def _(spark, d):
    from trackweave.operators.cluster import dbscan

    return dbscan(dense_cells(spark, d), key="cell", eps_km=450.0, min_samples=6)


@query("k2_dbscan_two_pass", f"""WITH RECURSIVE {DENSE}, {scan_sql('p', 450.0, 9, '1')}, rest AS MATERIALIZED (SELECT p.* FROM p JOIN cl1 USING (cell) WHERE cluster IS NULL), {scan_sql('rest', 450.0, 5, '2')}
SELECT cell, lat, lon, n AS point_count, coalesce(cl1.cluster, cl2.cluster) AS cluster, CASE WHEN cl1.cluster IS NOT NULL THEN 1 WHEN cl2.cluster IS NOT NULL THEN 2 END AS pass_no
FROM p JOIN cl1 USING (cell) LEFT JOIN cl2 USING (cell)""")
def _(spark, d):
    from trackweave.operators.cluster import dbscan_two_pass

    return dbscan_two_pass(dense_cells(spark, d), key="cell", eps_km=450.0, strict=9, relaxed=5)


NEAR2 = f"""{centred(2.0, "")}, r AS MATERIALIZED (SELECT a.cell, b.n FROM p a CROSS JOIN p b QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY round({FAR}, 6), b.cell) <= 60),
 hot AS MATERIALIZED (SELECT p.* FROM p JOIN (SELECT cell, greatest(quantile_cont(n::DOUBLE, 0.5), 2.0) AS th FROM r GROUP BY cell) USING (cell) WHERE n >= th)"""


@query("k3_traffic_clusters", f"""WITH RECURSIVE {NEAR2}, {scan_sql('hot', 450.0, 6, '1')}, rest AS MATERIALIZED (SELECT hot.* FROM hot JOIN cl1 USING (cell) WHERE cluster IS NULL), {scan_sql('rest', 450.0, 4, '2')},
c AS MATERIALIZED (SELECT lat, lon, n::DOUBLE AS w, coalesce(cl1.cluster, cl2.cluster) AS cluster FROM hot JOIN cl1 USING (cell) LEFT JOIN cl2 USING (cell) WHERE coalesce(cl1.cluster, cl2.cluster) IS NOT NULL),
m AS (SELECT cluster, count(*) AS n_cells, sum(w) AS total_flight_count, sum(lat * w) / sum(w) AS clat, sum(lon * w) / sum(w) AS clon FROM c GROUP BY cluster)
SELECT cluster, any_value(n_cells) AS n_cells, any_value(total_flight_count) AS total_flight_count, round(any_value(clat), 6) + 0.0 AS center_lat, round(any_value(clon), 6) + 0.0 AS center_lon,
 round(max({HAV.format(r=6371.0088, a='clat', b='clon', c='lat', d='lon')}), 3) AS radius_km FROM c JOIN m USING (cluster) GROUP BY cluster""")
def _(spark, d):
    from trackweave.operators.cluster import dbscan_two_pass, knn_threshold, summarize_clusters

    cells = dn.point_density(telemetry(spark, d), cell(2.0))
    la, lo = geo.square_cell_center(F.col("cell"), 2.0)
    cells = cells.select("cell", la.alias("lat"), lo.alias("lon"), F.col("point_count").cast("double").alias("flight_count"))
    hot = knn_threshold(cells, key="cell", value="flight_count", k=60, prob=0.5, floor=2.0, start_km=800.0).filter("keep")
    out = summarize_clusters(dbscan_two_pass(hot, key="cell", eps_km=450.0, strict=6, relaxed=4), weight="flight_count")
    return rounded(rounded(out, "center_lat", "center_lon"), "radius_km", n=3)


@query("d14_cluster_summary", f"""WITH c AS (SELECT {BIG} AS cluster, lat, lon, x AS w FROM tel),
m AS (SELECT cluster, count(*) AS n_cells, sum(w) AS total_flight_count, sum(lat * w) / sum(w) AS clat, sum(lon * w) / sum(w) AS clon FROM c GROUP BY cluster)
SELECT cluster, any_value(n_cells) AS n_cells, round(any_value(total_flight_count), 3) AS total_flight_count, round(any_value(clat), 6) AS center_lat, round(any_value(clon), 6) AS center_lon,
 round(max({HAV.format(r=6371.0088, a='clat', b='clon', c='lat', d='lon')}), 3) AS radius_km FROM c JOIN m USING (cluster) GROUP BY cluster""")
def _(spark, d):
    from trackweave.operators.cluster import summarize_clusters

    out = summarize_clusters(telemetry(spark, d).withColumn("cluster", cell(20.0)), weight="x")
    return rounded(rounded(out, "center_lat", "center_lon"), "total_flight_count", "radius_km", n=3)
