"""Segments, episodes and exposure."""

from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators import episodes as ep
from trackweave.operators import segments as sg
from trackweave.plans.track import Track, sweep, Lag, row_frame, time_frame
from trackweave.suites.base import POSITION, TRACK, query, r6, rounded, telemetry

GAP = 21600.0
SEG = """
lg AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel),
seg AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 21600 THEN 1 ELSE 0 END)
          OVER (PARTITION BY source_id ORDER BY t, row_pos) - 1 AS seq FROM lg),
fl AS (SELECT *, source_id || '_' || lpad(CAST(seq AS VARCHAR), 3, '0') AS flight_id FROM seg)
"""


def flights(spark, d):
    return sg.gap_segments(telemetry(spark, d), TRACK, gap_s=GAP, number="seq")


@query("e1_gap_segment", f"WITH {SEG} SELECT row_pos, flight_id FROM fl")
def _(spark, d):
    return flights(spark, d).select("row_pos", "flight_id")


@query("e1_day_prefixed", f"""WITH {SEG}
SELECT row_pos, strftime(make_timestamp(t_us), '%Y%m%d') || '_' || flight_id AS flight_id FROM fl""")
def _(spark, d):
    day = F.date_format(F.timestamp_micros("t_us"), "yyyyMMdd")
    return sg.gap_segments(telemetry(spark, d), TRACK, gap_s=GAP, prefix=day).select("row_pos", "flight_id")


@query("e2_legs_one_based", """WITH lg AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel)
SELECT row_pos, CAST(sum(CASE WHEN dt IS NULL OR dt > 43200 THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id ORDER BY t, row_pos) AS BIGINT) AS leg FROM lg""")
def _(spark, d):
    return sg.gap_segments(telemetry(spark, d), TRACK, gap_s=43200.0, number="leg", first=1).select("row_pos", "leg")


@query("e3_last_flight", f"""WITH {SEG}, m AS (SELECT *, max(seq) OVER (PARTITION BY source_id) AS top FROM fl)
SELECT source_id, row_pos, t_us FROM m WHERE seq = top""")
def _(spark, d):
    return sg.last_segment(telemetry(spark, d), TRACK, gap_s=GAP).select("source_id", "row_pos", "t_us")


@query("e4_group_diff", """SELECT row_pos, round(x - lag(x) OVER w, 6) AS dx, round((x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0), 6) AS rate
FROM tel WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos)""")
def _(spark, d):
    out = sg.diff_columns(telemetry(spark, d), TRACK, {"dx": "x", "dt": "t"})
    return out.select("row_pos", r6("dx").alias("dx"), r6(F.col("dx") / F.nullif(F.col("dt"), F.lit(0.0))).alias("rate"))


@query("e5_trailing_median", """SELECT row_pos, round(quantile_cont(vertical_rate_ms, 0.5) OVER
 (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS med FROM tel""")
def _(spark, d):
    out = sg_median(telemetry(spark, d), 5)
    return out.select("row_pos", r6("med").alias("med"))


def sg_median(df, n):
    from trackweave.operators.windows import trailing_median

    return trailing_median(df, TRACK, value="vertical_rate_ms", rows=n, out="med")


@query("e6_message_interval", """WITH v AS (SELECT *, CASE WHEN row_pos % 9 <> 0 THEN t END AS tt FROM tel),
p AS (SELECT *, last_value(tt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM v)
SELECT row_pos, CASE WHEN tt IS NULL THEN 'TIMESTAMP_MISSING' WHEN pt IS NULL THEN 'FIRST_OBSERVATION'
 WHEN tt - pt < 0 THEN 'NON_MONOTONIC_TIMESTAMP' WHEN tt - pt > 21600 THEN 'MESSAGE_GAP' ELSE 'CONTIGUOUS' END AS status,
 round(CASE WHEN tt - pt > 21600 THEN tt - pt END, 6) AS gap_s FROM p""")
def _(spark, d):
    df = telemetry(spark, d).withColumn("tt", F.when(F.col("row_pos") % 9 != 0, F.col("t")))
    out = sg.message_intervals(df, POSITION, time="tt", threshold_s=GAP)
    return out.select("row_pos", F.col("message_interval_status").alias("status"), r6("message_gap_s").alias("gap_s"))


@query("e9_alarm_episodes", """WITH a AS (SELECT source_id, t, row_pos, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel WHERE alarm),
i AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS k FROM a)
SELECT source_id, min(t) AS episode_start, max(t) AS episode_end, count(*) AS n_emissions FROM i GROUP BY source_id, k""")
def _(spark, d):
    return ep.alarm_episodes(telemetry(spark, d), TRACK, alarm=F.col("alarm"), merge_gap_s=86400.0)


UNION_SQL = """iv AS (SELECT source_id, t AS t_start, t + 3600.0 * (1 + row_pos % 12) AS t_end FROM tel),
m AS (SELECT *, max(t_end) OVER (PARTITION BY source_id ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t_start, t_end) AS g FROM m),
u AS (SELECT source_id, min(t_start) AS t_start, max(t_end) AS t_end FROM k GROUP BY source_id, g)"""


def intervals(spark, d):
    hours = F.lit(3600.0) * (1 + F.col("row_pos") % 12)
    return telemetry(spark, d).withColumns({"t_start": F.col("t"), "t_end": F.col("t") + hours})


@query("e10_interval_union", f"WITH {UNION_SQL} SELECT * FROM u")
def _(spark, d):
    return ep.interval_union(intervals(spark, d), TRACK)


@query("e10_exposure_seconds", f"WITH {UNION_SQL} SELECT source_id, round(sum(t_end - t_start), 3) AS seconds FROM u GROUP BY source_id")
def _(spark, d):
    return rounded(ep.exposure_of_intervals(intervals(spark, d), TRACK), "seconds", n=3)


@query("d27_alert_burden", f"""WITH {UNION_SQL},
a AS (SELECT source_id, t, row_pos, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel WHERE alarm),
e AS (SELECT source_id, count(*) FILTER (WHERE dt IS NULL OR dt > 86400) AS n FROM a GROUP BY source_id),
h AS (SELECT sum(t_end - t_start) / 3600 AS hours FROM u)
SELECT CAST((SELECT sum(n) FROM e) AS BIGINT) AS n_alert_episodes, (SELECT count(DISTINCT source_id) FROM tel) AS n_scoreable_flights,
 (SELECT count(*) FROM e) AS n_alerted_flights, round(hours, 4) AS scoreable_flight_hours,
 round((SELECT count(*) FROM e) * 1.0 / (SELECT count(DISTINCT source_id) FROM tel), 6) AS alerted_flight_fraction,
 round((SELECT sum(n) FROM e) / hours, 6) AS episodes_per_hour FROM h""")
def _(spark, d):
    out = ep.alert_burden(intervals(spark, d), TRACK, alarm=F.col("alarm"), merge_gap_s=86400.0)
    return rounded(rounded(out, "alerted_flight_fraction", "episodes_per_hour"), "scoreable_flight_hours", n=4)


@query("e15_k_of_n", """SELECT row_pos, count(*) FILTER (WHERE x > 40) OVER
 (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS state FROM tel""")
def _(spark, d):
    from trackweave.operators.decide import k_of_n

    return k_of_n(telemetry(spark, d), TRACK, hit=F.col("x") > 40, k=3, n=5).select("row_pos", "state")


@query("e16_alarm_onsets", """WITH p AS (SELECT *, lag(alarm) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS pa FROM tel)
SELECT source_id, row_pos FROM p WHERE alarm AND NOT coalesce(pa, false)""")
def _(spark, d):
    from trackweave.operators.decide import onsets

    return onsets(telemetry(spark, d), TRACK, state=F.col("alarm")).filter("onset").select("source_id", "row_pos")


@query("e30_stale_segments", """WITH v AS (SELECT *, floor(x / 40) AS q FROM tel),
p AS (SELECT *, lag(q) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS pq FROM v),
g AS (SELECT *, sum(CASE WHEN pq = q THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS k FROM p)
SELECT source_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows FROM g GROUP BY source_id, k HAVING max(t) - min(t) >= 7200""")
def _(spark, d):
    df = telemetry(spark, d).withColumn("q", F.floor(F.col("x") / 40))
    return sg.equal_runs(df, TRACK, value="q", min_duration_s=7200.0)


@query("e31_drop_non_monotonic", """WITH v AS (SELECT *, floor(t / 20000) + row_pos % 2 AS tt FROM tel),
p AS (SELECT *, lag(tt) OVER (PARTITION BY source_id ORDER BY row_pos) AS pt FROM v)
SELECT source_id, row_pos FROM p WHERE pt IS NULL OR tt > pt""")
def _(spark, d):
    df = telemetry(spark, d).withColumn("tt", F.floor(F.col("t") / 20000) + F.col("row_pos") % 2)
    return sg.drop_non_monotonic(df, POSITION, time="tt").select("source_id", "row_pos")


QUAT = """q AS (SELECT *, CAST(row_pos % 5 - 2 AS DOUBLE) AS a, CAST(row_pos % 3 - 1 AS DOUBLE) AS b, CAST(row_pos % 7 - 3 AS DOUBLE) / 2 AS c, CASE WHEN row_pos % 11 <> 0 THEN 1.0::DOUBLE END AS e FROM tel),
f AS (SELECT * FROM q WHERE e IS NOT NULL),
dd AS (SELECT *, a * lag(a) OVER w + b * lag(b) OVER w + c * lag(c) OVER w + e * lag(e) OVER w AS dot FROM f WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos)),
n AS (SELECT *, sum(CASE WHEN dot = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS z FROM dd),
s AS (SELECT *, sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, z ORDER BY t, row_pos) % 2 AS odd FROM n)"""


@query("e32_quaternion_sign", f"""WITH {QUAT} SELECT row_pos, CASE WHEN odd = 1 THEN -a ELSE a END + 0.0 AS a, CASE WHEN odd = 1 THEN -e ELSE e END + 0.0 AS e FROM s
UNION ALL SELECT row_pos, a, e FROM q WHERE e IS NULL""")
def _(spark, d):
    i = F.col("row_pos")
    df = telemetry(spark, d).withColumns({
        "a": (i % 5 - 2) * 1.0, "b": (i % 3 - 1) * 1.0, "c": (i % 7 - 3) * 0.5, "e": F.when(i % 11 != 0, 1.0),
    })
    out = sg.sign_continuity(df, TRACK, ["a", "b", "c", "e"])
    return out.select("row_pos", (F.col("a") + 0.0).alias("a"), (F.col("e") + 0.0).alias("e"))


@query("e33_cadence_bucket", """WITH p AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel)
SELECT row_pos, CASE WHEN dt > 43200 THEN 'gap' WHEN dt IS NULL OR dt <= 0 THEN 'initial_or_invalid' WHEN dt <= 3600 THEN 'cadence_0'
 WHEN dt <= 14400 THEN 'cadence_1' ELSE 'cadence_2' END AS cadence FROM p""")
def _(spark, d):
    out = sg.diff_columns(telemetry(spark, d), TRACK, {"dt": "t"})
    return out.select("row_pos", sc.cadence_bucket(F.col("dt"), (3600.0, 14400.0), 43200.0).alias("cadence"))


@query("e36_path_pieces", """WITH p AS (SELECT *, lead(row_pos) OVER w AS nr, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon, lead(alt) OVER w AS na FROM tel
 WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos))
SELECT row_pos, to_lat, to_lon, coalesce((alt + na) / 2, alt, na) AS piece_alt FROM p WHERE nr IS NOT NULL""")
def _(spark, d):
    return sg.path_pieces(telemetry(spark, d), TRACK).select("row_pos", "to_lat", "to_lon", "piece_alt")


@query("e37_exposure_bounds", """SELECT row_pos, coalesce(lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos), t) AS t_start, t AS t_end FROM tel""")
def _(spark, d):
    return sg.exposure_bounds(telemetry(spark, d), TRACK).select("row_pos", "t_start", "t_end")


@query("e39_even_rows", """WITH n AS (SELECT source_id, row_pos, row_number() OVER (PARTITION BY source_id ORDER BY t, row_pos) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM tel),
j AS (SELECT unnest(range(0, 10)) AS j)
SELECT DISTINCT source_id, row_pos FROM n, j WHERE n <= 10 OR i = (j * (n - 1)) // 9""")
def _(spark, d):
    return sg.even_rows(telemetry(spark, d), TRACK, max_points=10).select("source_id", "row_pos")


@query("e40_transition_validity", f"""WITH {SEG}, p AS (SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t, row_pos) AS d2,
 x - lag(x) OVER (PARTITION BY flight_id ORDER BY t, row_pos) AS dx FROM fl)
SELECT row_pos, round(CASE WHEN d2 > 0 AND d2 <= 7200 THEN dx END, 6) AS dx FROM p""")
def _(spark, d):
    fl = flights(spark, d)
    out = sg.diff_columns(fl, TRACK.by("source_id", "flight_id"), {"dx": "x", "dt": "t"})
    ok = (F.col("dt") > 0) & (F.col("dt") <= 7200)
    return out.select("row_pos", r6(F.when(ok, F.col("dx"))).alias("dx"))


@query("d15_flight_summary", f"""WITH {SEG} SELECT flight_id, count(*) AS n_rows, round(max(t) - min(t), 6) AS duration_s, min(t) AS start_time FROM fl GROUP BY flight_id""")
def _(spark, d):
    return rounded(sg.segment_summary(flights(spark, d), TRACK), "duration_s")


@query("d11_flight_legs", f"""WITH {SEG}
SELECT source_id, flight_id, count(*) AS n_points, arg_min(lat, t) AS start_lat, arg_min(lon, t) AS start_lon, min(t) AS start_t,
 arg_max(lat, t) AS end_lat, arg_max(lon, t) AS end_lon, max(t) AS end_t FROM fl GROUP BY source_id, flight_id HAVING count(*) >= 3""")
def _(spark, d):
    return sg.legs(flights(spark, d), TRACK, segment="flight_id")


@query("d20_session_summary", f"""WITH {SEG} SELECT source_id, CAST(seq + 1 AS BIGINT) AS segment_no, min(t) AS start_t, max(t) AS end_t,
 count(*) AS points, round(max(t) - min(t), 6) AS duration_s FROM fl GROUP BY source_id, seq HAVING count(*) >= 3""")
def _(spark, d):
    return rounded(sg.sessions(telemetry(spark, d), TRACK, gap_s=GAP), "duration_s")


@query("d41_boundary_agreement", f"""WITH {SEG}, p AS (SELECT *, lag(flight_id) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS pf FROM fl)
SELECT count(*) AS n_boundaries, round(avg(CASE WHEN flags_new_leg THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM p WHERE pf <> flight_id""")
def _(spark, d):
    out = sg.boundary_agreement(flights(spark, d), TRACK, segment="flight_id", flag="flags_new_leg")
    return rounded(out, "agreement")


@query("d49_row_exposure", """WITH p AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel)
SELECT source_id, round(sum(CASE WHEN dt > 0 AND dt <= 21600 AND NOT on_ground THEN dt ELSE 0 END), 4) AS exposure_s FROM p GROUP BY source_id""")
def _(spark, d):
    out = ep.row_exposure(telemetry(spark, d), TRACK, evaluable=~F.col("on_ground"), max_gap_s=GAP)
    return rounded(out, "exposure_s", n=4)


@query("d50_block_exposure", """WITH s AS (SELECT source_id, min(t) AS t0 FROM tel GROUP BY source_id)
SELECT source_id, CAST(floor((t - t0) / 86400) AS BIGINT) AS block, round(max(t) - min(t), 6) AS exposure_s, count(*) AS n_rows
FROM tel JOIN s USING (source_id) GROUP BY source_id, block HAVING count(*) >= 2""")
def _(spark, d):
    return rounded(ep.block_exposure(telemetry(spark, d), TRACK, block_s=86400.0), "exposure_s")


@query("e28_phase_boundary", """WITH p AS (SELECT *, CASE WHEN on_ground THEN 'ground' WHEN abs(roll_deg) > 25 THEN 'maneuver' WHEN vertical_rate_ms > 3 THEN 'takeoff'
 WHEN vertical_rate_ms < -3 THEN 'landing' ELSE 'cruise' END AS phase FROM tel),
c AS (SELECT *, lag(phase) OVER (PARTITION BY source_id ORDER BY t, row_pos) <> phase AS chg FROM p),
n AS (SELECT *, max(CASE WHEN chg THEN t END) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS b,
  min(CASE WHEN chg THEN t END) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM c)
SELECT row_pos, phase, coalesce(t - b <= 3600, false) OR coalesce(f - t <= 3600, false) AS boundary FROM n""")
def _(spark, d):
    out = sg.label_phases(
        telemetry(spark, d), TRACK, on_ground=F.col("on_ground"), maneuver=F.abs("roll_deg") > 25,
        takeoff=F.col("vertical_rate_ms") > 3, landing=F.col("vertical_rate_ms") < -3, buffer_s=3600.0,
    )
    return out.select("row_pos", "phase", "boundary")
