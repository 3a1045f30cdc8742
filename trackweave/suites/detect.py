"""Residuals, windows and sequential detectors."""

from dataclasses import replace

from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators import decide as dc
from trackweave.operators import residuals as rs
from trackweave.operators import windows as wn
from trackweave.plans.track import Track
from trackweave.operators.contracts import AlertBudget, DetectorProfile
from trackweave.suites.base import TRACK, query, r6, rounded, telemetry

MICROS = Track(("source_id",), ("t_us", "row_pos"), 3 * 86400e6)
HOUR = 3_600_000_000
W = "WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos)"
PREV = f"""pv AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(alt) OVER w AS palt, lag(track_deg) OVER w AS ptrack,
 lag(alt_geom_m - alt) OVER w AS pgap, t - lag(t) OVER w AS dt, lag(t) OVER w AS pt, lag(on_ground) OVER w AS pg, lag(row_pos) OVER w AS pr FROM tel {W}),
geo AS (SELECT *, nullif(dt, 0) AS st,
 2 * 6371000.0 * asin(sqrt(greatest(least(power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2), 1.0), 0.0))) AS dist,
 (degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360) % 360 AS brg FROM pv)"""
MOD = "((({0}) % 360) + 360) % 360"

RES = {
    "vertical_rate_residual": "vertical_rate_ms - (alt - palt) / st",
    "speed_residual": "CASE WHEN pr IS NOT NULL THEN ground_speed_ms - dist / st END",
    "east_velocity_residual": "CASE WHEN pr IS NOT NULL THEN ground_speed_ms * sin(radians(track_deg)) - dist / CASE WHEN dt > 0 THEN dt END * sin(radians(brg)) END",
    "north_velocity_residual": "CASE WHEN pr IS NOT NULL THEN ground_speed_ms * cos(radians(track_deg)) - dist / CASE WHEN dt > 0 THEN dt END * cos(radians(brg)) END",
    "turn_bank_residual": "((((track_deg - ptrack + 180) % 360) + 360) % 360 - 180) / st - degrees(9.80665 * tan(radians(roll_deg)) / nullif(ground_speed_ms, 0))",
    "altitude_source_residual": "((alt_geom_m - alt) - pgap) / st",
}
NAMES = {"time": "t"}


def _residual(name, sql, n=6):
    @query(name, f"WITH {PREV} SELECT row_pos, " + ", ".join(f"round({RES[c]}, {n}) + 0.0 AS {c}" for c in sql) + " FROM geo")
    def _(spark, d):
        out = rs.residuals(telemetry(spark, d), TRACK, columns=NAMES, which=sql)
        return rounded(out.select("row_pos", *sql), *sql, n=n)


_residual("h4_vertical_rate_residual", ["vertical_rate_residual"])
_residual("h5_speed_residual", ["speed_residual"], 4)
_residual("h6_velocity_component_residuals", ["east_velocity_residual", "north_velocity_residual"], 4)
_residual("h8_turn_bank_residual", ["turn_bank_residual"])
_residual("h9_altitude_source_residual", ["altitude_source_residual"])
_residual("h10_feature_table", list(RES), 4)


@query("h7_heading_residual", f"""WITH {PREV} SELECT row_pos, CASE WHEN pr IS NOT NULL THEN CAST(floor(abs(round((((track_deg - brg + 180) % 360) + 360) % 360 - 180, 6))) AS BIGINT) END AS whole FROM geo""")
def _(spark, d):
    out = rs.residuals(telemetry(spark, d), TRACK, columns=NAMES, which=["heading_residual"])
    return out.select("row_pos", F.floor(F.abs(r6("heading_residual"))).alias("whole"))


CTX = f"""{PREV}, h AS (SELECT *, quantile_cont(vertical_rate_ms, 0.5) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hist FROM pv),
c AS (SELECT *, CASE WHEN on_ground THEN 'ground' WHEN hist > 1 THEN 'climb' WHEN hist < -1 THEN 'descent' WHEN hist IS NOT NULL THEN 'level' ELSE 'unknown' END AS phase,
 CASE WHEN dt > 43200 THEN 'gap' WHEN dt IS NULL OR dt <= 0 THEN 'initial_or_invalid' WHEN dt <= 3600 THEN 'cadence_0' WHEN dt <= 14400 THEN 'cadence_1' ELSE 'cadence_2' END AS cadence FROM h)"""


def context(spark, d):
    return rs.causal_context(telemetry(spark, d), TRACK, time="t", edges=(3600.0, 14400.0), max_gap_s=43200.0)


@query("e34_causal_context", f"""WITH {CTX} SELECT row_pos, round(dt, 6) AS context_dt_s, round(ln(1 + dt), 6) AS context_log1p_dt_s, phase AS context_phase, cadence AS context_cadence,
 round(sin(radians(track_deg)), 6) + 0.0 AS track_sin, round(cos(radians(track_deg)), 6) + 0.0 AS track_cos, phase <> 'unknown' AND cadence LIKE 'cadence_%' AS context_evaluable FROM c""")
def _(spark, d):
    cols = ["context_dt_s", "context_log1p_dt_s", "track_sin", "track_cos"]
    return rounded(context(spark, d).select("row_pos", *cols, "context_phase", "context_cadence", "context_evaluable"), *cols)


@query("h35_context_vector", f"""WITH {CTX} SELECT row_pos, array_to_string([CAST(CAST(round(1000 * v) AS BIGINT) AS VARCHAR) FOR v IN
 [coalesce(alt, 0), CASE WHEN alt IS NULL THEN 0.0 ELSE 1.0 END, x, 1.0, coalesce(ln(1 + dt), 0), sin(radians(track_deg)), cos(radians(track_deg)),
 CAST(phase = 'climb' AS DOUBLE), CAST(phase = 'descent' AS DOUBLE), CAST(phase = 'ground' AS DOUBLE), CAST(phase = 'level' AS DOUBLE), CAST(phase = 'unknown' AS DOUBLE),
 CAST(cadence = 'cadence_0' AS DOUBLE), CAST(cadence = 'cadence_1' AS DOUBLE), CAST(cadence = 'cadence_2' AS DOUBLE), CAST(cadence = 'gap' AS DOUBLE), CAST(cadence = 'initial_or_invalid' AS DOUBLE)]], ',') AS vec FROM c""")
def _(spark, d):
    vec = rs.context_vector(["alt", "x"])
    text = F.transform(vec, lambda v: F.round(v * 1000).cast("long").cast("string"))
    return context(spark, d).select("row_pos", F.array_join(text, ",").alias("vec"))


# ---------------------------------------------------------------- windows
NUM = f"""n AS (SELECT *, row_number() OVER w AS rn, t - lag(t) OVER w AS dt FROM tel {W})"""


@query("e20_sliding_windows", f"""WITH {NUM}, f AS (SELECT *, count(*) OVER v AS k, last_value(t) OVER v AS t_end, sum(coalesce(alt, 0)) OVER v AS s_alt, count(alt) OVER v AS n_alt,
 max(dt) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS gap
 FROM n WINDOW v AS (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT source_id, t AS t_start, t_end, round(s_alt, 3) AS s_alt, CAST(n_alt AS BIGINT) AS n_alt FROM f WHERE k = 6 AND (rn - 1) % 3 = 0 AND gap <= 86400""")
def _(spark, d):
    out = wn.sliding_windows(telemetry(spark, d), TRACK, features=["alt", "x"], window=6, stride=3, max_gap_s=86400.0)
    total = lambda c, i: F.aggregate(c, F.lit(0.0), lambda a, r: a + r[i])
    return out.select("source_id", "t_start", "t_end", r6(total("x", 0), 3).alias("s_alt"), total("mask", 0).cast("long").alias("n_alt"))


@query("e21_history_windows", f"""WITH {NUM}, f AS (SELECT *, sum(x) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hx,
 min(dt) OVER v AS lo, max(dt) OVER v AS hi FROM n WINDOW v AS (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT row_pos, round(hx, 4) AS hx, alt AS target, CAST(alt IS NOT NULL AS INTEGER) AS target_mask FROM f WHERE rn > 4 AND lo > 0 AND hi <= 86400""")
def _(spark, d):
    out = wn.history_windows(telemetry(spark, d), TRACK, inputs=["x"], targets=["alt"], history=4, max_gap_s=86400.0)
    hx = F.aggregate("history", F.lit(0.0), lambda a, r: a + r[0])
    return out.select("row_pos", r6(hx, 4).alias("hx"), F.col("target")[0].alias("target"), F.col("target_mask")[0].alias("target_mask"))


@query("e22_run_window_scores", f"""WITH {NUM}, g AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt <= 0 OR dt > 43200 THEN 1 ELSE 0 END) OVER w AS run FROM n {W}),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY t, row_pos) AS i FROM g),
f AS (SELECT *, avg(x) OVER v AS score, sum(CASE WHEN alt IS NULL THEN 0 ELSE 1 END) OVER v AS c, first_value(t) OVER v AS t_start
 FROM k WINDOW v AS (PARTITION BY source_id, run ORDER BY t, row_pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT source_id, t_start, t AS t_end, round(score, 5) AS score, round(c / 4.0, 6) AS support FROM f WHERE i >= 4 AND (i - 4) % 2 = 0 AND c > 0""")
def _(spark, d):
    out = wn.run_window_scores(
        telemetry(spark, d), TRACK, penalty="x", observed=F.col("alt").isNotNull().cast("int"), n_channels=1, window=4, stride=2, max_gap_s=43200.0
    )
    return rounded(rounded(out, "support"), "score", n=5)


@query("e23_window_truth", f"""WITH {NUM}, b AS (SELECT *, CASE WHEN x > 60 AND row_pos % 5 <> 0 THEN 1 ELSE 0 END AS c, CASE WHEN row_pos % 5 <> 0 THEN 1 ELSE 0 END AS e FROM n),
f AS (SELECT *, count(*) OVER v AS k, last_value(t) OVER v AS t_end, max(dt) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS gap,
 sum(c) OVER s AS num, sum(e) OVER s AS den, sum(c) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS old
 FROM b WINDOW v AS (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), s AS (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 4 FOLLOWING AND 5 FOLLOWING)),
q AS (SELECT *, CASE WHEN den > 0 THEN num / den END AS q_w FROM f WHERE k = 6 AND (rn - 1) % 2 = 0 AND gap <= 172800)
SELECT source_id, t AS t_start, t_end, round(q_w, 6) AS q_w, q_w IS NOT NULL AS truth_scoreable, q_w > 0 AS y_any, coalesce(q_w IN (0, 1), false) AS steady_subset,
 CASE WHEN q_w IN (0, 1) THEN q_w = 1 END AS steady_label, old > 0 AS history_contaminated FROM q""")
def _(spark, d):
    out = wn.window_truth(
        telemetry(spark, d), TRACK, changed=F.col("x") > 60, evaluable=F.col("row_pos") % 5 != 0, window=6, stride=2,
        max_gap_s=172800.0, support_rows=2,
    )
    return rounded(out, "q_w")


def _tri(lo, hi, first=False):
    cond = f"a.t_us - b.t_us >= {int(lo * HOUR)} AND a.t_us - b.t_us {'<=' if first else '<'} {int(hi * HOUR)}"
    wt = f"(1 + ({hi} - (a.t_us - b.t_us) / {HOUR}.0) / {hi - lo})"
    return f"sum(CASE WHEN {cond} THEN {wt} * b.x END) / sum(CASE WHEN {cond} THEN {wt} END)"


@query("e24_lag_summary", f"""WITH j AS (SELECT a.row_pos, any_value(a.x) AS x, {_tri(0.0, 2.0, True)} AS a0, {_tri(2.0, 6.0)} AS a1, {_tri(6.0, 12.0)} AS a2
 FROM tel a JOIN tel b ON a.source_id = b.source_id AND b.t_us BETWEEN a.t_us - {12 * HOUR} AND a.t_us GROUP BY a.row_pos)
SELECT row_pos, x AS last, round(a0, 5) AS a0, round(a1, 5) AS a1, round(a2, 5) AS a2, round(x - a2, 5) AS delta FROM j""")
def _(spark, d):
    out = wn.lag_summary(telemetry(spark, d), MICROS, value="x", unit=HOUR, ages=((0.0, 2.0), (2.0, 6.0), (6.0, 12.0)))
    return out.select("row_pos", F.col("x__last").alias("last"), *[r6(f"x__tri_{i}", 5).alias(f"a{i}") for i in range(3)], r6("x__delta", 5).alias("delta"))


@query("e25_future_mean", f"""SELECT row_pos, round(avg(x) OVER (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN 1 FOLLOWING AND {12 * HOUR} FOLLOWING), 5) AS fm FROM tel""")
def _(spark, d):
    return wn.future_mean(telemetry(spark, d), MICROS, value="x", horizon=12 * HOUR, out="fm").select("row_pos", r6("fm", 5).alias("fm"))


@query("e26_finite_difference", f"""WITH f AS (SELECT *, first_value(t_us) OVER v AS lt, first_value(x) OVER v AS lx, last_value(t_us) OVER v AS rt, last_value(x) OVER v AS rx,
 lag(t_us, 1, t_us) OVER w AS bt, lag(x, 1, x) OVER w AS bx, lead(t_us, 1, t_us) OVER w AS ft, lead(x, 1, x) OVER w AS fx FROM tel
 WINDOW v AS (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN {3 * HOUR} PRECEDING AND {3 * HOUR} FOLLOWING), w AS (PARTITION BY source_id ORDER BY t_us)),
g AS (SELECT row_pos, CASE WHEN lt = rt THEN bt ELSE lt END AS t0, CASE WHEN lt = rt THEN bx ELSE lx END AS x0, CASE WHEN lt = rt THEN ft ELSE rt END AS t1, CASE WHEN lt = rt THEN fx ELSE rx END AS x1 FROM f)
SELECT row_pos, round(CASE WHEN t1 > t0 THEN (x1 - x0) / ((t1 - t0) / {HOUR}.0) END, 4) AS dx FROM g""")
def _(spark, d):
    out = wn.finite_difference(telemetry(spark, d), MICROS, value="x", width=6 * HOUR, unit=HOUR, out="dx")
    return out.select("row_pos", r6("dx", 4).alias("dx"))


def _nr(cmd, resp, ct, rt, h):
    return f"""CASE WHEN count(*) OVER v >= 2 AND count({cmd}) OVER v = count(*) OVER v AND count({resp}) OVER v = count(*) OVER v
 THEN greatest(0, (max({cmd}) OVER v - min({cmd}) OVER v) / {ct} - (max({resp}) OVER v - min({resp}) OVER v) / {rt}) END"""


@query("e27_no_response_score", f"""SELECT row_pos, round({_nr('roll_deg', 'alt', 10.0, 2000.0, 12)}, 6) AS score FROM tel
 WINDOW v AS (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    out = wn.no_response_score(
        telemetry(spark, d), MICROS, command="roll_deg", response="alt", command_threshold=10.0, response_threshold=2000.0, width=12 * HOUR, out="score"
    )
    return out.select("row_pos", r6("score").alias("score"))


@query("k14_rule_bank", f"""WITH a AS (SELECT *, {_nr('roll_deg', 'alt', 10.0, 2000.0, 12)} AS p1, {_nr('track_deg', 'x', 60.0, 50.0, 12)} AS p2,
 abs(vertical_rate_ms - 9.80665 * tan(radians(roll_deg)) / ground_speed_ms) / 0.5 AS turn,
 CASE WHEN x >= 40 THEN greatest((3.0 - vertical_rate_ms) / 2.0, 0) ELSE 0 END AS thrust FROM tel WINDOW v AS (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW))
SELECT source_id, t, 'command_no_response' AS channel, round(greatest(p1, p2), 6) AS z FROM a UNION ALL SELECT source_id, t, 'coordinated_turn', round(turn, 6) FROM a
UNION ALL SELECT source_id, t, 'thrust_speed', round(thrust, 6) FROM a""")
def _(spark, d):
    from trackweave.operators.rules import rule_bank

    turn = sc.coordinated_turn_rate(F.radians("roll_deg"), F.col("ground_speed_ms"))
    out = rule_bank(
        telemetry(spark, d), MICROS, pairs=[("roll_deg", "alt", 10.0, 2000.0), ("track_deg", "x", 60.0, 50.0)], width=12 * HOUR,
        turn_rate=F.col("vertical_rate_ms"), coordinated=turn, turn_band=0.5, throttle=F.col("x"), throttle_high=40.0,
        acceleration=F.col("vertical_rate_ms"), expected=3.0, accel_band=2.0, time="t",
    )
    return rounded(out, "z")


@query("e29_turn_points", f"""WITH d AS (SELECT *, min(t_us) OVER (PARTITION BY source_id) AS t0, max(t_us) OVER (PARTITION BY source_id) AS t1,
 max(x) OVER (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING) AS past,
 max(x) OVER (PARTITION BY source_id ORDER BY t_us RANGE BETWEEN 1 FOLLOWING AND {24 * HOUR} FOLLOWING) AS nxt FROM tel),
c AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY source_id ORDER BY t_us, row_pos) AS gp FROM d WHERE x <= 30 AND t_us - t0 >= {24 * HOUR} AND t1 - t_us >= {24 * HOUR} AND past - x >= 10 AND nxt - x >= 10),
k AS (SELECT *, sum(CASE WHEN gp IS NULL OR gp > {8 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t_us, row_pos) AS cl FROM c),
m AS (SELECT *, min(x) OVER (PARTITION BY source_id, cl) AS mn FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, cl ORDER BY t_us, row_pos) AS i, count(*) OVER (PARTITION BY source_id, cl) AS n FROM m WHERE x = mn),
ev AS (SELECT source_id, t_us, row_pos FROM r WHERE i = n // 2 + 1)
SELECT tel.row_pos, e.row_pos IS NOT NULL AS turn_event, EXISTS (SELECT 1 FROM ev b WHERE b.source_id = tel.source_id AND abs(b.t_us - tel.t_us) <= {6 * HOUR}) AS turn_boundary
FROM tel LEFT JOIN ev e ON e.source_id = tel.source_id AND e.row_pos = tel.row_pos""")
def _(spark, d):
    out = wn.turn_points(
        telemetry(spark, d), MICROS, distance="x", window=24 * HOUR, max_distance=30.0, min_approach=10.0, min_departure=10.0,
        separation=8 * HOUR, buffer=6 * HOUR,
    )
    return out.select("row_pos", "turn_event", "turn_boundary")


# ---------------------------------------------------------------- detectors
def _page(ch, med, mad, k, val):
    return f"""
 o_{ch} AS (SELECT *, live AND {val} IS NOT NULL AS obs, live AND {val} IS NULL AS mis, greatest(-3, least(3, ({val} - {med}) / {mad})) AS z FROM rz),
 g_{ch} AS (SELECT *, sum(CASE WHEN rst OR obs THEN 1 ELSE 0 END) OVER w AS grp FROM o_{ch} {W}),
 e_{ch} AS (SELECT *, mis AND sum(CASE WHEN mis THEN dt ELSE 0 END) OVER (PARTITION BY source_id, grp ORDER BY t, row_pos) >= 30000 AS mr FROM g_{ch}),
 s_{ch} AS (SELECT *, sum(CASE WHEN rst OR mr THEN 1 ELSE 0 END) OVER w AS sg FROM e_{ch} {W}),
 p_{ch} AS (SELECT *, sum(CASE WHEN obs THEN z - {k} ELSE 0 END) OVER v AS pp, sum(CASE WHEN obs THEN -z - {k} ELSE 0 END) OVER v AS pn FROM s_{ch} WINDOW v AS (PARTITION BY source_id, sg ORDER BY t, row_pos)),
 q_{ch} AS (SELECT row_pos, obs, mr, reason, pp - least(0, min(pp) OVER v) AS sp, pn - least(0, min(pn) OVER v) AS sn FROM p_{ch} WINDOW v AS (PARTITION BY source_id, sg ORDER BY t, row_pos))"""


PAGE = f"""{PREV}, rr AS (SELECT *, CASE WHEN pr IS NULL THEN 'flight_start' WHEN on_ground THEN 'on_ground' WHEN pg THEN 'ground_transition' WHEN dt < 0 THEN 'negative_dt' WHEN dt > 172800 THEN 'long_gap'
 WHEN dt = 0 THEN 'zero_dt' ELSE 'none' END AS reason FROM pv), rz AS (SELECT *, reason = 'none' AS live, reason NOT IN ('none', 'zero_dt') AS rst FROM rr),
 {_page('a', 5000.0, 3000.0, 0.2, 'alt')}, {_page('b', 50.0, 40.0, 0.1, 'x')}"""


@query("e11_vector_page_cusum", f"""WITH {PAGE} SELECT row_pos, a.reason AS cusum_reset_reason, round(a.sp, 6) + 0.0 AS alt_pos, round(a.sn, 6) + 0.0 AS alt_neg, round(b.sp, 6) + 0.0 AS x_pos, a.mr AS alt_missing_reset,
 round(greatest(a.sp, a.sn, b.sp, b.sn), 6) + 0.0 AS joint, (a.obs OR b.obs) AND round(greatest(a.sp, a.sn, b.sp, b.sn), 9) > 2.0 AS alarm FROM q_a a JOIN q_b b USING (row_pos)""")
def _(spark, d):
    out = page(spark, d)
    return out.select(
        "row_pos", "cusum_reset_reason", r6("alt_cusum_positive").alias("alt_pos"), r6("alt_cusum_negative").alias("alt_neg"),
        r6("x_cusum_positive").alias("x_pos"), "alt_missing_reset", r6("cusum_joint_score").alias("joint"), F.col("cusum_joint_alarm").alias("alarm"),
    )


def page(spark, d):
    cal = {"alt": dc.Calibration(5000.0, 3000.0, 0.2), "x": dc.Calibration(50.0, 40.0, 0.1)}
    return dc.page_sums(
        telemetry(spark, d), TRACK, cal, time="t", on_ground="on_ground", threshold=2.0, max_gap_s=172800.0, missing_reset_s=30000.0, z_clip=3.0
    )


SIMPLE = f"""{PREV}, z AS (SELECT *, (x - 45) / 30 AS z, on_ground OR dt IS NULL OR dt <= 0 OR dt > 86400 AS rst FROM pv),
 sg AS (SELECT *, sum(CASE WHEN rst THEN 1 ELSE 0 END) OVER w AS sg FROM z {W}),
 p AS (SELECT *, sum(CASE WHEN rst THEN 0 ELSE z - 0.25 END) OVER v AS pp, sum(CASE WHEN rst THEN 0 ELSE -z - 0.25 END) OVER v AS pn FROM sg WINDOW v AS (PARTITION BY source_id, sg ORDER BY t, row_pos)),
 s AS (SELECT *, greatest(pp - least(0, min(pp) OVER v), pn - least(0, min(pn) OVER v)) AS score FROM p WINDOW v AS (PARTITION BY source_id, sg ORDER BY t, row_pos))"""


def simple(spark, d):
    return dc.simple_page_sums(telemetry(spark, d), TRACK, {"x": (F.col("x") - 45) / 30}, slack=0.25, max_gap_s=86400.0, evaluable=~F.col("on_ground"))


@query("e12_simple_page_cusum", f"WITH {SIMPLE} SELECT row_pos, rst AS reset, round(score, 6) + 0.0 AS cusum_score FROM s")
def _(spark, d):
    return rounded(simple(spark, d).select("row_pos", "reset", "cusum_score"), "cusum_score")


@query("e13_crossing_alarms", f"""WITH RECURSIVE {SIMPLE}, f9 AS (SELECT * REPLACE (round(score, 9) AS score) FROM s), l AS (SELECT *, CASE WHEN rst THEN 0 ELSE coalesce(lag(score) OVER w, 0) END AS ps FROM f9 {W}),
 c AS (SELECT source_id, row_pos, t, row_number() OVER w AS i FROM l WHERE ps < 1.0 AND score >= 1.0 {W}),
 fold AS (SELECT source_id, row_pos, t AS last, i, true AS emit FROM c WHERE i = 1
  UNION ALL SELECT c.source_id, c.row_pos, CASE WHEN c.t - f.last >= 172800 THEN c.t ELSE f.last END, c.i, c.t - f.last >= 172800 FROM fold f JOIN c ON c.source_id = f.source_id AND c.i = f.i + 1)
SELECT source_id, row_pos FROM fold WHERE emit""")
def _(spark, d):
    out = dc.crossing_alarms(simple(spark, d), TRACK, score="cusum_score", reset=F.col("reset"), threshold=1.0, refractory_s=172800.0)
    return out.select("source_id", "row_pos")


@query("e14_refractory_cusum", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER w AS i, (ln(greatest(1e-6, least(1 - 1e-6, x / 200)) / (1 - greatest(1e-6, least(1 - 1e-6, x / 200)))) + 1.5) / 1.0 AS z FROM tel {W}),
 fold AS (SELECT source_id, row_pos, i, CASE WHEN greatest(0, z - 0.5) > 1.5 THEN 0.0 ELSE greatest(0, z - 0.5) END AS s, CASE WHEN greatest(0, z - 0.5) > 1.5 THEN 3 ELSE 0 END AS skip, greatest(0, z - 0.5) > 1.5 AS onset FROM n WHERE i = 1
  UNION ALL SELECT n.source_id, n.row_pos, n.i, CASE WHEN f.skip > 0 OR greatest(0, f.s + n.z - 0.5) > 1.5 THEN 0.0 ELSE greatest(0, f.s + n.z - 0.5) END,
   CASE WHEN f.skip > 0 THEN f.skip - 1 WHEN greatest(0, f.s + n.z - 0.5) > 1.5 THEN 3 ELSE 0 END, f.skip = 0 AND greatest(0, f.s + n.z - 0.5) > 1.5 FROM fold f JOIN n ON n.source_id = f.source_id AND n.i = f.i + 1)
SELECT row_pos, onset FROM fold""")
def _(spark, d):
    z = sc.logit_standardise(F.col("x") / 200, -1.5, 1.0)
    return dc.refractory_page_alarms(telemetry(spark, d), TRACK, z=z, slack=0.5, threshold=1.5, refractory_rows=3).select("row_pos", "onset")


PV = "(1.0 + row_pos * 7919 % 997) / 998.0"


def p_values(spark, d):
    return telemetry(spark, d).withColumn("p", (1.0 + F.col("row_pos") * 7919 % 997) / 998.0)


@query("e17_persistence", f"""WITH {PREV}, b AS (SELECT *, {PV} AS p, pr IS NULL OR dt <= 0 OR dt > 86400 AS cut FROM pv), g AS (SELECT *, sum(CASE WHEN cut OR p > 0.6 THEN 1 ELSE 0 END) OVER w AS k FROM b {W}),
e AS (SELECT *, sum(CASE WHEN cut OR p > 0.6 THEN 0 ELSE dt END) OVER (PARTITION BY source_id, k ORDER BY t, row_pos) AS ev FROM g)
SELECT row_pos, round(ev, 4) AS temporal_evidence, ev >= 43200 AS alarm, CASE WHEN pr IS NULL THEN 'flight_start' WHEN cut THEN 'invalid_or_large_gap' ELSE '' END AS reset_reason FROM e""")
def _(spark, d):
    out = dc.temporal_evidence(p_values(spark, d), TRACK, p_value="p", alpha=0.6, mode="persistence", max_gap_s=86400.0, persistence_s=43200.0)
    return rounded(out.select("row_pos", "temporal_evidence", "alarm", "reset_reason"), "temporal_evidence", n=4)


@query("l8_profile_alarms", f"""WITH {PREV}, b AS (SELECT *, {PV} AS p, pr IS NULL OR dt <= 0 OR dt > 86400 AS cut FROM pv), g AS (SELECT *, sum(CASE WHEN cut OR p > 0.5 THEN 1 ELSE 0 END) OVER w AS k FROM b {W}),
e AS (SELECT *, sum(CASE WHEN cut OR p > 0.5 THEN 0 ELSE dt END) OVER (PARTITION BY source_id, k ORDER BY t, row_pos) AS ev FROM g)
SELECT 'speed' AS channel, row_pos, ev >= 43200 AS alarm FROM e UNION ALL SELECT 'track', row_pos, p <= 0.3 FROM b""")
def _(spark, d):
    budget = AlertBudget(0.8, {"speed": 0.5, "track": 0.3})
    held = DetectorProfile("speed", "persistence", 86400.0, persistence_s=43200.0)
    once = DetectorProfile("track", "instant", 86400.0)
    rows = p_values(spark, d)
    both = [x.apply(rows, TRACK, budget, p_value="p").select("channel", "row_pos", "alarm") for x in (held, once)]
    return both[0].unionByName(both[1])


@query("e18_accumulation", f"""WITH {PREV}, b AS (SELECT *, {PV} AS p, pr IS NULL OR dt <= 0 OR dt > 86400 AS cut FROM pv), g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER w AS k FROM b {W}),
e AS (SELECT *, sum(CASE WHEN cut THEN 0 ELSE dt * (-ln(p) - 0.9) END) OVER (PARTITION BY source_id, k ORDER BY t, row_pos) AS ps FROM g),
s AS (SELECT *, ps - least(0, min(ps) OVER (PARTITION BY source_id, k ORDER BY t, row_pos)) AS ev FROM e)
SELECT row_pos, round(ev, 3) + 0.0 AS temporal_evidence, ev >= 20000 AS alarm FROM s""")
def _(spark, d):
    out = dc.temporal_evidence(
        p_values(spark, d), TRACK, p_value="p", alpha=0.6, mode="accumulation", max_gap_s=86400.0, reference_surprisal=0.9, accumulation_threshold=20000.0
    )
    return rounded(out.select("row_pos", "temporal_evidence", "alarm"), "temporal_evidence", n=3)


@query("e19_instant", f"SELECT row_pos, {PV} <= 0.05 AS alarm FROM tel")
def _(spark, d):
    return dc.temporal_evidence(p_values(spark, d), TRACK, p_value="p", alpha=0.05, mode="instant", max_gap_s=86400.0).select("row_pos", "alarm")


HS = (60.0, 90.0, 120.0)
BLOCKS_SQL = """pv2 AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt, min(t) OVER (PARTITION BY source_id) AS t0, max(t) OVER (PARTITION BY source_id) AS t1 FROM tel),
ex AS (SELECT *, CASE WHEN NOT on_ground AND dt > 0 AND dt <= 86400 THEN dt ELSE 0 END AS e, greatest(t1 - 604800 - t0, 0) AS span FROM pv2),
h AS (SELECT unnest([60.0, 90.0, 120.0])::DOUBLE AS h),
al AS (SELECT source_id, row_pos, h, t - lag(t) OVER (PARTITION BY source_id, h ORDER BY t, row_pos) AS g FROM tel, h WHERE NOT on_ground AND x > h),
rb AS (SELECT source_id, row_pos, e, t, t0, t1, span, unnest(range(0, CAST(ceil(span / 259200 - 1e-9) AS BIGINT) + 1)) AS block, CAST(ceil(span / 259200 - 1e-9) AS BIGINT) AS k FROM ex),
inb AS (SELECT source_id, row_pos, block, e FROM rb WHERE CASE WHEN block = k THEN t - t0 >= span ELSE t - t0 >= block * 259200 AND t - t0 < block * 259200 + 604800 END),
bl AS (SELECT i.source_id, i.block, h.h, sum(i.e) AS exposure_s, count(*) FILTER (WHERE al.row_pos IS NOT NULL AND (al.g IS NULL OR al.g > 43200)) AS onsets
 FROM inb i CROSS JOIN h LEFT JOIN al ON al.source_id = i.source_id AND al.row_pos = i.row_pos AND al.h = h.h GROUP BY i.source_id, i.block, h.h)"""


def blocks(spark, d):
    return wn.moving_blocks(
        telemetry(spark, d), TRACK, score="x", evaluable=~F.col("on_ground"), candidates=HS, block_s=604800.0, stride_s=259200.0,
        merge_gap_s=43200.0, max_gap_s=86400.0,
    )


@query("e35_moving_blocks", f"WITH {BLOCKS_SQL} SELECT source_id, block, h, round(exposure_s, 3) AS exposure_s, onsets FROM bl")
def _(spark, d):
    return rounded(blocks(spark, d), "exposure_s", n=3)
