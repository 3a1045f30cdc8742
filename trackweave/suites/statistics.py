"""Joins in time, robust fits, ranks, samples, splits and evaluation."""

from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators import conformal as cf
from trackweave.operators import evaluate as ev
from trackweave.operators import joins as jn
from trackweave.operators import robust as rb
from trackweave.operators import sampling as sp
from trackweave.operators import windows as wn
from trackweave.operators.residuals import residuals
from trackweave.plans.track import Track
from trackweave.suites.base import TRACK, query, r6, rounded, table, telemetry

# ---------------------------------------------------------------- joins in time
ALARMS = "al AS (SELECT source_id, t AS ta, x AS ax, row_pos AS ap FROM tel WHERE alarm)"


def alarms(spark, d):
    return telemetry(spark, d).filter("alarm")


@query("c1_asof_tolerance", f"""WITH {ALARMS} SELECT l.row_pos, CASE WHEN l.t - al.ta <= 43200 THEN al.ax END AS ax, CASE WHEN l.t - al.ta <= 43200 THEN al.ta END AS ta
FROM (SELECT * FROM tel WHERE NOT alarm) l ASOF LEFT JOIN al ON l.source_id = al.source_id AND l.t >= al.ta""")
def _(spark, d):
    right = alarms(spark, d).select("source_id", F.col("t").alias("ta"), F.col("x").alias("ax"))
    out = jn.asof_join(telemetry(spark, d).filter("NOT alarm"), right, TRACK, right_time="ta", values=["ax"], tolerance=43200.0, matched_time="ta")
    return out.select("row_pos", "ax", "ta")


@query("c2_align_to_clock", f"""WITH {ALARMS}, v AS (SELECT source_id, t AS vt, x, alt FROM tel WHERE source_type = 'view'), c AS (SELECT * FROM tel WHERE source_type NOT IN ('view', 'error')),
 j AS (SELECT c.row_pos, c.t, c.source_id, c.x, v.x AS vx, v.alt, v.vt FROM c ASOF LEFT JOIN v ON c.source_id = v.source_id AND c.t >= v.vt),
 k AS (SELECT j.*, al.ax, al.ta FROM j ASOF LEFT JOIN al ON j.source_id = al.source_id AND j.t >= al.ta)
SELECT row_pos, x, CASE WHEN t - vt <= 43200 THEN vx END AS view__x, CASE WHEN t - vt <= 43200 THEN alt END AS alt, coalesce(round(CASE WHEN t - vt <= 43200 THEN (t - vt) * 1000 END, 2), -1) AS view__x_ms,
 CASE WHEN t - ta <= 86400 THEN ax END AS ax, coalesce(round(CASE WHEN t - ta <= 86400 THEN (t - ta) * 1000 END, 2), -1) AS ax_ms FROM k""")
def _(spark, d):
    tel = telemetry(spark, d)
    clock = tel.filter("source_type NOT IN ('view', 'error')").select("source_id", "t", "row_pos", "x")
    topics = {
        "view": (tel.filter("source_type = 'view'").select("source_id", "t", "x", "alt"), ["x", "alt"]),
        "err": (tel.filter("alarm").select("source_id", "t", F.col("x").alias("ax")), ["ax"]),
    }
    out = jn.align_to_clock(clock, topics, TRACK, tolerances={"view": 43200.0, "err": 86400.0})
    ms = lambda c: F.when(F.col(c) == float("inf"), -1.0).otherwise(F.round(c, 2))
    return out.select("row_pos", "x", "view__x", "alt", ms("view__x_staleness_ms").alias("view__x_ms"), "ax", ms("ax_staleness_ms").alias("ax_ms"))


@query("c3_interval_member", f"""WITH {ALARMS} SELECT row_pos, EXISTS (SELECT 1 FROM al WHERE al.source_id = tel.source_id AND tel.t BETWEEN ta AND ta + 20000) AS inside FROM tel""")
def _(spark, d):
    iv = alarms(spark, d).select("source_id", F.col("t").alias("s"), (F.col("t") + 20000.0).alias("e"))
    return jn.interval_member(telemetry(spark, d), iv, TRACK, start="s", end="e", out="inside").select("row_pos", "inside")


EVENTS = """ev AS (SELECT source_id, row_pos AS event_id, t AS onset, t + 40000 + row_pos % 7 * 30000 AS fin FROM tel WHERE source_type = 'signup')"""


def events_of(spark, d):
    e = telemetry(spark, d).filter("source_type = 'signup'")
    return e.select("source_id", F.col("row_pos").alias("event_id"), F.col("t").alias("onset"), (F.col("t") + 40000 + F.col("row_pos") % 7 * 30000).alias("fin"))


@query("c12_event_first_alarm", f"""WITH {ALARMS}, {EVENTS}, m AS (SELECT event_id, any_value(onset) AS onset, min(ta) AS f FROM ev LEFT JOIN al ON al.source_id = ev.source_id AND ta >= onset AND ta <= least(fin, onset + 100000) GROUP BY event_id)
SELECT event_id, f IS NOT NULL AS detected, round(f - onset, 6) AS first_alarm_delay_s FROM m""")
def _(spark, d):
    out = jn.first_alarm(events_of(spark, d), alarms(spark, d), TRACK, event_id="event_id", onset="onset", end="fin", deadline_s=100000.0)
    return rounded(out.select("event_id", "detected", "first_alarm_delay_s"), "first_alarm_delay_s")


COVER = f"""{EVENTS}, wn AS (SELECT source_id, t AS s, t + 9000 + row_pos % 5 * 20000 AS e FROM tel WHERE alarm),
 x AS (SELECT event_id, onset, fin, greatest(s, onset) AS s, least(e, fin) AS e FROM ev JOIN wn USING (source_id) WHERE least(e, fin) >= greatest(s, onset)),
 r AS (SELECT *, max(e) OVER (PARTITION BY event_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
 cv AS (SELECT event_id, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS covered FROM r GROUP BY event_id)"""


def coverage(spark, d):
    w = alarms(spark, d).select("source_id", F.col("t").alias("t_start"), (F.col("t") + 9000 + F.col("row_pos") % 5 * 20000).alias("t_end"))
    return jn.interval_coverage(events_of(spark, d), w, TRACK, event_id="event_id", onset="onset", end="fin")


@query("c13_event_coverage", f"WITH {COVER} SELECT event_id, round(fin - onset, 3) AS duration_s, round(coalesce(covered, 0), 3) AS covered_s, round(coalesce(covered, 0) / (fin - onset), 5) AS fraction FROM ev LEFT JOIN cv USING (event_id)")
def _(spark, d):
    out = coverage(spark, d).select("event_id", "duration_s", "covered_s", "fraction")
    return rounded(rounded(out, "fraction", n=5), "duration_s", "covered_s", n=3)


@query("c19_event_details", f"""WITH {ALARMS}, {COVER}, m AS (SELECT event_id, min(ta) - any_value(onset) AS dl FROM ev JOIN al ON al.source_id = ev.source_id AND ta BETWEEN onset AND fin GROUP BY event_id)
SELECT event_id, dl IS NOT NULL AS detected, round(dl, 5) AS first_alarm_delay_s, round(coalesce(covered, 0) / (fin - onset), 5) AS fraction FROM ev LEFT JOIN cv USING (event_id) LEFT JOIN m USING (event_id)""")
def _(spark, d):
    return rounded(details(spark, d).select("event_id", "detected", "first_alarm_delay_s", "fraction"), "first_alarm_delay_s", "fraction", n=5)


def details(spark, d):
    e = events_of(spark, d)
    hit = jn.first_alarm(e, alarms(spark, d), TRACK, event_id="event_id", onset="onset", end="fin").drop("source_id")
    return e.join(hit, "event_id", "left").join(coverage(spark, d).drop("source_id"), "event_id", "left")


@query("d30_detection_summary", f"""WITH {ALARMS}, {COVER}, m AS (SELECT event_id, min(ta) - any_value(onset) AS dl FROM ev JOIN al ON al.source_id = ev.source_id AND ta BETWEEN onset AND fin GROUP BY event_id),
 a AS (SELECT *, coalesce(covered, 0) AS c, fin - onset AS du FROM ev LEFT JOIN cv USING (event_id) LEFT JOIN m USING (event_id))
SELECT count(*) AS n_events, count(dl) AS n_detected, round(avg(c / du), 5) AS macro_coverage, round(sum(c) / sum(du), 5) AS micro_coverage, round(quantile_cont(dl, 0.5), 3) AS median_delay_s,
 round(quantile_cont(dl, 0.95), 3) AS p95_delay_s, round(count(dl) / count(*), 6) AS recall FROM a""")
def _(spark, d):
    out = ev.detection_summary(details(spark, d)).drop("recall_low", "recall_high")
    out = rounded(rounded(out, "macro_coverage", "micro_coverage", n=5), "median_delay_s", "p95_delay_s", n=3)
    return rounded(out, "recall")


@query("d34_wilson_interval", """WITH c AS (SELECT source_id, count(*) FILTER (WHERE alarm) AS k, count(*) AS n FROM tel GROUP BY source_id)
SELECT source_id, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM c""")
def _(spark, d):
    c = telemetry(spark, d).groupBy("source_id").agg(F.count_if("alarm").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    return c.select("source_id", r6(lo).alias("low"), r6(hi).alias("high"))


@query("d35_recall_by_mode", f"""WITH {ALARMS}, {EVENTS}, m AS (SELECT event_id, count(ta) > 0 AS hit FROM ev LEFT JOIN al ON al.source_id = ev.source_id AND ta BETWEEN onset AND fin GROUP BY event_id)
SELECT event_id % 3 AS fault_mode, count(*) AS n_events, count(*) FILTER (WHERE hit) AS n_detected, round(count(*) FILTER (WHERE hit) / count(*), 6) AS recall FROM m GROUP BY ROLLUP (event_id % 3)""")
def _(spark, d):
    hit = jn.first_alarm(events_of(spark, d), alarms(spark, d), TRACK, event_id="event_id", onset="onset", end="fin")
    return rounded(ev.recall_by_mode(hit.withColumn("fault_mode", F.col("event_id") % 3), mode="fault_mode"), "recall")


@query("c10_exact_paired_join", "SELECT row_pos, row_pos % 10 = 0 AS changed FROM tel")
def _(spark, d):
    a = telemetry(spark, d)
    b = a.withColumn("x", F.when(F.col("row_pos") % 10 == 0, F.col("x") + 5).otherwise(F.col("x")))
    return jn.paired_rows(a, b, on=["row_pos"], time="t", columns=["x", "alt"])


@query("c11_observable_changed", "SELECT row_pos, (CASE WHEN row_pos % 5 = 0 THEN NULL ELSE alt END) IS DISTINCT FROM alt AS changed FROM tel")
def _(spark, d):
    from trackweave.operators.inject import observable_changed

    a = telemetry(spark, d)
    b = a.withColumn("alt", F.when(F.col("row_pos") % 5 != 0, F.col("alt")))
    return observable_changed(a, b, on=["row_pos"], time="t", columns=["alt"], observation=lambda f: f.select("row_pos", "t", "alt"))


@query("c17_metadata_join", "SELECT row_pos, c_mktsegment AS session FROM tel JOIN customer ON c_custkey = CAST(source_id AS BIGINT) + 1")
def _(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") - 1).cast("string").alias("source_id"), F.col("c_mktsegment").alias("session"))
    return jn.metadata_join(telemetry(spark, d), c, on="source_id", column="session").select("row_pos", "session")


@query("c20_identity_join", "SELECT row_pos, t, x, x * 2 AS y FROM tel")
def _(spark, d):
    a = telemetry(spark, d).select("row_pos", "t", "x")
    b = a.select("row_pos", "t", (F.col("x") * 2).alias("y"))
    return jn.identity_join(a, b, on=["row_pos"], time="t")


@query("c8_semi_anti", "WITH k AS (SELECT DISTINCT source_id FROM tel WHERE is_military), s AS (SELECT DISTINCT source_id FROM tel WHERE x > 400) SELECT row_pos FROM tel WHERE source_id IN (FROM k) AND source_id NOT IN (FROM s)")
def _(spark, d):
    tel = telemetry(spark, d)
    kept, gone = tel.filter("is_military").select("source_id").distinct(), tel.filter("x > 400").select("source_id").distinct()
    return tel.join(kept, "source_id", "left_semi").join(gone, "source_id", "left_anti").select("row_pos")


@query("e38_observed_tolerances", """WITH p AS (SELECT source_id, source_type, t - lag(t) OVER (PARTITION BY source_id, source_type ORDER BY t, row_pos) AS dt FROM tel)
SELECT source_id, source_type, round(greatest(CASE WHEN source_type = 'view' THEN 100000.0 ELSE 0 END, 1.5 * quantile_cont(dt, 0.5)), 3) AS tolerance FROM p WHERE dt > 0 GROUP BY source_id, source_type""")
def _(spark, d):
    out = jn.observed_tolerances(telemetry(spark, d), TRACK, topic="source_type", registered={"view": 100000.0})
    return rounded(out, "tolerance", n=3)


# ---------------------------------------------------------------- robust fits
@query("d22_median_mad", """WITH l AS (SELECT 'x' AS channel, x AS v FROM tel UNION ALL SELECT 'alt', alt FROM tel WHERE alt IS NOT NULL UNION ALL SELECT 'roll_deg', roll_deg FROM tel),
 m AS (SELECT channel, quantile_cont(v, 0.5) AS med, count(*) AS n FROM l GROUP BY channel)
SELECT channel, any_value(n) AS n, round(any_value(med), 6) AS median, round(1.4826 * quantile_cont(abs(v - med), 0.5), 6) AS mad, quantile_cont(abs(v - med), 0.5) > 0 AS usable FROM l JOIN m USING (channel) GROUP BY channel""")
def _(spark, d):
    return rounded(rb.median_mad(telemetry(spark, d), ["x", "alt", "roll_deg"]), "median", "mad")


@query("d23_median_iqr", """SELECT source_type, 'alt' AS channel, count(alt) AS n, round(quantile_cont(alt, 0.5), 6) AS median, round(quantile_cont(alt, 0.75) - quantile_cont(alt, 0.25), 6) AS iqr FROM tel GROUP BY source_type""")
def _(spark, d):
    return rounded(rb.median_iqr(telemetry(spark, d), ["alt"], groups=["source_type"]), "median", "iqr")


@query("d24_distribution", """WITH r AS (SELECT x, row_number() OVER (ORDER BY sha256('7' || chr(0) || row_pos || chr(0) || 'x')) AS k FROM tel), s AS (SELECT * FROM r WHERE k <= 500)
SELECT 'x' AS channel, count(x) AS finite_n, 0::BIGINT AS missing_n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std_population, min(x) AS min, max(x) AS max,
 (SELECT round(quantile_cont(x, 0.5), 5) FROM s) AS p50, (SELECT round(quantile_cont(x, 0.99), 5) FROM s) AS p99, (SELECT round(sqrt(ln(40) / (2 * count(*))), 6) FROM s) AS dkw_error FROM tel""")
def _(spark, d):
    out = rb.distribution(telemetry(spark, d), ["x"], sample=500, seed="7", row_key=["row_pos"])
    out = rounded(rounded(out, "dkw_error"), "mean", "std_population", "p50", "p99", n=5)
    return out.select("channel", "finite_n", "missing_n", "mean", "std_population", "min", "max", "p50", "p99", "dkw_error")


def _pen(c, m, s):
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(0, least(abs(({c} - {m}) / {s}) - 3, 10)) END"


@query("h24_rule_penalty", f"SELECT row_pos, round({_pen('x', 35.0, 8.0)} + 2 * {_pen('alt', 5000.0, 900.0)}, 6) AS rule_penalty FROM tel")
def _(spark, d):
    out = rb.rule_scores(telemetry(spark, d), {"x": (35.0, 8.0), "alt": (5000.0, 900.0)}, {"alt": 2.0})
    return rounded(out.select("row_pos", "rule_penalty"), "rule_penalty")


@query("k12_rule_scorer", """WITH m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(alt, 0.5) AS ma FROM tel), s AS (SELECT mx, ma, 1.4826 * quantile_cont(abs(x - mx), 0.5) AS sx, 1.4826 * quantile_cont(abs(alt - ma), 0.5) AS sa FROM tel, m GROUP BY mx, ma),
 p AS (SELECT tel.*, """ + _pen("x", "mx", "sx") + " + " + _pen("alt", "ma", "sa") + """ AS pen, row_number() OVER w AS rn, t - lag(t) OVER w AS dt FROM tel, s WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos)),
 g AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt <= 0 OR dt > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS run FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY t, row_pos) AS i, avg(pen) OVER (PARTITION BY source_id, run ORDER BY t, row_pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS sc FROM g)
SELECT source_id, t AS t_end, round(sc, 5) AS score FROM k WHERE i >= 4 AND (i - 4) % 2 = 0""")
def _(spark, d):
    from trackweave.operators.rules import rule_window_scores

    tel = telemetry(spark, d)
    scales = rb.parameters(rb.median_mad(tel, ["x", "alt"]))
    out = rule_window_scores(tel, TRACK, scales=scales, weights={}, window=4, stride=2, max_gap_s=86400.0)
    return out.select("source_id", "t_end", r6("score", 5).alias("score"))


@query("h25_zscore_confidence", """WITH z AS (SELECT row_pos, (x - 45) / 30 AS z FROM tel) SELECT row_pos, round(CASE WHEN z >= 0 THEN 1 - exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
 ELSE exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) END, 6) AS conf FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM z)""")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(sc.normal_cdf((F.col("x") - 45) / 30)).alias("conf"))


# ---------------------------------------------------------------- ranks and conformal
@query("c15_rank_against", """SELECT q.row_pos, (SELECT count(*) FROM tel r WHERE NOT r.alarm AND r.x >= q.x) AS n_ge,
 (SELECT count(*) FROM tel r WHERE NOT r.alarm AND r.x <= q.x) AS n_le FROM tel q WHERE alarm""")
def _(spark, d):
    tel = telemetry(spark, d)
    return cf.rank_against(tel.filter("alarm"), tel.filter("NOT alarm"), groups=[], score="x").select("row_pos", "n_ge", "n_le")


@query("h26_empirical_probability", """WITH v AS (SELECT x, is_military FROM tel WHERE NOT alarm) SELECT q.row_pos, round(((SELECT count(*) FROM v r WHERE r.is_military = q.is_military AND r.x <= q.x) + 0.5)
 / ((SELECT count(*) FROM v r WHERE r.is_military = q.is_military) + 1), 8) AS probability FROM tel q WHERE alarm""")
def _(spark, d):
    tel = telemetry(spark, d)
    out = cf.empirical_probability(tel.filter("alarm"), tel.filter("NOT alarm"), groups=["is_military"], score="x")
    return out.select("row_pos", r6("probability", 8).alias("probability"))


CONF = """sc AS (SELECT row_pos, source_type AS channel, CASE WHEN row_pos % 50 < 30 THEN 'level' WHEN row_pos % 50 < 49 THEN 'climb' ELSE 'descent' END AS ph, 'c' || row_pos % 3 AS ca, x AS score FROM tel),
 cal AS (SELECT * FROM sc WHERE row_pos % 2 = 0), q AS (SELECT * FROM sc WHERE row_pos % 2 = 1),
 n3 AS (SELECT channel, ph, ca, count(*) AS n FROM cal GROUP BY ALL), n2 AS (SELECT channel, ph, count(*) AS n FROM cal GROUP BY ALL), n1 AS (SELECT channel, count(*) AS n FROM cal GROUP BY ALL),
 lv AS (SELECT q.*, CASE WHEN n3.n >= 20 THEN 3 WHEN n2.n >= 20 THEN 2 ELSE 1 END AS l, n3.n AS a, n2.n AS b, n1.n AS c FROM q LEFT JOIN n3 USING (channel, ph, ca) LEFT JOIN n2 USING (channel, ph) LEFT JOIN n1 USING (channel)),
 p AS (SELECT lv.row_pos, l, CASE l WHEN 3 THEN a WHEN 2 THEN b ELSE c END AS n, (SELECT count(*) FROM cal WHERE cal.channel = lv.channel AND (l = 1 OR cal.ph = lv.ph) AND (l < 3 OR cal.ca = lv.ca) AND cal.score >= lv.score) AS tail FROM lv)"""


def scored(spark, d):
    m = F.col("row_pos") % 50
    phase = F.when(m < 30, "level").when(m < 49, "climb").otherwise("descent")
    return telemetry(spark, d).select(
        "row_pos", F.col("source_type").alias("channel"), phase.alias("context_phase"),
        F.concat(F.lit("c"), (F.col("row_pos") % 3).cast("string")).alias("context_cadence"), F.col("x").alias("score"),
    )


def conformal(spark, d):
    s = scored(spark, d)
    ref = cf.conformal_fit(s.filter("row_pos % 2 = 0"), role=cf.CALIBRATION_ROLE, contains_synthetic=False)
    return cf.conformal_transform(s.filter("row_pos % 2 = 1"), ref, min_group_size=20)


LEVEL = "CASE l WHEN 3 THEN 'channel+context_phase+context_cadence' WHEN 2 THEN 'channel+context_phase' ELSE 'channel' END"


@query("c14_hierarchical_fallback", f"WITH {CONF} SELECT row_pos, {LEVEL} AS calibration_level, n AS calibration_n FROM p")
def _(spark, d):
    return conformal(spark, d).select("row_pos", "calibration_level", "calibration_n")


@query("h27_conformal_p", f"WITH {CONF} SELECT row_pos, round((1.0 + tail) / (n + 1.0), 9) AS conformal_p_value FROM p")
def _(spark, d):
    return conformal(spark, d).select("row_pos", r6("conformal_p_value", 9).alias("conformal_p_value"))


@query("k13_conformal_alarms", f"WITH {CONF} SELECT row_pos, (1.0 + tail) / (n + 1.0) <= 0.05 AS alarm FROM p")
def _(spark, d):
    return cf.conformal_alarms(conformal(spark, d), alpha=0.05).select("row_pos", "alarm")


@query("h28_logit_standardise", "SELECT row_pos, round((ln(greatest(1e-6, least(1 - 1e-6, x / 300)) / (1 - greatest(1e-6, least(1 - 1e-6, x / 300)))) + 2) / 0.7, 6) AS z FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(sc.logit_standardise(F.col("x") / 300, -2.0, 0.7)).alias("z"))


# ---------------------------------------------------------------- ranking diagnostics
AUC = """sr AS (SELECT row_pos, round(x) AS s, row_pos % 4 = 0 OR x > 80 AS y, CASE WHEN row_pos % 4 = 0 THEN 1.0 WHEN row_pos % 4 = 1 THEN 0.5 ELSE 0.0 END AS q FROM tel),
 agg AS (SELECT s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM sr GROUP BY s)"""


@query("d31_ranking_metrics", f"""WITH sr AS (SELECT round(x) AS s, CASE WHEN row_pos % 4 = 0 THEN 1.0 WHEN row_pos % 4 = 1 THEN 0.5 ELSE 0.0 END AS q, row_pos FROM tel),
 v AS (SELECT 'primary' AS view, s, q > 0 AS y FROM sr WHERE row_pos % 31 <> 0 UNION ALL SELECT 'steady', s, q > 0 FROM sr WHERE row_pos % 31 <> 0 AND q IN (0, 1)),
 agg AS (SELECT view, s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM v GROUP BY view, s),
 c AS (SELECT *, sum(n) OVER (PARTITION BY view ORDER BY s) - n AS below, sum(p) OVER (PARTITION BY view ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY view ORDER BY s DESC) AS fp, sum(p) OVER (PARTITION BY view) AS tpos, sum(n) OVER (PARTITION BY view) AS tneg FROM agg)
SELECT view, CAST(any_value(tpos) AS DOUBLE) AS n_positive, CAST(any_value(tneg) AS DOUBLE) AS n_negative, round(sum(p * (below + n / 2.0)) / (any_value(tpos) * any_value(tneg)), 8) AS auroc, round(sum(p * tp / (tp + fp)) / any_value(tpos), 8) AS auprc,
 (SELECT count(*) FROM sr) AS n_input, (SELECT count(*) FROM sr WHERE row_pos % 31 = 0) AS n_unscoreable FROM c GROUP BY view""")
def _(spark, d):
    m = F.col("row_pos") % 4
    rows = telemetry(spark, d).select(
        F.when(m == 0, 1.0).when(m == 1, 0.5).otherwise(0.0).alias("q_w"), F.when(F.col("row_pos") % 31 != 0, F.round("x")).alias("score")
    )
    return rounded(ev.window_diagnostics(rows), "auroc", "auprc", n=8)


@query("d33_bounded_roc", f"""WITH {AUC}, o AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS i, count(*) OVER () AS m, lead(p) OVER (ORDER BY s DESC) AS np, lead(n) OVER (ORDER BY s DESC) AS nn,
 sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS fpr FROM agg),
 k AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS idx, count(*) OVER () AS n2 FROM o WHERE i = 1 OR i = m OR np <> p OR nn <> n),
 a AS (SELECT idx AS point, fpr, tpr, n2 FROM k UNION ALL SELECT 0, 0, 0, (SELECT max(n2) FROM k)), j AS (SELECT DISTINCT (jj * (SELECT max(n2) FROM k)) // 20 AS idx FROM (SELECT unnest(range(0, 21)) AS jj))
SELECT point, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, n2 + 1 AS n_exact_points FROM a WHERE n2 + 1 <= 21 OR point IN (SELECT idx FROM j)""")
def _(spark, d):
    rows = telemetry(spark, d).select(F.round("x").alias("s"), ((F.col("row_pos") % 4 == 0) | (F.col("x") > 80)).alias("y"))
    return rounded(ev.bounded_roc(rows, score="s", positive=F.col("y"), max_points=21), "fpr", "tpr", n=8)


@query("d32_sampled_ranking", f"""WITH {AUC}, r AS (SELECT s, y, row_number() OVER (PARTITION BY y ORDER BY sha256('3' || chr(0) || row_pos)) AS k, count(*) OVER (PARTITION BY y) AS pop FROM sr),
 w AS (SELECT s, sum(CASE WHEN y THEN pop / least(pop, 800.0) ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE pop / least(pop, 800.0) END) AS n FROM r WHERE k <= 800 GROUP BY s),
 c AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM w)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS auprc FROM c""")
def _(spark, d):
    rows = telemetry(spark, d).select("row_pos", F.round("x").alias("s"), ((F.col("row_pos") % 4 == 0) | (F.col("x") > 80)).alias("y"))
    out = ev.sampled_ranking(rows, score="s", positive=F.col("y"), cap=800, seed="3", key=["row_pos"])
    return rounded(out.select("auroc", "auprc"), "auroc", "auprc")


RANKS = "(SELECT *, rank() OVER (ORDER BY round(x)) + (count(*) OVER (PARTITION BY round(x)) - 1) / 2.0 AS ra, rank() OVER (ORDER BY alt) + (count(*) OVER (PARTITION BY alt) - 1) / 2.0 AS rb FROM tel WHERE alt IS NOT NULL)"


@query("d37_spearman", f"SELECT count(*) AS n, round(corr(ra, rb), 8) AS rho, 'evaluated' AS status, false AS flagged FROM {RANKS}")
def _(spark, d):
    rows = telemetry(spark, d).select(F.round("x").alias("a"), F.col("alt").alias("b"))
    return rounded(ev.spearman(rows, "a", "b", threshold=0.8), "rho", n=8)


@query("k17_magnitude_domination", """WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra, rank() OVER (ORDER BY ground_speed_ms) + (count(*) OVER (PARTITION BY ground_speed_ms) - 1) / 2.0 AS rb,
 rank() OVER (ORDER BY floor(x / 7)) + (count(*) OVER (PARTITION BY floor(x / 7)) - 1) / 2.0 AS rc FROM tel) SELECT round(corr(ra, rb), 8) AS rho_untrained, round(corr(ra, rc), 8) AS rho_magnitude, corr(ra, rc) >= 0.8 AS flagged FROM r""")
def _(spark, d):
    rows = telemetry(spark, d).select("x", F.col("ground_speed_ms").alias("u"), F.floor(F.col("x") / 7).cast("double").alias("m"))
    return rounded(ev.magnitude_domination(rows, trained="x", untrained="u", magnitude="m"), "rho_untrained", "rho_magnitude", n=8)


@query("d38_ks_gate", """WITH RECURSIVE b AS (SELECT source_type, x AS v, row_pos % 3 = 0 AS post FROM tel), s AS (SELECT source_type, v, count(*) FILTER (WHERE post) AS p, count(*) FILTER (WHERE NOT post) AS n FROM b GROUP BY ALL),
 c AS (SELECT *, abs(sum(p) OVER w / sum(p) OVER g - sum(n) OVER w / sum(n) OVER g) AS dd, sum(p) OVER g AS tp, sum(n) OVER g AS tn FROM s WINDOW w AS (PARTITION BY source_type ORDER BY v), g AS (PARTITION BY source_type)),
 k AS (SELECT source_type, CAST(any_value(tn) AS BIGINT) AS n, CAST(any_value(tp) AS BIGINT) AS m, max(dd) AS ks FROM c GROUP BY source_type),
 w(source_type, n, m, ks, i, o) AS (SELECT source_type, n, m, ks, 0::BIGINT, list_transform(range(n + 1), lambda a: 0.0::DOUBLE) FROM k WHERE ks > 0
  UNION ALL SELECT source_type, n, m, ks, i + 1, list_transform(o, lambda v, a: CASE WHEN a - 1 > i + 1 OR i + 2 - a > m THEN 0.0 WHEN abs((a - 1) / n - (i + 2 - a) / m) >= ks - 1e-9 THEN 1.0
    ELSE (CASE WHEN a > 1 THEN (a - 1) / (i + 1.0) * o[a - 1] ELSE 0 END) + (i + 2 - a) / (i + 1.0) * v END) FROM w WHERE i < n + m),
 p AS (SELECT source_type, o[n + 1] AS p FROM w WHERE i = n + m)
SELECT source_type, n AS n_pre, m AS n_post, round(ks, 8) AS ks, round(p, 7) AS p_value, CASE WHEN ks IS NULL THEN 'not_evaluable' WHEN p < 0.2 THEN 'passed' ELSE 'failed' END AS status FROM k LEFT JOIN p USING (source_type)""")
def _(spark, d):
    out = ev.ks_gate(telemetry(spark, d), value="x", is_post=F.col("row_pos") % 3 == 0, groups=["source_type"], p_threshold=0.2)
    return rounded(rounded(out, "ks", n=8), "p_value", n=7)


# ---------------------------------------------------------------- truth and reports
TRUTH = """tr AS (SELECT row_pos, source_id AS flight_id, CASE WHEN row_pos % 3 <> 0 THEN 'ev_' || source_id END AS event_id, 'drift' AS event_type,
 row_pos % 2 = 0 AS ia, row_pos % 4 = 0 AND is_military AS oc, x < 60 AS et, min(t) OVER (PARTITION BY source_id) AS t0, max(t) OVER (PARTITION BY source_id) AS t1 FROM tel)"""


def truth_rows(spark, d):
    tel = telemetry(spark, d)
    span = tel.groupBy("source_id").agg(F.min("t").alias("attack_onset"), F.max("t").alias("event_end"))
    i = F.col("row_pos")
    return tel.join(span, "source_id").select(
        F.col("source_id").alias("flight_id"), F.when(i % 3 != 0, F.concat(F.lit("ev_"), "source_id")).alias("event_id"), F.lit("drift").alias("event_type"),
        "attack_onset", F.col("attack_onset").alias("observable_onset"), "event_end", (i % 2 == 0).alias("injection_active"),
        ((i % 4 == 0) & F.col("is_military")).alias("observable_changed"), (F.col("x") < 60).alias("evaluable_truth"), "t", "row_pos",
    )


EVT = f"""{TRUTH}, te AS (SELECT event_id, any_value(flight_id) AS flight_id, any_value(t0) AS attack_onset, any_value(t1) AS event_end, count(*) FILTER (WHERE ia) AS attack_active_rows,
 count(*) FILTER (WHERE ia AND et) AS evaluable_active_rows, count(*) FILTER (WHERE oc AND et) AS observable_changed_rows FROM tr WHERE event_id IS NOT NULL GROUP BY event_id),
 tf AS (SELECT *, attack_active_rows > 0 AND evaluable_active_rows > 0 AS attack_eligible, attack_active_rows > 0 AND evaluable_active_rows > 0 AND observable_changed_rows > 0 AS observable_eligible FROM te)"""


@query("d28_truth_events", f"WITH {EVT} SELECT event_id, flight_id, attack_onset, event_end, attack_active_rows, evaluable_active_rows, observable_changed_rows, attack_eligible, observable_eligible, attack_eligible AND NOT observable_eligible AS active_but_unobservable FROM tf")
def _(spark, d):
    return ev.truth_events(truth_rows(spark, d)).drop("event_type", "observable_onset")


@query("d29_observability", f"WITH {EVT} SELECT count(*) AS n_declared, count(*) FILTER (WHERE attack_eligible) AS n_attack_eligible, count(*) FILTER (WHERE observable_eligible) AS n_observable_eligible, count(*) FILTER (WHERE attack_eligible AND NOT observable_eligible) AS n_unobservable FROM tf")
def _(spark, d):
    return ev.observability(ev.truth_events(truth_rows(spark, d)))


POLICY = """pl AS (SELECT *, CASE WHEN is_military THEN 'motor_fault' ELSE 'normal' END AS label, lag(t) OVER w AS pt, lag(x > 120) OVER w AS ps, min(t) OVER (PARTITION BY source_id) + 500000 AS es FROM tel WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos)),
 p2 AS (SELECT *, is_military AND t >= es AS truth, x > 120 AND NOT coalesce(ps, false) AS onset FROM pl), p3 AS (SELECT *, lag(truth) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS ptr FROM p2),
 pe AS (SELECT source_id, label, bool_or(onset) AS anyo, bool_or(onset AND truth) AS detected, min(CASE WHEN onset AND truth THEN t END) - min(es) AS dl, count(*) FILTER (WHERE onset AND NOT truth) AS fa,
  coalesce(sum(CASE WHEN NOT ptr AND t - pt <= 43200 THEN t - pt END), 0) AS ns FROM p3 GROUP BY ALL),
 po AS (SELECT *, CASE WHEN label = 'normal' AND anyo THEN 'fp' WHEN label = 'normal' THEN 'tn' WHEN detected THEN 'tp' ELSE 'fn' END AS outcome FROM pe)"""


def policy(spark, d):
    from trackweave.operators.decide import onsets

    rows = onsets(telemetry(spark, d), TRACK, state=F.col("x") > 120)
    first = rows.groupBy("source_id").agg((F.min("t") + 500000).alias("es"))
    rows = rows.join(first, "source_id").withColumn("label", F.when(F.col("is_military"), "motor_fault").otherwise("normal"))
    return ev.policy_evaluation(
        rows, TRACK, onset=F.col("onset"), truth=F.col("is_military") & (F.col("t") >= F.col("es")), label="label", event_start="es", max_step_s=43200.0
    )


@query("d36_policy_per_flight", f"WITH {POLICY} SELECT source_id, label, detected, round(dl, 4) AS first_alarm_delay_s, fa AS false_alarms, round(ns, 3) AS normal_s, outcome FROM po")
def _(spark, d):
    return rounded(rounded(policy(spark, d), "first_alarm_delay_s", n=4), "normal_s", n=3)


@query("d36_policy_summary", f"""WITH {POLICY} SELECT label, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fn') AS fn, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'tn') AS tn,
 CAST(sum(fa) AS BIGINT) AS false_alarms, round(sum(fa) / (sum(ns) / 3600), 6) AS false_alarms_per_hour FROM po GROUP BY ROLLUP (label)""")
def _(spark, d):
    return rounded(ev.policy_summary(policy(spark, d), label="label").drop("normal_s", "recall"), "false_alarms_per_hour")


@query("d39_completeness", "SELECT 'alt' AS feature, round(avg(CASE WHEN alt IS NULL THEN 0.0 ELSE 1.0 END), 6) AS overall, round(avg(CASE WHEN alt IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE NOT alarm), 6) AS normal, round(avg(CASE WHEN alt IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE alarm), 6) AS anomaly FROM tel UNION ALL SELECT 'x', 1.0, 1.0, 1.0")
def _(spark, d):
    return rounded(ev.completeness(telemetry(spark, d), ["alt", "x"], normal=~F.col("alarm")), "overall", "normal", "anomaly")


@query("d40_dt_histogram", """WITH p AS (SELECT t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel), b AS (SELECT CASE WHEN dt < 0 OR dt > 500000 THEN NULL WHEN dt < 3600 THEN 0 WHEN dt < 21600 THEN 1 WHEN dt < 86400 THEN 2 ELSE 3 END AS bin FROM p WHERE dt IS NOT NULL)
SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def _(spark, d):
    return ev.dt_histogram(telemetry(spark, d), TRACK, edges=[0.0, 3600.0, 21600.0, 86400.0, 500000.0])


NUM = "n AS (SELECT *, CAST(CAST(x AS FLOAT) AS DOUBLE) AS xf, row_number() OVER w AS rn, t - lag(t) OVER w AS dt FROM tel WINDOW w AS (PARTITION BY source_id ORDER BY t, row_pos))"
WINS = f"""{NUM}, f AS (SELECT source_id, t AS t_start, rn, count(*) OVER v AS k, sum(xf * xf) OVER v AS sx, sum(coalesce(alt * alt, 0)) OVER v AS sa, count(alt) OVER v AS na,
 sum((xf - 50) * (xf - 50)) OVER v AS ex, sum(coalesce((alt - 50) * (alt - 50), 0)) OVER v AS ea, max(dt) OVER (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS gap FROM n WINDOW v AS (PARTITION BY source_id ORDER BY t, row_pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
 g AS (SELECT * FROM f WHERE k = 6 AND (rn - 1) % 6 = 0 AND gap <= 172800)"""


def windows_of(spark, d):
    tel = telemetry(spark, d).withColumn("x", F.col("x").cast("double"))
    return wn.sliding_windows(tel, TRACK, features=["x", "alt"], window=6, stride=6, max_gap_s=172800.0)


@query("d42_magnitude_score", f"WITH {WINS} SELECT source_id, t_start, round((sx + sa) / 1000, 0) AS score FROM g")
def _(spark, d):
    return windows_of(spark, d).select("source_id", "t_start", r6(ev.magnitude_score(F.col("x"), F.col("mask")) / 1000, 0).alias("score"))


@query("d43_masked_mse", f"WITH {WINS} SELECT source_id, t_start, round(ex / 100, 0) AS num_x, round((ex + ea) / greatest(6 + na, 1) / 100, 0) AS mse FROM g")
def _(spark, d):
    w = windows_of(spark, d)
    flat = F.transform("x", lambda r: F.transform(r, lambda v: F.lit(50.0).cast("float")))
    num, den = ev.masked_error(F.col("x"), flat, F.col("mask"))
    return w.select("source_id", "t_start", r6(num[0] / 100, 0).alias("num_x"), r6(ev.masked_mse(num, den) / 100, 0).alias("mse"))


@query("d45_role_burden", """WITH f AS (SELECT source_id, CAST(CAST(min(make_timestamp(t_us)) AS DATE) AS VARCHAR) AS day, CASE WHEN is_military THEN 'holdout' ELSE 'fit' END AS role, 'c' || CAST(source_id AS BIGINT) % 3 AS stratum,
 CASE WHEN count(*) > 60 THEN count(*) * 60.0 ELSE 0 END AS e, count(*) FILTER (WHERE x > 150) AS ep FROM tel GROUP BY source_id, is_military)
SELECT day, role, stratum, CAST(grouping(stratum) AS INTEGER) AS is_total, CAST(sum(e) AS DOUBLE) AS exposure_s, CAST(sum(ep) AS BIGINT) AS episodes, count(*) FILTER (WHERE e > 0) AS scoreable_flights, count(*) FILTER (WHERE ep > 0) AS alerted_flights,
 round(sum(ep) / nullif(sum(e) / 3600, 0), 6) AS episodes_per_hour FROM f GROUP BY GROUPING SETS ((day, role), (day, role, stratum))""")
def _(spark, d):
    f = telemetry(spark, d).groupBy("source_id", "is_military").agg(
        F.min("t_us").alias("t0"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") > 150).alias("ep")
    ).select(
        F.to_date(F.timestamp_micros("t0")).cast("string").alias("day"), F.when(F.col("is_military"), "holdout").otherwise("fit").alias("role"),
        F.concat(F.lit("c"), (F.col("source_id").cast("long") % 3).cast("string")).alias("stratum"), F.when(F.col("n") > 60, F.col("n") * 60.0).otherwise(0.0).alias("e"), "ep",
    )
    out = ev.role_burden(f, day="day", role="role", stratum="stratum", exposure="e", episodes="ep")
    return rounded(out.withColumn("is_total", F.col("is_total").cast("int")), "episodes_per_hour")


@query("d51_q_strata", "WITH q AS (SELECT CASE WHEN row_pos % 11 = 0 THEN NULL WHEN row_pos % 4 = 0 THEN 1.0 WHEN row_pos % 4 = 1 THEN 0.25 ELSE 0 END AS q FROM tel) SELECT count(*) FILTER (WHERE q IS NULL) AS unscoreable, count(*) FILTER (WHERE q = 0) AS q_eq_0, count(*) FILTER (WHERE q > 0 AND q < 1) AS q_mixed, count(*) FILTER (WHERE q = 1) AS q_eq_1 FROM q")
def _(spark, d):
    i = F.col("row_pos")
    return ev.q_strata(telemetry(spark, d).withColumn("q_w", F.when(i % 11 != 0, F.when(i % 4 == 0, 1.0).when(i % 4 == 1, 0.25).otherwise(0.0))))


@query("d52_timeline_stats", """WITH s AS (SELECT *, CASE WHEN is_military THEN min(t) OVER (PARTITION BY source_id) + 1000000 END AS onset FROM tel), g AS (SELECT x, alarm, CASE WHEN onset IS NULL THEN 'without_onset' WHEN t < onset THEN 'before_onset' ELSE 'after_onset' END AS stratum FROM s)
SELECT stratum, count(*) AS n, round(avg(CASE WHEN alarm THEN 1.0 ELSE 0 END), 6) AS alarm_fraction, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.05), 5) AS p05, round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.95), 5) AS p95 FROM g GROUP BY stratum""")
def _(spark, d):
    tel = telemetry(spark, d)
    first = tel.groupBy("source_id").agg((F.min("t") + 1000000).alias("f"))
    rows = tel.join(first, "source_id").withColumn("onset", F.when(F.col("is_military"), F.col("f")))
    rows = rows.withColumn("stratum", ev.timeline_stratum(F.col("t"), F.col("onset")))
    out = ev.score_stats(rows, score="x", alarm=F.col("alarm"), groups=["stratum"])
    return rounded(rounded(out, "alarm_fraction"), "mean", "p05", "median", "p95", n=5)


@query("d53_aggressiveness", "SELECT source_id, round(quantile_cont(greatest(abs(roll_deg), abs(vertical_rate_ms * 5)), 0.99), 6) AS aggressiveness FROM tel GROUP BY source_id")
def _(spark, d):
    out = ev.aggressiveness(telemetry(spark, d), flight="source_id", roll_deg=F.col("roll_deg"), rate_deg_s=F.col("vertical_rate_ms") * 5)
    return rounded(out, "aggressiveness")


@query("d54_input_magnitude", "SELECT vec_id, round(sqrt(list_sum([v * v FOR v IN CAST(embedding AS DOUBLE[])])), 5) AS norm FROM embeddings", tel=False)
def _(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", r6(ev.input_norm(F.col("embedding").cast("array<double>")), 5).alias("norm"))


@query("d54_attitude_proxy", "SELECT row_pos, round(sqrt(power(roll_deg / 25, 2) + power(vertical_rate_ms / 15, 2)), 6) AS proxy FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(ev.attitude_proxy(F.col("roll_deg"), F.col("vertical_rate_ms"))).alias("proxy"))


@query("d55_stress_burden", "SELECT source_type AS domain, 'c' || row_pos % 2 AS contract, CASE WHEN row_pos % 3 = 0 THEN 'native' ELSE 'cusum' END AS method, count(*) FILTER (WHERE alarm OR x > 50) AS episodes, CAST(count(*) * 10 AS DOUBLE) AS exposure_s, round(count(*) FILTER (WHERE alarm OR x > 50) / (count(*) * 10.0 / 3600), 6) AS episodes_per_hour, count(*) FILTER (WHERE alarm OR x > 50) / (count(*) * 10.0 / 3600) > 200 AS warning FROM tel GROUP BY 1, 2, 3")
def _(spark, d):
    i = F.col("row_pos")
    rows = telemetry(spark, d).select(
        F.col("source_type").alias("domain"), F.concat(F.lit("c"), (i % 2).cast("string")).alias("contract"), F.when(i % 3 == 0, "native").otherwise("cusum").alias("method"),
        F.when(F.col("alarm") | (F.col("x") > 50), 1).otherwise(0).alias("episodes"), F.lit(10.0).alias("exposure_s"),
    )
    return rounded(ev.stress_burden(rows, budget=100.0), "episodes_per_hour")


# ---------------------------------------------------------------- samples and splits
@query("f2_stable_sort", "SELECT source_id, t, row_pos FROM tel ORDER BY source_id, t, row_pos")
def _(spark, d):
    return sp.stable_sort(telemetry(spark, d), "source_id", "t", position="row_pos").select("source_id", "t", "row_pos")


@query("f3_recent_alerts", "SELECT row_pos, source_id FROM tel WHERE alarm ORDER BY t DESC, row_pos DESC LIMIT 20")
def _(spark, d):
    return sp.recent(alarms(spark, d), time="t", ties=["row_pos"]).select("row_pos", "source_id")


@query("f4_bottom_k_sample", "SELECT row_pos FROM tel ORDER BY sha256('s' || chr(0) || row_pos), row_pos LIMIT 300")
def _(spark, d):
    return sp.bottom_k(telemetry(spark, d), k=300, seed="s", key=["row_pos"]).select("row_pos")


@query("f6_reservoir_per_group", "WITH r AS (SELECT source_id, row_pos, row_number() OVER (PARTITION BY source_id ORDER BY sha256('r' || chr(0) || row_pos)) AS k FROM tel) SELECT source_id, row_pos FROM r WHERE k <= 5")
def _(spark, d):
    return sp.bottom_k(telemetry(spark, d), k=5, seed="r", key=["row_pos"], groups=["source_id"]).select("source_id", "row_pos")


@query("f5_bernoulli_sample", "SELECT row_pos FROM tel WHERE ('0x' || substr(sha256('9' || chr(0) || 'fit' || chr(0) || source_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.3")
def _(spark, d):
    return sp.bernoulli(telemetry(spark, d), p=0.3, seed="9", key=["source_id"], purpose="fit").select("row_pos")


@query("f7_fit_role", "SELECT DISTINCT source_id, CASE WHEN sha256('42' || chr(0) || source_id) < 'c000000000000000000000000000000000000000000000000000000000000000' THEN 'fit' ELSE 'calibration' END AS role FROM tel")
def _(spark, d):
    ids = telemetry(spark, d).select("source_id").distinct()
    return sp.fit_role(ids, seed=42, entity="source_id", fraction=0.75)


@query("f8_exact_split", """WITH i AS (SELECT source_id, row_number() OVER (ORDER BY sha256('5' || chr(0) || source_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM tel)),
 c AS (SELECT *, floor(n * 0.2)::BIGINT AS a, floor(n * 0.6)::BIGINT AS b FROM i) SELECT source_id, CASE WHEN r <= a THEN 'calibration' WHEN r <= a + b THEN 'fit' ELSE 'holdout' END AS split FROM c""")
def _(spark, d):
    return sp.exact_split(telemetry(spark, d), entity="source_id", weights={"fit": 0.6, "calibration": 0.2, "holdout": 0.2}, seed=5)


@query("f9_session_split")
def _(spark, d):
    f = telemetry(spark, d).groupBy("source_id").agg(F.min("source_type").alias("fault_class"))
    f = f.withColumn("session", F.concat(F.lit("s"), (F.col("source_id").cast("long") % 12).cast("string")))
    f = f.withColumn("fault_class", F.when(F.col("source_id").cast("long") % 5 == 0, "motor").when(F.col("source_id").cast("long") % 5 == 1, "sensor").otherwise("normal"))
    return sp.session_split(f, session="session", fault_class="fault_class", seed="1")


@query("f10_balanced_roles", """WITH c AS (SELECT DISTINCT source_id, 'm' || CAST(source_id AS BIGINT) % 3 AS mode, CASE WHEN CAST(source_id AS BIGINT) % 4 = 0 THEN 'f' || CAST(source_id AS BIGINT) % 5 END AS fault, CAST(source_id AS BIGINT) % 29 = 0 AS q FROM tel),
 r AS (SELECT *, row_number() OVER (PARTITION BY q, mode, fault ORDER BY source_id) AS i FROM c)
SELECT source_id, CASE WHEN q THEN 'quarantine' WHEN mode = 'm2' OR fault NOT IN ('f0', 'f1') THEN NULL WHEN fault IS NOT NULL THEN CASE i WHEN 1 THEN 'rehearsal' WHEN 2 THEN 'holdout' ELSE 'development' END
 WHEN i <= 4 THEN 'fit' WHEN i <= 6 THEN 'calibration' WHEN i = 7 THEN 'rehearsal' WHEN i <= 9 THEN 'holdout' ELSE 'development' END AS role FROM r""")
def _(spark, d):
    k = F.col("source_id").cast("long")
    c = telemetry(spark, d).select("source_id").distinct().withColumns({
        "mode": F.concat(F.lit("m"), (k % 3).cast("string")), "fault": F.when(k % 4 == 0, F.concat(F.lit("f"), (k % 5).cast("string"))),
    })
    out = sp.balanced_roles(
        c, flight="source_id", mode="mode", fault="fault", is_fault=F.col("fault").isNotNull(), quarantined=k % 29 == 0, modes=["m0", "m1"], faults=["f0", "f1"])
    return out.select("source_id", "role")


@query("f11_group_folds", """WITH RECURSIVE s AS (SELECT source_id, count(*) AS rows FROM tel GROUP BY source_id), r AS (SELECT *, row_number() OVER (ORDER BY rows DESC, source_id DESC) AS r FROM s),
 g(r, load, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0
  UNION ALL SELECT g.r + 1, list_transform(load, lambda v, i: CASE WHEN i = list_position(load, list_min(load)) THEN v + r.rows ELSE v END), list_position(load, list_min(load)) - 1 FROM g JOIN r ON r.r = g.r + 1)
SELECT source_id, rows, CAST(fold AS INTEGER) AS fold FROM g JOIN r USING (r)""")
def _(spark, d):
    return sp.group_folds(telemetry(spark, d), group="source_id", max_folds=5)


@query("f12_candidate_thresholds", """WITH u AS (SELECT DISTINCT x FROM tel), a AS (SELECT list(x ORDER BY x) AS l, count(*) AS n FROM u), j AS (SELECT unnest(range(0, 200)) AS j),
 q AS (SELECT j * (n - 1) / 199.0 AS p, l, n FROM j, a) SELECT DISTINCT round(l[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (l[least(CAST(floor(p) AS BIGINT) + 2, n)] - l[CAST(floor(p) AS BIGINT) + 1]), 6) AS threshold FROM q UNION ALL SELECT 'infinity'::DOUBLE""")
def _(spark, d):
    out = sp.candidate_thresholds(telemetry(spark, d), score="x", cap=200)
    return out.select(F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 6)).alias("threshold"))


@query("f13_nearest_target", """WITH r AS (SELECT source_type, floor(x / 10) AS g, count(*) / 24.0 AS rate FROM tel GROUP BY 1, 2) SELECT source_type, arg_min(g, (abs(rate - 3.0), g)) AS g, round(arg_min(rate, (abs(rate - 3.0), g)), 6) AS rate FROM r GROUP BY source_type""")
def _(spark, d):
    r = telemetry(spark, d).groupBy("source_type", F.floor(F.col("x") / 10).cast("double").alias("g")).agg((F.count(F.lit(1)) / 24.0).alias("rate"))
    return rounded(sp.nearest_to_target(r, groups=["source_type"], rate="rate", target=F.lit(3.0), keep=["g"]), "rate")
