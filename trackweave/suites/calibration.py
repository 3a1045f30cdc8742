"""Budgets, gates, models and injected disturbances."""

import numpy as np
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators import calibrate as cb
from trackweave.operators import decide as dc
from trackweave.operators import inject as ij
from trackweave.operators import models as md
from trackweave.operators import robust as rb
from trackweave.operators.segments import diff_columns
from trackweave.plans.track import Track, Whole, sweep
from trackweave.suites.base import TRACK, query, r6, rounded, telemetry
from trackweave.suites.detect import BLOCKS_SQL, HOUR, HS, MICROS, SIMPLE, blocks, simple

UNIT = "('0x' || substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0"
WEIGHT = " + ".join(f"(CASE WHEN u >= {p!r} THEN 1 ELSE 0 END)" for p in cb.POISSON_ONE)
BOOT = f"""{BLOCKS_SQL}, rp AS (SELECT unnest(range(0, 40)) AS r),
 dr AS (SELECT r, h, exposure_s, onsets, {UNIT.format("'k7' || chr(0) || r || chr(0) || source_id || chr(0) || block")} AS u FROM bl, rp WHERE exposure_s > 0),
 rt AS (SELECT r, h, sum(({WEIGHT}) * onsets) / (sum(({WEIGHT}) * exposure_s) / 3600) AS rate FROM dr GROUP BY r, h),
 ob AS (SELECT h, sum(onsets) / (sum(exposure_s) / 3600) AS o FROM bl WHERE exposure_s > 0 GROUP BY h),
 ca AS (SELECT h, any_value(o) AS observed_rate, quantile_cont(rate, 0.95) AS bootstrap_upper, avg(rate) AS bootstrap_mean FROM rt JOIN ob USING (h) GROUP BY h)"""


def candidates(spark, d):
    return cb.budget_candidates(blocks(spark, d), block_key=["source_id", "block"], budget=0.02, replicates=40, seed="k7")


@query("k7_budget_candidates", f"WITH {BOOT} SELECT h, round(observed_rate, 7) AS observed_rate, round(bootstrap_upper, 7) AS bootstrap_upper, round(bootstrap_mean, 7) AS bootstrap_mean, round(greatest(observed_rate, bootstrap_upper), 7) AS conservative_upper, greatest(observed_rate, bootstrap_upper) <= 0.02 AS meets_budget FROM ca")
def _(spark, d):
    return rounded(candidates(spark, d), "observed_rate", "bootstrap_upper", "bootstrap_mean", "conservative_upper", n=7)


@query("k7_selected_threshold", f"WITH {BOOT} SELECT min(CASE WHEN greatest(observed_rate, bootstrap_upper) <= 0.02 THEN h END) AS selected_h, count(*) AS n_candidates FROM ca")
def _(spark, d):
    return cb.select_smallest(candidates(spark, d))


@query("k18_corrected_selection", f"WITH {BOOT}, s AS (SELECT min(CASE WHEN bootstrap_upper <= 0.02 THEN h END) AS old_selected_h, min(CASE WHEN greatest(observed_rate, bootstrap_upper) <= 0.02 THEN h END) AS new_selected_h FROM ca) SELECT *, old_selected_h IS NOT DISTINCT FROM new_selected_h AS unchanged FROM s")
def _(spark, d):
    return cb.corrected_selection(candidates(spark, d), budget=0.02)


@query("k20_axis_gate", f"WITH {BOOT} SELECT min(CASE WHEN greatest(observed_rate, bootstrap_upper) <= 0.02 THEN h END) AS selected_h, 2::BIGINT AS n_axes, CASE WHEN min(CASE WHEN greatest(observed_rate, bootstrap_upper) <= 0.02 THEN h END) IS NULL THEN 'blocked_no_threshold' ELSE 'allowed' END AS decision FROM ca")
def _(spark, d):
    cov = rb.median_mad(telemetry(spark, d), ["x", "alt"]).select(F.col("channel").alias("axis"), F.col("usable").alias("calibrated"))
    return cb.axis_gate(cov, cb.select_smallest(candidates(spark, d)), axes=["x", "alt"])


@query("k11_pareto_points", f"WITH {BOOT}, v AS (SELECT unnest([1.0, 3.0, 9.0])::DOUBLE AS point) SELECT point, arg_min(h, (abs(observed_rate - 0.5 * point / 100), h)) AS h, round(arg_min(observed_rate, (abs(observed_rate - 0.5 * point / 100), h)), 7) AS observed_rate FROM ca, v GROUP BY point")
def _(spark, d):
    out = cb.pareto_points(candidates(spark, d), grid=[1.0, 3.0, 9.0], share=0.5, rate="observed_rate")
    return rounded(out, "observed_rate", n=7)


def fresh(rows, track):
    out = dc.simple_page_sums(rows, track, {"x": (F.col("x") - 45) / 30}, slack=0.25, max_gap_s=86400.0, evaluable=~F.col("on_ground"))
    return out.withColumn("cusum_score", F.round(sc.settled(F.col("cusum_score")), 1) + F.lit(0.0))


BLOCKED = SIMPLE.replace("FROM tel", "FROM telb").replace("source_id", "flight_block")
K8 = f"""telb AS (SELECT *, source_id || ':' || CAST(floor((t - t0) / 604800) AS BIGINT) AS flight_block FROM (SELECT *, min(t) OVER (PARTITION BY source_id) AS t0 FROM tel)), {BLOCKED},
 q AS (SELECT flight_block, t, row_pos, rst, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 1) AS DOUBLE) AS score FROM s),
 bl AS (SELECT flight_block, max(t) - min(t) AS exposure_s FROM q GROUP BY 1 HAVING count(*) >= 2 AND max(t) > min(t)),
 l AS (SELECT q.*, CASE WHEN rst THEN 0 ELSE coalesce(lag(score) OVER (PARTITION BY flight_block ORDER BY t, row_pos), 0) END AS ps FROM q SEMI JOIN bl USING (flight_block)),
 hh AS (SELECT DISTINCT score AS h FROM l WHERE score > 2.3e-16),
 c AS (SELECT flight_block, h, t, row_number() OVER (PARTITION BY flight_block, h ORDER BY t, row_pos) AS i FROM l, hh WHERE ps < h AND score >= h),
 fold AS (SELECT flight_block, h, t AS last, i, true AS emit FROM c WHERE i = 1 UNION ALL
  SELECT c.flight_block, c.h, CASE WHEN c.t - f.last >= 86400 THEN c.t ELSE f.last END, c.i, c.t - f.last >= 86400 FROM fold f JOIN c ON c.flight_block = f.flight_block AND c.h = f.h AND c.i = f.i + 1),
 ct AS (SELECT flight_block, h, count(*) AS onsets FROM fold WHERE emit GROUP BY ALL),
 wt AS MATERIALIZED (SELECT flight_block, exposure_s, r, {WEIGHT} AS w FROM (SELECT flight_block, exposure_s, r, {UNIT.format("'k8' || chr(0) || r || chr(0) || split_part(flight_block, ':', 1) || chr(0) || split_part(flight_block, ':', 2)")} AS u FROM bl, (SELECT unnest(range(0, 30)) AS r))),
 ex AS (SELECT r, sum(w * exposure_s) / 3600 AS hours FROM wt GROUP BY r), sm AS (SELECT h, r, sum(w * onsets) AS n FROM ct JOIN wt USING (flight_block) GROUP BY ALL),
 rt AS (SELECT h, r, coalesce(n, 0) / hours AS rate FROM hh CROSS JOIN ex LEFT JOIN sm USING (h, r)), mn AS (SELECT h, avg(rate) AS m, median(rate) AS med, quantile_cont(rate, 0.95) AS p95 FROM rt GROUP BY h),
 best AS (SELECT min(h) AS h FROM mn WHERE m <= 0.01)"""


@query("k8_mean_rate_threshold", f"""WITH RECURSIVE {K8} SELECT round((SELECT coalesce(max(h), 0) FROM hh WHERE h < best.h), 6) AS threshold_h, (SELECT CAST(coalesce(sum(onsets), 0) AS BIGINT) FROM ct WHERE ct.h = best.h) AS observed_alarms,
 (SELECT round(sum(exposure_s) / 3600, 6) FROM bl) AS observed_hours, (SELECT count(*) FROM bl) AS n_blocks, round(m, 7) AS bootstrap_mean, round(med, 7) AS bootstrap_median, round(p95, 7) AS bootstrap_p95 FROM best JOIN mn USING (h)""")
def _(spark, d):
    out = cb.mean_rate_threshold(
        telemetry(spark, d), TRACK, score=fresh, column="cusum_score", reset="reset", block_s=604800.0, target_per_hour=0.01, refractory_s=86400.0, replicates=30, seed="k8")
    return rounded(rounded(out, "threshold_h", "observed_hours"), "bootstrap_mean", "bootstrap_median", "bootstrap_p95", n=7)


@query("k8_crossing_counts", f"""WITH RECURSIVE {SIMPLE}, b AS (SELECT * REPLACE (round(score, 9) AS score), CAST(floor(t / 604800) AS BIGINT) AS block FROM s), l AS (SELECT *, CASE WHEN rst THEN 0 ELSE coalesce(lag(score) OVER (PARTITION BY source_id, block ORDER BY t, row_pos), 0) END AS ps FROM b),
 hh AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS h), c AS (SELECT source_id, block, h, t, row_number() OVER (PARTITION BY source_id, block, h ORDER BY t, row_pos) AS i FROM l, hh WHERE ps < h AND score >= h),
 fold AS (SELECT source_id, block, h, t AS last, i, true AS emit FROM c WHERE i = 1 UNION ALL
  SELECT c.source_id, c.block, c.h, CASE WHEN c.t - f.last >= 86400 THEN c.t ELSE f.last END, c.i, c.t - f.last >= 86400 FROM fold f JOIN c ON c.source_id = f.source_id AND c.block = f.block AND c.h = f.h AND c.i = f.i + 1)
SELECT source_id, block, h, count(*) AS onsets FROM fold WHERE emit GROUP BY ALL""")
def _(spark, d):
    s = simple(spark, d).withColumn("block", F.floor(F.col("t") / 604800))
    return cb.crossing_counts(s, TRACK, score="cusum_score", reset=F.col("reset"), candidates=[0.5, 1.0, 2.0], refractory_s=86400.0, block="block")


CURVE = """v AS (SELECT *, round(x) AS s FROM tel), l AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY source_id ORDER BY t, row_pos), -1e9) AS p FROM v), hs AS (SELECT DISTINCT s AS threshold FROM v),
 cu AS (SELECT threshold, (SELECT count(*) FROM l WHERE p <= threshold AND s > threshold) AS onsets FROM hs)"""


@query("k9_threshold_curve", f"WITH {CURVE} SELECT threshold, onsets, round(onsets / ((SELECT count(*) FROM tel) * 60 / 3600), 6) AS fa_per_hour FROM cu UNION ALL SELECT 'infinity'::DOUBLE, 0, 0.0")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("s", F.round("x"))
    return rounded(cb.threshold_curve(rows, TRACK, score="s", stride_s=60.0), "fa_per_hour")


@query("k9_threshold_policy", f"WITH {CURVE} SELECT min(threshold) AS threshold, round(arg_min(onsets, threshold) / ((SELECT count(*) FROM tel) * 60 / 3600), 6) AS fa_per_hour FROM cu WHERE onsets / ((SELECT count(*) FROM tel) * 60 / 3600) <= 2.0")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("s", F.round("x"))
    return rounded(cb.fit_threshold_policy(rows, TRACK, score="s", stride_s=60.0, budget_per_hour=2.0), "fa_per_hour")


KON = """kk AS (SELECT * FROM (VALUES (2, 3), (3, 5)) kk(k, n)), v AS (SELECT tel.*, round(x) AS s, row_number() OVER (PARTITION BY source_id ORDER BY t, row_pos) AS rn FROM tel),
 e AS (SELECT a.source_id, a.rn, k, n, list_sort(list(b.s), 'DESC')[k] AS eff FROM v a JOIN v b ON a.source_id = b.source_id JOIN kk ON b.rn BETWEEN a.rn - n + 1 AND a.rn GROUP BY a.source_id, a.rn, k, n),
 l AS (SELECT *, coalesce(lag(coalesce(eff, -1e9)) OVER (PARTITION BY source_id, k, n ORDER BY rn), -1e9) AS p, coalesce(eff, -1e9) AS s FROM e), hs AS (SELECT DISTINCT k, n, eff AS h FROM e WHERE eff IS NOT NULL),
 cu AS (SELECT hs.k, hs.n, h, count(l.rn) AS onsets FROM hs LEFT JOIN l ON l.k = hs.k AND l.n = hs.n AND p <= h AND s > h GROUP BY ALL),
 f AS (SELECT k, n, min(h) AS threshold, arg_min(onsets, h) AS o FROM cu WHERE onsets / ((SELECT count(*) FROM tel) * 60 / 3600) <= 2.0 GROUP BY k, n)"""


@query("k9_k_of_n_policy", f"WITH {KON} SELECT threshold, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, round(o / ((SELECT count(*) FROM tel) * 60 / 3600), 6) AS fa_per_hour FROM f ORDER BY threshold, n, k LIMIT 1")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("s", F.round("x"))
    return rounded(cb.fit_k_of_n_policy(rows, TRACK, score="s", stride_s=60.0, budget_per_hour=2.0), "fa_per_hour")


K9 = f"""lg AS (SELECT source_id, row_pos, t, ln(p / (1 - p)) AS g FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, x / (x + 40))) AS p FROM tel)), st AS (SELECT avg(g) AS mu, stddev_pop(g) AS sd FROM lg),
 zz AS MATERIALIZED (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY t, row_pos) - 1 AS at, (g - mu) / sd AS z FROM lg, st),
 nm AS (SELECT source_id, n, row_number() OVER (ORDER BY sha256(source_id)) - 1 AS no, count(*) OVER () AS k FROM (SELECT source_id, count(*) AS n FROM zz GROUP BY 1) WHERE n >= 10),
 dw AS (SELECT id, source_id, n, CAST(floor({UNIT.format("'k9' || chr(0) || 'start' || chr(0) || id")} * (n - 9)) AS BIGINT) AS f FROM (SELECT unnest(range(0, 300)) AS id) JOIN nm ON no = CAST(floor({UNIT.format("'k9' || chr(0) || 'track' || chr(0) || id")} * k) AS BIGINT)),
 sr AS MATERIALIZED (SELECT id * 10 + i AS pos, z FROM dw, (SELECT unnest(range(0, 10)) AS i) JOIN zz ON zz.source_id = dw.source_id AND zz.at = f + i),
 zl AS MATERIALIZED (SELECT list(z ORDER BY pos) AS l FROM sr)"""


def page_fold(name: str, source: str) -> str:
    """Alarms of every h in ``source`` on the drawn stream."""
    return f"""{name}(h, i, s, skip, n) AS (SELECT h, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT FROM {source} UNION ALL
  SELECT h, i + 1, CASE WHEN skip > 0 OR v > h THEN 0.0 ELSE v END, CASE WHEN skip > 0 THEN skip - 1 WHEN v > h THEN 5 ELSE 0 END, n + CASE WHEN skip = 0 AND v > h THEN 1 ELSE 0 END
  FROM (SELECT *, greatest(0.0, s + l[i + 1] - 0.5) AS v FROM {name}, zl WHERE i < 3000))"""


@query("k9_page_policy", f"""WITH RECURSIVE {K9}, pw AS (SELECT 2.0::DOUBLE ** unnest(range(0, 21)) AS h), {page_fold("fa", "pw")},
 top AS (SELECT min(h) AS top FROM fa WHERE i = 3000 AND n / 50.0 <= 1.0), gr AS (SELECT top * unnest(range(1, 4097)) / 4096 AS h FROM top), {page_fold("fb", "gr")},
 rr AS MATERIALIZED (SELECT h, n / 50.0 AS r FROM fb WHERE i = 3000),
 bs(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, top FROM top UNION ALL SELECT k + 1, CASE WHEN r <= 1.0 THEN lo ELSE h END, CASE WHEN r <= 1.0 THEN h ELSE hi END FROM bs JOIN rr ON h = (lo + hi) / 2 WHERE k < 12)
SELECT round(mu, 6) AS mu, round(sd, 6) AS sigma, round(hi, 6) AS h, r AS fa_per_hour, r <= 1.0 AS meets_budget FROM bs JOIN rr ON h = hi, st WHERE k = 12""")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("p", F.col("x") / (F.col("x") + 40))
    out = cb.fit_page_policy(rows, TRACK, score="p", slack=0.5, budget_per_hour=1.0, stride_s=60.0, hours=50.0, block_s=600.0, refractory_s=300.0, seed="k9")
    return rounded(out, "mu", "sigma", "h")


def p_rows(spark, d):
    """Two channels; the second lacks every seventh cell."""
    i = F.col("row_pos")
    return telemetry(spark, d).withColumns({"p1": (1.0 + i * 7919 % 997) / 998.0, "p2": F.when(i % 7 != 0, (1.0 + i * 5003 % 991) / 992.0)})


ALPHAS = [float(a) for a in np.geomspace(0.02, 1.8, 8)]
ALPHA = f"""al AS (SELECT unnest({ALPHAS})::DOUBLE AS alpha),
 ch AS (SELECT source_id, t, row_pos, 1 AS c, (1.0 + row_pos * 7919 % 997) / 998.0 AS p FROM tel UNION ALL SELECT source_id, t, row_pos, 2, (1.0 + row_pos * 5003 % 991) / 992.0 FROM tel WHERE row_pos % 7 <> 0),
 d AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id, c ORDER BY t, row_pos) AS dt FROM ch),
 x AS (SELECT *, dt IS NULL OR dt <= 0 OR dt > 86400 OR p > alpha / 2 AS mk FROM d, al), g AS (SELECT *, sum(CASE WHEN mk THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, c, alpha ORDER BY t, row_pos) AS k FROM x),
 e AS (SELECT *, sum(CASE WHEN mk THEN 0 ELSE dt END) OVER (PARTITION BY source_id, c, alpha, k ORDER BY t, row_pos) AS ev FROM g), a AS (SELECT DISTINCT source_id, alpha, t, row_pos FROM e WHERE ev >= 21600),
 o AS (SELECT alpha, t - lag(t) OVER (PARTITION BY source_id, alpha ORDER BY t, row_pos) AS gp FROM a), c AS (SELECT alpha, count(*) FILTER (WHERE gp IS NULL OR gp > 86400) AS n FROM o GROUP BY alpha),
 td AS (SELECT t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM tel), hr AS (SELECT sum(CASE WHEN dt > 0 AND dt <= 86400 THEN dt ELSE 0 END) / 3600 AS hours FROM td), cv AS (SELECT alpha, coalesce(n, 0) / hours AS eph FROM al LEFT JOIN c USING (alpha), hr)"""


def alpha_table(spark, d):
    return cb.alpha_curve(p_rows(spark, d), TRACK, p_values=["p1", "p2"], alphas=ALPHAS, persistence_s=21600.0, max_gap_s=86400.0, merge_gap_s=86400.0, evaluable=F.lit(True))


@query("k10_alpha_curve", f"WITH {ALPHA} SELECT round(alpha, 9) AS alpha, round(eph, 7) AS episodes_per_hour FROM cv")
def _(spark, d):
    return rounded(rounded(alpha_table(spark, d), "episodes_per_hour", n=7), "alpha", n=9)


@query("k10_alpha_selection", f"WITH {ALPHA} SELECT round(max(alpha), 9) AS alpha, round(arg_max(eph, alpha), 7) AS episodes_per_hour FROM cv WHERE eph <= 0.005")
def _(spark, d):
    return rounded(rounded(cb.select_alpha(alpha_table(spark, d), budget_per_hour=0.005), "episodes_per_hour", n=7), "alpha", n=9)


def gate_metrics(spark, d, *by):
    method = F.when(F.col("source_type") == "view", "native").when(F.col("source_type") == "click", "cusum").otherwise("model")
    m = telemetry(spark, d).groupBy(*by, method.alias("method")).agg(F.avg((F.col("x") > 20).cast("double")).alias("recall"))
    return m.withColumns({"coverage": F.lit(0.9), "event_coverage": F.lit(0.9), "recall_low": F.col("recall") - 0.05, "min_mode_recall": F.col("recall"), "rate": F.lit(0.5)})


GATE = {"coverage_min": 0.8, "event_coverage_min": 0.8, "recall_min": 0.5, "wilson_lower_min": 0.0, "per_mode_recall_min": 0.0, "max_rate": 1.0}
METHOD = "CASE WHEN source_type = 'view' THEN 'native' WHEN source_type = 'click' THEN 'cusum' ELSE 'model' END"
GATE_SQL = """SELECT {by}CASE WHEN max(recall) FILTER (WHERE method = 'native') >= 0.5 THEN 'native' WHEN max(recall) FILTER (WHERE method = 'cusum') >= 0.5 THEN 'cusum'
 WHEN max(recall) FILTER (WHERE method = 'model') >= 0.5 AND max(recall) FILTER (WHERE method = 'model') >= max(recall) FILTER (WHERE method = 'cusum') + 0.10 THEN 'model' END AS selected, count(*) FILTER (WHERE recall >= 0.5) AS n_passing FROM m {group}"""


@query("k16_method_gate", f"WITH m AS (SELECT {METHOD} AS method, avg(CASE WHEN x > 20 THEN 1.0 ELSE 0 END) AS recall FROM tel GROUP BY 1) {GATE_SQL.format(by='', group='')}")
def _(spark, d):
    return cb.method_gate(gate_metrics(spark, d), GATE, order=["native", "cusum", "model"], baseline="cusum", model="model")


@query("k16_method_gate_by_entity", f"WITH m AS (SELECT source_id, {METHOD} AS method, avg(CASE WHEN x > 20 THEN 1.0 ELSE 0 END) AS recall FROM tel GROUP BY ALL) {GATE_SQL.format(by='source_id, ', group='GROUP BY source_id')}")
def _(spark, d):
    return cb.method_gate(gate_metrics(spark, d, "source_id"), GATE, order=["native", "cusum", "model"], baseline="cusum", model="model", by=["source_id"])


# ---------------------------------------------------------------- models
RIDGE = """r AS (SELECT source_id, row_pos, ground_speed_ms AS f, x + ground_speed_ms / 4 AS y FROM tel), m AS (SELECT avg(f) AS mf, avg(y) AS my FROM r),
 c AS (SELECT sum((f - mf) * (y - my)) / (sum((f - mf) * (f - mf)) + 1000.0) AS b, any_value(mf) AS mf, any_value(my) AS my FROM r, m)"""


def ridge_rows(spark, d):
    return telemetry(spark, d).withColumn("y", F.col("x") + F.col("ground_speed_ms") / 4)


@query("k4_ridge_residuals", f"WITH {RIDGE} SELECT row_pos, round(y, 5) AS y, round(my + b * (f - mf), 5) AS y_hat, round(y - my - b * (f - mf), 5) AS r FROM r, c")
def _(spark, d):
    rows = ridge_rows(spark, d)
    fit = md.fit_ridge(rows, features=["ground_speed_ms"], response="y", group="source_id", alphas=[1000.0])
    out = md.residual_table(rows, fit, response="y", keep=["row_pos"], channel="y").drop("channel")
    return rounded(out, "y", "y_hat", "r", n=5)


@query("d44_ablation_ratio", f"""WITH {RIDGE}, s AS (SELECT var_pop(y) AS v0 FROM r), f AS (SELECT avg(power(y - my - b * (f - mf), 2)) AS v1 FROM r, c)
SELECT round(v1, 5) AS full_variance, round(v0, 5) AS reduced_variance, round(v0 / v1, 5) AS ratio, v0 / v1 < 1.02 AS flagged FROM s, f""")
def _(spark, d):
    rows = ridge_rows(spark, d).withColumn("zero", F.lit(0.0))
    out = md.ablation_ratio(rows, features=["ground_speed_ms", "zero"], commands=["ground_speed_ms"], response="y", group="source_id", alpha=1000.0, minimum=1.02)
    return rounded(out, "full_variance", "reduced_variance", "ratio", n=5)


def matrix(spark, d):
    tel = telemetry(spark, d).withColumns({
        "phase": F.when(F.col("on_ground"), "ground").when(F.col("roll_deg") > 20, "maneuver").otherwise("cruise"), "bnd": F.col("row_pos") % 10 == 0,
    })
    onset = tel.groupBy("source_id").agg((F.min("t_us") + 20 * 24 * HOUR).alias("onset"))
    return md.build_matrix(
        tel.join(onset, "source_id"), MICROS, commands=["roll_deg"], context=["x"], response="vertical_rate_ms", speed="ground_speed_ms", phase="phase",
        boundary="bnd", horizon=12 * HOUR, unit=HOUR, onset="onset", ages=((0.0, 6.0), (6.0, 24.0)),
    )


@query("k5_build_matrix", f"""WITH m AS (SELECT a.row_pos, any_value(a.t_us) AS t_us, any_value(a.ground_speed_ms) AS sp, any_value(a.roll_deg) AS roll,
 sum(CASE WHEN a.t_us - b.t_us <= {6 * HOUR} AND b.t_us <= a.t_us THEN (1 + (6.0 - (a.t_us - b.t_us) / {HOUR}.0) / 6.0) * b.roll_deg END) / sum(CASE WHEN a.t_us - b.t_us <= {6 * HOUR} AND b.t_us <= a.t_us THEN 1 + (6.0 - (a.t_us - b.t_us) / {HOUR}.0) / 6.0 END) AS w0,
 sum(CASE WHEN a.t_us - b.t_us >= {6 * HOUR} AND a.t_us - b.t_us < {24 * HOUR} THEN (1 + (24.0 - (a.t_us - b.t_us) / {HOUR}.0) / 18.0) * b.roll_deg END) / sum(CASE WHEN a.t_us - b.t_us >= {6 * HOUR} AND a.t_us - b.t_us < {24 * HOUR} THEN 1 + (24.0 - (a.t_us - b.t_us) / {HOUR}.0) / 18.0 END) AS w1,
 avg(CASE WHEN b.t_us > a.t_us THEN b.vertical_rate_ms END) AS y FROM tel a JOIN tel b ON a.source_id = b.source_id AND b.t_us BETWEEN a.t_us - {24 * HOUR} AND a.t_us + {12 * HOUR}
 WHERE NOT a.on_ground AND a.row_pos % 10 <> 0 GROUP BY a.row_pos), o AS (SELECT source_id, min(t_us) + {20 * 24 * HOUR} AS onset FROM tel GROUP BY source_id)
SELECT m.row_pos, round(w0, 5) AS w0, round(w1, 5) AS w1, sp * roll AS inter, round(y, 5) AS target, m.t_us < onset - {10 * HOUR} AS train_eligible FROM m JOIN tel USING (row_pos) JOIN o USING (source_id) WHERE w0 IS NOT NULL AND w1 IS NOT NULL AND y IS NOT NULL""")
def _(spark, d):
    m = matrix(spark, d)
    return m.select("row_pos", r6("roll_deg__tri_0", 5).alias("w0"), r6("roll_deg__tri_1", 5).alias("w1"), F.col("roll_deg__speed_interaction").alias("inter"), r6("target", 5).alias("target"), "train_eligible")


@query("k15_linear_surprise")
def _(spark, d):
    rows = telemetry(spark, d)
    return md.linear_surprise(
        rows, features=["ground_speed_ms", "track_deg"], targets=["x", "alt"], group="source_id", alphas=[1.0, 100.0], keep=["row_pos"],
        fit_rows=F.col("row_pos") % 2 == 0,
    )


@query("k6_isolation_forest")
def _(spark, d):
    tel = telemetry(spark, d)
    scales = rb.parameters(rb.median_mad(tel, ["x", "alt", "vertical_rate_ms"]))
    model = md.fit_forest(tel, scales, trees=50, sample=128, seed="k6", key=["row_pos"])
    return md.score_forest(tel, model, scales).select("row_pos", "isolation_score")


# ---------------------------------------------------------------- injections
BASE = "i AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, row_pos) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM tel)"


@query("h33_inject_freeze", f"""WITH {BASE}, a AS (SELECT *, rn > floor(n * 0.6) AS act FROM i)
SELECT row_pos, act AS injection_active, CASE WHEN act THEN last_value(CASE WHEN NOT act THEN x END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY t, row_pos) ELSE x END AS x FROM a""")
def _(spark, d):
    return ij.inject(telemetry(spark, d), TRACK, ij.Recipe("freeze", ("x",), onset=0.6)).select("row_pos", "injection_active", "x")


@query("h33_inject_bias", f"WITH {BASE} SELECT row_pos, round(CASE WHEN rn > floor(n * 0.5) THEN x + 3 * stddev_samp(x) OVER (PARTITION BY source_id) ELSE x END, 4) AS x FROM i")
def _(spark, d):
    return rounded(ij.inject(telemetry(spark, d), TRACK, ij.Recipe("bias", ("x",), size=3.0)).select("row_pos", "x"), "x", n=4)


@query("h33_inject_noise", f"""WITH {BASE}, u AS (SELECT *, {UNIT.format("'u' || chr(0) || 'z' || chr(0) || 'x' || chr(0) || source_id || chr(0) || rn")} AS u, {UNIT.format("'v' || chr(0) || 'z' || chr(0) || 'x' || chr(0) || source_id || chr(0) || rn")} AS v FROM i)
SELECT row_pos, round(CASE WHEN rn > floor(n * 0.5) THEN x + 2 * stddev_samp(x) OVER (PARTITION BY source_id) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) ELSE x END, 4) AS x FROM u""")
def _(spark, d):
    return rounded(ij.inject(telemetry(spark, d), TRACK, ij.Recipe("noise", ("x",), size=2.0, seed="z")).select("row_pos", "x"), "x", n=4)


@query("h33_inject_dropout", f"""WITH {BASE}, b AS (SELECT *, greatest(floor(n * 0.25), 1) AS sz, {UNIT.format("'q' || chr(0) || 'block' || chr(0) || source_id")} AS u FROM i), s AS (SELECT *, floor(u * (n - sz + 1)) AS st FROM b)
SELECT row_pos, rn > st AND rn <= st + sz AS injection_active, CASE WHEN NOT (rn > st AND rn <= st + sz) THEN alt END AS alt FROM s""")
def _(spark, d):
    return ij.inject(telemetry(spark, d), TRACK, ij.Recipe("dropout", ("alt",), block_share=0.25, seed="q")).select("row_pos", "injection_active", "alt")


@query("h33_inject_ramp", f"""WITH {BASE}, a AS (SELECT *, rn > floor(n * 0.5) AS act FROM i), o AS (SELECT *, min(CASE WHEN act THEN t END) OVER (PARTITION BY source_id) AS o FROM a)
SELECT row_pos, round(CASE WHEN act THEN lat + 0.002 * (t - o) * cos(radians(60.0)) / 111320.0 ELSE lat END, 8) AS lat FROM o""")
def _(spark, d):
    r = ij.Recipe("ramp", ("lat", "lon"), size=0.002, bearing_deg=60.0)
    return rounded(ij.inject(telemetry(spark, d), TRACK, r).select("row_pos", "lat"), "lat", n=8)


@query("h34_annotate_truth", f"""WITH {BASE}, a AS (SELECT *, rn > floor(n * 0.5) AS act, CASE WHEN rn > floor(n * 0.5) THEN NULL ELSE alt END AS alt2 FROM i),
 c AS (SELECT *, alt2 IS DISTINCT FROM alt AS chg FROM a) SELECT row_pos, act AS injection_active, chg AS observable_changed, min(CASE WHEN act THEN t END) OVER (PARTITION BY source_id) AS attack_onset,
 max(CASE WHEN act THEN t END) OVER (PARTITION BY source_id) AS event_end, min(CASE WHEN chg THEN t END) OVER (PARTITION BY source_id) AS observable_onset, x < 100 AS evaluable_truth FROM c""")
def _(spark, d):
    clean = telemetry(spark, d)
    bad = ij.inject(clean, TRACK, ij.Recipe("freeze", ("lat",)))
    bad = bad.withColumn("alt", F.when(~F.col("injection_active"), F.col("alt")))
    changed = ij.observable_changed(clean, bad, on=["row_pos"], time="t", columns=["alt"])
    out = ij.annotate_truth(bad, changed, TRACK, on=["row_pos"], evaluable=F.col("x") < 100)
    return out.select("row_pos", "injection_active", "observable_changed", "attack_onset", "event_end", "observable_onset", "evaluable_truth")
