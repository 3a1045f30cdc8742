"""Event truth, detection, ranking diagnostics, burden reports and statistical gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.ladder import ladder
from trackweave.plans.select import exact_quantiles
from trackweave.plans.track import Lag, Running, Track, Whole, sweep

true = lambda c: F.coalesce(c, F.lit(False))


def truth_events(rows: DataFrame, *, flight: str = "flight_id") -> DataFrame:
    """One row per event with its scalars, row counts and eligibility; an inconsistent scalar raises."""
    scalars = ["event_type", flight, "attack_onset", "observable_onset", "event_end"]
    types = {c: rows.schema[c].dataType for c in scalars}
    ev, active = rows.filter(F.col("event_id").isNotNull()), true(F.col("injection_active"))
    fine, changed = true(F.col("evaluable_truth")), true(F.col("observable_changed"))
    agg = ev.groupBy("event_id").agg(
        *[F.min(c).alias(f"_lo_{c}") for c in scalars], *[F.max(c).alias(f"_hi_{c}") for c in scalars],
        F.count_if(active).alias("attack_active_rows"), F.count_if(active & fine).alias("evaluable_active_rows"),
        F.count_if(changed & fine).alias("observable_changed_rows"),
    )
    clash = lambda c: F.raise_error(F.concat(F.lit(f"inconsistent {c} in event "), F.col("event_id").cast("string"))).cast(types[c])
    out = agg.select(
        "event_id", *[F.when(F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")), F.col(f"_lo_{c}")).otherwise(clash(c)).alias(c) for c in scalars],
        "attack_active_rows", "evaluable_active_rows", "observable_changed_rows",
    )
    attack = (F.col("attack_active_rows") > 0) & (F.col("evaluable_active_rows") > 0)
    seen = attack & (F.col("observable_changed_rows") > 0) & F.col("observable_onset").isNotNull() & F.col("event_end").isNotNull()
    return out.withColumns({"attack_eligible": attack, "observable_eligible": seen, "active_but_unobservable": attack & ~seen})


def observability(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n_declared"), F.count_if("attack_eligible").alias("n_attack_eligible"),
        F.count_if("observable_eligible").alias("n_observable_eligible"), F.count_if("active_but_unobservable").alias("n_unobservable"),
    )


def detection_summary(per_event: DataFrame, *, groups: Sequence[str] = ()) -> DataFrame:
    """Recall with its Wilson interval, median and p95 delay of the detected, coverage when present."""
    g = list(groups)
    aggs = [F.count(F.lit(1)).alias("n_events"), F.count_if("detected").alias("n_detected")]
    if "covered_s" in per_event.columns:
        aggs += [F.avg("fraction").alias("macro_coverage"), F.try_divide(F.sum("covered_s"), F.sum("duration_s")).alias("micro_coverage")]
    probs = {"median_delay_s": 0.5, "p95_delay_s": 0.95}
    base = per_event.groupBy(*g).agg(*aggs)
    q = exact_quantiles(per_event.filter("detected"), g, "first_alarm_delay_s", probs)
    if g:
        out = base.join(q.drop("n"), g, "left")
    else:
        out = base.withColumn("_q", q.select(F.struct(*probs)).scalar())
        out = out.withColumns({k: F.col("_q")[k] for k in probs}).drop("_q")
    low, high = sc.wilson(F.col("n_detected"), F.col("n_events"))
    return out.withColumns({"recall": F.col("n_detected") / F.col("n_events"), "recall_low": low, "recall_high": high})


def recall_by_mode(per_event: DataFrame, *, mode: str) -> DataFrame:
    """Recall per fault mode plus the total (null mode), from one rollup."""
    out = per_event.rollup(mode).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("detected").alias("n_detected"))
    return out.withColumn("recall", F.col("n_detected") / F.col("n_events"))


def _classes(rows: DataFrame, groups: Sequence[str], score: str, positive: Column, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return ladder(rows, groups, score, {"pos": F.when(positive, w).otherwise(0.0), "neg": F.when(positive, 0.0).otherwise(w)})


def ranking_metrics(rows: DataFrame, *, score: str, positive: Column, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Exact AUROC (ties count half) and average precision over distinct scores; null without both classes."""
    steps = _classes(rows, groups, score, positive, weight)
    pos, neg, tp = F.col("tot_pos"), F.col("tot_neg"), F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    agg = steps.groupBy(*groups).agg(
        F.max(pos).alias("n_positive"), F.max(neg).alias("n_negative"), wins.alias("_u"), F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("_ap"),
    )
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return agg.withColumns({
        "auroc": F.when(both, F.col("_u") / (F.col("n_positive") * F.col("n_negative"))),
        "auprc": F.when(both, F.col("_ap") / F.col("n_positive")),
    }).drop("_u", "_ap")


def window_diagnostics(rows: DataFrame, *, q: str = "q_w", score: str = "score") -> DataFrame:
    """Primary (q > 0) and steady-state (q in {0, 1}) ranking metrics with the unscoreable count; q outside [0,1] raises."""
    qv, sv = sc.finite(F.col(q)), sc.finite(F.col(score))
    safe = F.when(qv.isNull() | qv.between(0, 1), qv).otherwise(F.raise_error(F.lit("q outside the unit interval")).cast("double"))
    base = rows.select(safe.alias("_q"), sv.alias("_s"))
    counts = base.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("_q").isNull() | F.col("_s").isNull()).alias("n_unscoreable"))
    usable = base.filter(F.col("_q").isNotNull() & F.col("_s").isNotNull())
    views = F.array_compact(F.array(F.lit("primary"), F.when(F.col("_q").isin(0.0, 1.0), "steady")))
    long = usable.withColumn("view", F.explode(views))
    out = ranking_metrics(long, score="_s", positive=F.col("_q") > 0, groups=["view"])
    n = counts.select(F.struct("n_input", "n_unscoreable").alias("n")).scalar()
    return out.withColumns({"n_input": n["n_input"], "n_unscoreable": n["n_unscoreable"]})


def q_strata(rows: DataFrame, *, q: str = "q_w") -> DataFrame:
    v = sc.finite(F.col(q))
    bad = F.when(v.isNull() | v.between(0, 1), v).otherwise(F.raise_error(F.lit("q outside the unit interval")).cast("double"))
    return rows.select(bad.alias("_q")).agg(
        F.count_if(F.col("_q").isNull()).alias("unscoreable"), F.count_if(F.col("_q") == 0).alias("q_eq_0"),
        F.count_if((F.col("_q") > 0) & (F.col("_q") < 1)).alias("q_mixed"), F.count_if(F.col("_q") == 1).alias("q_eq_1"),
    )


def bounded_roc(rows: DataFrame, *, score: str, positive: Column, max_points: int = 201) -> DataFrame:
    """At most ``max_points`` evenly spaced points of the exact ROC curve, ends included.

    Points inside a straight stretch are no corner of the curve and not counted. Empty
    without both classes.
    """
    if max_points < 2:
        raise ValueError("max_points must be at least 2")
    steps = _classes(rows, [], score, positive, None).filter((F.col("tot_pos") > 0) & (F.col("tot_neg") > 0))
    numbered = ladder(rows, [], score, {"i": F.lit(0)}).select(score)  # distinct scores
    rank = ladder(numbered, [], score, {"i": F.lit(1).cast("long")}).select(score, F.col("cum_i").alias("i"), F.col("tot_i").alias("m"))
    pts = steps.join(rank, score).withColumn("_all", F.lit(0))
    up, down = Track(("_all",), ("i",), 100_000), Track(("_all",), ("k",), 100_000)
    pts = sweep(pts, up, {"_b": Lag(F.struct("pos", "neg"))})  # the next lower score
    # the first threshold is the highest score, so number from the top
    corner = (F.col("i") == F.col("m")) | (F.col("i") == 1) | (F.col("_b.pos") != F.col("pos")) | (F.col("_b.neg") != F.col("neg"))
    kept = pts.filter(corner).withColumn("k", F.col("m") - F.col("i"))
    one = F.lit(1).cast("long")
    kept = sweep(kept, down, {"idx": Running(one), "n": Whole(one)})
    tpr = (F.col("tot_pos") - F.col("cum_pos") + F.col("pos")) / F.col("tot_pos")
    fpr = (F.col("tot_neg") - F.col("cum_neg") + F.col("neg")) / F.col("tot_neg")
    # index 0 is the origin, so the curve has n + 1 points
    last = F.col("n")
    j = F.ceil(F.col("idx") * (max_points - 1) / last)
    keep = (last + 1 <= max_points) | (F.floor(j * last / (max_points - 1)) == F.col("idx"))
    body = kept.select(F.col("idx").alias("point"), fpr.alias("fpr"), tpr.alias("tpr"), keep.alias("_k"), (last + 1).alias("n_exact_points")).filter("_k").drop("_k")
    origin = body.groupBy().agg(F.max("n_exact_points").alias("n_exact_points")).filter(F.col("n_exact_points").isNotNull()).select(
        F.lit(0).cast("long").alias("point"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), "n_exact_points"
    )
    return body.unionByName(origin).orderBy("point")


def sampled_ranking(rows: DataFrame, *, score: str, positive: Column, cap: int, seed: str, key: Sequence[str]) -> DataFrame:
    """AUROC and AUPRC of a per-class bounded sample, classes weighted population/sample."""
    from trackweave.operators.sampling import bottom_k

    base = rows.withColumn("_y", positive).filter(sc.finite(F.col(score)).isNotNull())
    pop = base.groupBy("_y").agg(F.count(F.lit(1)).alias("_pop"))
    kept = bottom_k(base, k=cap, seed=seed, key=key, groups=["_y"]).join(pop, "_y")
    kept = kept.withColumn("_w", F.col("_pop") / F.least(F.col("_pop"), F.lit(cap)))
    return ranking_metrics(kept, score=score, positive=F.col("_y"), weight=F.col("_w"))


def average_ranks(df: DataFrame, *, value: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank of the value with ties sharing their mean rank."""
    steps = ladder(df, groups, value, {"n": F.lit(1).cast("long")})
    rank = steps.select(*groups, value, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(out))
    return df.join(rank, [*groups, value], "left")


def spearman(df: DataFrame, a: str, b: str, *, groups: Sequence[str] = (), threshold: float | None = None, min_rows: int = 3) -> DataFrame:
    """Rank correlation; constant input or fewer than ``min_rows`` rows is not evaluable."""
    rows = df.filter(sc.finite(F.col(a)).isNotNull() & sc.finite(F.col(b)).isNotNull())
    rows = average_ranks(average_ranks(rows, value=a, out="_ra", groups=groups), value=b, out="_rb", groups=groups)
    g = rows.groupBy(*groups) if groups else rows.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("_r"), F.stddev_pop("_ra").alias("_sa"), F.stddev_pop("_rb").alias("_sb"))
    ok = (F.col("n") >= min_rows) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    out = out.select(*groups, "n", F.when(ok, F.col("_r")).alias("rho"), F.when(ok, "evaluated").otherwise("not_evaluable").alias("status"))
    return out if threshold is None else out.withColumn("flagged", F.coalesce(F.col("rho") >= threshold, F.lit(False)))


def magnitude_domination(df: DataFrame, *, trained: str, untrained: str, magnitude: str, threshold: float = 0.8) -> DataFrame:
    """Flag scores whose ranks follow an untrained model or the plain magnitude."""
    one = spearman(df, trained, untrained).select(F.col("rho").alias("rho_untrained"))
    two = spearman(df, trained, magnitude).select(F.col("rho").alias("rho_magnitude"))
    rho2 = two.scalar()
    out = one.withColumn("rho_magnitude", rho2)
    hit = true(F.col("rho_untrained") >= threshold) | true(F.col("rho_magnitude") >= threshold)
    return out.withColumn("flagged", hit)


def _ks_exact(n: int, m: int, ks: float) -> float:
    """Share of the orders of n and m distinct values whose distance reaches ``ks``.

    Moves along the diagonals of the grid of counts seen so far: the share that has reached
    the distance by (i, j) is the mean of its predecessors weighted by i and j, or one.
    """
    reached, i = np.zeros(n + 1), np.arange(n + 1)
    for step in range(1, n + m + 1):
        j = step - i
        before = np.concatenate(([0.0], reached[:-1]))
        reached = np.where((j >= 0) & (j <= m), (i * before + j * reached) / step, 0.0)
        reached[(j >= 0) & (j <= m) & (np.abs(i / n - j / m) >= ks - 1e-9)] = 1.0
    return float(reached[n])


def ks_gate(
    df: DataFrame, *, value: str, is_post: Column, groups: Sequence[str], p_threshold: float, terms: int = 100, exact_limit: int = 10_000,
) -> DataFrame:
    """Two-sample KS statistic of pre and post pools per group with its p-value; a missing pool is not evaluable.

    The p-value is exact while both pools hold at most ``exact_limit`` rows, asymptotic beyond.
    """
    steps = ladder(df, groups, value, {"post": F.when(is_post, 1).otherwise(0).cast("long"), "pre": F.when(is_post, 0).otherwise(1).cast("long")})
    gap = F.abs(F.try_divide(F.col("cum_post"), F.col("tot_post")) - F.try_divide(F.col("cum_pre"), F.col("tot_pre")))
    out = steps.groupBy(*groups).agg(F.max("tot_pre").alias("n_pre"), F.max("tot_post").alias("n_post"), F.max(gap).alias("ks"))
    # one row per group is left: the exact count depends on two sizes and the statistic alone
    @F.pandas_udf("double")
    def exact(n: pd.Series, m: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([_ks_exact(int(a), int(b), d) if 0 < max(a, b) <= exact_limit and d == d else np.nan for a, b, d in zip(n, m, ks)])

    lam = F.sqrt(F.col("n_pre") * F.col("n_post") / (F.col("n_pre") + F.col("n_post"))) * F.col("ks")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("_lam") * F.col("_lam")),
    )
    limit = F.when(F.col("_lam") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    small = F.greatest("n_pre", "n_post") <= exact_limit
    out = out.withColumns({"_lam": lam, "_exact": F.when(F.col("ks").isNotNull(), exact("n_pre", "n_post", "ks"))})
    p = F.when(F.col("ks").isNotNull(), F.when(small, F.col("_exact")).otherwise(limit))
    out = out.withColumn("p_value", p).drop("_lam", "_exact")
    status = F.when(F.col("ks").isNull(), "not_evaluable").when(F.col("p_value") < p_threshold, "passed").otherwise("failed")
    return out.withColumn("status", status)


def pre_post_pools(df: DataFrame, events: DataFrame, *, flight: str, time: str, onset: str, pre: tuple[float, float] = (-60.0, -10.0), post: tuple[float, float] = (0.0, 15.0)) -> DataFrame:
    """Rows around the onset of their flight's event, ``is_post`` telling the two pools apart."""
    rows = df.join(events.select(flight, onset), flight)
    rel = F.col(time) - F.col(onset)
    a, b = rel.between(*pre), rel.between(*post)
    return rows.filter(a | b).withColumn("is_post", b)


def policy_evaluation(rows: DataFrame, track: Track, *, onset: Column, truth: Column, label: str, event_start: str, max_step_s: float = 2.0, normal: str = "normal") -> DataFrame:
    """Per entity: detection, first delay, false alarms and normal seconds (steps of at most ``max_step_s`` that start outside truth)."""
    t = track.order[0]
    base = rows.withColumns({"_on": true(onset), "_tr": true(truth)})
    base = sweep(base, track, {"_p": Lag(F.struct(F.col(t).alias("t"), F.col("_tr").alias("tr")))})
    dt = F.col(t) - F.col("_p.t")
    hit = F.col("_on") & F.col("_tr")
    per = base.groupBy(*track.keys, label).agg(
        F.bool_or("_on").alias("_any"), F.bool_or(hit).alias("detected"),
        (F.min(F.when(hit, F.col(t))) - F.min(event_start)).alias("first_alarm_delay_s"),
        F.count_if(F.col("_on") & ~F.col("_tr")).alias("false_alarms"),
        F.coalesce(F.sum(F.when(~F.col("_p.tr") & (dt <= max_step_s), dt)), F.lit(0.0)).alias("normal_s"),
    )
    is_normal = F.col(label) == normal
    outcome = F.when(is_normal & F.col("_any"), "fp").when(is_normal, "tn").when(F.col("detected"), "tp").otherwise("fn")
    return per.withColumn("outcome", outcome).drop("_any")


def policy_summary(per_entity: DataFrame, *, label: str, normal: str = "normal") -> DataFrame:
    """Totals and per-label counts of ``policy_evaluation`` from one rollup."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    out = per_entity.rollup(label).agg(n("tp"), n("fn"), n("fp"), n("tn"), F.sum("false_alarms").alias("false_alarms"), F.sum("normal_s").alias("normal_s"))
    return out.withColumns({
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")),
        "false_alarms_per_hour": F.try_divide(F.col("false_alarms").cast("double"), F.col("normal_s") / 3600),
    })


def score_stats(rows: DataFrame, *, score: str, alarm: Column, groups: Sequence[str]) -> DataFrame:
    """n, alarm share, mean, median, p05 and p95 per group."""
    base = rows.withColumn("_a", true(alarm)).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_a").cast("double")).alias("alarm_fraction"), F.avg(score).alias("mean")
    )
    q = exact_quantiles(rows, groups, score, {"p05": 0.05, "median": 0.5, "p95": 0.95}).drop("n")
    return base.join(q, list(groups), "left")


def timeline_stratum(t: Column, onset: Column) -> Column:
    return F.when(onset.isNull(), "without_onset").when(t < onset, "before_onset").otherwise("after_onset")


def role_burden(per_flight: DataFrame, *, day: str, role: str, stratum: str, exposure: str, episodes: str) -> DataFrame:
    """Exposure, episodes, scoreable and alerted flights per (day, role) and per (day, role, stratum)."""
    out = per_flight.groupingSets([[day, role], [day, role, stratum]], day, role, stratum).agg(
        F.grouping(stratum).alias("is_total"), F.sum(exposure).alias("exposure_s"), F.sum(episodes).alias("episodes"),
        F.count_if(F.col(exposure) > 0).alias("scoreable_flights"), F.count_if(F.col(episodes) > 0).alias("alerted_flights"),
    )
    return out.withColumn("episodes_per_hour", F.try_divide(F.col("episodes").cast("double"), F.col("exposure_s") / 3600))


def stress_burden(per_case: DataFrame, *, keys: Sequence[str] = ("domain", "contract", "method"), budget: float, warn_factor: float = 2.0) -> DataFrame:
    """Episodes per hour per stress case with a warning beyond ``warn_factor`` x budget."""
    out = per_case.groupBy(*keys).agg(F.sum("episodes").alias("episodes"), F.sum("exposure_s").alias("exposure_s"))
    rate = F.try_divide(F.col("episodes").cast("double"), F.col("exposure_s") / 3600)
    return out.withColumn("episodes_per_hour", rate).withColumn("warning", true(F.col("episodes_per_hour") > warn_factor * budget))


def completeness(df: DataFrame, columns: Sequence[str], *, normal: Column) -> DataFrame:
    """Non-null share per column: overall, on normal rows and on the others."""
    flags = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), sc.finite(F.col(c)).isNotNull().cast("double").alias("_has")) for c in columns]))
    rows = df.withColumn("_n", true(normal)).select("_n", flags)
    return rows.groupBy("feature").agg(
        F.avg("_has").alias("overall"), F.avg(F.when(F.col("_n"), F.col("_has"))).alias("normal"), F.avg(F.when(~F.col("_n"), F.col("_has"))).alias("anomaly")
    )


def dt_histogram(df: DataFrame, track: Track, *, edges: Sequence[float]) -> DataFrame:
    """Steps counted over fixed bins; bin i holds edges[i] <= dt < edges[i+1], the last one closed."""
    t = F.col(track.order[0])
    dt = sweep(df, track, {"_pt": Lag(t)}).select((t - F.col("_pt")).alias("dt")).filter(F.col("dt").isNotNull())
    b = F.when((F.col("dt") < edges[0]) | (F.col("dt") > edges[-1]), F.lit(None).cast("int"))
    for i in range(len(edges) - 1):
        b = b.when(F.col("dt") < edges[i + 1], F.lit(i))
    b = b.otherwise(F.lit(len(edges) - 2))
    return dt.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def masked_error(x: Column, y: Column, mask: Column) -> tuple[Column, Column]:
    """(numerator, denominator) arrays per channel over (rows x channels) nested arrays."""
    rows = F.zip_with(x, F.zip_with(y, mask, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), lambda a, r: F.struct(a.alias("a"), r["b"].alias("b"), r["m"].alias("m")))
    err = F.transform(rows, lambda r: F.zip_with(F.zip_with(r["a"], r["b"], lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2)), r["m"], lambda e, m: e * m.cast("double")))
    add = lambda acc, row: F.when(F.size(acc) == 0, row).otherwise(F.zip_with(acc, row, lambda p, q: p + q))
    empty = F.array().cast("array<double>")
    masks = F.transform(mask, lambda r: F.transform(r, lambda m: m.cast("double")))
    return F.aggregate(err, empty, add), F.aggregate(masks, empty, add)


def masked_mse(numerator: Column, denominator: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return total(numerator) / F.greatest(total(denominator), F.lit(1.0))


def magnitude_score(x: Column, mask: Column) -> Column:
    """Masked sum of squares of a (rows x channels) window."""
    row = lambda r, m: F.aggregate(F.zip_with(r, m, lambda a, b: F.pow(a.cast("double"), 2) * b.cast("double")), F.lit(0.0), lambda p, q: p + q)
    return F.aggregate(F.zip_with(x, mask, row), F.lit(0.0), lambda p, q: p + q)


def input_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + F.pow(v.cast("double"), 2)))


def attitude_proxy(roll_deg: Column, rate_deg_s: Column, *, roll_scale: float = 25.0, rate_scale: float = 15.0) -> Column:
    return F.sqrt(F.pow(roll_deg / roll_scale, 2) + F.pow(rate_deg_s / rate_scale, 2))


def aggressiveness(df: DataFrame, *, flight: str, roll_deg: Column, rate_deg_s: Column, prob: float = 0.99) -> DataFrame:
    """p99 of the larger of |roll| and |roll rate| per flight."""
    rows = df.select(flight, F.greatest(F.abs(roll_deg), F.abs(rate_deg_s)).alias("_v"))
    return exact_quantiles(rows, [flight], "_v", {"aggressiveness": prob}).drop("n")
