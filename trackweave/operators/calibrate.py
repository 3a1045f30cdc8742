"""Thresholds under a false-alarm budget, and the gates a calibrated detector must pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.decide import crossings, fold_groups, spaced
from trackweave.operators.episodes import row_exposure
from trackweave.plans.durable import durable
from trackweave.plans.ladder import ladder
from trackweave.plans.track import Carry, Lag, Running, Track, close, row_frame, runs, settle, sweep

# fixed values: distribution function of a Poisson count with mean 1 at 0, 1, 2, ...
POISSON_ONE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402,
)
INFINITY = float("inf")


def bootstrap_weight(*parts: Column | str) -> Column:
    """Number of times a block enters a replicate: a hashed Poisson(1) draw."""
    u = sc.hash_unit(*parts)
    return sum(((u >= p).cast("int") for p in POISSON_ONE), F.lit(0))


def bootstrap_rates(blocks: DataFrame, *, block_key: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(replicate, h, rate per hour) from (block, h, exposure_s, onsets); h values share the draws.

    Every block is weighted in place, so only one partial row per replicate and h is shuffled.
    """
    rows = blocks.filter(F.col("exposure_s") > 0)
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = bootstrap_weight(seed, F.col("replicate"), *[F.col(c) for c in block_key])
    rows = rows.withColumn("_w", w).groupBy("replicate", "h").agg(
        F.sum(F.col("_w") * F.col("onsets")).alias("_n"), F.sum(F.col("_w") * F.col("exposure_s")).alias("_s")
    )
    return rows.select("replicate", "h", F.try_divide(F.col("_n").cast("double"), F.col("_s") / 3600).alias("rate"))


def budget_candidates(
    blocks: DataFrame, *, block_key: Sequence[str], budget: float, replicates: int, seed: str, upper: float = 0.95,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Per candidate: observed rate, bootstrap quantile, their maximum and whether it meets the budget.

    ``observed(h, episodes, exposure_s)`` holds whole-track counters; without it the blocks stand in.
    """
    if observed is None:
        observed = blocks.filter(F.col("exposure_s") > 0).groupBy("h").agg(
            F.sum("onsets").alias("episodes"), F.sum("exposure_s").alias("exposure_s")
        )
    boot = bootstrap_rates(blocks, block_key=block_key, replicates=replicates, seed=seed)
    tail = boot.groupBy("h").agg(F.percentile("rate", F.lit(upper)).alias("bootstrap_upper"), F.avg("rate").alias("bootstrap_mean"))
    out = observed.select("h", F.try_divide(F.col("episodes").cast("double"), F.col("exposure_s") / 3600).alias("observed_rate")).join(tail, "h")
    out = out.withColumn("conservative_upper", F.greatest("observed_rate", "bootstrap_upper"))
    return out.withColumn("meets_budget", F.col("conservative_upper") <= budget)


def select_smallest(candidates: DataFrame, *, ok: str = "meets_budget", h: str = "h") -> DataFrame:
    """One row: the smallest candidate that qualifies, null when none does."""
    return candidates.agg(F.min(F.when(F.col(ok), F.col(h))).alias("selected_h"), F.count(F.lit(1)).alias("n_candidates"))


def corrected_selection(candidates: DataFrame, *, budget: float, raw: str = "bootstrap_upper", observed: str = "observed_rate") -> DataFrame:
    """Re-read stored candidates with upper = max(observed, raw) and compare the selections."""
    upper = F.greatest(F.col(observed), F.col(raw))
    out = candidates.agg(
        F.min(F.when(F.col(raw) <= budget, F.col("h"))).alias("old_selected_h"), F.min(F.when(upper <= budget, F.col("h"))).alias("new_selected_h")
    )
    return out.withColumn("unchanged", F.col("old_selected_h").eqNullSafe(F.col("new_selected_h")))


def crossing_counts(scores: DataFrame, track: Track, *, score: str, reset: Column, candidates: Sequence[float], refractory_s: float, block: str) -> DataFrame:
    """(block, h, onsets): rising crossings of every candidate, thinned by the refractory time.

    A row only speaks for the candidates between its predecessor and itself, so rows are
    not multiplied by the number of candidates.
    """
    inner = track.by(*track.keys, block)
    grid = F.array(*[F.lit(float(h)) for h in candidates])
    passed = F.filter(grid, lambda h: (F.col("_was") < h) & (h <= F.col("_now")))
    hits = crossings(scores, inner, score=score, reset=reset).select(*inner.keys, *track.order, F.explode(passed).alias("h"))
    line = track.by(*inner.keys, "h")
    return spaced(hits, line, apart=refractory_s).groupBy(*line.keys).agg(F.count(F.lit(1)).alias("onsets"))


def mean_rate_threshold(
    rows: DataFrame, track: Track, *, score: Callable[[DataFrame, Track], DataFrame], column: str, reset: str, block_s: float, target_per_hour: float,
    refractory_s: float, replicates: int, seed: str, lot: int = 32,
) -> DataFrame:
    """One row: the smallest threshold whose bootstrap mean alarm rate over normal blocks is at or below the target.

    Blocks of ``block_s`` begin at a track's own first row, and ``score(rows, track of blocks)``
    scores each from a fresh state. Blocks of one row or no duration are no exposure;
    exposure too short to resolve one alarm at the target raises. A rate only changes at
    a score that occurs, so lots of occurring scores are tried, narrowing the
    bracket until its neighbours are known; the threshold lies just above the last
    score that is too low.
    """
    if target_per_hour <= 0:
        raise ValueError("target must be positive")
    t, keys = F.col(track.order[0]), [*track.keys, "block"]
    begin = rows.groupBy(*track.keys).agg(F.min(t).alias("_t0"))
    cut = rows.join(begin, list(track.keys)).withColumn("block", F.floor((t - F.col("_t0")) / block_s)).drop("_t0")
    scored = durable(score(cut, track.by(*keys)).select(*keys, *track.order, sc.settled(F.col(column)).alias(column), reset))
    length = scored.groupBy(*keys).agg((F.max(t) - F.min(t)).alias("exposure_s"), F.count(F.lit(1)).alias("_n"))
    length = durable(length.filter((F.col("_n") >= 2) & (F.col("exposure_s") > 0)).drop("_n"))
    total = length.agg((F.sum("exposure_s") / 3600).alias("hours"), F.count(F.lit(1)).alias("n")).first()
    if (total.hours or 0.0) < 1.0 / target_per_hour:
        raise ValueError(f"{total.hours or 0.0:.6f} normal hours cannot resolve {target_per_hour:.6f} alarms per hour")
    live = durable(scored.join(length, keys, "left_semi"))

    def rates(hs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
        """(onsets per block and h, rate per replicate and h)."""
        counts = crossing_counts(live, track, score=column, reset=F.col(reset), candidates=hs, refractory_s=refractory_s, block="block")
        grid = F.explode(F.array(*[F.lit(float(h)) for h in hs])).alias("h")
        table = durable(length.select(*keys, "exposure_s", grid).join(counts, [*keys, "h"], "left").withColumn("onsets", F.coalesce("onsets", F.lit(0))))
        return table, bootstrap_rates(table, block_key=keys, replicates=replicates, seed=seed)

    def feasible(hs: Sequence[float]) -> dict[float, bool]:
        means = rates(hs)[1].groupBy("h").agg(F.avg("rate").alias("m")).collect()
        return {r.h: r.m is not None and r.m <= target_per_hour for r in means}

    low, high = float(np.finfo(float).eps), INFINITY
    if feasible([low])[low]:
        threshold = high = low
    else:
        values = live.select(F.col(column).alias("h")).filter(sc.finite(F.col(column)) > low).distinct()
        while True:
            inside = values.filter((F.col("h") > low) & (F.col("h") < high))
            few = [r.h for r in inside.limit(lot + 1).collect()]
            if not few:
                break
            if len(few) > lot:
                probs = F.array(*[F.lit((i + 1) / (lot + 1)) for i in range(lot)])
                few = inside.agg(F.percentile_approx("h", probs, F.lit(100 * lot))).first()[0]
            for h, ok in sorted(feasible(sorted(set(few))).items()):
                if ok:
                    high = h
                    break
                low = h
        threshold = float(np.nextafter(low, INFINITY))
    at = high if high < INFINITY else threshold
    table, boot = rates([at])
    seen = table.agg(F.sum("onsets").alias("observed_alarms"))
    spread = boot.agg(
        F.avg("rate").alias("bootstrap_mean"), F.percentile("rate", F.lit(0.5)).alias("bootstrap_median"), F.percentile("rate", F.lit(0.95)).alias("bootstrap_p95"))
    return seen.join(F.broadcast(spread)).select(
        F.lit(threshold).alias("threshold_h"), "observed_alarms", F.lit(total.hours).alias("observed_hours"), F.lit(total.n).cast("long").alias("n_blocks"),
        "bootstrap_mean", "bootstrap_median", "bootstrap_p95")


def threshold_curve(rows: DataFrame, track: Track, *, score: str, stride_s: float) -> DataFrame:
    """False alarms per hour at every candidate threshold (distinct scores and infinity) in one pass.

    State is score > h, so a row starts an alarm for exactly previous <= h < score. Adding
    +1 at the previous score and -1 at the score, the running sum over values is the
    number of onsets at each h.
    """
    s = sc.finite(F.col(score))
    v = F.coalesce(s, F.lit(-INFINITY))
    line = sweep(rows.withColumn("_v", v), track, {"_p": Lag(F.col("_v"))})
    p = F.coalesce(F.col("_p"), F.lit(-INFINITY))
    rising = F.col("_v") > p
    zero = F.lit(0).cast("long")
    marks = F.array_compact(F.array(
        F.when(F.col("_v") > -INFINITY, F.struct(F.col("_v").alias("h"), F.when(rising, F.lit(-1).cast("long")).otherwise(zero).alias("d"))),
        F.when(rising, F.struct(p.alias("h"), F.lit(1).cast("long").alias("d"))),
    ))
    steps = ladder(line.select(F.inline(marks)), [], "h", {"d": F.col("d")}).filter(F.col("h") > -INFINITY)
    hours = rows.agg((F.count(F.lit(1)) * stride_s / 3600.0).alias("x")).scalar()
    finite = steps.select(F.col("h").alias("threshold"), F.col("cum_d").alias("onsets"))
    top = rows.sparkSession.sql("SELECT double('infinity') AS threshold, 0L AS onsets")
    return finite.unionByName(top).withColumn("fa_per_hour", F.col("onsets") / hours)


def kth_largest(rows: DataFrame, track: Track, *, score: str, k: int, n: int, out: str) -> DataFrame:
    """The k-th largest finite score of the last n rows: at least k of them exceed h exactly when it does."""
    v = sc.finite(F.col(score))
    recent = lambda w: F.collect_list("_v").over(w.rowsBetween(1 - n, 0))
    base = row_frame(rows.withColumn("_v", v), track, {"_last": recent}, before=n - 1)
    return base.withColumn(out, F.get(F.sort_array("_last", asc=False), F.lit(k - 1))).drop("_v", "_last")


def fit_threshold_policy(rows: DataFrame, track: Track, *, score: str, stride_s: float, budget_per_hour: float) -> DataFrame:
    """Lowest candidate within the budget: (threshold, fa_per_hour)."""
    curve = threshold_curve(rows, track, score=score, stride_s=stride_s).filter(F.col("fa_per_hour") <= budget_per_hour)
    return curve.agg(F.min(F.struct("threshold", "fa_per_hour")).alias("b")).select("b.*")


def fit_k_of_n_policy(rows: DataFrame, track: Track, *, score: str, stride_s: float, budget_per_hour: float, pairs: Sequence[tuple[int, int]] = ((2, 3), (3, 5))) -> DataFrame:
    """Best (k, n) by lowest threshold, then n, then k."""
    fits = None
    for k, n in pairs:
        eff = kth_largest(rows, track, score=score, k=k, n=n, out="_eff")
        raw = threshold_curve(eff, track, score="_eff", stride_s=stride_s)
        one = raw.filter(F.col("fa_per_hour") <= budget_per_hour).agg(F.min(F.struct("threshold", "fa_per_hour")).alias("b")).select(
            "b.threshold", F.lit(n).alias("n"), F.lit(k).alias("k"), "b.fa_per_hour"
        )
        fits = one if fits is None else fits.unionByName(one)
    return fits.agg(F.min(F.struct("threshold", "n", "k", "fa_per_hour")).alias("b")).select("b.*")


def bootstrap_stream(z: DataFrame, track: Track, *, value: str, position: str, total: int, block_rows: int, seed: str) -> DataFrame:
    """(pos, value): ``total`` rows of whole blocks drawn with replacement.

    Each draw takes a track (all alike, whatever their length) and then any start in it at
    which a block fits; if no track holds a whole block, any start of any track, wrapping
    round. ``position`` numbers a track's rows from 0. Only drawn rows are joined.
    """
    sizes = z.groupBy(*track.keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = not sizes.filter(F.col("_n") >= block_rows).isEmpty()
    eligible = sizes.filter(F.col("_n") >= block_rows) if whole else sizes
    name = F.sha2(F.concat_ws("\0", *[F.col(k).cast("string") for k in track.keys]), 256)
    named = eligible.withColumn("_h", name)
    numbered = durable(named.join(ladder(named, [], "_h", {"n": F.lit(1).cast("long")}).select("_h", (F.col("cum_n") - 1).alias("_no")), "_h").drop("_h"))
    n = numbered.count()
    if n == 0:
        raise ValueError("no row to draw from")
    draws = z.sparkSession.range(-(-total // block_rows)).withColumn("_no", F.floor(sc.hash_unit(seed, F.lit("track"), F.col("id")) * n))
    starts = F.col("_n") - block_rows + 1 if whole else F.col("_n")
    drawn = draws.join(numbered, "_no").withColumn("_from", F.floor(sc.hash_unit(seed, F.lit("start"), F.col("id")) * starts))
    cells = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block_rows - 1))))
    cells = cells.select((F.col("id") * block_rows + F.col("_k")).alias("pos"), *track.keys, F.pmod(F.col("_from") + F.col("_k"), F.col("_n")).alias(position)).filter(F.col("pos") < total)
    return cells.join(z.select(*track.keys, position, value), [*track.keys, position]).select("pos", value)


def fit_page_policy(
    rows: DataFrame, track: Track, *, score: str, slack: float, budget_per_hour: float, stride_s: float, hours: float, block_s: float, refractory_s: float, seed: str,
) -> DataFrame:
    """One row: mu, sigma, h and the alarms per hour of the refractory page rule at h.

    The rule runs on a block-bootstrapped stream of ``hours`` (a parameter, whatever the
    data). h doubles from 1 until the budget holds and is then halved into place 12 times;
    several candidates of either search run side by side.
    """
    block_rows, total = max(1, round(block_s / stride_s)), max(1, round(hours * 3600 / stride_s))
    logit = sc.logit_standardise(F.col(score), 0.0, 1.0)
    stats = rows.agg(F.avg(logit).alias("mu"), F.stddev_pop(logit).alias("sd")).first()
    mu, sigma = stats.mu or 0.0, stats.sd if stats.sd and stats.sd > 0 else 1.0
    z = sweep(rows.withColumn("_z", (logit - mu) / sigma), track, {"_rn": Running(F.lit(1).cast("long"))})
    z = z.select(*track.keys, (F.col("_rn") - 1).alias("_at"), "_z")
    stream = durable(bootstrap_stream(z, track, value="_z", position="_at", total=total, block_rows=block_rows, seed=seed))
    skip_rows = max(0, round(refractory_s / stride_s))

    def fold(part: pd.DataFrame, state: dict) -> np.ndarray:
        s, skip, h = state.get("s", 0.0), state.get("skip", 0), float(part["h"].iloc[0])
        flags = np.zeros(len(part), dtype=bool)
        for i, v in enumerate(part["_z"].to_numpy(float)):
            if skip:
                skip, s = skip - 1, 0.0
                continue
            s = max(0.0, s + (v if np.isfinite(v) else 0.0) - slack)
            if s > h:
                flags[i], s, skip = True, 0.0, skip_rows
        state.update(s=s, skip=skip)
        return flags

    def rate(hs: Sequence[float]) -> dict[float, float]:
        spread = stream.withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in hs])))
        fired = fold_groups(spread, ["h"], ["pos"], fold, out="_on").groupBy("h").agg((F.count_if("_on") / hours).alias("r"))
        return {r.h: r.r for r in fired.collect()}

    found = rate([2.0**i for i in range(21)])
    low, high = 0.0, next((h for h in sorted(found) if found[h] <= budget_per_hour), max(found))
    for _ in range(3):  # four halvings in each: their 15 possible midpoints together
        step = (high - low) / 16
        found |= rate([low + i * step for i in range(1, 16)])
        a, b = 0, 16
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if found[low + mid * step] <= budget_per_hour else (mid, b)
        low, high = low + a * step, low + b * step if b < 16 else high
    row = (float(mu), float(sigma), float(high), float(found[high]), found[high] <= budget_per_hour)
    return rows.sparkSession.createDataFrame([row], "mu double, sigma double, h double, fa_per_hour double, meets_budget boolean")


def alpha_curve(
    rows: DataFrame, track: Track, *, p_values: Sequence[str], alphas: Sequence[float], persistence_s: float, max_gap_s: float, merge_gap_s: float, evaluable: Column,
) -> DataFrame:
    """Episodes per scoreable hour of the persistence rule at every total alpha.

    Each channel (a p-value column; a null cell is no row of that channel) gathers evidence at
    alpha divided by the number of channels; a row alarms if any channel does. Evidence is the time since
    the channel's latest row that is cut off or above its share of alpha. It only grows with alpha, so
    a row is told by the smallest alpha at which it alarms: rows are not spread over the alphas.
    """
    if not p_values:
        raise ValueError("no channel of p-values")
    t, share = F.col(track.order[0]), len(p_values)
    grid = sorted({float(a) for a in alphas})
    cells = [F.col(c).alias(f"_p{i}") for i, c in enumerate(p_values)]
    base = settle(rows.select(*track.keys, *track.order, evaluable.alias("_ok"), *cells), track)
    seconds = row_exposure(base, track, evaluable=F.col("_ok"), max_gap_s=max_gap_s).agg(F.sum("exposure_s")).scalar()
    seen = [F.col(f"_p{c}").isNotNull() for c in range(share)]
    marked = sweep(base.drop("_ok"), track, {f"_t{c}": Carry(t, when=seen[c], inclusive=False) for c in range(share)})
    step = [t - F.col(f"_t{c}") for c in range(share)]
    cut = [s.isNull() | (s <= 0) | (s > max_gap_s) for s in step]
    off = {(c, i): seen[c] & (cut[c] | (F.col(f"_p{c}") > a / share)) for c in range(share) for i, a in enumerate(grid)}
    marked = sweep(marked, track, {f"_m{c}_{i}": Carry(t, when=o) for (c, i), o in off.items()})
    held = {(c, i): seen[c] & (t - F.col(f"_m{c}_{i}") >= persistence_s) for c, i in off}
    least = [F.when(reduce(Column.__or__, [F.coalesce(held[c, i], F.lit(False)) for c in range(share)]), F.lit(i)) for i in range(len(grid))]
    hits = durable(close(marked.withColumn("_first", F.coalesce(*least))).filter(F.col("_first").isNotNull()).select(*track.keys, *track.order, "_first"))
    hits = sweep(hits, track, {f"_a{i}": Carry(t, when=F.col("_first") <= i, inclusive=False) for i in range(len(grid))})
    opens = [(F.col("_first") <= i) & (F.col(f"_a{i}").isNull() | (t - F.col(f"_a{i}") > merge_gap_s)) for i in range(len(grid))]
    counts = hits.agg(*[F.count_if(o).alias(f"_n{i}") for i, o in enumerate(opens)])
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_n{grid.index(float(a))}").alias("_n")) for a in alphas])
    out = counts.select(F.inline(each)).withColumn("_s", seconds)
    return out.select("alpha", F.try_divide(F.col("_n").cast("double"), F.col("_s") / 3600).alias("episodes_per_hour"))


def select_alpha(curve: DataFrame, *, budget_per_hour: float, fallback: float = 1e-12) -> DataFrame:
    """Largest alpha within the budget, or the fallback with no episodes."""
    ok = F.coalesce(F.col("episodes_per_hour") <= budget_per_hour, F.lit(False))
    best = curve.agg(F.max(F.when(ok, F.struct("alpha", "episodes_per_hour"))).alias("b"))
    return best.select(F.coalesce("b.alpha", F.lit(fallback)).alias("alpha"), F.coalesce("b.episodes_per_hour", F.lit(0.0)).alias("episodes_per_hour"))


def pareto_points(curve: DataFrame, *, grid: Sequence[float], share: float, rate: str, h: str = "h") -> DataFrame:
    """Per grid point V the candidate with the rate nearest to share x V / 100 (ties: smaller h); a missing rate is far away."""
    target = lambda v: share * v / 100.0
    far = F.coalesce(F.col(rate), F.lit(1e9))
    picks = [F.min_by(F.struct(F.col(h), F.col(rate)), F.struct(F.abs(far - target(v)), F.col(h))).alias(f"_{i}") for i, v in enumerate(grid)]
    one = curve.agg(*picks)
    rows = F.array(*[F.struct(F.lit(float(v)).alias("point"), F.col(f"_{i}.{h}").alias(h), F.col(f"_{i}.{rate}").alias(rate)) for i, v in enumerate(grid)])
    return one.select(F.inline(rows))


def method_gate(
    metrics: DataFrame, gate: Mapping[str, float], *, order: Sequence[str], baseline: str, model: str, model_margin: float = 0.10, by: Sequence[str] = (),
) -> DataFrame:
    """First method in ``order`` that passes every gate, per ``by``.

    ``model`` must also reach the recall of ``baseline`` plus the margin, whether or not the
    baseline passes itself; without a baseline recall it is not selected.

    ``metrics`` has one row per method: coverage, event_coverage, recall, recall_low, min_mode_recall, rate.
    """
    c = F.col
    ok = F.lit(True)
    for col, key in (("coverage", "coverage_min"), ("event_coverage", "event_coverage_min"), ("recall", "recall_min"),
                     ("recall_low", "wilson_lower_min"), ("min_mode_recall", "per_mode_recall_min")):
        ok = ok & (c(col) >= gate[key])
    ok = F.coalesce(ok & (c("rate") <= gate["max_rate"]), F.lit(False))
    rank = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(order))):
        rank = F.when(c("method") == m, i).otherwise(rank)
    passing = F.when(ok & (c("method") != model), F.struct(rank.alias("rank"), c("method"))).alias("_plain")
    rows = metrics.select(*by, c("method"), ok.alias("_ok"), F.when(c("method") == baseline, c("recall")).alias("_base"), F.when((c("method") == model) & ok, c("recall")).alias("_model"), rank.alias("_rank"), passing)
    one = rows.groupBy(*by).agg(
        F.min(F.when(c("_plain.rank").isNotNull(), c("_plain"))).alias("_plain"), F.max("_base").alias("_base"), F.max("_model").alias("_model"),
        F.max(F.when(c("method") == model, c("_rank"))).alias("_at"), F.count_if("_ok").alias("n_passing"),
    )
    wins = F.coalesce(c("_model") >= c("_base") + model_margin, F.lit(False))
    best = F.when(wins & (c("_plain").isNull() | (c("_at") < c("_plain.rank"))), F.lit(model)).otherwise(c("_plain.method"))
    return one.select(*by, best.alias("selected"), "n_passing")


def class_gate(channels: DataFrame, *, cls: str = "fault_class", status: str = "status") -> DataFrame:
    """Class passes if any channel passed, failed if any was evaluated, else not evaluable."""
    s = F.col(status)
    out = channels.groupBy(cls).agg(F.bool_or(s == "passed").alias("_p"), F.bool_or(s == "failed").alias("_f"))
    return out.select(cls, F.when(F.col("_p"), "passed").when(F.col("_f"), "failed").otherwise("not_evaluable").alias("status"))


def missing_classes(gate: DataFrame, required: DataFrame, *, cls: str = "fault_class") -> DataFrame:
    """Required classes that did not pass; calibration stays locked while there is one."""
    return required.select(cls).distinct().join(gate.filter(F.col("status") == "passed"), cls, "left_anti")


def axis_gate(coverage: DataFrame, selection: DataFrame, *, axes: Sequence[str]) -> DataFrame:
    """Threshold selection is allowed only with every axis calibrated and a threshold found."""
    active = coverage.filter(F.col("axis").isin(*axes) & F.col("calibrated")).agg(F.countDistinct("axis").alias("n")).scalar()
    out = selection.withColumn("n_axes", active)
    decision = (
        F.when(F.col("n_axes") < len(axes), "blocked_axis_missing").when(F.col("selected_h").isNull(), "blocked_no_threshold").otherwise("allowed")
    )
    return out.select("selected_h", "n_axes", decision.alias("decision"))
