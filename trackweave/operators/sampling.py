"""Deterministic samples, splits and candidate grids: functions of the data, not of its layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.durable import durable
from trackweave.plans.ladder import ladder
from trackweave.plans.track import Running, Track, sweep


def priority(seed: str, key: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(seed), *[F.col(c).cast("string") for c in key]), 256)


def bottom_k(df: DataFrame, *, k: int, seed: str, key: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """The k rows with the smallest hashed priority (per group): a uniform sample of exact size.

    ``key`` must identify a row. Each task keeps at most k rows (per group) before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    rows = df.withColumn("_pr", priority(seed, key))
    if not groups:
        return rows.orderBy("_pr", *key).limit(k).drop("_pr")
    order = Window.partitionBy(*groups).orderBy("_pr", *key)
    return rows.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k).drop("_pr", "_rk")


def bernoulli(df: DataFrame, *, p: float, seed: str, key: Sequence[str], purpose: str) -> DataFrame:
    """Rows (or whole entities, by the key chosen) whose hashed draw falls below p."""
    if not 0 <= p <= 1:
        raise ValueError("p must be inside [0, 1]")
    return df.filter(sc.hash_unit(seed, purpose, *[F.col(c) for c in key]) < p)


def fit_role(df: DataFrame, *, seed: int | str, entity: str, fraction: float, out: str = "role") -> DataFrame:
    fit = sc.sha_fraction_below(fraction, str(seed), F.col(entity))
    return df.withColumn(out, F.when(fit, "fit").otherwise("calibration"))


def _slots(n: int, weights: Mapping[str, float]) -> list[tuple[str, int]]:
    """Largest-remainder counts per split, splits in name order."""
    total = sum(weights.values())
    if not weights or any(w < 0 for w in weights.values()) or total <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    share = {k: n * w / total for k, w in weights.items()}
    count = {k: int(s) for k, s in share.items()}
    for k in sorted(weights, key=lambda k: (-(share[k] - count[k]), k))[: n - sum(count.values())]:
        count[k] += 1
    return [(k, count[k]) for k in sorted(weights)]


def exact_split(ids: DataFrame, *, entity: str, weights: Mapping[str, float], seed: int | str, exclude: DataFrame | None = None) -> DataFrame:
    """Split of distinct ids in hash order with exact counts; independent of input order.

    The rank comes from bucketed running counts over the hash, not from one sorted partition.
    """
    pool = ids.select(entity).distinct()
    if exclude is not None:
        pool = pool.join(exclude.select(entity), entity, "left_anti")
    pool = pool.withColumn("_h", priority(str(seed), [entity]))
    n = pool.count()
    ranked = pool.join(ladder(pool, [], "_h", {"n": F.lit(1).cast("long")}).select("_h", F.col("cum_n").alias("_rank")), "_h")
    split, upto = F.when(F.lit(False), ""), 0
    for name, size in _slots(n, weights):
        upto += size
        split = split.when(F.col("_rank") <= upto, name)
    return ranked.select(entity, split.alias("split"))


PARTITIONS = ("development", "test", "holdout")


def partition_counts(sessions: int, forced: int) -> dict[str, int]:
    """Sessions per partition: 70/15/15, at least one in test and holdout, development holding the forced ones."""
    raw = dict(zip(PARTITIONS, (0.70 * sessions, 0.15 * sessions, 0.15 * sessions)))
    n = {k: int(v) for k, v in raw.items()}
    for k in ("test", "holdout"):
        n[k] = max(n[k], 1)
    n["development"] -= max(0, sum(n.values()) - sessions)
    spare = sorted(PARTITIONS, key=lambda k: int(raw[k]) - raw[k])
    for i in range(sessions - sum(n.values())):
        n[spare[i % 3]] += 1
    n["development"] = max(n["development"], forced)
    for k in ("test", "holdout"):
        cut = min(sum(n.values()) - sessions, n[k] - 1)
        n[k] -= max(0, cut)
    if sum(n.values()) != sessions:
        raise ValueError("rare classes leave no session for test and holdout")
    return n


def session_split(
    flights: DataFrame, *, session: str, fault_class: str, seed: str, rare_max: int = 7, attempts: int = 20_000,
    plain: Sequence[str] = ("normal", "unknown"),
) -> DataFrame:
    """Whole sessions to development / test / holdout, 70/15/15.

    Sessions with a rare class (at most ``rare_max`` flights) stay in development. Attempts
    are hashed orders of the other sessions; the first one that shows every frequent class
    in all three partitions is taken, and none raises. Attempts are tried in growing lots
    up to the one that fits, so work grows with the attempts needed.
    """
    from trackweave.plans.durable import durable

    fault = flights.filter(~F.coalesce(F.col(fault_class), F.lit("normal")).isin(*plain))
    classes = durable(fault.groupBy(fault_class).agg(F.count(F.lit(1)).alias("_t")))
    mix = durable(flights.groupBy(session, fault_class).agg(F.count(F.lit(1)).alias("_n")))
    rare = mix.join(classes.filter(F.col("_t") <= rare_max), fault_class, "left_semi").select(session).distinct()
    everyone = mix.select(session).distinct()
    n, forced, headline = everyone.count(), rare.count(), classes.filter(F.col("_t") > rare_max)
    if n < 3:
        raise ValueError("a session split needs at least three sessions")
    size = partition_counts(n, forced)
    free_dev = size["development"] - forced
    loose = durable(everyone.join(rare, session, "left_anti"))
    held = headline.count()
    shows = durable(mix.join(headline.select(fault_class), fault_class, "left_semi").select(session, fault_class))

    def placed(lo: int, hi: int) -> DataFrame:
        """Partitions of all sessions under the attempts lo to hi - 1."""
        tries = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
        hashed = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("attempt").cast("string"), F.col(session).cast("string")), 256)
        at = F.row_number().over(Window.partitionBy("attempt").orderBy(hashed, session))
        dealt = loose.withColumn("attempt", tries).withColumn("_at", at).withColumn(
            "partition",
            F.when(F.col("_at") <= free_dev, "development").when(F.col("_at") <= free_dev + size["test"], "test").otherwise("holdout"),
        ).drop("_at")
        return dealt.unionByName(rare.withColumn("attempt", tries).withColumn("partition", F.lit("development")))

    lo, hi = 0, min(16, attempts)
    while lo < attempts:
        good = placed(lo, hi).join(shows, session).select("attempt", fault_class, "partition").distinct().groupBy("attempt").agg(F.count(F.lit(1)).alias("_k"))
        first = good.filter(F.col("_k") == 3 * held).agg(F.min("attempt")).first()[0] if held else 0
        if first is not None:
            return placed(first, first + 1).drop("attempt")
        lo, hi = hi, min(4 * hi, attempts)
    raise ValueError("no session split shows every frequent class in every partition")


def balanced_roles(
    catalog: DataFrame, *, flight: str, mode: str, fault: str, is_fault: Column, quarantined: Column, modes: Sequence[str], faults: Sequence[str],
) -> DataFrame:
    """Roles by position inside (mode) for normal and (mode, fault) for faulty flights, in id order.

    Normal: 4 fit, 2 calibration, 1 rehearsal, 2 holdout, the rest development. Fault: 1
    rehearsal, 1 holdout, the rest development. Quarantined flights take no position, flights
    of other modes or faults get no role. Fewer than 10 normal flights in a mode, or 2 of
    a fault in it, raise.
    """
    rows = catalog.withColumns({"_f": F.coalesce(is_fault, F.lit(False)), "_q": F.coalesce(quarantined, F.lit(False))})
    known = ~F.col("_q") & F.col(mode).isin(*modes) & (~F.col("_f") | F.col(fault).isin(*faults))
    group = [mode, F.when(F.col("_f"), F.col(fault)).alias("_fault")]
    sizes = {(r[0], r[1]): r["count"] for r in rows.filter(known).groupBy(*group).count().collect()}
    if short := [m for m in modes if sizes.get((m, None), 0) < 10]:
        raise ValueError(f"fewer than 10 normal flights in {short}")
    if short := [(m, f) for m in modes for f in faults if sizes.get((m, f), 0) < 2]:
        raise ValueError(f"fewer than 2 flights of {short}")
    # only the first places are ranked; the ranks beyond them are cut in each task before the shuffle
    order = Window.partitionBy(mode, "_f", F.when(F.col("_f"), F.col(fault))).orderBy(flight)
    i = F.col("_i")
    front = rows.filter(known).select(mode, fault, flight, "_f").withColumn("_i", F.row_number().over(order)).filter(i <= 9)
    place = (
        F.when(F.col("_f"), F.when(i == 1, "rehearsal").when(i == 2, "holdout"))
        .when(i <= 4, "fit").when(i <= 6, "calibration").when(i == 7, "rehearsal").otherwise("holdout")
    )
    named = front.select(flight, place.alias("_place"))
    role = F.when(F.col("_q"), "quarantine").when(known, F.coalesce("_place", F.lit("development")))
    return rows.join(named, flight, "left").withColumn("role", role).drop("_f", "_q", "_place")


def _turns(load: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How ``count`` groups of one size are dealt, each to the fold with the fewest rows: (first place, folds in turn) of each phase, and the rows of the folds afterwards.

    A fold is next in order of (its rows, its number). Once the folds that have caught up lie within one size
    of each other they take turns, until the next larger fold joins in: there are no more phases than folds.
    """
    load, done, phases = list(load), 0, []
    line = sorted(range(len(load)), key=lambda f: (load[f], f))
    for m in range(1, len(line) + 1):
        turn = sorted(line[:m], key=lambda f: (load[f], f))
        most = count - done
        if m < len(line):
            top, after = load[line[m]], line[m]
            room = {f: max(0, (top - load[f]) // size + 1 if f < after else -(-(top - load[f]) // size)) for f in turn}
            most = min(most, sum(room.values()))
        if not most:
            continue
        phases.append((done, turn))
        for i, f in enumerate(turn):
            load[f] += size * (most // m + (i < most % m))
        done += most
        if done == count:
            break
    return phases, load


def group_folds(df: DataFrame, *, group: str, max_folds: int = 5) -> DataFrame:
    """Fold per group: groups by falling size (ties: later names first), each to the fold with the fewest rows so far.

    Groups of one size are dealt together: only the distinct sizes, of which n rows have at most the root of 2 n, pass
    through the driver. A group finds its fold by its place among those of its size.
    """
    if max_folds < 2:
        raise ValueError("need at least two folds")
    sizes = durable(df.groupBy(group).agg(F.count(F.lit(1)).alias("rows")))
    counts = {r["rows"]: r["n"] for r in sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if n < 2:
        raise ValueError("need at least two groups")
    load, dealt = [0] * min(max_folds, n), []
    for size in sorted(counts, reverse=True):
        phases, load = _turns(load, size, counts[size])
        dealt.append((size, counts[size], phases))
    plan = df.sparkSession.createDataFrame(dealt, "rows long, _many long, phases array<struct<first:long,turn:array<int>>>")
    steps = ladder(sizes, ["rows"], group, {"n": F.lit(1).cast("long")})
    # falling names; the group without a name, if there is one, comes last of its size
    places = steps.select(F.col("rows").alias("_rows"), F.col(group).alias("_name"), (F.col("tot_n") - F.col("cum_n")).alias("_at"))
    rows = sizes.join(places, (F.col("rows") == F.col("_rows")) & (F.col(group) == F.col("_name")), "left").join(plan, "rows")
    rows = rows.withColumn("_place", F.coalesce("_at", F.col("_many") - 1))
    phase = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("_place")), -1)
    turn = (F.col("_place") - phase["first"]) % F.size(phase["turn"])
    return rows.select(group, "rows", F.get(phase["turn"], turn.cast("int")).alias("fold"))


def candidate_thresholds(df: DataFrame, *, score: str, cap: int = 4096) -> DataFrame:
    """Distinct finite scores, or ``cap`` evenly spaced quantiles of them, and infinity."""
    values = df.select(sc.finite(F.col(score)).alias("threshold")).filter(F.col("threshold").isNotNull()).distinct()
    steps = ladder(values, [], "threshold", {"n": F.lit(1).cast("long")})
    line = Track(("_all",), ("cum_n",), 100_000)
    from trackweave.plans.track import Lead

    steps = sweep(steps.withColumn("_all", F.lit(0)), line, {"_nx": Lead(F.col("threshold"))})
    i, n, m = F.col("cum_n") - 1, F.col("tot_n"), cap - 1
    # quantile j sits at j (n-1)/m: this value covers the j with floor of that equal to i
    lo = F.ceil(i * m / (n - 1))
    hi = F.least(F.ceil((i + 1) * m / (n - 1)) - 1, F.lit(m))
    js = F.when((n > cap) & (lo <= hi), F.sequence(lo, hi)).when((n > cap) & (i == n - 1), F.array(F.lit(m).cast("long")))
    picked = F.when(n <= cap, F.array(F.col("threshold"))).otherwise(
        F.transform(js, lambda j: F.col("threshold") + (j * (n - 1) / m - i) * (F.coalesce("_nx", "threshold") - F.col("threshold")))
    )
    out = steps.select(F.explode(picked).alias("threshold")).distinct()
    return out.unionByName(df.sparkSession.sql("SELECT double('infinity') AS threshold"))


def nearest_to_target(df: DataFrame, *, groups: Sequence[str], rate: str, target: Column, keep: Sequence[str]) -> DataFrame:
    """Per group the row whose rate is nearest to the target; ties by the kept columns' order."""
    best = F.min_by(F.struct(*keep, rate), F.struct(F.abs(F.col(rate) - target), *keep)).alias("_b")
    agg = df.groupBy(*groups).agg(best) if groups else df.agg(best)
    return agg.select(*groups, *[F.col(f"_b.{c}").alias(c) for c in (*keep, rate)])


def recent(df: DataFrame, *, time: str, n: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """The newest n rows."""
    return df.orderBy(F.desc(time), *[F.desc(c) for c in ties]).limit(n)


def stable_sort(df: DataFrame, *keys: str, position: str) -> DataFrame:
    """Global order by the keys, source position last; a range-partitioned sort."""
    return df.orderBy(*keys, position)
