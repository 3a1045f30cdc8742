"""Models whose fit is an aggregate: grouped-CV ridge, linear surprise, isolation forest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.robust import median_mad, parameters
from trackweave.operators.sampling import bottom_k, group_folds
from trackweave.operators.windows import future_mean, lag_summary
from trackweave.plans.track import Track

PHASES = ("ground", "maneuver", "takeoff", "landing", "cruise")


@dataclass(frozen=True)
class RidgeFit:
    features: tuple[str, ...]
    alpha: float
    intercept: float
    coefficients: tuple[float, ...]
    cv: tuple[tuple[float, float], ...]  # (alpha, mean squared error) per candidate
    n: int
    residual_variance: float

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for name, b in zip(self.features, self.coefficients):
            total = total + F.lit(b) * F.col(name)
        return total


def gram(df: DataFrame, columns: Sequence[str], *, fold: str) -> dict[int, np.ndarray]:
    """Sum of outer products of (1, columns) per fold.

    Tasks add up their Arrow batches; one small matrix per task and fold is shuffled, and
    folds x columns^2 numbers reach the driver.
    """
    width = len(columns) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[list(columns)].to_numpy(float)])
            folds = pdf[fold].to_numpy()
            for f in np.unique(folds):
                z = x[folds == f]
                acc[int(f)] = acc.get(int(f), 0.0) + z.T @ z
        for f, g in acc.items():
            yield pd.DataFrame({"fold": f, "cell": np.arange(width * width), "v": g.ravel()})

    cells = df.select(fold, *columns).mapInPandas(part, "fold int, cell int, v double")
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.fold, np.zeros(width * width))[r.cell] = r.v
    return {f: v.reshape(width, width) for f, v in out.items()}


def _solve(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Ridge with an unpenalised intercept from the Gram matrix of (1, x.., y)."""
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] - n * np.outer(mean, mean)
    p = c.shape[0] - 1
    b = np.linalg.solve(c[:p, :p] + alpha * np.eye(p), c[:p, p])
    return float(mean[p] - b @ mean[:p]), b


def _squared_error(g: np.ndarray, intercept: float, b: np.ndarray) -> float:
    w = np.concatenate([[intercept], b, [-1.0]])
    return float(w @ g @ w)


def fit_ridge(
    df: DataFrame, *, features: Sequence[str], response: str, group: str, alphas: Sequence[float], eligible: Column | None = None, max_folds: int = 5
) -> RidgeFit:
    """Alpha by group-disjoint cross validation (ties: the smaller), then a fit on all eligible rows.

    Every fold's fit and error come from subtracting its Gram matrix: the data is read twice
    in all, once for the folds and once for the products.
    """
    if not alphas or any(a <= 0 for a in alphas):
        raise ValueError("alphas must be positive")
    names = [*features, response]
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    for c in names:
        ok = ok & sc.finite(F.col(c)).isNotNull()
    rows = df.filter(ok).select(group, *[F.col(c).cast("double").alias(c) for c in names])
    folds = group_folds(rows, group=group, max_folds=max_folds).select(group, "fold")
    g = gram(rows.join(folds, group), names, fold="fold")
    total = sum(g.values())
    cv = []
    for a in sorted(float(a) for a in alphas):
        sse = sum(_squared_error(m, *_solve(total - m, a)) for m in g.values())
        cv.append((a, sse / total[0, 0]))
    alpha = min(cv, key=lambda c: (c[1], c[0]))[0]
    intercept, b = _solve(total, alpha)
    n = int(total[0, 0])
    return RidgeFit(tuple(features), alpha, intercept, tuple(float(v) for v in b), tuple(cv), n, _squared_error(total, intercept, b) / n)


def residual_table(df: DataFrame, fit: RidgeFit, *, response: str, keep: Sequence[str], channel: str) -> DataFrame:
    """y, prediction and residual of every complete row."""
    ok = F.lit(True)
    for c in (*fit.features, response):
        ok = ok & sc.finite(F.col(c)).isNotNull()
    y = F.col(response).cast("double")
    return df.filter(ok).select(*keep, F.lit(channel).alias("channel"), y.alias("y"), fit.prediction().alias("y_hat"), (y - fit.prediction()).alias("r"))


def coefficient_signs(fit: RidgeFit, positive: Sequence[str]) -> dict[str, bool]:
    """Whether each feature expected to act positively does."""
    found = dict(zip(fit.features, fit.coefficients))
    return {f: found.get(f, 0.0) > 0 for f in positive}


def ablation_ratio(
    df: DataFrame, *, features: Sequence[str], commands: Sequence[str], response: str, group: str, alpha: float, minimum: float, eligible: Column | None = None,
) -> DataFrame:
    """full_variance, reduced_variance, ratio, flagged: what leaving out the features of all commands does to the residuals.

    A feature belongs to a command by name or as ``command__...``. Every declared command must
    have one, otherwise nothing would be ablated and the gate would pass unseen.
    Both models are fitted on the same rows: those with every feature present.
    """
    if not commands:
        raise ValueError("no command to leave out")
    if alpha <= 0 or minimum <= 1:
        raise ValueError("alpha must be positive and the least ratio above one")
    belongs = {c: [f for f in features if f == c or f.startswith(f"{c}__")] for c in commands}
    if absent := [c for c, found in belongs.items() if not found]:
        raise ValueError(f"no feature of the commands {absent}")
    removed = {f for found in belongs.values() for f in found}
    whole = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    for f in (*features, response):
        whole = whole & sc.finite(F.col(f)).isNotNull()
    rows = df.filter(whole)
    kw = dict(response=response, group=group, alphas=[alpha])
    full = fit_ridge(rows, features=features, **kw)
    kept = [f for f in features if f not in removed]
    less = fit_ridge(rows, features=kept, **kw).prediction() if kept else None
    y = F.col(response).cast("double")
    out = rows.agg(F.var_pop(y - full.prediction()).alias("full_variance"), F.var_pop(y - less if kept else y).alias("reduced_variance"))
    f, r = F.col("full_variance"), F.col("reduced_variance")
    ratio = F.when(f != 0, r / f).when(r > 0, F.lit(float("inf"))).when(r == 0, F.lit(1.0))
    return out.withColumn("ratio", ratio).withColumn("flagged", F.col("ratio") < minimum)


def build_matrix(
    df: DataFrame, track: Track, *, commands: Sequence[str], context: Sequence[str], response: str, speed: str, phase: str, boundary: str,
    horizon: int, unit: int, onset: str | None = None, margin: float = 10.0, ages: Sequence[tuple[float, float]] = ((0.0, 0.25), (0.25, 0.5), (0.5, 1.0)),
) -> DataFrame:
    """Feature rows of one channel: command lags, context, speed terms, phase one-hot, future-mean target.

    Rows on the ground, at a boundary or with a missing cell are dropped; ``train_eligible``
    is true before onset - margin (always, without an onset).
    """
    rows = df
    lagged: list[str] = []
    for c in commands:
        rows = lag_summary(rows, track, value=c, unit=unit, ages=ages)
        lagged += [f"{c}__last", *[f"{c}__tri_{i}" for i in range(len(ages))], f"{c}__delta"]
    rows = future_mean(rows, track, value=response, horizon=horizon, out="_y")
    v = sc.finite(F.col(speed))
    extra = {f"{c}__last": sc.finite(F.col(c)) for c in context if f"{c}__last" not in lagged}
    if commands:
        extra |= {"context_speed": v, "context_speed_sq": v * v, **{f"{c}__speed_interaction": v * F.col(f"{c}__last") for c in commands}}
    extra |= {f"phase_{p}": (F.col(phase) == p).cast("double") for p in PHASES}
    rows = rows.withColumns(extra)
    features = list(dict.fromkeys([*lagged, *extra]))
    whole = F.col("_y").isNotNull()
    for c in features:
        whole = whole & F.col(c).isNotNull()
    candidate = (F.col(phase) != "ground") & ~F.coalesce(F.col(boundary), F.lit(False))
    t = F.col(track.order[0])
    early = F.lit(True) if onset is None else F.coalesce(t < F.col(onset) - margin * unit, F.lit(True))
    return rows.filter(candidate & whole).select(*track.keys, *track.order, *features, F.col("_y").alias("target"), early.alias("train_eligible"))


def linear_surprise(
    df: DataFrame, *, features: Sequence[str], targets: Sequence[str], group: str, alphas: Sequence[float], keep: Sequence[str], fit_rows: Column
) -> DataFrame:
    """|target - linear prediction| / scale per target channel; scale is the scaled median residual deviation on fit rows.

    A missing target cell has no surprise; a channel without spread is left out.
    """
    parts = None
    for target in targets:
        model = fit_ridge(df.filter(fit_rows), features=features, response=target, group=group, alphas=alphas)
        res = residual_table(df.withColumn("_fit", fit_rows), model, response=target, keep=[*keep, "_fit"], channel=target)
        spread = median_mad(res.filter("_fit"), ["r"])
        if spread.filter("usable").isEmpty():
            continue
        centre, scale = parameters(spread)["r"]
        one = res.select(*keep, "channel", (F.abs(F.col("r")) / scale).alias("surprise"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no target channel with spread")
    return parts


# ------------------------------------------------------------------ isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One random tree as flat arrays; a leaf has feature -1 and the adjustment of its size."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _path_norm(len(rows))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] <= cut
            if left.any() and not left.all():
                nodes[at][:4] = [f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]
        return at

    grow(x, 0)
    a = np.asarray(nodes)
    return {"feature": a[:, 0].astype(int), "cut": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "depth": a[:, 4]}


def _path_norm(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forest(df: DataFrame, channels: Mapping[str, tuple[float, float]], *, trees: int = 200, sample: int = 256, clip: float = 5.0, seed: str = "0", key: Sequence[str]) -> DataFrame:
    """Model table, one row per tree, from hashed samples of scaled complete rows; trees grow in parallel.

    Every tree draws from all rows by its own hash. A row is offered to as many trees as give
    each about four times its sample (all trees for a small table, one for a large one),
    and each task cuts a tree's offers to its sample before the shuffle.
    """
    cols = list(channels)
    ok = F.lit(True)
    for c in cols:
        ok = ok & sc.finite(F.col(c)).isNotNull()
    z = {c: F.greatest(F.lit(-clip), F.least((sc.finite(F.col(c)) - m) / s, F.lit(clip))) for c, (m, s) in channels.items()}
    slim = df.filter(ok).select(*key, *[v.alias(f"_z{i}") for i, v in enumerate(z.values())])
    n = slim.count()
    offers = min(trees, max(1, -(-4 * trees * sample // max(n, 1))))
    first = F.floor(sc.hash_unit(seed, F.lit("tree"), *[F.col(c) for c in key]) * trees)
    some = F.transform(F.sequence(F.lit(0), F.lit(offers - 1)), lambda j: F.pmod(first + j, F.lit(trees)).cast("long"))
    drawn = slim.withColumn("tree", F.explode(some))
    drawn = bottom_k(drawn, k=sample, seed=seed, key=["tree", *key], groups=["tree"])
    names = [f"_z{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(names)[names].to_numpy(float)
        t = _grow(rows, np.random.default_rng([number, len(rows)]))
        return pd.DataFrame({"tree": [number], "n": [len(rows)], **{k: [v.tolist()] for k, v in t.items()}})

    schema = "tree long, n int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
    return drawn.select("tree", *names).groupBy("tree").applyInPandas(grow, schema)


def score_forest(df: DataFrame, model: DataFrame, channels: Mapping[str, tuple[float, float]], *, clip: float = 5.0, out: str = "isolation_score") -> DataFrame:
    """2^(-mean path / norm) per row, larger is more anomalous; rows with a missing channel stay null.

    The model (trees x about 500 nodes, whatever the data size) travels with the tasks.
    """
    forest = [
        tuple(np.asarray(r[k]) for k in ("feature", "cut", "left", "right", "depth")) + (r["n"],) for r in model.orderBy("tree").collect()
    ]
    if not forest:
        raise ValueError("empty forest")
    norm = float(np.mean([_path_norm(f[5]) for f in forest])) or 1.0
    centre = np.asarray([m for m, _ in channels.values()])
    scale = np.asarray([s for _, s in channels.values()])

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        raw = np.column_stack([c.to_numpy(float) for c in cols])
        whole = np.isfinite(raw).all(axis=1)
        x = np.clip((raw - centre) / scale, -clip, clip)
        total = np.zeros(len(x))
        for feature, cut, left, right, depth, _ in forest:
            at = np.zeros(len(x), dtype=int)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                go_left = x[live, feature[node]] <= cut[node]
                at[live] = np.where(go_left, left[node], right[node])
                live = live[feature[at[live]] >= 0]
            total += depth[at]
        result = np.power(2.0, -(total / len(forest)) / norm)
        return pd.Series(np.where(whole, result, np.nan))

    raw = score(*[F.col(c).cast("double") for c in channels])
    return df.withColumn(out, raw).withColumn(out, F.nanvl(F.col(out), F.lit(None).cast("double")))
