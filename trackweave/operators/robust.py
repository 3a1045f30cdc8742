"""Robust location and scale, exact moments, and how they are applied."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.ladder import long_form
from trackweave.plans.select import exact_quantiles

# fixed value: factor that makes the median deviation consistent with a normal sigma
NORMAL_MAD = 1.4826
FIT_ROLE = "natural_clean_fit"


def require_fit_role(role: str, *, contains_synthetic: bool, allowed: Sequence[str] = (FIT_ROLE,)) -> None:
    if role not in allowed:
        raise ValueError(f"role {role!r} may not fit parameters")
    if contains_synthetic:
        raise ValueError("synthetic data cannot enter a fit")


def median_mad(df: DataFrame, channels: Sequence[str], *, groups: Sequence[str] = (), consistency: float = NORMAL_MAD) -> DataFrame:
    """Exact median and scaled median absolute deviation per (groups, channel) over finite values.

    ``usable`` is false where the deviation is zero: such a channel is left out, never floored.
    A channel without any finite value has no row.
    """
    rows = long_form(df, list(groups), channels).filter(F.col("v").isNotNull())
    by = [*groups, "channel"]
    mid = exact_quantiles(rows, by, "v", {"median": 0.5})
    dev = rows.join(mid.select(*by, "median"), by).withColumn("_d", F.abs(F.col("v") - F.col("median")))
    mad = exact_quantiles(dev, by, "_d", {"_m": 0.5}).select(*by, (F.col("_m") * consistency).alias("mad"))
    return mid.join(mad, by).select(*by, "n", "median", "mad", (F.col("mad") > 0).alias("usable"))


def median_iqr(df: DataFrame, channels: Sequence[str], *, groups: Sequence[str] = ()) -> DataFrame:
    """Median and interquartile range (1 where it is not positive) per (groups, channel)."""
    rows = long_form(df, list(groups), channels).filter(F.col("v").isNotNull())
    q = exact_quantiles(rows, [*groups, "channel"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    return q.select(*groups, "channel", "n", "median", F.when(width > 0, width).otherwise(1.0).alias("iqr"))


def parameters(table: DataFrame, *, scale: str = "mad", channels: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """Usable (centre, scale) per channel on the driver: one row per channel."""
    rows = table.filter("usable") if "usable" in table.columns else table
    found = {r["channel"]: (r["median"], r[scale]) for r in rows.select("channel", "median", scale).collect()}
    if not found:
        raise ValueError("every channel lacks data or spread")
    return {c: found[c] for c in (channels or sorted(found)) if c in found}


def scaled(column: Column, centre: float, scale: float, *, clip: float | None = None, eps: float = 0.0) -> Column:
    z = (sc.finite(column) - centre) / (scale + eps)
    return z if clip is None else F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(z, F.lit(clip))))


def distribution(df: DataFrame, channels: Sequence[str], *, sample: int, seed: str, row_key: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Exact counts and moments per channel, with quantiles of a fixed-size hashed sample and its DKW bound."""
    from trackweave.operators.sampling import bottom_k

    rows = long_form(df, list(row_key), channels)
    v = F.col("v")
    exact = rows.groupBy("channel").agg(
        F.count(v).alias("finite_n"), F.count_if(v.isNull()).alias("missing_n"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_population"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    kept = bottom_k(rows.filter(v.isNotNull()), k=sample, seed=seed, key=[*row_key, "channel"], groups=["channel"])
    probs = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    q = exact_quantiles(kept, ["channel"], "v", probs).withColumnRenamed("n", "sample_n")
    return exact.join(q, "channel", "left").withColumn("dkw_error", F.sqrt(F.lit(math.log(2 / alpha)) / (2 * F.col("sample_n"))))


def rule_scores(df: DataFrame, scales: Mapping[str, tuple[float, float]], weights: Mapping[str, float], *, out: str = "rule_penalty") -> DataFrame:
    z = {c: scaled(F.col(c), m, s) for c, (m, s) in scales.items()}
    return df.withColumn(out, sc.rule_penalty(z, weights))
