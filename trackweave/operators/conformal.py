"""Ranks against a reference distribution and hierarchical conformal p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.robust import require_fit_role
from trackweave.plans.ladder import ladder

CALIBRATION_ROLE = "natural_clean_calibration"
LEVELS = (("channel", "context_phase", "context_cadence"), ("channel", "context_phase"), ("channel",))


def rank_against(query: DataFrame, reference: DataFrame, *, groups: Sequence[str], score: str) -> DataFrame:
    """Add ``n_ref``, ``n_ge`` (reference scores >= s) and ``n_le`` (<= s) to every query row.

    Both tables are reduced to distinct scores before they meet; no inequality join.
    """
    g = list(groups)
    pool = reference.select(*g, score).withColumn("_r", F.lit(1).cast("long")).unionByName(
        query.select(*g, score).distinct().withColumn("_r", F.lit(0).cast("long"))
    )
    steps = ladder(pool, g, score, {"r": F.col("_r")})
    ranks = steps.select(
        *g, score, F.col("tot_r").alias("n_ref"), (F.col("tot_r") - F.col("cum_r") + F.col("r")).alias("n_ge"), F.col("cum_r").alias("n_le")
    )
    return query.join(ranks, [*g, score], "left")


def empirical_probability(query: DataFrame, reference: DataFrame, *, groups: Sequence[str], score: str, out: str = "probability") -> DataFrame:
    """(references <= s + 0.5) / (n + 1)."""
    ranked = rank_against(query, reference, groups=groups, score=score)
    return ranked.withColumn(out, (F.col("n_le") + 0.5) / (F.col("n_ref") + 1)).drop("n_ref", "n_ge", "n_le")


def _level_key(columns: Sequence[str]):
    return F.concat_ws("\u0001", F.lit("+".join(columns)), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])


def conformal_fit(calibration: DataFrame, *, role: str, contains_synthetic: bool, score: str = "score") -> DataFrame:
    """Reference table of (group_key, score, n), one copy per level; keep it as Parquet."""
    require_fit_role(role, contains_synthetic=contains_synthetic, allowed=(CALIBRATION_ROLE,))
    s = F.col(score)
    valid = F.when(s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s < float("inf")), s).otherwise(
        F.raise_error(F.lit("calibration scores must be finite and >= 0")).cast("double")
    )
    keys = F.explode(F.array(*[_level_key(c) for c in LEVELS])).alias("group_key")
    return calibration.select(keys, valid.alias("score")).groupBy("group_key", "score").agg(F.count(F.lit(1)).alias("n"))


def conformal_transform(scored: DataFrame, reference: DataFrame, *, min_group_size: int, score: str = "score") -> DataFrame:
    """Add p = (1 + #ref >= s)/(n + 1) from the most specific level holding enough references.

    A row whose channel has too few references at every level raises.
    """
    if min_group_size < 2:
        raise ValueError("min_group_size must be >= 2")
    sizes = reference.groupBy("group_key").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_group_size)
    rows = scored
    for i, cols in enumerate(LEVELS):
        rows = rows.withColumn(f"_k{i}", _level_key(cols)).join(
            sizes.select(F.col("group_key").alias(f"_k{i}"), F.lit(True).alias(f"_ok{i}")), f"_k{i}", "left"
        )
    key, level = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for i, cols in enumerate(LEVELS):
        key, level = key.when(F.col(f"_ok{i}"), F.col(f"_k{i}")), level.when(F.col(f"_ok{i}"), "+".join(cols))
    missing = F.raise_error(F.lit("no calibration fallback for a channel")).cast("string")
    rows = rows.withColumns({"group_key": F.coalesce(key, missing), "calibration_level": level})
    rows = rows.drop(*[f"_k{i}" for i in range(3)], *[f"_ok{i}" for i in range(3)])
    used = reference.join(sizes.select("group_key"), "group_key", "left_semi").select("group_key", "score", F.col("n").alias("_r"))
    pool = used.unionByName(rows.select("group_key", F.col(score).alias("score")).distinct().withColumn("_r", F.lit(0).cast("long")))
    steps = ladder(pool, ["group_key"], "score", {"r": F.col("_r")})
    tails = steps.select(
        "group_key", F.col("score").alias(score), F.col("tot_r").alias("calibration_n"),
        ((1.0 + F.col("tot_r") - F.col("cum_r") + F.col("r")) / (F.col("tot_r") + 1.0)).alias("conformal_p_value"),
    )
    return rows.join(tails, ["group_key", score], "left").drop("group_key")


def conformal_alarms(p_values: DataFrame, *, alpha: float | None) -> DataFrame:
    """The alert level must be given; there is no default threshold."""
    if alpha is None or not 0 < alpha < 1:
        raise ValueError("alpha must be given, inside (0, 1)")
    return p_values.withColumns({"alert_alpha": F.lit(float(alpha)), "alarm": F.col("conformal_p_value") <= alpha})
