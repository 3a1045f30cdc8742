"""Rule scorers: weighted penalties and the command/response bank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.windows import no_response_score, run_window_scores
from trackweave.plans.track import Track


def rule_bank(
    df: DataFrame, track: Track, *, pairs: Sequence[tuple[str, str, float, float]], width: int, turn_rate: Column,
    coordinated: Column, turn_band: float, throttle: Column, throttle_high: float, acceleration: Column, expected: float,
    accel_band: float, time: str,
) -> DataFrame:
    """Long (entity, t, channel, z): command without response, coordinated-turn error, thrust deficit at high throttle."""
    rows = df.withColumns({
        "_turn": F.abs(turn_rate - coordinated) / turn_band,
        "_thrust": F.when(throttle >= throttle_high, F.greatest((expected - acceleration) / accel_band, F.lit(0.0))).otherwise(0.0),
    })
    for i, (command, response, c_thr, r_thr) in enumerate(pairs):
        rows = no_response_score(
            rows, track, command=command, response=response, command_threshold=c_thr, response_threshold=r_thr, width=width, out=f"_p{i}"
        )
    scores = [F.col(f"_p{i}") for i in range(len(pairs))]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]  # skips nulls: null only when all are
    channels = {"command_no_response": best, "coordinated_turn": F.col("_turn"), "thrust_speed": F.col("_thrust")}
    pairs_out = F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("double").alias("z")) for k, v in channels.items()])
    return rows.select(*track.keys, F.col(time).alias("t"), F.inline(pairs_out))


def penalty_column(scales: Mapping[str, tuple[float, float]], weights: Mapping[str, float], *, cap: float = 10.0) -> Column:
    """Row penalty from per-channel (centre, scale); channels without a usable scale are left out by the caller."""
    z = {c: (sc.finite(F.col(c)) - m) / s for c, (m, s) in scales.items()}
    return sc.rule_penalty(z, weights, cap=cap)


def rule_window_scores(
    df: DataFrame, track: Track, *, scales: Mapping[str, tuple[float, float]], weights: Mapping[str, float], window: int,
    stride: int, max_gap_s: float,
) -> DataFrame:
    """Mean row penalty per gap-free window and the observed share of the active channels."""
    seen = sum((sc.finite(F.col(c)).isNotNull().cast("int") for c in scales), F.lit(0))
    rows = df.withColumn("_pen", penalty_column(scales, weights))
    return run_window_scores(
        rows, track, penalty="_pen", observed=seen, n_channels=len(scales), window=window, stride=stride, max_gap_s=max_gap_s
    )
