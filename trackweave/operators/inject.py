"""Synthetic disturbances with their truth columns, and what becomes observable of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.joins import paired_rows
from trackweave.plans.track import Carry, Running, Track, Whole, sweep

METERS_PER_DEGREE = 111_320.0


@dataclass(frozen=True)
class Recipe:
    """What to disturb: kind, column(s), the share of rows before the onset and the parameters of the kind."""

    kind: str
    columns: tuple[str, ...] = ()
    onset: float = 0.5
    size: float = 0.0
    bearing_deg: float = 90.0
    block_share: float = 0.2
    seed: str = "0"


def _freeze(df: DataFrame, r: Recipe, track: Track, active: Column) -> DataFrame:
    held = sweep(df, track, {f"_h_{c}": Carry(F.col(c), when=~active) for c in r.columns})
    return held.withColumns({c: F.when(active & F.col(f"_h_{c}").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(c)) for c in r.columns}).drop(
        *[f"_h_{c}" for c in r.columns]
    )


def _spread(c: Column, track: Track, df: DataFrame, name: str) -> DataFrame:
    """Sample standard deviation per entity, attached without grouping rows by entity."""
    v = F.coalesce(sc.finite(c), F.lit(0.0))
    n = sc.finite(c).isNotNull().cast("double")
    rows = sweep(df, track, {"_n": Whole(n), "_s": Whole(v * n)})
    rows = rows.withColumn("_dev", F.when(n > 0, F.pow(v - F.col("_s") / F.col("_n"), 2)).otherwise(0.0))
    rows = sweep(rows, track, {"_q": Whole(F.col("_dev"))})
    return rows.withColumn(name, F.when(F.col("_n") > 1, F.sqrt(F.col("_q") / (F.col("_n") - 1)))).drop("_n", "_s", "_dev", "_q")


def _bias(df: DataFrame, r: Recipe, track: Track, active: Column) -> DataFrame:
    for c in r.columns:
        df = _spread(F.col(c), track, df, "_sd").withColumn(c, F.when(active, F.col(c) + r.size * F.col("_sd")).otherwise(F.col(c))).drop("_sd")
    return df


def _noise(df: DataFrame, r: Recipe, track: Track, active: Column) -> DataFrame:
    for c in r.columns:
        draw = sc.hash_normal(r.seed, c, *[F.col(k) for k in track.keys], F.col("_i"))
        df = _spread(F.col(c), track, df, "_sd").withColumn(c, F.when(active, F.col(c) + r.size * F.col("_sd") * draw).otherwise(F.col(c))).drop("_sd")
    return df


def _dropout(df: DataFrame, r: Recipe, track: Track, active: Column) -> DataFrame:
    return df.withColumns({c: F.when(~active, F.col(c)) for c in r.columns})


def _ramp(df: DataFrame, r: Recipe, track: Track, active: Column) -> DataFrame:
    lat, lon = r.columns
    t = F.col(track.order[0])
    rows = sweep(df, track, {"_on": Whole(F.when(active, t), "min")})
    meters = F.lit(r.size) * (t - F.col("_on"))
    north, east = meters * F.cos(F.radians(F.lit(r.bearing_deg))), meters * F.sin(F.radians(F.lit(r.bearing_deg)))
    return rows.withColumns({
        lat: F.when(active, F.col(lat) + north / METERS_PER_DEGREE).otherwise(F.col(lat)),
        lon: F.when(active, F.col(lon) + east / (METERS_PER_DEGREE * F.cos(F.radians(F.col(lat))))).otherwise(F.col(lon)),
    }).drop("_on")


INJECTORS: Mapping[str, Callable[[DataFrame, Recipe, Track, Column], DataFrame]] = {
    "freeze": _freeze, "bias": _bias, "noise": _noise, "dropout": _dropout, "ramp": _ramp,
}


def inject(df: DataFrame, track: Track, recipe: Recipe) -> DataFrame:
    """Disturbed copy with ``injection_active``, ``attack_onset`` and ``event_end`` per entity.

    The onset is row floor(n x onset). A dropout covers a block of ``block_share`` of the rows
    whose start is drawn by hash, both ends inside the entity; the others last to the end.
    """
    if recipe.kind not in INJECTORS:
        raise ValueError(f"unknown injection {recipe.kind!r}")
    if not 0 <= recipe.onset < 1:
        raise ValueError("onset must be in [0, 1)")
    one = F.lit(1).cast("long")
    rows = sweep(df, track, {"_i": Running(one), "_n": Whole(one)})
    if recipe.kind == "dropout":
        size = F.greatest(F.floor(F.col("_n") * recipe.block_share), F.lit(1))
        start = F.floor(sc.hash_unit(recipe.seed, "block", *[F.col(k) for k in track.keys]) * (F.col("_n") - size + 1))
        active = (F.col("_i") > start) & (F.col("_i") <= start + size)
    else:
        active = F.col("_i") > F.floor(F.col("_n") * recipe.onset)
    rows = rows.withColumn("injection_active", active)
    rows = INJECTORS[recipe.kind](rows, recipe, track, F.col("injection_active"))
    when = F.when(F.col("injection_active"), F.col(track.order[0]))
    rows = sweep(rows, track, {"attack_onset": Whole(when, "min"), "event_end": Whole(when, "max")})
    return rows.drop("_i", "_n")


def observable_changed(
    clean: DataFrame, corrupt: DataFrame, *, on: Sequence[str], time: str, columns: Sequence[str],
    observation: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows on which an observation of both tables differs in any listed column.

    ``observation`` must keep rows one for one; a lost or added row fails the pairing.
    """
    view = observation or (lambda f: f)
    return paired_rows(clean.transform(view), corrupt.transform(view), on=on, time=time, columns=columns)


def annotate_truth(corrupt: DataFrame, changed: DataFrame, track: Track, *, on: Sequence[str], evaluable: Column) -> DataFrame:
    """Add observable_changed, observable_onset (first changed time) and evaluable_truth."""
    rows = corrupt.join(changed.withColumnRenamed("changed", "observable_changed"), list(on), "left")
    first = F.when(F.col("observable_changed"), F.col(track.order[0]))
    rows = sweep(rows, track, {"observable_onset": Whole(first, "min")})
    return rows.withColumn("evaluable_truth", F.coalesce(evaluable, F.lit(False)))
