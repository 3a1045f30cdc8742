"""Traffic on spatial grids, per country, per day and over live windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.plans.select import exact_quantiles

flag = lambda c: F.coalesce(c, F.lit(False))


def clean_coordinates(df: DataFrame, *, lat: str = "lat", lon: str = "lon", dropped: str | None = None) -> DataFrame:
    """Keep rows with a position inside [-90, 90] x [-180, 180]; ``dropped`` names an observation counting the rest."""
    ok = F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180), F.lit(False))
    if dropped:
        df = df.observe(dropped, F.count_if(~ok).alias("dropped"), F.count(F.lit(1)).alias("seen"))
    return df.filter(ok)


def point_density(df: DataFrame, cell: Column) -> DataFrame:
    return df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("point_count"))


def military_lookup(df: DataFrame, *, entity: str = "source_id", military: str = "is_military") -> DataFrame:
    """True for an entity flagged on any row; missing flags count as false."""
    return df.groupBy(entity).agg(F.bool_or(flag(F.col(military))).alias(military))


def flight_density(
    df: DataFrame, cells: Mapping[str, Column], *, day: Column, entity: str = "source_id", military: str = "is_military"
) -> DataFrame:
    """Per grid and cell: points, distinct (entity, day) split by the entity's military flag, distinct days.

    One scan serves all grids; every step is a partial-then-final aggregate, and only
    entity-days reach the second one.
    """
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), c.alias("cell")) for g, c in cells.items()])
    spread = df.select(entity, day.alias("_day"), F.inline(grids))
    visits = spread.groupBy("grid", "cell", entity, "_day").agg(F.count(F.lit(1)).alias("_pts"))
    visits = visits.join(military_lookup(df, entity=entity, military=military), entity, "left")
    dated = F.col("_day").isNotNull()
    mil = dated & flag(F.col(military))
    days = visits.groupBy("grid", "cell", "_day").agg(
        F.sum("_pts").alias("_pts"), F.count_if(dated).alias("_all"), F.count_if(mil).alias("_mil")
    )
    return days.groupBy("grid", "cell").agg(
        F.sum("_pts").alias("point_count"), F.sum("_all").alias("flight_count"),
        F.sum(F.col("_all") - F.col("_mil")).alias("flight_count_civil"), F.sum("_mil").alias("flight_count_military"),
        F.count("_day").alias("day_count"),
    )


def live_density(df: DataFrame, cell: Column, *, entity: str = "source_id", military: str = "is_military") -> DataFrame:
    """Rows, distinct entities and those with civil / military rows per cell."""
    m = flag(F.col(military))
    per = df.groupBy(cell.alias("cell"), entity).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(m).alias("_mil"), F.bool_or(~m).alias("_civ")
    )
    return per.groupBy("cell").agg(
        F.sum("_n").alias("point_count"), F.count(F.lit(1)).alias("aircraft"),
        F.count_if("_civ").alias("civil"), F.count_if("_mil").alias("military"),
    )


def country_counts(df: DataFrame, *, country: str = "country", entity: str = "source_id") -> DataFrame:
    per = df.filter(F.col(country).isNotNull()).groupBy(country, entity).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(country).agg(F.count(F.lit(1)).alias("hex_count"), F.sum("_n").alias("row_count"))
    return out.orderBy(F.desc("hex_count"), country)


def mlat_ratio(df: DataFrame, cell: Column, *, is_mlat: Column) -> DataFrame:
    """Share of rows positioned by multilateration, for cells having any."""
    out = df.groupBy(cell.alias("cell")).agg(
        F.count_if(flag(is_mlat)).alias("mlat_count"), F.count(F.lit(1)).alias("total_count")
    )
    return out.filter(F.col("mlat_count") > 0).withColumn("ratio", F.round(F.col("mlat_count") / F.col("total_count"), 4))


def dominant_country(
    df: DataFrame, cell: Column, *, time: str, windows: Mapping[str, float | None], country: str = "country",
    entity: str = "source_id", military: str = "is_military",
) -> DataFrame:
    """Per window and cell: country with most distinct entities, totals, share and per-country maps.

    Windows count back in seconds from the data's own latest time; ties go to the first name.
    """
    rows = df.filter(F.col(country).isNotNull())
    rows = rows.withColumn("_latest", rows.agg(F.max(time)).scalar())
    names = F.array_compact(
        F.array(*[
            F.when(F.lit(True) if span is None else F.col(time) >= F.col("_latest") - span, F.lit(name)) for name, span in windows.items()
        ])
    )
    m = flag(F.col(military))
    per = rows.select(cell.alias("cell"), country, entity, m.alias("_m"), F.explode(names).alias("time_window"))
    per = per.groupBy("time_window", "cell", country, entity).agg(F.bool_or("_m").alias("_mil"), F.bool_or(~F.col("_m")).alias("_civ"))
    per = per.groupBy("time_window", "cell", country).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_civ").alias("n_civ"), F.count_if("_mil").alias("n_mil")
    )
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(country), F.col(c)))))
    out = per.groupBy("time_window", "cell").agg(
        F.min_by(country, F.struct(-F.col("n"), F.col(country))).alias("dominant_country"),
        F.max("n").alias("dominant_count"), F.sum("n").alias("total_count"),
        as_map("n").alias("per_country"), as_map("n_civ").alias("per_country_civil"), as_map("n_mil").alias("per_country_military"),
    )
    return out.withColumn("dominant_ratio", F.round(F.col("dominant_count") / F.col("total_count"), 3))


def quantile_breaks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Whole-number p10, p50, p75, p90, p99 of a column, at least 1 each."""
    probs = {"p10": 0.10, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
    out = exact_quantiles(df, groups, value, probs)
    return out.select(*groups, *[F.greatest(F.floor(p).cast("long"), F.lit(1).cast("long")).alias(p) for p in probs])


def daily_snapshots(df: DataFrame, cell: Column, *, day: Column, entity: str = "source_id", days: int = 7) -> DataFrame:
    """Distinct entities per cell for each of the last ``days`` calendar days of the data, oldest first, 0 where none."""
    rows = df.select(cell.alias("cell"), entity, day.alias("_day"))
    last = rows.agg(F.max("_day")).scalar()
    rows = rows.withColumn("_ago", F.datediff(last, "_day")).filter(F.col("_ago") < days)
    once = rows.groupBy("cell", entity, "_ago").agg(F.lit(1).alias("_one"))
    return once.groupBy("cell").agg(
        F.array(*[F.count_if(F.col("_ago") == i) for i in reversed(range(days))]).alias("counts")
    )


def category_coverage(df: DataFrame, *, category: str, entity: str) -> DataFrame:
    """Entities and rows per category with their percentages; an entity's category is constant."""
    per = df.groupBy(entity, category).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(category).agg(F.count(F.lit(1)).alias("entities"), F.sum("_n").alias("rows"))
    total = out.agg(F.struct(F.sum("entities").alias("e"), F.sum("rows").alias("r"))).scalar()
    return out.withColumns({
        "entity_pct": F.round(100 * F.col("entities") / total["e"], 1), "row_pct": F.round(100 * F.col("rows") / total["r"], 1),
    })


def hourly_unique(df: DataFrame, *, ts: str, entity: str, bucket: str = "1 hour") -> DataFrame:
    once = df.select(F.window(ts, bucket)["start"].alias("bucket"), entity).distinct()
    return once.groupBy("bucket").agg(F.count(F.lit(1)).alias("aircraft")).orderBy("bucket")


def replay_frame(df: DataFrame, *, time: str, start: float, step_s: float, entity: str, tie: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Latest row per entity in [start, start + step) with a position; the step is clamped to 5..300 s."""
    step = min(max(step_s, 5.0), 300.0)
    rows = df.filter((F.col(time) >= start) & (F.col(time) < start + step) & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    cols = [c for c in rows.columns if c != entity]
    return rows.groupBy(entity).agg(F.max_by(F.struct(*cols), F.struct(time, tie)).alias("_r")).select(entity, "_r.*")


def step_buckets(df: DataFrame, *, time: str, start: float, end: float, step_s: float) -> DataFrame:
    """Start times of the non-empty steps inside [start, end)."""
    rows = df.filter((F.col(time) >= start) & (F.col(time) < end))
    n = F.floor((F.col(time) - start) / step_s)
    return rows.select((F.lit(start) + n * step_s).alias("bucket_start")).distinct().orderBy("bucket_start")


def downsample_last(df: DataFrame, *, ts: str, every: str, entity: str, tie: str, fields: list[str]) -> DataFrame:
    """Last value of every field per time bucket and entity; a missing value does not replace an earlier one."""
    pos = F.struct(ts, tie)
    last = [F.max_by(F.struct(F.col(f)), F.when(F.col(f).isNotNull(), pos))[f].alias(f) for f in fields]
    return df.groupBy(F.window(ts, every)["start"].alias("bucket"), entity).agg(*last)
