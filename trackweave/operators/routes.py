"""Reference lookups, routes and corridors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo

# fixed values: name prefixes of range rows that are not a country
NON_COUNTRY = ("(reserved", "(unallocated")


def hex_value(text: Column) -> Column:
    """Integer of a hexadecimal id; null when it is not one."""
    clean = F.trim(text)
    return F.when(clean.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(clean, 16, 10).cast("long"))


def range_index(ranges: DataFrame, *, start: str, end: str, payload: list[str], bucket: int) -> DataFrame:
    """Ranges gathered per key bucket they touch, so that a lookup is one equi join.

    A bucket's list is as long as the nesting there, not as the table.
    """
    rows = ranges.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    entry = F.struct((F.col(end) - F.col(start)).alias("width"), F.col(start).alias("lo"), F.col(end).alias("hi"), *payload)
    touched = F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))
    return rows.select(touched.alias("_bk"), entry.alias("_e")).groupBy("_bk").agg(F.collect_list("_e").alias("_ranges"))


def narrowest_range(df: DataFrame, ranges: DataFrame, *, key: Column, start: str, end: str, payload: list[str], bucket: int = 4096) -> DataFrame:
    """Left lookup of the narrowest range holding ``key`` (ties: lowest start); nulls where none does."""
    index = range_index(ranges, start=start, end=end, payload=payload, bucket=bucket)
    rows = df.withColumn("_k", key).withColumn("_bk", F.floor(F.col("_k") / bucket))
    rows = rows.join(index, "_bk", "left")
    hits = F.filter("_ranges", lambda r: (r["lo"] <= F.col("_k")) & (F.col("_k") <= r["hi"]))
    best = F.array_min(hits)  # structs compare by width first
    return rows.withColumn("_best", best).select(*df.columns, *[F.col(f"_best.{p}").alias(p) for p in payload])


def country_lookup(df: DataFrame, ranges: DataFrame, *, hex_id: str, bucket: int = 4096) -> DataFrame:
    """Add ``country`` (null unless a real one) and ``category``: country, reserved or no_match.

    The lookup runs over distinct ids and is joined back.
    """
    ids = df.select(hex_id).distinct()
    found = narrowest_range(
        ids, ranges.withColumnRenamed("country", "_name"), key=hex_value(F.col(hex_id)), start="start", end="end", payload=["_name"], bucket=bucket
    )
    name = F.col("_name")
    reserved = F.lit(False)
    for p in NON_COUNTRY:
        reserved = reserved | name.startswith(p)
    found = found.select(
        hex_id, F.when(name.isNotNull() & ~reserved, name).alias("country"),
        F.when(name.isNull(), "no_match").when(reserved, "reserved").otherwise("country").alias("category"),
    )
    return df.join(found, hex_id, "left")


def map_lookup(df: DataFrame, lookup: DataFrame, on: str, column: str, default) -> DataFrame:
    """Left dictionary join with a default for unknown keys."""
    out = df.join(lookup.select(on, column), on, "left")
    return out if default is None else out.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def unit_cube(lat: Column, lon: Column, chord: float) -> list[Column]:
    """Cube of edge ``chord`` holding the point on the unit sphere: no seam, no poles."""
    p, l = F.radians(lat), F.radians(lon)
    xyz = (F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))
    return [F.floor(c / chord).cast("int") for c in xyz]


def around(cube: list[Column]) -> Column:
    """The 27 cubes within one step, as (x, y, z) structs to be exploded."""
    step = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.flatten(F.transform(step, lambda i: F.transform(step, lambda j: F.transform(
        step, lambda k: F.struct((cube[0] + i).alias("cx"), (cube[1] + j).alias("cy"), (cube[2] + k).alias("cz")))))))


def chord_of_km(km: float, radius: float = geo.EARTH_RADIUS_KM) -> float:
    import math

    return 2 * math.sin(min(km / radius, math.pi) / 2) * (1 + 1e-9)


def nearest_within(points: DataFrame, refs: DataFrame, *, key: list[str], ident: str, max_km: float, lat: str = "lat", lon: str = "lon",
                   ref_lat: str = "ref_lat", ref_lon: str = "ref_lon") -> DataFrame:
    """Nearest reference of each distinct ``key`` point, at most ``max_km`` away (ties: smallest ident).

    Points meet only the references of their own and the adjacent cubes of edge ``max_km``.
    """
    chord = chord_of_km(max_km)
    p = points.select(*key, lat, lon).dropDuplicates(key)
    cx, cy, cz = unit_cube(F.col(lat), F.col(lon), chord)
    p = p.withColumns({"cx": cx, "cy": cy, "cz": cz})
    near = refs.select(ident, ref_lat, ref_lon, F.inline(around(unit_cube(F.col(ref_lat), F.col(ref_lon), chord))))
    dist = geo.haversine(F.col(lat), F.col(lon), F.col(ref_lat), F.col(ref_lon), radius=geo.EARTH_RADIUS_KM)
    pairs = p.join(near, ["cx", "cy", "cz"]).withColumn("distance_km", dist).filter(F.col("distance_km") <= max_km)
    best = pairs.groupBy(*key).agg(F.min(F.struct("distance_km", ident)).alias("_b"))
    return points.join(best.select(*key, f"_b.{ident}", "_b.distance_km"), key, "left")


def rank_routes(legs: DataFrame, *, country: str = "country", pair: str = "pair", flight: str = "flight_id", min_flights: int = 2,
                keep: int = 15, confident: int = 15) -> DataFrame:
    """Routes per country by distinct flights: rank, top flag and a low-sample flag; ties in name order."""
    counts = legs.select(country, pair, flight).distinct().groupBy(country, pair).agg(F.count(F.lit(1)).alias("flight_count"))
    counts = counts.filter(F.col("flight_count") >= min_flights)
    order = Window.partitionBy(country).orderBy(F.desc("flight_count"), pair)
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return ranked.withColumns({"is_top": F.col("rank") == 1, "low_confidence": F.col("flight_count") < confident})


def corridors(points: DataFrame, legs: DataFrame, ranked: DataFrame, cell: Column, *, country: str = "country", pair: str = "pair",
              flight: str = "flight_id") -> DataFrame:
    """Distinct flights of a ranked route through each cell and their share of the route's flights."""
    kept = legs.join(ranked.select(country, pair), [country, pair], "left_semi").select(flight, country, pair)
    hits = points.select(flight, cell.alias("cell")).distinct().join(kept, flight)
    per = hits.groupBy(country, pair, "cell").agg(F.count(F.lit(1)).alias("flight_count_cell"))
    out = per.join(ranked, [country, pair])
    return out.withColumn("ratio", F.round(F.col("flight_count_cell") / F.col("flight_count"), 3))


def route_plausible(lat: Column, lon: Column, track: Column, dest_lat: Column, dest_lon: Column, *, threshold_deg: float = 90.0) -> Column:
    """Heading towards the claimed destination within the threshold; an unknown track passes."""
    off = F.abs(geo.circular_diff(geo.bearing(lat, lon, dest_lat, dest_lon), track))
    return F.when(track.isNull(), F.lit(True)).otherwise(off <= threshold_deg)


def callsign_search(df: DataFrame, *, query: str, callsign: str = "callsign") -> DataFrame:
    """Exact match on the trimmed upper-case callsign first, else the first one containing the text."""
    wanted = query.strip().upper()
    name = F.upper(F.trim(F.col(callsign)))
    rank = F.when(name == wanted, 0).when(name.contains(wanted), 1)
    return df.withColumn("match_rank", rank).filter(rank.isNotNull()).orderBy("match_rank", name).limit(1)
