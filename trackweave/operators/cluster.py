"""Neighbourhood operators on unique, weighted positions: kNN thresholds and DBSCAN.

Inputs are grid cells or otherwise distinct positions (repeats belong in a weight
column), so the number of neighbours within a radius is bounded by the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators.routes import around, chord_of_km, unit_cube
from trackweave.plans.durable import durable


def _near_pairs(left: DataFrame, right: DataFrame, *, key: str, km: float) -> DataFrame:
    """(key, other, distance_km) within ``km``, self included, by equi join on adjacent cubes."""
    chord = chord_of_km(km)
    a = left.select(key, "lat", "lon", F.inline(around(unit_cube(F.col("lat"), F.col("lon"), chord))))
    cx, cy, cz = unit_cube(F.col("lat"), F.col("lon"), chord)
    b = right.select(F.col(key).alias("other"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"),
                     *[c for c in right.columns if c.startswith("_w")])
    dist = geo.haversine(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"), radius=geo.EARTH_RADIUS_KM)
    return a.join(b, ["cx", "cy", "cz"]).withColumn("distance_km", dist).filter(F.col("distance_km") <= km).drop("cx", "cy", "cz")


def knn_threshold(
    cells: DataFrame, *, key: str, value: str, k: int = 1000, prob: float = 0.95, floor: float = 50.0, start_km: float = 200.0
) -> DataFrame:
    """Add ``threshold`` = max(quantile of the value over the k nearest cells, floor) and ``keep``.

    The search radius doubles for the cells that have not met k others yet, so a round
    only carries the sparse rest; the last radius spans the globe. The cell itself counts;
    distances that agree to a millimetre are ties, broken by name.
    """
    points = durable(cells.withColumn("_w", F.col(value)))
    k = min(k, points.count())
    half_turn = 3.1416 * geo.EARTH_RADIUS_KM
    todo, done, km = points, [], float(start_km)
    while True:
        km = min(km, half_turn)
        pairs = _near_pairs(todo, points, key=key, km=km)
        order = Window.partitionBy(key).orderBy(F.round("distance_km", 6), "other")
        top = pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        found = top.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.percentile("_w", F.lit(prob)).alias("threshold")
        ).filter(F.col("_n") >= k)
        found = durable(found.select(key, F.greatest("threshold", F.lit(float(floor))).alias("threshold")))
        done.append(found)
        todo = durable(todo.join(found, key, "left_anti"))
        if km >= half_turn or todo.isEmpty():
            break
        km *= 2
    thresholds = reduce(DataFrame.unionByName, done)
    out = points.drop("_w").join(thresholds, key, "left")
    return out.withColumn("keep", F.col(value) >= F.col("threshold"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from each node; ``nodes(id)``, ``edges(a, b)`` in both directions.

    Each round takes the smallest neighbour label and then the label of that label, so
    chains shorten geometrically. The label table is written to the shared folder per round.
    """
    edges = durable(edges)
    labels = durable(nodes.select("id", F.col("id").alias("label")))
    while True:  # a label only falls, so this ends
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("best"))
        step = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("best", "label")).alias("label")
        )
        up = step.select(F.col("id").alias("_root"), F.col("label").alias("_up"))
        jumped = durable(step.join(up, F.col("label") == F.col("_root"), "left").select("id", "old", F.least("label", F.coalesce("_up", "label")).alias("label")))
        labels = jumped.select("id", "label")
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def dbscan(cells: DataFrame, *, key: str, eps_km: float, min_samples: int) -> DataFrame:
    """Add ``cluster``: the smallest core key of the cluster, null for noise.

    A core has at least ``min_samples`` cells within ``eps_km``, itself included; a border
    cell joins its adjacent cluster with the smallest label.
    """
    points = durable(cells)
    pairs = durable(_near_pairs(points.select(key, "lat", "lon"), points.select(key, "lat", "lon"), key=key, km=eps_km).select(key, "other"))
    cores = durable(pairs.groupBy(key).count().filter(F.col("count") >= min_samples).select(F.col(key).alias("id")))
    linked = pairs.join(cores.withColumnRenamed("id", key), key, "left_semi")
    edges = linked.join(cores.withColumnRenamed("id", "other"), "other", "left_semi").select(F.col(key).alias("a"), F.col("other").alias("b"))
    labels = connected_components(cores, edges)
    reach = pairs.join(labels.withColumnRenamed("id", "other"), "other").groupBy(key).agg(F.min("label").alias("_border"))
    own = labels.select(F.col("id").alias(key), F.col("label").alias("_own"))
    out = points.join(own, key, "left").join(reach, key, "left")
    return out.withColumn("cluster", F.coalesce("_own", "_border")).drop("_own", "_border")


def dbscan_two_pass(cells: DataFrame, *, key: str, eps_km: float, strict: int, relaxed: int) -> DataFrame:
    """Strict pass, then a relaxed one over its noise alone; ``pass_no`` tells the two apart."""
    first = durable(dbscan(cells, key=key, eps_km=eps_km, min_samples=strict))
    kept = first.filter(F.col("cluster").isNotNull()).withColumn("pass_no", F.lit(1))
    again = dbscan(first.filter(F.col("cluster").isNull()).drop("cluster"), key=key, eps_km=eps_km, min_samples=relaxed)
    return kept.unionByName(again.withColumn("pass_no", F.when(F.col("cluster").isNotNull(), 2)))


def summarize_clusters(df: DataFrame, *, cluster: str = "cluster", weight: str = "flight_count") -> DataFrame:
    """Cells, total weight, weighted centre and the largest distance to it, per cluster; noise is left out."""
    rows, w = df.filter(F.col(cluster).isNotNull()), F.col(weight)
    mid = rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(w).alias("total_flight_count"),
        (F.sum(F.col("lat") * w) / F.sum(w)).alias("center_lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("center_lon"),
    )
    far = geo.haversine(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon"), radius=geo.EARTH_RADIUS_KM)
    radius = rows.join(mid.select(cluster, "center_lat", "center_lon"), cluster).groupBy(cluster).agg(F.max(far).alias("radius_km"))
    return mid.join(radius, cluster).orderBy(F.desc("total_flight_count"), cluster)
