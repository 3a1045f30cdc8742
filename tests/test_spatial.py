"""Geometry by known values; neighbourhood operators by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators import cluster, routes


def km(a, b):
    (la, lo), (lb, lp) = a, b
    p, q = math.radians(la), math.radians(lb)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    L = lambda v: F.lit(float(v))
    r = one(
        spark, quarter=geo.haversine(L(0), L(0), L(0), L(90), radius=1.0), east=geo.bearing(L(0), L(0), L(0), L(10)), south=geo.bearing(L(10), L(0), L(0), L(0)),
        diff=geo.circular_diff(L(10), L(350)), half=geo.circular_diff(L(180), L(0)), pi=geo.wrap_radians(L(-math.pi)), none=geo.haversine(L(0), L(0), F.lit(None).cast("double"), L(1)),
        path=geo.great_circle_points(L(0), L(170), L(0), L(-170), 4), same=geo.great_circle_points(L(5), L(5), L(5), L(5), 4),
    )
    assert r.quarter == pytest.approx(math.pi / 2) and r.east == pytest.approx(90) and r.south == pytest.approx(180)
    assert r.diff == pytest.approx(20) and r.half == pytest.approx(-180) and r.pi == pytest.approx(math.pi) and r.none is None
    assert [round(p[1], 6) for p in r.path] == [170, 175, 180, 185, 190] and len(r.same) == 2


def test_hexagons(spark):
    rnd = random.Random(1)
    pts = [(rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for _ in range(200)] + [(10.0, 179.99), (-10.0, -179.99)]
    df = spark.createDataFrame(pts, "lat double, lon double").withColumn("cell", geo.hex_cell(F.col("lat"), F.col("lon"), 3))
    la, lo = geo.hex_center(F.col("cell"), 3)
    rows = df.withColumns({"la": la, "lo": lo, "ring": geo.hex_polygon(F.col("cell"), 3)}).withColumn("back", geo.hex_cell(F.col("la"), F.col("lo"), 3)).collect()
    size = 65.0 / 6371.0088
    for r in rows:
        assert r.back == r.cell  # a centre lies in its own cell
        dx, dy = math.radians(r.lon - r.lo), math.sin(math.radians(r.lat)) - math.sin(math.radians(r.la))
        assert math.hypot(dx, dy) <= size * (1 + 1e-9)  # on the plane, within the corner radius
        assert r.ring is None or (len(r.ring) == 7 and r.ring[0] == r.ring[-1] and max(p[0] for p in r.ring) - min(p[0] for p in r.ring) < 180)


def cells(n=160, seed=4):
    rnd = random.Random(seed)
    out = [(f"c{i:03d}", rnd.gauss(50, 3), rnd.gauss(10, 4), float(rnd.randint(1, 60))) for i in range(n)]
    return out + [(f"d{i:03d}", rnd.gauss(-2, 1), 179.5 + rnd.gauss(0, 1), float(rnd.randint(1, 60))) for i in range(40)]


def wrapped(rows):
    return [(k, la, (lo + 180) % 360 - 180, w) for k, la, lo, w in rows]


def test_knn_threshold(spark):
    rows = wrapped(cells())
    got = {r.key: r for r in cluster.knn_threshold(spark.createDataFrame(rows, "key string, lat double, lon double, v double"), key="key", value="v", k=25, prob=0.9, floor=5.0, start_km=60.0).collect()}
    for k, la, lo, v in rows:
        near = sorted((km((la, lo), (b, c)), n, w) for n, b, c, w in rows)[:25]
        vals = sorted(w for _, _, w in near)
        at = 0.9 * 24
        want = max(vals[int(at)] + (at - int(at)) * (vals[int(at) + 1] - vals[int(at)]), 5.0)
        assert got[k].threshold == pytest.approx(want) and got[k].keep == (v >= want)


@pytest.mark.parametrize("eps,minimum", [(60.0, 4), (120.0, 8)])
def test_dbscan(spark, eps, minimum):
    rows = wrapped(cells())
    near = {k: [n for n, b, c, _ in rows if km((la, lo), (b, c)) <= eps] for k, la, lo, _ in rows}
    core = {k for k, v in near.items() if len(v) >= minimum}
    label = {}
    for k in sorted(core):
        if k in label:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += [n for n in near[x] if n in core]
    for k in near:
        if k not in core:
            label[k] = min((label[n] for n in near[k] if n in core), default=None)
    got = cluster.dbscan(spark.createDataFrame(rows, "key string, lat double, lon double, v double"), key="key", eps_km=eps, min_samples=minimum)
    assert {r.key: r.cluster for r in got.collect()} == label
    assert len(set(label.values()) - {None}) > 1


def test_two_pass_only_adds_to_noise(spark):
    df = spark.createDataFrame(wrapped(cells()), "key string, lat double, lon double, v double")
    strict = {r.key: r.cluster for r in cluster.dbscan(df, key="key", eps_km=60.0, min_samples=8).collect()}
    two = {r.key: (r.cluster, r.pass_no) for r in cluster.dbscan_two_pass(df, key="key", eps_km=60.0, strict=8, relaxed=3).collect()}
    assert all(two[k] == (c, 1) for k, c in strict.items() if c is not None)
    assert any(p == 2 for _, p in two.values())


def test_long_chain_is_one_component(spark):
    n = 200
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)]
    both = edges + [(b, a) for a, b in edges]
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "id string")
    got = cluster.connected_components(nodes, spark.createDataFrame(both, "a string, b string"))
    assert {r.label for r in got.collect()} == {"n000"}


def test_nearest_within(spark):
    rnd = random.Random(8)
    pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(120)]
    refs = [(f"r{i}", rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(90)]
    got = routes.nearest_within(
        spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(refs, "ident string, ref_lat double, ref_lon double"), key=["id"], ident="ident", max_km=900.0
    ).collect()
    assert len(got) == len(pts)
    for r in got:
        d, name = min((km((r.lat, r.lon), (b, c)), n) for n, b, c in refs)
        assert r.ident == (name if d <= 900 else None)


def test_narrowest_range(spark):
    ranges = [(0, 1000, "(reserved, X)"), (100, 199, "A"), (150, 160, "Inner"), (5000, 9000, "B, quoted")]
    df = spark.createDataFrame([("96",), ("9b",), ("c8",), ("1388",), ("ffff",), ("zz",), (None,)], "hex string")
    got = {r.hex: (r.country, r.category) for r in routes.country_lookup(df, spark.createDataFrame(ranges, "start long, end long, country string"), hex_id="hex", bucket=64).collect()}
    assert got["96"] == ("Inner", "country") and got["c8"] == (None, "reserved") and got["1388"] == ("B, quoted", "country")
    assert got["9b"] == ("Inner", "country") and got["ffff"] == got["zz"] == (None, "no_match")
