"""Distances, bearings and grid cells as plain Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sphere radii in use (metres for residuals, km for reference points)
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6371.0088

# fixed values: approximate cell edge in km per resolution name
CELL_KM = {3: 65.0, 4: 25.0, 5: 8.5}
_ROOT3 = math.sqrt(3.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, *, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in the unit of ``radius``; null if any coordinate is null."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least/greatest skip nulls, so the null case is spelled out
    a = F.when(a.isNotNull(), F.greatest(F.least(a, F.lit(1.0)), F.lit(0.0)))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360) degrees."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def circular_diff(a: Column, b: Column) -> Column:
    """Signed angle a-b in [-180, 180) degrees."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def wrap_radians(x: Column) -> Column:
    """Angle in (-pi, pi]; -pi itself maps to +pi."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - x, F.lit(2 * math.pi))


def square_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Equal-angle cell id ``<row>_<col>``."""
    return F.concat_ws(
        "_", F.floor(lat / degrees).cast("string"), F.floor(lon / degrees).cast("string")
    )


def square_cell_center(cell: Column, degrees: float) -> tuple[Column, Column]:
    row, col = F.split(cell, "_")[0].cast("double"), F.split(cell, "_")[1].cast("double")
    return (row + 0.5) * degrees, (col + 0.5) * degrees


def _hex_size(resolution: int) -> float:
    if resolution not in CELL_KM:
        raise ValueError(f"resolution must be one of {sorted(CELL_KM)}")
    return CELL_KM[resolution] / EARTH_RADIUS_KM


def hex_cell(lat: Column, lon: Column, resolution: int) -> Column:
    """Hexagon id ``<resolution>_<q>_<r>`` on the cylindrical equal-area plane.

    The plane is x = longitude in radians, y = sin(latitude); ids are this
    library's own and do not equal those of any other hexagon index.
    """
    size = _hex_size(resolution)
    x, y = F.radians(lon), F.sin(F.radians(lat))
    q = (x * (_ROOT3 / 3) - y / 3) / size
    r = y * (2.0 / 3) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws("_", F.lit(str(resolution)), fq.cast("long").cast("string"), fr.cast("long").cast("string"))


def _hex_plane(cell: Column, resolution: int) -> tuple[Column, Column]:
    size = _hex_size(resolution)
    q, r = F.split(cell, "_")[1].cast("double"), F.split(cell, "_")[2].cast("double")
    return (q + r / 2) * (_ROOT3 * size), r * (1.5 * size)


def _unproject(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.asin(F.greatest(F.least(y, F.lit(1.0)), F.lit(-1.0)))), F.degrees(x)


def hex_center(cell: Column, resolution: int) -> tuple[Column, Column]:
    """(lat, lon) of the cell centre."""
    return _unproject(*_hex_plane(cell, resolution))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once however often it appears."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def close_ring(ring: Column) -> Column:
    """Ring of [lon, lat] pairs: shifted +360 across the antimeridian, null at a pole, closed.

    A ring whose corners leave the projection plane has no polygon and gives null.
    """

    def facts(r: Column) -> Column:
        lons = F.transform(r, lambda p: p[0])
        wide = (F.array_max(lons) - F.array_min(lons)) > 180
        return F.struct(r.alias("r"), wide.alias("wide"), F.exists(r, lambda p: F.abs(p[1]) >= 90).alias("polar"))

    def shift(f: Column) -> Column:
        moved = F.transform(f["r"], lambda p: F.array(F.when(f["wide"] & (p[0] < 0), p[0] + 360).otherwise(p[0]), p[1]))
        return F.when(~f["polar"], moved)

    return bound(bound(bound(ring, facts), shift), lambda s: F.concat(s, F.slice(s, 1, 1)))


def hex_polygon(cell: Column, resolution: int) -> Column:
    """Closed boundary ring as an array of [lon, lat]."""
    size = _hex_size(resolution)
    cx, cy = _hex_plane(cell, resolution)

    def corner(angle_deg: float, c: Column) -> Column:
        a = math.radians(angle_deg)
        lat, lon = _unproject(c["x"] + math.cos(a) * size, c["y"] + math.sin(a) * size)
        # a plane position beyond +-180 is the far side of the antimeridian
        return bound(lon, lambda l: F.array(F.when(l > 180, l - 360).when(l < -180, l + 360).otherwise(l), lat))

    center = F.struct(cx.alias("x"), cy.alias("y"))
    return close_ring(bound(center, lambda c: F.array(*[corner(60.0 * i - 30.0, c) for i in range(6)])))


def great_circle_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int = 32) -> Column:
    """``n + 1`` points [lat, lon] along the great circle, longitude made continuous.

    Ends closer than about a millimetre give the two ends only.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    rad = lambda c: F.radians(c.cast("double"))
    ends = F.struct(
        rad(lat1).alias("p1"), rad(lon1).alias("l1"), rad(lat2).alias("p2"), rad(lon2).alias("l2"),
        haversine(lat1, lon1, lat2, lon2, radius=1.0).alias("arc"),
    )

    def path(e: Column) -> Column:
        def point(i: Column) -> Column:
            f = i / F.lit(float(n))
            a, b = F.sin((1 - f) * e["arc"]) / F.sin(e["arc"]), F.sin(f * e["arc"]) / F.sin(e["arc"])
            x = a * F.cos(e["p1"]) * F.cos(e["l1"]) + b * F.cos(e["p2"]) * F.cos(e["l2"])
            y = a * F.cos(e["p1"]) * F.sin(e["l1"]) + b * F.cos(e["p2"]) * F.sin(e["l2"])
            z = a * F.sin(e["p1"]) + b * F.sin(e["p2"])
            # a minor arc never turns by more than half a circle from its start
            turn = circular_diff(F.degrees(F.atan2(y, x)), F.degrees(e["l1"]))
            return F.array(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(e["l1"]) + turn)

        two = F.array(F.array(F.degrees(e["p1"]), F.degrees(e["l1"])), F.array(F.degrees(e["p2"]), F.degrees(e["l2"])))
        return F.when(e["arc"] < 1e-9, two).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n)), point))

    return bound(ends, path)
