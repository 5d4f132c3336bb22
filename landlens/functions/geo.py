"""Column mathematics of map projections, tiles and measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid, Web Mercator radius, metres a degree, square metres a pyeong.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
MERCATOR_HALF = math.pi * SEMI_MAJOR
DEGREE_LAT, DEGREE_LNG = 111132.95, 111320.0
PYEONG = 3.3058
TILE = 256
VOID = -32768


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class TransverseMercator:
    """Transverse Mercator on GRS80 by the usual series to the sixth power; all parameters in degrees and metres."""

    def __init__(self, lon0: float, lat0: float, k0: float = 1.0, false_east: float = 200000.0, false_north: float = 600000.0):
        self.lon0, self.k0, self.fe, self.fn = math.radians(lon0), k0, false_east, false_north
        self.e2 = FLATTENING * (2 - FLATTENING)
        self.ep2 = self.e2 / (1 - self.e2)
        e2 = self.e2
        #: Coefficients of the meridian arc: of latitude and of the sines of 2, 4 and 6 times it.
        self.arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
        p = math.radians(lat0)
        self.m0 = SEMI_MAJOR * (self.arc[0] * p - self.arc[1] * math.sin(2 * p) + self.arc[2] * math.sin(4 * p) - self.arc[3] * math.sin(6 * p))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """East and north of a position in degrees."""
        p = F.radians(lat)
        s, c, t2 = F.sin(p), F.cos(p), F.pow(F.tan(p), 2)
        n = SEMI_MAJOR / F.sqrt(1 - self.e2 * s * s)
        g = self.ep2 * c * c
        a = (F.radians(lon) - self.lon0) * c
        m = SEMI_MAJOR * (self.arc[0] * p - self.arc[1] * F.sin(2 * p) + self.arc[2] * F.sin(4 * p) - self.arc[3] * F.sin(6 * p))
        east = a + (1 - t2 + g) * F.pow(a, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * g - 58 * self.ep2) * F.pow(a, 5) / 120
        north = F.pow(a, 2) / 2 + (5 - t2 + 9 * g + 4 * g * g) * F.pow(a, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * g - 330 * self.ep2) * F.pow(a, 6) / 720
        return self.fe + self.k0 * n * east, self.fn + self.k0 * (m - self.m0 + n * F.tan(p) * north)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        mu = (self.m0 + (north - self.fn) / self.k0) / (SEMI_MAJOR * self.arc[0])
        q = math.sqrt(1 - self.e2)
        e1 = (1 - q) / (1 + q)
        foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
        s, c, t = F.sin(foot), F.cos(foot), F.tan(foot)
        w, t2, g = 1 - self.e2 * s * s, t * t, self.ep2 * c * c
        n, r = SEMI_MAJOR / F.sqrt(w), SEMI_MAJOR * (1 - self.e2) / F.pow(w, 1.5)
        d = (east - self.fe) / (n * self.k0)
        lat = foot - n * t / r * (F.pow(d, 2) / 2 - (5 + 3 * t2 + 10 * g - 4 * g * g - 9 * self.ep2) * F.pow(d, 4) / 24 + (61 + 90 * t2 + 298 * g + 45 * t2 * t2 - 252 * self.ep2 - 3 * g * g) * F.pow(d, 6) / 720)
        lon = self.lon0 + (d - (1 + 2 * t2 + g) * F.pow(d, 3) / 6 + (5 - 2 * g + 28 * t2 - 3 * g * g + 8 * self.ep2 + 24 * t2 * t2) * F.pow(d, 5) / 120) / c
        return F.degrees(lon), F.degrees(lat)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SEMI_MAJOR, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SEMI_MAJOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2)


def tile_resolution(z: Column) -> Column:
    """Metres a pixel."""
    return 2 * MERCATOR_HALF / TILE / F.pow(F.lit(2.0), z)


def tile_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Tile of a Mercator point; rows count from the north."""
    side = tile_resolution(z) * TILE
    return F.floor((x + MERCATOR_HALF) / side).cast("int"), F.floor((MERCATOR_HALF - y) / side).cast("int")


def tile_origin(tx: Column, ty: Column, z: Column) -> tuple[Column, Column]:
    """North-west corner of a tile."""
    side = tile_resolution(z) * TILE
    return tx * side - MERCATOR_HALF, MERCATOR_HALF - ty * side


def to_decimetres(v: Column) -> Column:
    """Metres as whole decimetres within ±32000; null as the void value."""
    return F.when(v.isNull() | F.isnan(v), VOID).otherwise(F.greatest(F.least(F.bround(v * 10), F.lit(32000.0)), F.lit(-32000.0))).cast("int")


def from_decimetres(q: Column) -> Column:
    return F.when(q != VOID, q / 10.0)


def local_metres(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """East and north of a position from another, by a flat scale."""
    return (lng - lng0) * DEGREE_LNG * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE_LAT


COMPASS = ("북", "북동", "동", "남동", "남", "남서", "서", "북서")


def compass_name(degrees: Column) -> Column:
    """Nearest of the eight winds; null for a direction that is null or not finite."""
    names = F.array(*[F.lit(n) for n in COMPASS])
    return F.when(F.abs(degrees) < float("inf"), F.element_at(names, (F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)) + 1).cast("int")))


def area_units(square_metres: Column, ridge: Column) -> dict[str, Column]:
    return {"pyeong": square_metres / PYEONG, "ha": square_metres / 10000, "storeys": F.greatest(F.lit(1), F.floor(ridge / 3 + 0.5)).cast("int")}


def solar_position(lat: Column, declination: Column, hour_angle: Column) -> tuple[Column, Column]:
    """Elevation and azimuth of the sun in degrees; azimuth from south, west positive."""
    f, d, h = F.radians(lat), F.radians(declination), F.radians(hour_angle)
    up = F.asin(F.sin(f) * F.sin(d) + F.cos(f) * F.cos(d) * F.cos(h))
    return F.degrees(up), F.degrees(F.atan2(F.sin(h), F.cos(h) * F.sin(f) - F.tan(d) * F.cos(f)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


# -- rings: array<struct<x, y>>, first point not repeated ---------------------------------------------------------------
def _edges(ring: Column) -> Column:
    """Each point with its successor, the last with the first."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), after.alias("b"))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point."""

    def crosses(e):
        (ax, ay), (bx, by) = ((e[p]["x"], e[p]["y"]) for p in "ab")
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by == ay, 1e-300).otherwise(by - ay) + ax)

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the first ring and none of the holes."""
    return in_ring(x, y, rings[0]) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda r: in_ring(x, y, r))


def polygon_area_lonlat(rings: Column) -> Column:
    """Square metres of a lon/lat polygon with holes, scaled at its mean latitude."""
    lat = F.aggregate(rings[0], F.lit(0.0), lambda s, p: s + p["y"]) / F.size(rings[0])
    scale = DEGREE_LAT * DEGREE_LNG * F.cos(F.radians(lat))
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), F.lit(0.0), lambda s, r: s + ring_area(r))
    return (ring_area(rings[0]) - holes) * scale


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    """Smallest distance from a point to an edge of the ring."""

    def one(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(_edges(ring), one))


def path_length(points: Column) -> Column:
    """struct<flat, slope, rise> of a path of struct<x, y, z>."""
    legs = F.zip_with(F.slice(points, 2, F.size(points)), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda b, a: F.struct(F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("h"), (b["z"] - a["z"]).alias("v")))
    add = lambda f: F.aggregate(legs, F.lit(0.0), lambda s, e: s + f(e))
    return F.struct(add(lambda e: e["h"]).alias("flat"), add(lambda e: F.hypot(e["h"], e["v"])).alias("slope"), (F.element_at(points, -1)["z"] - points[0]["z"]).alias("rise"))
