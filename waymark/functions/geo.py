"""Coordinates and rings as expressions: distances, gates, repairs, areas, point tests.

A ring is an array of ``struct<x: double, y: double>`` (longitude, latitude); it may be open or closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


@dataclass(frozen=True)
class Box:
    """A region's bounds, inclusive; which region is the caller's to say."""

    south: float
    north: float
    west: float
    east: float

    def holds(self, lat: Column, lon: Column) -> Column:
        """J3; null coordinates are outside."""
        return F.coalesce(lat.between(self.south, self.north) & lon.between(self.west, self.east), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """J1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The equirectangular distance."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return EARTH_M * F.sqrt(x * x + y * y)


def unswapped(lat: Column, lon: Column, box: Box) -> Column:
    """``lat`` and ``lon``, exchanged where only the other order can be right or lies in ``box``."""
    swap = ((F.abs(lat) > 90) & (F.abs(lon) <= 90)) | (box.holds(lon, lat) & ~box.holds(lat, lon))
    swap = F.coalesce(swap, F.lit(False))
    return F.struct(F.when(swap, lon).otherwise(lat).alias("lat"), F.when(swap, lat).otherwise(lon).alias("lon"))


def pruned(lat: Column, lon: Column, box: Box) -> Column:
    """Both coordinates, or both null outside the box."""
    ok = box.holds(lat, lon)
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


def fixed8(c: Column) -> Column:
    """J8; blank for null."""
    return F.coalesce(F.format_string("%.8f", c), F.lit(""))


def ring_of(text: Column) -> Column:
    """``lon,lat[,alt] lon,lat …`` as a ring (L2); parts that aren't numbers are left out."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.struct(F.split_part(t, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(t, F.lit(","), F.lit(2)).try_cast("double").alias("y")))
    return F.filter(parts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def closed(ring: Column) -> Column:
    """The first point again at the end."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when((F.size(ring) > 0) & (first != last), F.concat(ring, F.array(first))).otherwise(ring)


def edges(ring: Column) -> Column:
    """``a`` and ``b`` of each side, the closing one included."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    """The planar shoelace sum."""
    return _sum(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area_m2(ring: Column) -> Column:
    """The area on a tangent plane at the ring's mean latitude."""
    lat = _sum(F.transform(ring, lambda p: p["y"])) / F.greatest(F.size(ring), F.lit(1))
    return F.abs(signed_area(ring)) * F.pow(F.radians(F.lit(1.0)) * EARTH_M, F.lit(2)) * F.cos(F.radians(lat))


def centroid(rings: Column) -> Column:
    """The area-weighted centroid of rings (J7); null where the area is zero."""
    def moments(ring: Column) -> Column:
        each = F.transform(edges(ring), lambda e: F.struct((e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).alias("c"), (e["a"]["x"] + e["b"]["x"]).alias("x"), (e["a"]["y"] + e["b"]["y"]).alias("y")))
        area = _sum(F.transform(each, lambda t: t["c"])) / 2
        sign = F.signum(area)
        return F.struct((area * sign).alias("a"), (_sum(F.transform(each, lambda t: t["c"] * t["x"])) / 6 * sign).alias("x"), (_sum(F.transform(each, lambda t: t["c"] * t["y"])) / 6 * sign).alias("y"))

    m = F.transform(rings, moments)
    area = _sum(F.transform(m, lambda t: t["a"]))
    part = lambda k: F.when(area > 0, _sum(F.transform(m, lambda t: t[k])) / area)
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def on_side(x: Column, y: Column, a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Whether a point lies on a side (K1)."""
    cross = (x - a["x"]) * (b["y"] - a["y"]) - (y - a["y"]) * (b["x"] - a["x"])
    dot = (x - a["x"]) * (x - b["x"]) + (y - a["y"]) * (y - b["y"])
    return (F.abs(cross) <= eps) & (dot <= eps)


def in_ring(x: Column, y: Column, ring: Column, eps: float = 1e-10) -> Column:
    """Whether a point lies in a ring, its border included (K2); a ring of fewer than three points holds none."""
    sides = edges(ring)
    border = F.exists(sides, lambda e: on_side(x, y, e["a"], e["b"], eps))

    def crosses(e: Column) -> Column:
        return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])

    inside = F.aggregate(sides, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))
    return (F.size(ring) >= 3) & (border | inside)


def edge_distance(x: Column, y: Column, ring: Column) -> Column:
    """The least distance to a side, inside as well as outside (K3), in the ring's units."""

    def to_side(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        along = (x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy
        t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / (dx * dx + dy * dy))))
        return F.sqrt(F.pow(x - e["a"]["x"] - t * dx, 2) + F.pow(y - e["a"]["y"] - t * dy, 2))

    return F.array_min(F.transform(edges(ring), to_side))


def bounds(ring: Column) -> Column:
    """``west``, ``east``, ``south``, ``north`` of a ring, for a range test before the ring's own."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north"))


def without_collinear(ring: Column, eps: float = 1e-12) -> Column:
    """A ring without points on the line between their neighbours."""
    n = F.size(ring)

    def bends(p: Column, i: Column) -> Column:
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        return F.abs((p["x"] - a["x"]) * (b["y"] - a["y"]) - (p["y"] - a["y"]) * (b["x"] - a["x"])) > eps

    return F.filter(ring, bends)


def largest_ring(rings: Column) -> Column:
    """K18."""
    return F.get(F.array_sort(rings, lambda a, b: F.signum(F.abs(signed_area(b)) - F.abs(signed_area(a))).cast("int")), F.lit(0))
