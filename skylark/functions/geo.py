"""Geographical predicates and distances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def distance_m(lat: Column, lng: Column, at: tuple[float, float]) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    p, q = F.radians(lat), F.radians(F.lit(at[0]))
    a = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng - F.lit(at[1])) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def around(lat: Column, lng: Column, at: tuple[float, float], radius: float | None) -> Column:
    """Whether a point is within the radius; a band of latitudes comes first and can be pushed into a scan."""
    if radius is None:
        return lat.isNotNull() & lng.isNotNull()
    reach = radius / EARTH_M * 57.29577951308232 * 1.000001
    return lat.between(at[0] - reach, at[0] + reach) & (distance_m(lat, lng, at) <= radius)


def inside_boxes(lat: Column, lng: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Whether a point is in a box given by two opposite corners."""
    return reduce(lambda a, b: a | b, [lat.between(min(b[0], b[2]), max(b[0], b[2])) & lng.between(min(b[1], b[3]),
        max(b[1], b[3])) for b in boxes])


def inside_polygon(lat: Column, lng: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is in the polygon: an odd number of edges lies to its east, and none runs through it."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for p, q in zip(points, [*points[1:], points[0]], strict=True):
        (a, b), (c, d) = sorted((p, q))  # neighbours that share an edge compute the same line
        on_edge |= (lat == p[0]) & (lng == p[1])
        if a == c:
            on_edge |= (lat == a) & lng.between(b, d)
        else:
            slope = (d - b) / (c - a)
            east, line = lng - lat * slope, b - a * slope
            crossings += ((lat >= a) & (lat < c) & (east < line)).cast("int")
            on_edge |= lat.between(a, c) & (east == line)
    return (crossings % 2 == 1) & ~on_edge


def precision(distance: Column, by: int | Sequence[tuple[int, int]] = 1) -> Column:
    """Distances as whole buckets: one width, or (from, width) ranges in rising order."""
    if isinstance(by, int):
        return F.floor(distance / by).cast("long")
    out = F.floor(distance).cast("long")
    for start, width in by:
        out = F.when(distance >= start, F.floor(distance / width).cast("long")).otherwise(out)
    return out


def auto_radius(distance: Column, share: float = 0.1, least: float = 0.0) -> Column:
    """An aggregate: the distance within which the given share of points lies, and no less than `least`."""
    return F.greatest(F.percentile(distance, F.lit(share)), F.lit(least))
