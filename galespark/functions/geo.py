"""Spherical geometry as Column expressions.

Everything here stays inside code generation; the ellipsoidal forms live in
``geodesic.py`` as Arrow batches for callers that need WGS84 distances.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galespark.functions.units import M_PER_DEGREE, signed_lon

EARTH_RADIUS_M = 6371008.8


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine form."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, -180..180."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.degrees(F.atan2(y, x))


def dest_lat(lat: Column, az: Column, dist: Column) -> Column:
    d = dist / F.lit(EARTH_RADIUS_M)
    s = F.sin(F.radians(lat)) * F.cos(d) + F.cos(F.radians(lat)) * F.sin(d) * F.cos(F.radians(az))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def dest_dlon(lat: Column, az: Column, dist: Column) -> Column:
    """Longitude change of the direct problem, not wrapped."""
    d = dist / F.lit(EARTH_RADIUS_M)
    lat2 = F.radians(dest_lat(lat, az, dist))
    y = F.sin(F.radians(az)) * F.sin(d) * F.cos(F.radians(lat))
    x = F.cos(d) - F.sin(F.radians(lat)) * F.sin(lat2)
    return F.degrees(F.atan2(y, x))


def dest_lon(lat: Column, lon: Column, az: Column, dist: Column) -> Column:
    return signed_lon(lon + dest_dlon(lat, az, dist))


def metres_to_lat_degrees(dist: Column) -> Column:
    return dist / F.lit(M_PER_DEGREE)


def metres_to_lon_degrees(lat: Column, dist: Column) -> Column:
    return dist / (F.lit(M_PER_DEGREE) * F.cos(F.radians(lat)))


def lat_gap(a: Column, b: Column) -> Column:
    """Latitude difference with the half-turn wrap of the link rule."""
    d = F.abs(a - b)
    return F.least(d, F.abs(d - F.lit(180.0)))


def lon_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.abs(d - F.lit(360.0)))


def circle_ring(lat: Column, lon: Column, radius_m: Column, sides: int = 24) -> Column:
    """Closed ring of points round a centre, one each 360/sides degrees."""
    step = 360 // sides
    angles = F.sequence(F.lit(0), F.lit(360 - step), F.lit(step))
    ring = F.transform(
        angles,
        lambda a: F.struct(
            dest_lon(lat, lon, a.cast("double"), radius_m).alias("lon"),
            dest_lat(lat, a.cast("double"), radius_m).alias("lat"),
        ),
    )
    return F.concat(ring, F.slice(ring, 1, 1))


def shoelace(ring: Column) -> Column:
    """Sum of (x2-x1)(y2+y1); negative for a counter-clockwise ring."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nxt, lambda p, q: (q["lon"] - p["lon"]) * (q["lat"] + p["lat"]))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def counter_clockwise(ring: Column) -> Column:
    return F.when(shoelace(ring) < 0, ring).otherwise(F.reverse(ring))


def unwrap_ring(ring: Column) -> Column:
    """First vertex into -180..180, every other one to within 180 of it."""
    first = signed_lon(F.element_at(ring, 1)["lon"])
    return F.transform(
        ring,
        lambda p: F.struct(
            (p["lon"] + F.lit(360.0) * F.round((first - p["lon"]) / F.lit(360.0))).alias("lon"),
            p["lat"].alias("lat"),
        ),
    )


def clip_ring(ring: Column, at: float, keep_below: bool) -> Column:
    """One half of a ring cut by the meridian ``at`` (one half-plane of the
    Sutherland-Hodgman clip). The ring is closed; the result is closed too,
    and empty where nothing is left."""

    def inside(p):
        return p["lon"] <= F.lit(at) if keep_below else p["lon"] >= F.lit(at)

    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))

    def edge(p, q):
        ratio = (F.lit(at) - p["lon"]) / (q["lon"] - p["lon"])
        cross = F.struct(F.lit(float(at)).alias("lon"), (p["lat"] + (q["lat"] - p["lat"]) * ratio).alias("lat"))
        end = F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))
        none = F.filter(F.array(end), lambda _: F.lit(False))
        return (
            F.when(inside(p) & inside(q), F.array(end))
            .when(inside(p), F.array(cross))
            .when(inside(q), F.array(cross, end))
            .otherwise(none)
        )

    open_part = F.array_distinct(F.flatten(F.zip_with(ring, nxt, edge)))
    return F.when(F.size(open_part) >= 3, F.concat(open_part, F.slice(open_part, 1, 1)))


def split_at_antimeridian(ring: Column) -> Column:
    """Array of one or two rings, each inside -180..180."""
    far = unwrap_ring(ring)
    low = F.array_min(F.transform(far, lambda p: p["lon"]))
    high = F.array_max(F.transform(far, lambda p: p["lon"]))

    def shifted(r, by):
        return F.transform(r, lambda p: F.struct((p["lon"] + F.lit(float(by))).alias("lon"), p["lat"].alias("lat")))

    east = F.array(clip_ring(far, 180.0, True), shifted(clip_ring(far, 180.0, False), -360))
    west = F.array(clip_ring(far, -180.0, False), shifted(clip_ring(far, -180.0, True), 360))
    rings = F.when((low < 180) & (high > 180), east).when((low < -180) & (high > -180), west).otherwise(F.array(far))
    return F.filter(rings, lambda r: r.isNotNull())


def covers(ring: list[tuple[float, float]], lat: Column, lon: Column) -> Column:
    """Point in polygon for a fixed (lon, lat) ring; boundary points count."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    corners = {(x, y) for x in (min(xs), max(xs)) for y in (min(ys), max(ys))}
    if set(ring) == corners:
        return box
    on_edge, crossings = F.lit(False), F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        on_edge = on_edge | (
            (cross == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
        )
        if y1 != y2:
            spans = (lat >= min(y1, y2)) & (lat < max(y1, y2))
            at = (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return box & (on_edge | (crossings % 2 == 1))
