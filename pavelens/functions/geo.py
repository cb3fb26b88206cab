"""Geodesic column functions on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: sphere radius in metres.
EARTH_RADIUS_M = 6378137.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0)))) * (2 * EARTH_RADIUS_M)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return wrap_degrees(F.degrees(F.atan2(east, north)))


def wrap_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def destination(lat: Column, lon: Column, heading_rad: Column, dist: Column) -> Column:
    """Great-circle destination as struct(lat, lon)."""
    la, arc = F.radians(lat), dist / EARTH_RADIUS_M
    sin_out = F.sin(la) * F.cos(arc) + F.cos(la) * F.sin(arc) * F.cos(heading_rad)
    out = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_out)))
    dlon = F.atan2(F.sin(heading_rad) * F.sin(arc) * F.cos(la), F.cos(arc) - F.sin(la) * F.sin(out))
    return F.struct(F.degrees(out).alias("lat"), F.degrees(F.radians(lon) + dlon).alias("lon"))


def local_to_global(lat: Column, lon: Column, heading_deg: Column, x: Column, z: Column) -> Column:
    """Offset x metres right and z metres forward of a heading, as struct(lat, lon)."""
    return destination(lat, lon, F.radians(heading_deg) + F.atan2(x, z), F.hypot(x, z))


def global_to_local(lat: Column, lon: Column, heading_deg: Column, to_lat: Column, to_lon: Column) -> Column:
    """Inverse of local_to_global, as struct(x, z)."""
    d = haversine(lat, lon, to_lat, to_lon)
    a = F.radians(bearing(lat, lon, to_lat, to_lon) - heading_deg)
    return F.struct((d * F.sin(a)).alias("x"), (d * F.cos(a)).alias("z"))


def camera_offset(lat: Column, lon: Column, heading_deg: Column, right_m: Column, forward_m: Column) -> Column:
    moved = local_to_global(lat, lon, heading_deg, right_m, forward_m)
    still = F.struct(lat.alias("lat"), lon.alias("lon"))
    return F.when((right_m == 0.0) & (forward_m == 0.0), still).otherwise(moved)


def decompose_offset(lat1: Column, lon1: Column, lat2: Column, lon2: Column, heading_deg: Column) -> Column:
    """Displacement along and across a heading, as struct(longitudinal, lateral)."""
    d = haversine(lat1, lon1, lat2, lon2)
    a = F.radians(bearing(lat1, lon1, lat2, lon2) - heading_deg)
    tiny = d < 1e-9
    return F.struct(
        F.when(tiny, 0.0).otherwise(d * F.cos(a)).alias("longitudinal"),
        F.when(tiny, 0.0).otherwise(d * F.sin(a)).alias("lateral"),
    )


def project_xy(lat: Column, lon: Column, base_lat: Column, base_lon: Column) -> Column:
    """North-aligned local plane by distance and bearing, as struct(x, y)."""
    d = haversine(base_lat, base_lon, lat, lon)
    a = F.radians(bearing(base_lat, base_lon, lat, lon))
    return F.struct((d * F.sin(a)).alias("x"), (d * F.cos(a)).alias("y"))


def unproject_xy(x: Column, y: Column, base_lat: Column, base_lon: Column) -> Column:
    return destination(base_lat, base_lon, F.atan2(x, y), F.hypot(x, y))


def equirect_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """East/north metres from an origin, longitude scaled by cos(lat0)."""
    return F.struct(
        (F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M).alias("x"),
        (F.radians(lat - lat0) * EARTH_RADIUS_M).alias("y"),
    )


def equirect_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    return F.struct(
        (lat0 + F.degrees(y / EARTH_RADIUS_M)).alias("lat"),
        (lon0 + F.degrees(x / (F.cos(F.radians(lat0)) * EARTH_RADIUS_M))).alias("lon"),
    )


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> Column:
    xy = equirect_xy(lat, lon, lat0, lon0)
    return F.struct(xy["x"].alias("x"), xy["y"].alias("y"), (alt - alt0).alias("z"))


def view_heading(heading_deg: Column, view: Column, yaw_deg: Column) -> Column:
    return wrap_degrees(heading_deg + F.when(view == "rear", 180.0).otherwise(0.0) + yaw_deg)


def footprint(lat: Column, lon: Column, heading_deg: Column, near: Column, far: Column, width: Column) -> Column:
    """Ground rectangle ahead of the camera: centre, size and corners as lon/lat.

    Corners run far-left, far-right, near-right, near-left.
    """
    half = width / 2
    zero = F.lit(0.0)
    centre = local_to_global(lat, lon, heading_deg, zero, (near + far) / 2)

    def corner(x: Column, z: Column) -> Column:
        p = local_to_global(lat, lon, heading_deg, x, z)
        return F.array(p["lon"], p["lat"])

    return F.struct(
        centre["lat"].alias("lat"),
        centre["lon"].alias("lon"),
        heading_deg.alias("heading"),
        width.alias("width_m"),
        (far - near).alias("height_m"),
        F.array(corner(-half, far), corner(half, far), corner(half, near), corner(-half, near)).alias("corners"),
    )


def close_ring(ring: Column) -> Column:
    """Append the first position when the ring is open."""
    first = F.element_at(ring, 1)
    closed = F.concat(ring, F.array(first))
    return F.when(F.size(ring) == 0, ring).when(first == F.element_at(ring, -1), ring).otherwise(closed)


def bev_px_to_lonlat(
    points: Column, lat: Column, lon: Column, heading_deg: Column, gsd: Column, half_width: Column, far: Column
) -> Column:
    """Top-down pixel polygon (array of struct(x, y)) to a closed lon/lat ring."""

    def place(p: Column) -> Column:
        g = local_to_global(lat, lon, heading_deg, p["x"] * gsd - half_width, far - p["y"] * gsd)
        return F.array(g["lon"], g["lat"])

    return close_ring(F.transform(points, place))


def corridor_points_m(points: Column, meta: Column) -> Column:
    """Relative canvas positions (0-1) to metres in the corridor frame."""
    return F.transform(
        points,
        lambda p: F.struct(
            (p["x"] * meta["w_canvas"] / meta["ppm"] + meta["min_x_m"]).alias("x"),
            (meta["max_y_m"] - p["y"] * meta["h_canvas"] / meta["ppm"]).alias("y"),
        ),
    )


def corridor_px_to_lonlat(points: Column, meta: Column) -> Column:
    def place(p: Column) -> Column:
        g = local_to_global(meta["base_lat"], meta["base_lon"], meta["base_heading"], p["x"], p["y"])
        return F.array(g["lon"], g["lat"])

    return close_ring(F.transform(corridor_points_m(points, meta), place))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of struct(x, y); open or closed rings."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crosses = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda acc, c: acc + c)) / 2


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def convex_hull(points: Column) -> Column:
    """Corners of the convex hull of an array of struct(x, y), counter-clockwise, without points on its sides.

    A chain over the sorted points keeps its convex beginning: the corners that a further point hides are always the last ones.
    """
    cross = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    own = F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))

    def chain(ps: Column) -> Column:
        turn = lambda st, p: F.filter(st, lambda q, i: (i == 0) | (cross(F.get(st, i - 1), q, p) > 0))
        whole = F.aggregate(ps, F.slice(ps, 1, 0), lambda st, p: F.concat(turn(st, p), F.array(p)))
        return _let(whole, lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1))))

    return _let(F.array_sort(F.array_distinct(own)), lambda ps: F.when(F.size(ps) < 2, ps).otherwise(F.concat(chain(ps), chain(F.reverse(ps)))))


def smallest_rectangle(points: Column) -> Column:
    """struct(long, short): sides of the rectangle of least area around the points; one of its sides lies on a side of their hull."""
    spread = lambda v: _let(v, lambda x: F.array_max(x) - F.array_min(x))

    def around(hull: Column, p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        along = spread(F.transform(hull, lambda c: (c["x"] * dx + c["y"] * dy) / F.hypot(dx, dy)))
        across = spread(F.transform(hull, lambda c: (c["y"] * dx - c["x"] * dy) / F.hypot(dx, dy)))
        return _let(F.struct(along.alias("w"), across.alias("h")), lambda s: F.struct((s["w"] * s["h"]).alias("area"), F.greatest(s["w"], s["h"]).alias("long"), F.least(s["w"], s["h"]).alias("short")))

    def sides(hull: Column) -> Column:
        nxt = F.concat(F.slice(hull, 2, F.greatest(F.size(hull) - 1, F.lit(0))), F.slice(hull, 1, 1))
        best = F.array_min(F.zip_with(hull, nxt, lambda p, q: around(hull, p, q)))
        zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("long"), F.lit(0.0).alias("short"))
        return F.when(F.size(hull) < 2, zero).otherwise(best)

    return _let(_let(convex_hull(points), sides), lambda b: F.struct(b["long"].alias("long"), b["short"].alias("short")))
