"""Distances, bearings and planar projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, HEURISTIC_KMH, KM_PER_DEGREE_MOBILE, METERS_PER_DEGREE, ZOOM_MAX, ZOOM_MIN


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance of points in degrees, in the radius' unit; the half-chord is clamped to 1."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_RADIUS_M / 1000)


def micro(c) -> Column:
    """Microdegrees as degrees."""
    return col(c) / F.lit(1e6)


def to_micro(c) -> Column:
    """Degrees as microdegrees, truncated and kept within 32 bits."""
    return F.least(F.greatest(F.lit(-2147483648.0), col(c) * 1e6), F.lit(2147483647.0)).cast("int")


def haversine_micro(lat1, lon1, lat2, lon2) -> Column:
    return haversine(*map(micro, (lat1, lon1, lat2, lon2)))


def approx_distance(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance with the mean latitude, metres."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(EARTH_RADIUS_M) * F.sqrt(x * x + y * y)


def approx_distance_micro(lat1, lon1, lat2, lon2) -> Column:
    return approx_distance(*map(micro, (lat1, lon1, lat2, lon2)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def to_local(lat, lon, ref_lat, ref_lon) -> tuple[Column, Column]:
    """Metres east and north of a reference point."""
    lat, lon, ref_lat, ref_lon = map(col, (lat, lon, ref_lat, ref_lon))
    return F.radians(lon - ref_lon) * EARTH_RADIUS_M * F.cos(F.radians(ref_lat)), F.radians(lat - ref_lat) * EARTH_RADIUS_M


def from_local(x, y, ref_lat, ref_lon) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and north."""
    x, y, ref_lat, ref_lon = map(col, (x, y, ref_lat, ref_lon))
    return ref_lat + F.degrees(y / EARTH_RADIUS_M), ref_lon + F.degrees(x / (F.cos(F.radians(ref_lat)) * EARTH_RADIUS_M))


def distance_km_mobile(lat, lon, veh_lat, veh_lon) -> Column:
    lat, lon, veh_lat, veh_lon = map(col, (lat, lon, veh_lat, veh_lon))
    return F.sqrt(F.pow((lat - veh_lat) * KM_PER_DEGREE_MOBILE, 2.0) + F.pow((lon - veh_lon) * KM_PER_DEGREE_MOBILE * F.cos(F.radians(veh_lat)), 2.0))


def smooth_angle(current, target, smoothing) -> Column:
    """Step from one heading towards another over the shorter side, 0 to 360."""
    current, target = col(current), col(target)
    d = target - current
    d = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    return F.pmod(current + d * col(smoothing), F.lit(360.0))


def clamp_zoom(zoom) -> Column:
    return F.least(F.greatest(col(zoom), F.lit(ZOOM_MIN)), F.lit(ZOOM_MAX))


def world_to_screen(x, y, scale: float, rotation_deg, center: float) -> tuple[Column, Column]:
    x, y, r = col(x), col(y), F.radians(col(rotation_deg))
    return F.lit(center) + (x * F.cos(r) - y * F.sin(r)) * scale, F.lit(center) - (x * F.sin(r) + y * F.cos(r)) * scale


def screen_to_world(x, y, scale: float, rotation_deg, center: float) -> tuple[Column, Column]:
    r = F.radians(col(rotation_deg))
    sx, sy = (col(x) - center) / scale, -(col(y) - center) / scale
    return sx * F.cos(r) + sy * F.sin(r), -sx * F.sin(r) + sy * F.cos(r)


def viewport_matrix(scale, rotation_deg, center) -> Column:
    """3 x 3 matrix of rotation, scale and translation, as rows; it does not flip y."""
    s, r, c = col(scale), F.radians(col(rotation_deg)), col(center)
    return F.array(F.array(s * F.cos(r), -s * F.sin(r), c), F.array(s * F.sin(r), s * F.cos(r), c), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def dead_reckon(lat, lon, heading, dt, speed: float = 200.0) -> tuple[Column, Column]:
    """Position after ``dt`` seconds at ``speed`` metres a second along the heading."""
    lat, lon, h = col(lat), col(lon), F.radians(col(heading))
    way = col(dt) * speed
    return lat + F.cos(h) * way / METERS_PER_DEGREE, lon + F.sin(h) * way / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(lat)))


def turn(heading, dt, rate: float = 90.0) -> Column:
    return F.pmod(col(heading) + col(dt) * rate, F.lit(360.0))


def project(lat, lon, veh_lat, veh_lon, heading, mpp: float, center: float, rotate: bool = True) -> tuple[Column, Column]:
    """Screen pixels of a point: metres from the vehicle, scaled, y down, turned so that the heading points up."""
    x, y = to_local(lat, lon, veh_lat, veh_lon)
    x, y = x / mpp, -y / mpp
    if not rotate:
        return F.lit(center) + x, F.lit(center) + y
    a = -F.radians(col(heading))
    return F.lit(center) + x * F.cos(a) - y * F.sin(a), F.lit(center) + x * F.sin(a) + y * F.cos(a)


def heuristic_cs(lat1, lon1, lat2, lon2) -> Column:
    """Centiseconds that the way between two places in microdegrees takes at least, at HEURISTIC_KMH, truncated."""
    return (haversine_micro(lat1, lon1, lat2, lon2) / F.lit(HEURISTIC_KMH * 1000.0 / 3600.0) * 100.0).cast("long")
