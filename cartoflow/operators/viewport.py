"""What a vehicle sees: tiles near it, projected, culled and triangulated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, geometry, grid

CENTER = C.SCREEN / 2


def load_visible(layer: DataFrame, lat: float, lon: float, radius: float = C.VIEW_RADIUS_DEG) -> DataFrame:
    """Rows of a tiled layer within ``radius`` degrees; the tile bounds prune partitions."""
    return grid.prune_to_bbox(layer, lat - radius, lat + radius, lon - radius, lon + radius)


def decode_segments(tiles: DataFrame) -> DataFrame:
    """Offsets x1, y1, x2, y2 as degrees lat1, lon1, lat2, lon2."""
    lat, lon = grid.tile_origin("tile_x", "tile_y")
    return tiles.withColumns({"lat1": grid.from_offset(F.col("y1"), lat), "lon1": grid.from_offset(F.col("x1"), lon), "lat2": grid.from_offset(F.col("y2"), lat), "lon2": grid.from_offset(F.col("x2"), lon)})


def project_segments(segs: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT, rotate: bool = True) -> DataFrame:
    """Segments (lat1, lon1, lat2, lon2) as sx1, sy1, sx2, sy2 on screen; those outside the widened screen go."""
    lat, lon, heading = vehicle
    x1, y1 = geo.project("lat1", "lon1", lat, lon, heading, mpp, CENTER, rotate)
    x2, y2 = geo.project("lat2", "lon2", lat, lon, heading, mpp, CENTER, rotate)
    out = segs.withColumns({"sx1": x1, "sy1": y1, "sx2": x2, "sy2": y2})
    return out.filter(geometry.segment_visible(F.col("sx1"), F.col("sy1"), F.col("sx2"), F.col("sy2"), C.SCREEN, C.SEGMENT_MARGIN))


def project_points(points: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT, rotate: bool = True) -> DataFrame:
    """Points (lat, lon) as sx, sy on screen."""
    lat, lon, heading = vehicle
    x, y = geo.project("lat", "lon", lat, lon, heading, mpp, CENTER, rotate)
    return points.withColumns({"sx": x, "sy": y}).filter(geometry.point_visible(F.col("sx"), F.col("sy"), C.SCREEN, C.POI_MARGIN))


def project_areas(areas: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT, rotate: bool = True) -> DataFrame:
    """Polygons (points) with screen = array<struct<x,y>>; kept if three vertices or more and one of them is in sight."""
    lat, lon, heading = vehicle

    def at(p):
        x, y = geo.project(p["lat"], p["lon"], lat, lon, heading, mpp, CENTER, rotate)
        return F.struct(x.alias("x"), y.alias("y"))

    out = areas.withColumn("screen", F.transform("points", at))
    return out.filter((F.size("screen") >= 3) & F.exists("screen", lambda p: geometry.point_visible(p["x"], p["y"], C.SCREEN, C.AREA_MARGIN)))


def area_triangles(areas: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT) -> DataFrame:
    """A row a triangle: columns of the area, tri_no, a, b, c."""
    seen = project_areas(areas, vehicle, mpp)
    return seen.select("*", F.posexplode(geometry.triangulate_fan(F.col("screen"))).alias("tri_no", "t")).select(*(c for c in seen.columns if c not in ("points", "screen")), "tri_no", "t.*")


def route_segments_on_screen(path: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT) -> DataFrame:
    """A route (points; nothing if it has fewer than two) as highlighted segments."""
    segs = path.filter(F.size("points") >= 2).select(F.posexplode(geometry.segments(F.col("points"))).alias("pos", "s")).select("pos", "s.*", F.lit(C.ROAD_HIGHLIGHT).alias("road_type"))
    return project_segments(segs, vehicle, mpp)


def render_all(roads: DataFrame, pois: DataFrame, areas: DataFrame, waterways: DataFrame, vehicle: tuple[float, float, float], mpp: float = C.ZOOM_DEFAULT) -> dict[str, DataFrame]:
    """The four layers of a frame."""
    return {"roads": project_segments(roads, vehicle, mpp), "pois": project_points(pois, vehicle, mpp), "triangles": area_triangles(areas, vehicle, mpp), "waterways": project_segments(waterways, vehicle, mpp)}
