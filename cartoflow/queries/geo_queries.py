"""Distances, tiles and boxes over the query points and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TILE_SIZE_DEG
from ..functions import geo, grid
from ..sources import fixtures as X
from .duck import hav, pmod, tile, with_views

LAT, LON = 47.3769, 8.5417
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("haversine", with_views("query_points", f"select point_id, round({hav(LAT, LON, 'lat', 'lon')}, 3) as meters, round({hav(LAT, LON, 'lat', 'lon', '6371.0')}, 5) as km from query_points"))
def _haversine(spark: SparkSession, d: str) -> DataFrame:
    return X.query_points(spark, d).select("point_id", F.round(geo.haversine(LAT, LON, "lat", "lon"), 3).alias("meters"), F.round(geo.haversine_km(LAT, LON, "lat", "lon"), 5).alias("km"))


@query("haversine_micro", with_views("query_points", f"select point_id, round({hav('47.3769', '8.5417', 'lat_micro / 1e6::double', 'lon_micro / 1e6::double')}, 3) as meters from query_points"))
def _haversine_micro(spark: SparkSession, d: str) -> DataFrame:
    return X.query_points(spark, d).select("point_id", F.round(geo.haversine_micro(47_376_900, 8_541_700, "lat_micro", "lon_micro"), 3).alias("meters"))


_X = f"radians(lon - {LON}) * cos(radians((lat + {LAT}) / 2))"


@query("approx_distance", with_views("query_points", f"select point_id, round(6371000.0::double * sqrt({_X} * ({_X}) + radians(lat - {LAT}) * radians(lat - {LAT})), 3) as meters from query_points"))
def _approx(spark: SparkSession, d: str) -> DataFrame:
    return X.query_points(spark, d).select("point_id", F.round(geo.approx_distance_micro(47_376_900, 8_541_700, "lat_micro", "lon_micro"), 3).alias("meters"))


@query("bearing", with_views("query_points", f"select point_id, round({pmod(f'degrees(atan2(sin(radians(lon - {LON})) * cos(radians(lat)), cos(radians({LAT})) * sin(radians(lat)) - sin(radians({LAT})) * cos(radians(lat)) * cos(radians(lon - {LON}))))', '360.0::double')}, 6) as bearing from query_points"))
def _bearing(spark: SparkSession, d: str) -> DataFrame:
    return X.query_points(spark, d).select("point_id", F.round(geo.bearing(LAT, LON, "lat", "lon"), 6).alias("bearing"))


@query("local_meters", with_views("query_points", f"select point_id, round(radians(lon - {LON}) * 6371000.0::double * cos(radians({LAT})), 2) as x, round(radians(lat - {LAT}) * 6371000.0::double, 2) as y from query_points"))
def _local(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_local("lat", "lon", LAT, LON)
    return X.query_points(spark, d).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("local_meters_inverse", with_views("query_points", f"select point_id, round({LAT} + degrees((point_id % 977)::double / 6371000.0::double), 7) as lat, round({LON} + degrees((point_id % 1013)::double / (cos(radians({LAT})) * 6371000.0::double)), 7) as lon from query_points"))
def _from_local(spark: SparkSession, d: str) -> DataFrame:
    p = X.query_points(spark, d).select("point_id", (F.col("point_id") % 1013).cast("double").alias("x"), (F.col("point_id") % 977).cast("double").alias("y"))
    lat, lon = geo.from_local("x", "y", LAT, LON)
    return p.select("point_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


_D = "(event_id * 53 % 360)::double - heading"


@query("smooth_angle", with_views("gps", f"select event_id, round({pmod(f'heading + (case when {_D} > 180 then {_D} - 360 when {_D} < -180 then {_D} + 360 else {_D} end) * 0.2::double', '360.0::double')}, 6) as heading from gps"))
def _smooth_angle(spark: SparkSession, d: str) -> DataFrame:
    return X.gps_events(spark, d).select("event_id", F.round(geo.smooth_angle("heading", (F.col("event_id") * 53 % 360).cast("double"), 0.2), 6).alias("heading"))


_R = "radians(heading)"
_SX = f"400 + (x * cos({_R}) - y * sin({_R})) / 1.5::double"
_SY = f"400 - (x * sin({_R}) + y * cos({_R})) / 1.5::double"


@query("viewport_roundtrip", with_views("query_points", f"select point_id, round(sx, 3) as sx, round(sy, 3) as sy, x::double as wx, y::double as wy from (select *, {_SX} as sx, {_SY} as sy from (select *, (point_id % 977)::double as x, (point_id % 1013)::double as y from query_points))"))
def _viewport(spark: SparkSession, d: str) -> DataFrame:
    p = X.query_points(spark, d).select("point_id", "heading", (F.col("point_id") % 977).cast("double").alias("x"), (F.col("point_id") % 1013).cast("double").alias("y"))
    sx, sy = geo.world_to_screen("x", "y", 1 / 1.5, "heading", 400.0)
    p = p.withColumns({"sx": sx, "sy": sy})
    wx, wy = geo.screen_to_world("sx", "sy", 1 / 1.5, "heading", 400.0)
    return p.select("point_id", F.round("sx", 3).alias("sx"), F.round("sy", 3).alias("sy"), (F.round(wx, 4) + 0.0).alias("wx"), (F.round(wy, 4) + 0.0).alias("wy"))


@query("viewport_matrix", with_views("query_points", f"select point_id, round(cos({_R}) / 1.5::double, 6) + 0.0 as m00, round(-sin({_R}) / 1.5::double, 6) + 0.0 as m01, 400.0::double as m02 from query_points"))
def _matrix(spark: SparkSession, d: str) -> DataFrame:
    m = geo.viewport_matrix(1 / 1.5, "heading", 400.0)
    return X.query_points(spark, d).select("point_id", (F.round(m[0][0], 6) + 0.0).alias("m00"), (F.round(m[0][1], 6) + 0.0).alias("m01"), m[0][2].alias("m02"))


@query("zoom_clamp", "select event_id, round(least(greatest(value / 100.0::double * 0.8::double, 0.75), 3.0), 6) as zoomed_in, round(least(greatest(value / 100.0::double * 1.25::double, 0.75), 3.0), 6) as zoomed_out from events")
def _zoom(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("value") / 100.0
    return X.table(spark, d, "events").select("event_id", F.round(geo.clamp_zoom(z * 0.8), 6).alias("zoomed_in"), F.round(geo.clamp_zoom(z * 1.25), 6).alias("zoomed_out"))


@query("dead_reckon", with_views("query_points", f"select point_id, round(lat + cos({_R}) * (0.5 * 200) / 111320.0::double, 7) as lat, round(lon + sin({_R}) * (0.5 * 200) / (111320.0::double * cos(radians(lat))), 7) as lon, round({pmod('heading + 0.5 * 90', '360.0::double')}, 6) as heading from query_points"))
def _dead_reckon(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.dead_reckon("lat", "lon", "heading", 0.5)
    return X.query_points(spark, d).select("point_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(geo.turn("heading", 0.5), 6).alias("heading"))


@query("tile_key_levels", with_views("query_points", " union all ".join(f"select point_id, {lv} as level, {tile('lon', size)} as tile_x, {tile('lat', size)} as tile_y from query_points" for lv, size in TILE_SIZE_DEG.items())))
def _tile_keys(spark: SparkSession, d: str) -> DataFrame:
    p = X.query_points(spark, d)
    keys = F.array(*(F.struct(F.lit(lv).alias("level"), grid.tile_index("lon", lv).alias("tile_x"), grid.tile_index("lat", lv).alias("tile_y")) for lv in TILE_SIZE_DEG))
    return p.select("point_id", F.explode(keys).alias("k")).select("point_id", "k.*")


_O = "select point_id, lat, lon, floor(lat / 0.01::double)::int * 0.01::double as la, floor(lon / 0.01::double)::int * 0.01::double as lo from query_points"


@query("tile_offset_roundtrip", with_views("query_points", f"select point_id, x, y, round(la + y * 0.01::double / 3000, 7) as lat, round(lo + x * 0.01::double / 3000, 7) as lon from (select *, trunc(least(greatest((lon - lo) * 3000 / 0.01::double, -32768), 32767))::smallint as x, trunc(least(greatest((lat - la) * 3000 / 0.01::double, -32768), 32767))::smallint as y from ({_O}))"))
def _offsets(spark: SparkSession, d: str) -> DataFrame:
    tx, ty = grid.tile_key("lat", "lon")
    lat, lon = grid.tile_origin("tile_x", "tile_y")
    p = X.query_points(spark, d).withColumns({"tile_x": tx, "tile_y": ty}).withColumns({"la": lat, "lo": lon})
    p = p.withColumns({"x": grid.to_offset(F.col("lon"), F.col("lo")), "y": grid.to_offset(F.col("lat"), F.col("la"))})
    return p.select("point_id", "x", "y", F.round(grid.from_offset(F.col("y"), F.col("la")), 7).alias("lat"), F.round(grid.from_offset(F.col("x"), F.col("lo")), 7).alias("lon"))


@query("visible_tiles", with_views("query_points", f"select tile_x, tile_y, count(*)::bigint as vehicles from (select unnest(generate_series({tile('lon - 0.015')}, {tile('lon + 0.015')}))::int as tile_x, tile_y from (select lon, unnest(generate_series({tile('lat - 0.015')}, {tile('lat + 0.015')}))::int as tile_y from query_points)) group by all"))
def _visible(spark: SparkSession, d: str) -> DataFrame:
    return grid.visible_tiles(X.query_points(spark, d), "lat", "lon", 0.015).groupBy("tile_x", "tile_y").agg(F.count("*").alias("vehicles"))


@query("bbox_from_center_filter", with_views("query_points", "select point_id from query_points where lat between 47.12 - 900 / 111320.0::double - 0.001 and 47.12 + 900 / 111320.0::double + 0.001 and lon between 8.425 - 900 / (111320.0::double * cos(radians(47.12))) - 0.001 and 8.425 + 900 / (111320.0::double * cos(radians(47.12))) + 0.001"))
def _bbox(spark: SparkSession, d: str) -> DataFrame:
    box = grid.bbox_expand(grid.bbox_from_center(47.12, 8.425, 900), 0.001)
    return X.query_points(spark, d).filter(grid.bbox_contains(box, "lat", "lon")).select("point_id")


@query("to_micro", with_views("query_points", "select point_id, trunc(lat * 1.0000001::double * 1e6::double)::int as lat_micro, trunc(lon * 1.0000001::double * 1e6::double)::int as lon_micro from query_points"))
def _to_micro(spark: SparkSession, d: str) -> DataFrame:
    return X.query_points(spark, d).select("point_id", geo.to_micro(F.col("lat") * 1.0000001).alias("lat_micro"), geo.to_micro(F.col("lon") * 1.0000001).alias("lon_micro"))
