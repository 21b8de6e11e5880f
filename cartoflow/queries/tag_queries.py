"""Classification of ways, nodes and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify
from ..functions.classify import tag
from ..sources import fixtures as X
from .duck import by_class, hav, quoted, with_views

QUERIES, ORACLES = {}, {}


def tags() -> Column:
    return F.col("tags")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


ROAD_TYPE = f"case when highway in ({quoted(C.RENDER_PRIMARY)}) then 0 when highway in ({quoted(C.RENDER_SECONDARY)}) then 1 end"
WATERWAY = "case waterway when 'river' then 0 when 'stream' then 1 when 'canal' then 2 end"
IS_WATER = "coalesce(nat = 'water', false) or coalesce(waterway = 'riverbank', false) or coalesce(landuse = 'reservoir', false)"
AREA = f"case when {IS_WATER} then 0 when nat = 'wood' or landuse = 'forest' then 1 when leisure = 'park' then 2 when landuse in ('grass', 'meadow') or nat = 'grassland' then 3 end"
POI = "coalesce(case when amenity = 'fuel' then 0 when amenity = 'car_wash' then 3 when amenity = 'fast_food' then 4 when amenity = 'parking' and bicycle is null and parking in ('multi-storey', 'underground') then 1 end, case when shop = 'mall' then 2 end)"
_BARE = "regexp_replace(maxspeed, '( km/h)+$', '')"
SPEED = f"coalesce(case when regexp_matches({_BARE}, '^\\+?[0-9]+$') and try_cast({_BARE} as bigint) between 0 and 255 then try_cast({_BARE} as bigint) end, {by_class('highway', 3)})::int"
ONEWAY = "coalesce(oneway in ('yes', '1', 'true'), false) or coalesce(highway = 'motorway', false) or coalesce(junction = 'roundabout', false)"


@query("road_type", with_views("ways", f"select way_id, {ROAD_TYPE} as road_type, case when coalesce(highway in ({quoted(C.RENDER_PRIMARY)}), false) then 0 else 1 end as loose_type, case {ROAD_TYPE} when 0 then 4 when 1 then 2 else 6 end as stroke from ways"))
def _road_type(spark: SparkSession, d: str) -> DataFrame:
    h = tag(tags(), "highway")
    return X.way_tags(spark, d).select("way_id", classify.road_type(h).alias("road_type"), classify.road_type_loose(h).alias("loose_type"), classify.road_stroke(classify.road_type(h)).alias("stroke"))


@query("road_class_speed_oneway", with_views("ways", f"select way_id, {by_class('highway', 1)} as road_class, {SPEED} as speed, {ONEWAY} as oneway from ways where {by_class('highway', 1)} is not null"))
def _road_class(spark: SparkSession, d: str) -> DataFrame:
    ways = X.way_tags(spark, d)
    return ways.select("way_id", classify.road_class(tag(tags(), "highway")).alias("road_class"), classify.speed_kmh(tags()).alias("speed"), classify.is_oneway(tags()).alias("oneway")).filter("road_class is not null")


@query("hierarchy_level", with_views("ways", f"select level, default_speed, size_deg, size_km, count(*)::bigint as ways from (select {by_class('highway', 2)} as level, {by_class('highway', 3)} as default_speed, case {by_class('highway', 2)} when 0 then 1.0::double when 1 then 0.1 when 2 then 0.01 end as size_deg, case {by_class('highway', 2)} when 0 then 111.0::double when 1 then 11.1 when 2 then 1.1 end as size_km from ways) where level is not null group by all"))
def _level(spark: SparkSession, d: str) -> DataFrame:
    code = classify.road_class(tag(tags(), "highway"))
    ways = X.way_tags(spark, d).select(code.alias("c")).filter("c is not null").select(classify.hierarchy_level(F.col("c")).alias("level"), classify.default_speed(F.col("c")).alias("default_speed"))
    return ways.withColumns({"size_deg": classify.tile_size_deg(F.col("level")), "size_km": classify.tile_size_km(F.col("level"))}).groupBy("level", "default_speed", "size_deg", "size_km").agg(F.count("*").alias("ways"))


@query("poi_type", with_views("poi_nodes", f"select node_id, {POI} as poi_type from poi_nodes"))
def _poi_type(spark: SparkSession, d: str) -> DataFrame:
    return X.poi_nodes(spark, d).select("node_id", classify.poi_type(tags()).alias("poi_type"))


@query("area_type", with_views("ways", f"select way_id, {AREA} as area_type from ways"))
def _area_type(spark: SparkSession, d: str) -> DataFrame:
    return X.way_tags(spark, d).select("way_id", classify.area_type(tags()).alias("area_type"))


@query("waterway_type", with_views("ways", f"select way_id, {WATERWAY} as waterway_type, case {WATERWAY} when 0 then 5 when 1 then 2 else 4 end as stroke from ways"))
def _waterway_type(spark: SparkSession, d: str) -> DataFrame:
    w = classify.waterway_type(tags())
    return X.way_tags(spark, d).select("way_id", w.alias("waterway_type"), classify.waterway_stroke(w).alias("stroke"))


@query("is_render_way", with_views("ways", f"select way_id, coalesce({ROAD_TYPE} is not null or {POI} is not null or shop = 'mall' or {AREA} is not null or {WATERWAY} is not null, false) as wanted from ways"))
def _is_render_way(spark: SparkSession, d: str) -> DataFrame:
    return X.way_tags(spark, d).select("way_id", classify.is_render_way(tags()).alias("wanted"))


@query(
    "classify_render_way",
    with_views(
        "ways",
        f"""select way_id, kind, case kind when 'road' then {ROAD_TYPE} when 'waterway' then {WATERWAY} when 'area' then {AREA} when 'poi' then {POI} end as code
        from (select *, case when highway is not null then case when {ROAD_TYPE} is not null then 'road' end when {WATERWAY} is not null then 'waterway' when way_id % 4 <> 0 and {AREA} is not null then 'area' when {POI} is not null then 'poi' end as kind from ways)""",
    ),
)
def _render_way(spark: SparkSession, d: str) -> DataFrame:
    ways = X.way_tags(spark, d).withColumn("k", classify.render_way(tags(), F.col("way_id") % 4 != 0))
    return ways.select("way_id", F.col("k.kind").alias("kind"), F.col("k.code").alias("code"))


CATEGORY = f"""case when place is not null then case when place in ({quoted(C.SETTLEMENT_PLACES)}) then 0 else 255 end when highway is not null then 1
    when amenity is not null then case when amenity in ({quoted(C.POI_AMENITIES)}) then 2 else 255 end when shop is not null or tourism is not null then 2
    when coalesce(aeroway = 'aerodrome', false) or coalesce(railway in ('station', 'halt'), false) then 3
    when nat is not null then case when nat in ({quoted(C.NATURAL_PLACES)}) then 4 else 255 end when coalesce(waterway in ('river', 'stream'), false) then 4 else 255 end"""


@query("place_category", with_views("poi_nodes", f"select node_id, category, case category when 0 then 'City/Town' when 1 then 'Street' when 2 then 'Point of Interest' when 3 then 'Transport' when 4 then 'Natural Feature' else 'Place' end as label, case category when 0 then 'Settlement' when 1 then 'Street' when 2 then 'POI' when 3 then 'Transport' when 4 then 'Natural' else 'Place' end as short_label from (select node_id, {CATEGORY} as category from poi_nodes)"))
def _category(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("category")
    return X.poi_nodes(spark, d).select("node_id", classify.place_category(tags()).alias("category")).select("node_id", "category", classify.category_label(c).alias("label"), classify.category_label(c, mobile=True).alias("short_label"))


@query("gps_status", with_views("gps", "select event_id, case when accuracy_m < 0 then 0 when accuracy_m <= 20 then 2 when accuracy_m <= 100 then 1 else 0 end as status from gps"))
def _gps_status(spark: SparkSession, d: str) -> DataFrame:
    return X.gps_events(spark, d).select("event_id", classify.gps_status(F.col("accuracy_m")).alias("status"))


_M = hav("47.1", "8.4", "47.1 + (point_id % 1000) / 1000.0::double", "8.4")


@query("select_level", with_views("query_points", f"select point_id, case when m < 5000 then 2 when m < 50000 then 1 else 0 end as level from (select point_id, {_M} as m from query_points)"))
def _select_level(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import geo

    m = geo.haversine(47.1, 8.4, F.lit(47.1) + (F.col("point_id") % 1000) / F.lit(1000.0), 8.4)
    return X.query_points(spark, d).select("point_id", classify.select_level(m).alias("level"))


@query("edge_flags", "select event_id, (event_id % 16) & 1 <> 0 as oneway, (event_id % 16) & 2 <> 0 as tunnel, (event_id % 16) & 4 <> 0 as bridge, (event_id % 16) & 8 <> 0 as toll, (event_id % 8) & 2 <> 0 as traffic_signal from events")
def _flags(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id") % 16, F.col("event_id") % 8
    return X.table(spark, d, "events").select("event_id", classify.flag(e, C.EDGE_ONEWAY).alias("oneway"), classify.flag(e, C.EDGE_TUNNEL).alias("tunnel"), classify.flag(e, C.EDGE_BRIDGE).alias("bridge"), classify.flag(e, C.EDGE_TOLL).alias("toll"), classify.flag(n, C.NODE_TRAFFIC_SIGNAL).alias("traffic_signal"))


@query("hit_rate", "select user_id as vehicle, coalesce(count(*) filter (event_type = 'view')::double / nullif(count(*) filter (event_type in ('view', 'error')), 0), 0.0) as hit_rate from events group by 1")
def _hit_rate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return X.table(spark, d, "events").groupBy(F.col("user_id").alias("vehicle")).agg(classify.hit_rate(n("view"), n("error")).alias("hit_rate"))
