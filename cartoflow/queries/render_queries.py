"""Render tiles, the viewport over them, readers and place search."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, geo, geometry, grid
from ..functions.classify import tag
from ..operators import render_etl, search, viewport
from ..plans.storage import shared_folder
from ..sources import fixtures as X
from ..sources import readers
from .duck import hav, offset, tile, with_views
from .tag_queries import AREA, POI, ROAD_TYPE, WATERWAY

QUERIES, ORACLES = {}, {}
VEHICLE = (47.12, 8.425, 30.0)
ETL = "ways refs nodes_grid"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SEG = "seg as (select * from (select way_id, pos, ref as src, lead(ref) over (partition by way_id order by pos) as dst from refs) where dst is not null), placed as (select way_id, pos, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2 from seg join nodes_grid a on a.node_id = src join nodes_grid b on b.node_id = dst)"
TILES = f"tiles as (select *, unnest(generate_series(least({tile('lat1')}, {tile('lat2')}), greatest({tile('lat1')}, {tile('lat2')})))::int as tile_y from (select *, unnest(generate_series(least({tile('lon1')}, {tile('lon2')}), greatest({tile('lon1')}, {tile('lon2')})))::int as tile_x from {{src}}))"
BOX = "tile_y * 0.01::double as min_lat, tile_y * 0.01::double + 0.01::double as max_lat, tile_x * 0.01::double as min_lon, tile_x * 0.01::double + 0.01::double as max_lon"


def _code(p: str) -> str:
    return f"(case when lon{p} < min_lon then 1 when lon{p} > max_lon then 2 else 0 end + case when lat{p} < min_lat then 4 when lat{p} > max_lat then 8 else 0 end)"


def clip_sql(columns: str) -> str:
    """Common tables k0 to k6: rows of ``tiles`` clipped round by round; the last holds ends that are inside."""
    out = [f"k0 as (select {columns}, tile_x, tile_y, lat1, lon1, lat2, lon2, {BOX} from tiles)"]
    at_lat = lambda b: f"lon1 + (lon2 - lon1) * ({b} - lat1) / nullif(lat2 - lat1, 0)"
    at_lon = lambda b: f"lat1 + (lat2 - lat1) * ({b} - lon1) / nullif(lon2 - lon1, 0)"
    for i in range(geometry.CLIP_ROUNDS):
        out.append(
            f"""k{i + 1} as (select {columns}, tile_x, tile_y, min_lat, max_lat, min_lon, max_lon, case when c1 <> 0 then y else lat1 end as lat1, case when c1 <> 0 then x else lon1 end as lon1,
            case when c1 = 0 and c2 <> 0 then y else lat2 end as lat2, case when c1 = 0 and c2 <> 0 then x else lon2 end as lon2 from (
            select *, case when o & 8 <> 0 then max_lat when o & 4 <> 0 then min_lat when o & 2 <> 0 then {at_lon("max_lon")} else {at_lon("min_lon")} end as y,
            case when o & 8 <> 0 then {at_lat("max_lat")} when o & 4 <> 0 then {at_lat("min_lat")} when o & 2 <> 0 then max_lon else min_lon end as x from (
            select *, case when c1 <> 0 then c1 else c2 end as o from (select *, {_code("1")} as c1, {_code("2")} as c2 from k{i}) where c1 & c2 = 0)))"""
        )
    return ", ".join(out) + f", cut as (select * from k{geometry.CLIP_ROUNDS} where {_code('1')} = 0 and {_code('2')} = 0)"


OFFSETS = f"{offset('lon1', 'min_lon')} as x1, {offset('lat1', 'min_lat')} as y1, {offset('lon2', 'min_lon')} as x2, {offset('lat2', 'min_lat')} as y2"
CLIPPED = f"{SEG}, {{kind}}, src as (select p.*, code from placed p join kind using (way_id)), {TILES.format(src='src')}, {clip_sql('way_id, pos, code')}"
ROADS = CLIPPED.format(kind=f"kind as (select way_id, {ROAD_TYPE} as code from ways where {ROAD_TYPE} is not null)")
WATERS = CLIPPED.format(kind=f"kind as (select way_id, {WATERWAY} as code from ways where highway is null and {WATERWAY} is not null)")


def layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return X.way_tags(spark, d), X.way_refs(spark, d), X.nodes_grid(spark, d)


@query("road_tiles_clipped", with_views(ETL, f"{ROADS} select way_id, pos, tile_x, tile_y, code as road_type, {OFFSETS} from cut"))
def _roads(spark: SparkSession, d: str) -> DataFrame:
    return render_etl.road_tiles(*layers(spark, d))


@query("waterway_tiles_clipped", with_views(ETL, f"{WATERS} select way_id, pos, tile_x, tile_y, code as waterway_type, {OFFSETS} from cut"))
def _waterways(spark: SparkSession, d: str) -> DataFrame:
    return render_etl.waterway_tiles(*layers(spark, d))


@query("tiles_for_segment", with_views(ETL, f"{SEG}, {TILES.format(src='placed')} select tile_x, tile_y, count(*)::bigint as segments from tiles group by all"))
def _segment_tiles(spark: SparkSession, d: str) -> DataFrame:
    _, refs, nodes = layers(spark, d)
    return render_etl.segment_tiles(render_etl.placed_segments(refs, nodes)).groupBy("tile_x", "tile_y").agg(F.count("*").alias("segments"))


POINTS = "pts as (select way_id, list(struct_pack(lat := lat, lon := lon) order by pos) as points from refs join nodes_grid on node_id = ref group by way_id)"
CLOSED = "len(points) >= 3 and abs(points[1].lat - points[len(points)].lat) < 1e-4 and abs(points[1].lon - points[len(points)].lon) < 1e-4"
MEAN = "round(list_sum(list_transform(points, lambda p: p.{f})) / len(points), 6) as {f}"


@query("way_points", with_views(ETL, f"{POINTS} select way_id, len(points)::int as n, round(points[1].lat, 6) as first_lat, round(points[len(points)].lon, 6) as last_lon, {CLOSED} as closed from pts"))
def _way_points(spark: SparkSession, d: str) -> DataFrame:
    _, refs, nodes = layers(spark, d)
    p = render_etl.way_points(refs, nodes)
    return p.select("way_id", F.size("points").alias("n"), F.round(F.get("points", F.lit(0))["lat"], 6).alias("first_lat"), F.round(F.element_at("points", -1)["lon"], 6).alias("last_lon"), geometry.is_closed(F.col("points")).alias("closed"))


@query("way_centroid_poi", with_views(ETL, f"{POINTS} select way_id, {POI} as poi_type, {MEAN.format(f='lat')}, {MEAN.format(f='lon')} from ways join pts using (way_id) where highway is null and {WATERWAY} is null and not ({CLOSED} and {AREA} is not null) and {POI} is not null"))
def _way_pois(spark: SparkSession, d: str) -> DataFrame:
    p = render_etl.way_pois(*layers(spark, d))
    return p.select("way_id", "poi_type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


POI_TILES = f"pt as (select node_id, {POI} as poi_type, {tile('lon')} as tile_x, {tile('lat')} as tile_y, lat, lon from poi_nodes where {POI} is not null)"


@query("poi_tiles", with_views("poi_nodes", f"{POI_TILES} select node_id, poi_type, tile_x, tile_y, {offset('lon', 'tile_x * 0.01::double')} as x, {offset('lat', 'tile_y * 0.01::double')} as y from pt"))
def _poi_tiles(spark: SparkSession, d: str) -> DataFrame:
    return render_etl.poi_tiles(render_etl.node_pois(X.poi_nodes(spark, d)))


EDGE = "list_min(list_transform(points, lambda p: p.lat)) as a1, list_max(list_transform(points, lambda p: p.lat)) as a2, list_min(list_transform(points, lambda p: p.lon)) as o1, list_max(list_transform(points, lambda p: p.lon)) as o2"
AREA_TILES = f"atl as (select *, unnest(generate_series({tile('a1')}, {tile('a2')}))::int as tile_y from (select *, unnest(generate_series({tile('o1')}, {tile('o2')}))::int as tile_x from (select *, {EDGE} from areas)))"


@query("polygon_bbox_tiles", with_views("areas", f"{AREA_TILES} select area_id, area_type, tile_x, tile_y, round(a1, 6) as min_lat, round(a2, 6) as max_lat, round(o1, 6) as min_lon, round(o2, 6) as max_lon from atl"))
def _bbox_tiles(spark: SparkSession, d: str) -> DataFrame:
    a = X.areas(spark, d).withColumn("b", geometry.bbox(F.col("points")))
    t = a.withColumn("tile_x", F.explode(grid.span(F.col("b.min_lon"), F.col("b.max_lon")))).withColumn("tile_y", F.explode(grid.span(F.col("b.min_lat"), F.col("b.max_lat"))))
    return t.select("area_id", "area_type", "tile_x", "tile_y", *(F.round(f"b.{c}", 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))


def _clip_sql(points: str, axis: str, bound: str, above: bool) -> str:
    """One clipping pass over a list of points, for DuckDB."""
    other, op = ("lon", ">=") if axis == "lat" else ("lat", ">="), ">=" if above else "<="
    other = other[0]
    inside = lambda p: f"{p}.{axis} {op} {bound}"
    cross = f"struct_pack(lat := {bound}, lon := p.lon + ({bound} - p.lat) / nullif(q.lat - p.lat, 0) * (q.lon - p.lon))" if axis == "lat" else f"struct_pack(lat := p.lat + ({bound} - p.lon) / nullif(q.lon - p.lon, 0) * (q.lat - p.lat), lon := {bound})"
    cross_ = cross.replace("p.", "e.p.").replace("q.", "e.q.")
    pairs = f"list_transform(range(1, len({points}) + 1), lambda i: struct_pack(p := {points}[i], q := {points}[i % len({points}) + 1]))"
    return f"flatten(list_transform({pairs}, lambda e: case when {inside('e.p')} and {inside('e.q')} then [e.q] when {inside('e.p')} then [{cross_}] when {inside('e.q')} then [{cross_}, e.q] else [] end))"


def _area_steps() -> str:
    out, last = [], "at0"
    out.append(f"at0 as (select area_id, area_type, tile_x, tile_y, points, {BOX} from atl)")
    for i, (axis, bound, above) in enumerate((("lat", "min_lat", True), ("lat", "max_lat", False), ("lon", "min_lon", True), ("lon", "max_lon", False)), 1):
        out.append(f"at{i} as (select * replace ({_clip_sql('points', axis, bound, above)} as points) from {last})")
        last = f"at{i}"
    return ", ".join(out) + f", cutarea as (select * from {last} where len(points) >= 3)"


@query("area_tiles_clipped", with_views("areas", f"{AREA_TILES}, {_area_steps()} select area_id, area_type, tile_x, tile_y, (p).i as vertex, {offset('p.v.lon', 'min_lon')} as x, {offset('p.v.lat', 'min_lat')} as y from (select *, unnest(list_transform(range(len(points)), lambda i: struct_pack(i := i::int, v := points[i + 1]))) as p from cutarea)"))
def _area_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = render_etl.area_offsets(render_etl.area_tiles(X.areas(spark, d)))
    return t.select("area_id", "area_type", "tile_x", "tile_y", F.posexplode("points").alias("vertex", "p")).select("area_id", "area_type", "tile_x", "tile_y", "vertex", "p.x", "p.y")


@query("tile_feature_counts", with_views("ways refs nodes_grid poi_nodes areas", f"{ROADS}, {POI_TILES}, {AREA_TILES}, {_area_steps()} select tile_x, tile_y, 'roads' as layer, count(*)::bigint as n from cut group by all union all select tile_x, tile_y, 'pois', count(*)::bigint from pt group by all union all select tile_x, tile_y, 'areas', count(*)::bigint from cutarea group by all"))
def _counts(spark: SparkSession, d: str) -> DataFrame:
    return render_etl.feature_counts(roads=render_etl.road_tiles(*layers(spark, d)), pois=render_etl.poi_tiles(render_etl.node_pois(X.poi_nodes(spark, d))), areas=render_etl.area_tiles(X.areas(spark, d)))


def water_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each area's ring cut into three ways, the second turned round; (relations, way geometry)."""
    a = X.areas(spark, d)
    cut = F.array(F.slice("points", 1, 3), F.reverse(F.slice("points", 3, 2)), F.slice("points", 4, 3))
    ways = a.select("area_id", F.posexplode(cut).alias("k", "points")).select((F.col("area_id") * 3 + F.col("k")).alias("way_id"), "points")
    member = lambda k: F.struct(F.lit("way").alias("type"), (F.col("area_id") * 3 + k).alias("ref"), F.lit("outer" if k else "").alias("role"))
    tags = X.tag_map(type=F.lit("multipolygon"), natural=F.when(F.col("area_id") % 2 == 0, "water"))
    return a.select(F.col("area_id").alias("rel_id"), tags.alias("tags"), F.array(*(member(k) for k in range(3))).alias("members")), ways


@query("water_rings", with_views("areas", "select area_id as rel_id, 0 as ring_no, (i - 1)::int as vertex, round(p.lat, 6) as lat, round(p.lon, 6) as lon from (select area_id, unnest(points) as p, generate_subscripts(points, 1) as i from areas) where area_id % 2 = 0"))
def _rings(spark: SparkSession, d: str) -> DataFrame:
    rings = render_etl.assemble_rings(render_etl.water_members(*water_parts(spark, d)))
    return rings.select("rel_id", "ring_no", F.posexplode("points").alias("vertex", "p")).select("rel_id", "ring_no", "vertex", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


# --- viewport


def _screen(lat: str, lon: str) -> tuple[str, str]:
    la, lo, h = VEHICLE
    x = f"(radians({lon} - {lo}) * 6371000.0::double * cos(radians({la})) / 1.5::double)"
    y = f"(-(radians({lat} - {la}) * 6371000.0::double) / 1.5::double)"
    c, s = f"cos(-radians({h}::double))", f"sin(-radians({h}::double))"
    return f"(400 + {x} * {c} - {y} * {s})", f"(400 + {x} * {s} + {y} * {c})"


_X1, _Y1 = _screen("lat1", "lon1")
_X2, _Y2 = _screen("lat2", "lon2")
_PX, _PY = _screen("lat", "lon")
SEEN = "greatest(sx1, sx2) >= -50 and least(sx1, sx2) <= 850 and greatest(sy1, sy2) >= -50 and least(sy1, sy2) <= 850"


def _project_sql(columns: str, src: str) -> str:
    return f"select {columns}, round(sx1, 2) + 0.0 as sx1, round(sy1, 2) + 0.0 as sy1, round(sx2, 2) + 0.0 as sx2, round(sy2, 2) + 0.0 as sy2 from (select *, {_X1} as sx1, {_Y1} as sy1, {_X2} as sx2, {_Y2} as sy2 from {src}) where {SEEN}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) + 0.0 for c in columns})


def way_segments_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    ways, refs, nodes = layers(spark, d)
    code = classify.road_type(tag(F.col("tags"), "highway")) if kind == "road" else F.when(~classify.has(F.col("tags"), "highway"), classify.waterway_type(F.col("tags")))
    kinds = ways.select("way_id", code.alias("code")).filter("code is not null")
    return render_etl.placed_segments(refs, nodes).join(kinds, "way_id")


@query("project_roads", with_views(ETL, f"{SEG}, kind as (select way_id, {ROAD_TYPE} as code from ways where {ROAD_TYPE} is not null) {_project_sql('way_id, pos, code', '(select * from placed join kind using (way_id))')}"))
def _project_roads(spark: SparkSession, d: str) -> DataFrame:
    s = viewport.project_segments(way_segments_of(spark, d, "road"), VEHICLE)
    return rounded(s.select("way_id", "pos", "code", "sx1", "sy1", "sx2", "sy2"), "sx1", "sy1", "sx2", "sy2")


@query("project_waterways", with_views(ETL, f"{SEG}, kind as (select way_id, {WATERWAY} as code from ways where highway is null and {WATERWAY} is not null) {_project_sql('way_id, pos, code', '(select * from placed join kind using (way_id))')}"))
def _project_waterways(spark: SparkSession, d: str) -> DataFrame:
    s = viewport.project_segments(way_segments_of(spark, d, "waterway"), VEHICLE)
    return rounded(s.select("way_id", "pos", "code", "sx1", "sy1", "sx2", "sy2"), "sx1", "sy1", "sx2", "sy2")


@query("project_pois", with_views("poi_nodes", f"select node_id, {POI} as poi_type, round(sx, 2) + 0.0 as sx, round(sy, 2) + 0.0 as sy from (select *, {_PX} as sx, {_PY} as sy from poi_nodes) where {POI} is not null and sx between -20 and 820 and sy between -20 and 820"))
def _project_pois(spark: SparkSession, d: str) -> DataFrame:
    p = viewport.project_points(render_etl.node_pois(X.poi_nodes(spark, d)), VEHICLE)
    return rounded(p.select("node_id", "poi_type", "sx", "sy"), "sx", "sy")


_AX, _AY = _screen("p.lat", "p.lon")
ONSCREEN = f"scr as (select *, list_transform(points, lambda p: struct_pack(x := {_AX}, y := {_AY})) as s from areas), vis as (select * from scr where len(s) >= 3 and len(list_filter(s, lambda p: p.x between -100 and 900 and p.y between -100 and 900)) > 0)"


@query("project_areas", with_views("areas", f"{ONSCREEN} select area_id, area_type, len(s)::int as vertices, round(list_min(list_transform(s, lambda p: p.x)), 2) + 0.0 as min_x, round(list_max(list_transform(s, lambda p: p.y)), 2) + 0.0 as max_y from vis"))
def _project_areas(spark: SparkSession, d: str) -> DataFrame:
    a = viewport.project_areas(X.areas(spark, d), VEHICLE)
    of = lambda f: F.transform("screen", lambda p: p[f])
    return rounded(a.select("area_id", "area_type", F.size("screen").alias("vertices"), F.array_min(of("x")).alias("min_x"), F.array_max(of("y")).alias("max_y")), "min_x", "max_y")


@query("area_triangles", with_views("areas", f"{ONSCREEN} select area_id, area_type, (i - 2)::int as tri_no, round(s[1].x, 2) + 0.0 as ax, round(s[i].x, 2) + 0.0 as bx, round(s[i].y, 2) + 0.0 as by_, round(s[i + 1].x, 2) + 0.0 as cx, round(s[i + 1].y, 2) + 0.0 as cy from (select *, unnest(range(2, len(s))) as i from vis)"))
def _triangles(spark: SparkSession, d: str) -> DataFrame:
    t = viewport.area_triangles(X.areas(spark, d), VEHICLE)
    return rounded(t.select("area_id", "area_type", "tri_no", F.col("a.x").alias("ax"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy")), "ax", "bx", "by_", "cx", "cy")


VIEW = "tile_x between 841 and 844 and tile_y between 4710 and 4713"
DECODED = f"select tile_y * 0.01::double + y1 * 0.01::double / 3000 as lat1, tile_x * 0.01::double + x1 * 0.01::double / 3000 as lon1, tile_y * 0.01::double + y2 * 0.01::double / 3000 as lat2, tile_x * 0.01::double + x2 * 0.01::double / 3000 as lon2 from (select tile_x, tile_y, {OFFSETS} from cut) where {VIEW}"


@query(
    "render_frame_counts",
    with_views(
        "ways refs nodes_grid poi_nodes areas",
        f"""dec as (with {ROADS} {DECODED}), wet as (with {WATERS} {DECODED}), {ONSCREEN}
        select 'roads' as layer, count(*)::bigint as n from (select {_X1} as sx1, {_Y1} as sy1, {_X2} as sx2, {_Y2} as sy2 from dec) where {SEEN}
        union all select 'pois', count(*)::bigint from (select {_PX} as sx, {_PY} as sy from poi_nodes where {POI} is not null) where sx between -20 and 820 and sy between -20 and 820
        union all select 'triangles', sum(len(s) - 2)::bigint from vis
        union all select 'waterways', count(*)::bigint from (select {_X1} as sx1, {_Y1} as sy1, {_X2} as sx2, {_Y2} as sy2 from wet) where {SEEN}""",
    ),
)
def _frame(spark: SparkSession, d: str) -> DataFrame:
    near = lambda tiles: viewport.decode_segments(viewport.load_visible(tiles, *VEHICLE[:2]))
    roads, waters = near(render_etl.road_tiles(*layers(spark, d))), near(render_etl.waterway_tiles(*layers(spark, d)))
    frame = viewport.render_all(roads, render_etl.node_pois(X.poi_nodes(spark, d)), X.areas(spark, d), waters, VEHICLE)
    out = None
    for name, df in frame.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- readers

GEOJSON = json.dumps(
    {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[9.125, 46.75], [9.25, 46.5], [9.375, 46.25]]}, "properties": {"highway": "primary", "name": "Lake Road"}},
            {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[8.5, 47.3], [8.6, 47.4], [8.7, 47.5]], [[8.1, 47.1]]]}, "properties": {"highway": "track"}},
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [8.5, 47.3]}, "properties": {"name": "P"}},
        ],
    }
)
OVERPASS = json.dumps(
    {
        "elements": [
            {"type": "node", "id": 1, "lat": 47.0, "lon": 8.0},
            {"type": "node", "id": 2, "lat": 47.2, "lon": 8.2},
            {"type": "node", "id": 3, "lat": 47.4, "lon": 8.4, "tags": {"amenity": "fuel", "name": "Pump"}},
            {"type": "way", "id": 10, "nodes": [1, 2, 99], "tags": {"highway": "motorway", "name": "A1"}},
            {"type": "way", "id": 11, "nodes": [1, 2, 3], "tags": {"amenity": "parking"}},
            {"type": "way", "id": 12, "nodes": [1, 98]},
            {"type": "way", "id": 13, "nodes": [3, 1]},
        ]
    }
)


@query("sample_grid_roads", "select 'Horizontal ' || i as name, case when i = 0 then 0 else 1 end as road_type, round(47.3769 + i * 0.001, 6)::double as lat1, 8.5317::double as lon1 from range(-10, 11) t(i) union all select 'Vertical ' || i, case when i = 0 then 0 else 1 end, 47.3669::double, round(8.5417 + i * 0.001, 6)::double from range(-10, 11) t(i) union all select 'Main Highway', 2, 47.3669::double, 8.5317::double")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    p = F.get("points", F.lit(0))
    return readers.sample_grid(spark).select("name", "road_type", F.round(p["lat"], 6).alias("lat1"), F.round(p["lon"], 6).alias("lon1"))


@query("geojson_roads", "select * from (values (0, 0, 'Lake Road', 0, 3, 46.75::double, 9.375::double), (1, 0, null, 1, 3, 47.3::double, 8.7::double)) t(feature_no, line_no, name, road_type, n, first_lat, last_lon)")
def _geojson(spark: SparkSession, d: str) -> DataFrame:
    r = readers.geojson_roads(spark.createDataFrame([(GEOJSON,)], "doc string"))
    return r.select("feature_no", "line_no", "name", "road_type", F.size("points").alias("n"), F.get("points", F.lit(0))["lat"].alias("first_lat"), F.element_at("points", -1)["lon"].alias("last_lon"))


@query("overpass_features", "select * from (values ('road', 10::bigint, 'A1', 0, 47.1::double), ('road', 13::bigint, null, 1, 47.2::double), ('poi', 11::bigint, null, 1, 47.2::double), ('poi', 3::bigint, 'Pump', 0, 47.4::double)) t(kind, id, name, code, lat)")
def _overpass(spark: SparkSession, d: str) -> DataFrame:
    roads, pois = readers.overpass_features(spark.createDataFrame([(OVERPASS,)], "doc string"))
    a = roads.select(F.lit("road").alias("kind"), "id", "name", F.col("road_type").alias("code"), F.round(geometry.centroid(F.col("points"))["lat"], 6).alias("lat"))
    return a.unionByName(pois.select(F.lit("poi").alias("kind"), "id", "name", F.col("poi_type").alias("code"), F.round("lat", 6).alias("lat")))


@query("tile_index_lines", "select * from (values (843, 4714, 'line'), (-10, 20, 'line'), (-10, 20, 'file')) t(tile_x, tile_y, origin)")
def _index_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([("843,4714",), ("-10, 20",), ("invalid",), ("# 1,2",), ("",)], "value string")
    names = spark.createDataFrame([("tile_-10_20.bin",), ("index.txt",)], "name string")
    return readers.parse_tile_lines(lines).withColumn("origin", F.lit("line")).unionByName(readers.parse_tile_names(names).withColumn("origin", F.lit("file")))


# --- search

NORM = "trim(regexp_replace(lower(name), '[^\\p{L}\\p{N} ]', '', 'g'))"
INDEX = f"idx as (select *, {NORM} as norm from places)"
HERE = (47.12, 8.42)


def prefix_sql(q: str) -> str:
    return f"{INDEX}, hit as (select *, strlen(norm) - {len(q)} as score from (select * from idx where starts_with(norm, '{q}') order by norm, seq limit 20))"


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return search.index(X.places(spark, d))


@query("normalize_name", with_views("places", f"{INDEX} select seq, norm from idx"))
def _normalize(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).select("seq", "norm")


@query("search_layout", with_views("places", f"{INDEX} select seq, row_number() over (order by norm, seq) - 1 as entry_id, coalesce(sum(strlen(name)) over (order by norm, seq rows between unbounded preceding and 1 preceding), 0)::bigint as name_offset from idx"))
def _layout(spark: SparkSession, d: str) -> DataFrame:
    return search.layout(indexed(spark, d)).select("seq", "entry_id", "name_offset")


@query("places_by_norm", with_views("places", f"{INDEX} select norm, count(*)::bigint as entries, min(seq) as first_seq from idx group by norm"))
def _by_norm(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).groupBy("norm").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"))


@query("prefix_search", with_views("places", f"{prefix_sql('zu')} select seq, name, norm, score::int as score from hit"))
def _prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.prefix_search(indexed(spark, d), "Zu!").select("seq", "name", "norm", "score")


@query("exact_search", with_views("places", f"{INDEX} select seq, name, lat, lon, category, 0 as score from idx where norm = 'st gallen' order by seq limit 1"))
def _exact(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_search(indexed(spark, d), "St. Gallen").select("seq", "name", "lat", "lon", "category", "score")


@query("search_nearby", with_views("places", f"{prefix_sql('s')} select seq, name, round(km, 4) as km, score::int as score from (select *, {hav('lat', 'lon', HERE[0], HERE[1], '6371.0')} as km from hit) order by round(km, 6), score, norm, seq limit 10"))
def _nearby(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nearby(indexed(spark, d), "s", *HERE).select("seq", "name", F.round("km", 4).alias("km"), "score")


@query("search_nearby_mobile", with_views("places", f"{prefix_sql('z')} select seq, name, round(sqrt(pow((lat - {HERE[0]}) * 111.0::double, 2) + pow((lon - {HERE[1]}) * 111.0::double * cos(radians({HERE[0]})), 2)), 4) as km, score::int as score from hit order by round(pow(lat - {HERE[0]}, 2) + pow(lon - {HERE[1]}, 2), 12), score, norm, seq limit 10"))
def _nearby_mobile(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nearby_mobile(indexed(spark, d), "z", *HERE).select("seq", "name", F.round("km", 4).alias("km"), "score")


_KM = hav(HERE[0], HERE[1], "lat", "lon", "6371.0")


@query("distance_labels", with_views("places", f"select seq, case when km < 1 then round(km * 1000)::int || ' m' else printf('%.1f', round(km, 1)) || ' km' end as label from (select seq, {_KM} as km from places)"))
def _labels(spark: SparkSession, d: str) -> DataFrame:
    return X.places(spark, d).select("seq", classify.distance_label(geo.haversine_km(HERE[0], HERE[1], "lat", "lon")).alias("label"))


@query("extract_places", with_views("poi_nodes", "select node_id as seq, name from poi_nodes where name is not null"))
def _places(spark: SparkSession, d: str) -> DataFrame:
    return search.extract_places(X.poi_nodes(spark, d)).select("seq", "name")


@query("has_tile", with_views("query_points", f"select distinct {tile('lon')} as tile_x, {tile('lat')} as tile_y from query_points where {VIEW.replace('tile_x', tile('lon')).replace('tile_y', tile('lat'))}"))
def _has_tile(spark: SparkSession, d: str) -> DataFrame:
    x, y = grid.tile_key("lat", "lon")
    available = X.query_points(spark, d).select(x.alias("tile_x"), y.alias("tile_y")).distinct()
    la, lo, _ = VEHICLE
    wanted = grid.visible_tiles(spark.createDataFrame([(la, lo)], "lat double, lon double"), "lat", "lon", C.VIEW_RADIUS_DEG).select("tile_x", "tile_y")
    return wanted.join(available, ["tile_x", "tile_y"], "left_semi")


# --- what is written, read back


@query("write_read_tiles", with_views("poi_nodes", f"{POI_TILES} select tile_x, tile_y, count(*)::bigint as pois from pt where (tile_x, tile_y) in ((841, 4710), (842, 4711), (843, 4713), (1, 1)) group by all"))
def _written_tiles(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/cartoflow/tiles-{uuid.uuid4().hex}"
    readers.write_tiles(render_etl.poi_tiles(render_etl.node_pois(X.poi_nodes(spark, d))), path)
    return readers.read_tiles(spark, path, [(841, 4710), (842, 4711), (843, 4713), (1, 1)]).groupBy("tile_x", "tile_y").agg(F.count("*").alias("pois"))


@query("write_read_index", with_views("places", f"{prefix_sql('zug')} select seq, norm, score::int as score from hit"))
def _written_index(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/cartoflow/index-{uuid.uuid4().hex}"
    search.write_index(X.places(spark, d), path)
    return search.prefix_search(spark.read.parquet(path), "zug").select("seq", "norm", "score")
