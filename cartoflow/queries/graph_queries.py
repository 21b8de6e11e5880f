"""The routing-graph ETL, snapping, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, geo, grid
from ..operators import graph_etl, snap
from ..plans import front_door, routing
from ..plans.storage import new_folder, written
from ..sources import fixtures as X
from ..sources import readers
from .duck import by_class, hav, tile, with_views
from .tag_queries import ONEWAY, SPEED

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SEG = "seg as (select * from (select way_id, pos, ref as src, lead(ref) over (partition by way_id order by pos) as dst from refs) where dst is not null)"
ROUTABLE = f"routable as (select way_id, {by_class('highway', 1)} as road_class, {by_class('highway', 2)} as level, {SPEED} as speed, {ONEWAY} as oneway, name from ways where {by_class('highway', 1)} is not null)"
THERE = f"there as (select s.way_id, s.pos, s.src, s.dst, trunc({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 100)::bigint as distance_cm, road_class, level, speed, oneway, name from seg s join routable r using (way_id) join nodes_grid a on a.node_id = s.src join nodes_grid b on b.node_id = s.dst)"
EDGES = "edges as (select *, false as reverse from there union all select way_id, pos, dst, src, distance_cm, road_class, level, speed, oneway, name, true from there where not oneway)"
GRAPH = f"{SEG}, {ROUTABLE}, {THERE}, {EDGES}"
WEIGHT = f"case when speed > 0 then trunc(least(distance_cm / 100000.0::double / speed * 3600.0 * 100, {C.WEIGHT_MAX}))::bigint else {C.WEIGHT_MAX} end"
LEVEL = 2
SIZE = C.TILE_SIZE_DEG[LEVEL]
OWNED = f"""e as materialized (select * from edges where level = {LEVEL}), owned as materialized (select node_id, {tile('lon')} as tile_x, {tile('lat')} as tile_y, row_number() over (partition by {tile('lon')}, {tile('lat')} order by node_id) - 1 as local_idx,
    trunc(lat * 1e6::double)::int as lat_micro, trunc(lon * 1e6::double)::int as lon_micro from nodes_grid where node_id in (select src from e union select dst from e))"""
TILED = "tiled as materialized (select e.*, a.tile_x as sx, a.tile_y as sy, a.local_idx as si, b.tile_x as dx, b.tile_y as dy, b.local_idx as di, (a.tile_x, a.tile_y) <> (b.tile_x, b.tile_y) as crosses from e join owned a on a.node_id = e.src join owned b on b.node_id = e.dst)"
ETL = "ways refs nodes_grid"


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.graph_edges(X.way_tags(spark, d), X.way_refs(spark, d), X.nodes_grid(spark, d))


def level_parts(spark: SparkSession, d: str, level: int = LEVEL) -> tuple[DataFrame, DataFrame]:
    edges = written(graph_etl.at_level(edges_of(spark, d), level), "edges")  # the numbering and the tiling both read them
    owned = graph_etl.routing_nodes(edges, X.nodes_grid(spark, d), level)
    return owned, graph_etl.tiled_edges(edges, owned)


@query("needed_nodes", with_views(ETL, f"{ROUTABLE} select distinct ref as node_id, lat_micro, lon_micro from refs join routable using (way_id) join nodes_grid on node_id = ref"))
def _needed(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.needed_nodes(X.nodes_grid(spark, d), X.way_refs(spark, d), graph_etl.routable_ways(X.way_tags(spark, d))).select("node_id", "lat_micro", "lon_micro")


@query("way_segments", with_views("refs", f"{SEG} select way_id, pos, src, dst from seg"))
def _segments(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.way_segments(X.way_refs(spark, d))


@query("graph_edges", with_views(ETL, f"{GRAPH} select way_id, pos, reverse, src, dst, distance_cm, road_class, speed, oneway and not reverse as oneway, name from edges"))
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d)


@query("edge_weights", with_views(ETL, f"{GRAPH} select road_class, count(*)::bigint as edges, sum({WEIGHT})::bigint as weight_cs, max({WEIGHT})::bigint as most_cs, sum(distance_cm)::bigint as distance_cm from edges group by road_class"))
def _weights(spark: SparkSession, d: str) -> DataFrame:
    e = graph_etl.with_weight(edges_of(spark, d))
    return e.groupBy("road_class").agg(F.count("*").alias("edges"), F.sum("weight_cs").alias("weight_cs"), F.max("weight_cs").alias("most_cs"), F.sum("distance_cm").alias("distance_cm"))


@query("routing_nodes", with_views(ETL, f"{GRAPH}, {OWNED} select node_id, tile_x, tile_y, local_idx, lat_micro, lon_micro from owned"))
def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return level_parts(spark, d)[0]


@query("same_vs_cross_edges", with_views(ETL, f"{GRAPH}, {OWNED}, {TILED} select way_id, pos, reverse, sx as src_tile_x, sy as src_tile_y, si as src_idx, dx as dst_tile_x, dy as dst_tile_y, di as dst_idx, crosses, distance_cm from tiled"))
def _tiled(spark: SparkSession, d: str) -> DataFrame:
    return level_parts(spark, d)[1].select("way_id", "pos", "reverse", "src_tile_x", "src_tile_y", "src_idx", "dst_tile_x", "dst_tile_y", "dst_idx", "crosses", "distance_cm")


@query(
    "csr_offsets",
    with_views(ETL, f"{GRAPH}, {OWNED}, {TILED}, n as (select src, count(*) as n from tiled where not crosses group by src) select tile_x, tile_y, local_idx, coalesce(n, 0)::bigint as edge_count, coalesce(sum(coalesce(n, 0)) over (partition by tile_x, tile_y order by local_idx rows between unbounded preceding and 1 preceding), 0)::bigint as first_edge from owned left join n on n.src = node_id"),
)
def _csr(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.csr_offsets(*level_parts(spark, d))


BOUNDARY = "ends as (select distinct sx as tile_x, sy as tile_y, si as local_idx from tiled where crosses)"
NAMES = "names as (select tile_x, tile_y, name_id, name from (select sx as tile_x, sy as tile_y, name, row_number() over (partition by sx, sy order by k) as name_id from (select sx, sy, name, min((not crosses, way_id, pos, reverse)) as k from tiled where name is not null group by all)) where name_id <= 255)"


@query("boundary_nodes", with_views(ETL, f"{GRAPH}, {OWNED}, {TILED}, {BOUNDARY} select * from ends"))
def _boundary(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.boundary_nodes(level_parts(spark, d)[1])


@query("tile_name_dictionary", with_views(ETL, f"{GRAPH}, {OWNED}, {TILED}, {NAMES} select * from names"))
def _names(spark: SparkSession, d: str) -> DataFrame:
    return graph_etl.name_dictionary(level_parts(spark, d)[1])


@query(
    "tile_memory_estimate",
    with_views(
        ETL,
        f"""{GRAPH}, {OWNED}, {TILED}, {NAMES}, {BOUNDARY}, a as (select tile_x, tile_y, count(*) as n from owned group by all), b as (select sx as tile_x, sy as tile_y, count(*) as n from tiled where not crosses group by all),
        c as (select tile_x, tile_y, sum(strlen(name)) as n from names group by all), f as (select tile_x, tile_y, count(*) as n from ends group by all)
        select tile_x, tile_y, (a.n * 16 + coalesce(b.n, 0) * 12 + coalesce(f.n, 0) * 2 + coalesce(c.n, 0) + 64)::bigint as memory_bytes from a left join b using (tile_x, tile_y) left join c using (tile_x, tile_y) left join f using (tile_x, tile_y)""",
    ),
)
def _memory(spark: SparkSession, d: str) -> DataFrame:
    owned, tiled = (written(x, "tiles") for x in level_parts(spark, d))
    return graph_etl.tile_memory(owned, tiled, graph_etl.name_dictionary(tiled), graph_etl.boundary_nodes(tiled))


@query(
    "level_tile_counts",
    with_views(ETL, f"{GRAPH}, " + ", ".join(f"l{k} as (select distinct {k} as level, {tile('lon', s)} as tile_x, {tile('lat', s)} as tile_y, node_id from nodes_grid where node_id in (select src from edges where level = {k} union select dst from edges where level = {k}))" for k, s in C.TILE_SIZE_DEG.items()) + " select level, count(distinct (tile_x, tile_y))::bigint as tiles, count(*)::bigint as nodes from (select * from l0 union all select * from l1 union all select * from l2) group by level"),
)
def _level_tiles(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = edges_of(spark, d), X.nodes_grid(spark, d)
    ends = edges.select(classify.hierarchy_level(F.col("road_class")).alias("level"), F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    size = classify.tile_size_deg(F.col("level"))
    keyed = ends.join(nodes, "node_id").select("level", F.floor(F.col("lon") / size).alias("x"), F.floor(F.col("lat") / size).alias("y"))
    return keyed.groupBy("level", "x", "y").agg(F.count("*").alias("n")).groupBy("level").agg(F.count("*").alias("tiles"), F.sum("n").alias("nodes"))


def _near(neighbours: bool) -> str:
    steps = "(values (-1), (0), (1))" if neighbours else "(values (0))"
    return with_views(
        "query_points nodes_grid",
        f"""p as (select point_id, lat_micro, lon_micro, {tile('lon')} + x.c as tile_x, {tile('lat')} + y.c as tile_y from query_points, {steps} x(c), {steps} y(c)),
        n as (select node_id, lat_micro as la, lon_micro as lo, {tile('lon')} as tile_x, {tile('lat')} as tile_y from nodes_grid),
        m as (select point_id, node_id, round({hav('lat_micro / 1e6::double', 'lon_micro / 1e6::double', 'la / 1e6::double', 'lo / 1e6::double')}, 6) as dist from p join n using (tile_x, tile_y))
        select point_id, first(node_id order by dist, node_id) as node_id, round(min(dist), 3) as distance_m from m group by point_id""",
    )


@query("snap_nearest", _near(True))
def _snap(spark: SparkSession, d: str) -> DataFrame:
    return snap.snap_nearest(X.query_points(spark, d), X.nodes_grid(spark, d)).withColumn("distance_m", F.round("distance_m", 3))


@query("snap_in_tile", _near(False))
def _snap_tile(spark: SparkSession, d: str) -> DataFrame:
    return snap.snap_in_tile(X.query_points(spark, d), X.nodes_grid(spark, d)).withColumn("distance_m", F.round("distance_m", 3))


LEVELS = f"{GRAPH}, lv as materialized (select distinct level, node_id, lat_micro, lon_micro from (select level, src as node_id from edges union select level, dst from edges) join nodes_grid using (node_id))"


def level_nodes(spark: SparkSession, d: str) -> DataFrame:
    ends = edges_of(spark, d).select(classify.hierarchy_level(F.col("road_class")).alias("level"), F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.join(X.nodes_grid(spark, d), "node_id")


@query("level_transition", with_views(ETL, f"{LEVELS} select a.level as src_level, a.node_id as src, b.level as dst_level, b.node_id as dst, 0 as weight_cs from lv a join lv b using (lat_micro, lon_micro) where abs(a.level - b.level) = 1"))
def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return snap.level_transitions(level_nodes(spark, d))


# Streets between grid neighbours for routing: 30 km/h, some of them slower.
GRID_EDGES = f"g as materialized (select src, dst, 'Way ' || (least(src, dst) % 7) as name, trunc({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 100)::bigint as distance_cm, (20 + (src + dst) % 4 * 10)::int as speed from edges_grid join nodes_grid a on a.node_id = src join nodes_grid b on b.node_id = dst), w as materialized (select *, {WEIGHT} as w from g)"


def grid_edges(spark: SparkSession, d: str) -> DataFrame:
    n = X.nodes_grid(spark, d)
    end = lambda p: n.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    e = X.edges_grid(spark, d).join(end("src"), "src").join(end("dst"), "dst")
    cm = (geo.haversine("src_lat", "src_lon", "dst_lat", "dst_lon") * 100.0).cast("long")
    e = e.select("src", "dst", F.concat(F.lit("Way "), F.least("src", "dst") % 7).alias("name"), cm.alias("distance_cm"), (20 + (F.col("src") + F.col("dst")) % 4 * 10).cast("int").alias("speed"))
    return graph_etl.with_weight(e)


def scatter_edges(spark: SparkSession, d: str) -> DataFrame:
    """Long links between scattered nodes, from way segments: a graph of small diameter."""
    n = X.nodes_scatter(spark, d)
    end = lambda p: n.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    e = graph_etl.way_segments(X.way_refs(spark, d)).select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst")
    return e.select("src", "dst", (geo.haversine("src_lat", "src_lon", "dst_lat", "dst_lon") * 100.0).cast("long").alias("weight_cs"))


COSTS = "t(id, g) using key (id) as (select {src}::bigint, 0::bigint union (select w.dst, min(t.g + w.w) from t join w on t.id = w.src left join recurring.t r on r.id = w.dst where r.id is null or t.g + w.w < r.g group by w.dst))"


@query("sssp_costs", with_views("refs nodes_scatter", f"{SEG}, w as materialized (select src, dst, trunc({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 100)::bigint as w from (select distinct src, dst from seg) join nodes_scatter a on a.node_id = src join nodes_scatter b on b.node_id = dst), {COSTS.format(src=7)} select id as node_id, g as cost from t"))
def _sssp(spark: SparkSession, d: str) -> DataFrame:
    return routing.one_to_all(scatter_edges(spark, d), 7)


DEPOT = 7  # the node that every customer's way starts from, so that one search gives the oracle all costs


@query("route_costs", with_views("edges_grid nodes_grid", f"{GRID_EDGES}, {COSTS.format(src=DEPOT)} select c_custkey as req_id, {DEPOT}::bigint as src, c_custkey * 104729 % n as dst, g as cost_cs from customer, (select count(*) as n from part), t where id = c_custkey * 104729 % n"))
def _route_costs(spark: SparkSession, d: str) -> DataFrame:
    asked = X.route_requests(spark, d).withColumn("src", F.lit(DEPOT).cast("long"))
    found = routing.point_to_point(asked, grid_edges(spark, d), X.nodes_grid(spark, d))
    return found.filter("cost_cs is not null").select("req_id", "src", "dst", "cost_cs")


@query("route_paths")
def _route_paths(spark: SparkSession, d: str) -> DataFrame:
    return routing.point_to_point(X.route_requests(spark, d), grid_edges(spark, d), X.nodes_grid(spark, d))


@query("route_segments")
def _route_segments(spark: SparkSession, d: str) -> DataFrame:
    edges = grid_edges(spark, d)
    return routing.route_segments(routing.point_to_point(X.route_requests(spark, d), edges, X.nodes_grid(spark, d)), edges)


# A straight walk along a grid row: ten nodes from each customer's node on, as far as the row goes.
WALK = "walk as (select point_id as req_id, list_transform(range(least(10, 50 - start % 50)), lambda i: start + i) as path from (select point_id, point_id * 7919 % n as start from query_points, (select count(*) as n from part)) where start // 50 * 50 + 50 <= (select count(*) from part)), step as (select req_id, unnest(path) as src, generate_subscripts(path, 1) as i, len(path) as n from walk)"


def walks(spark: SparkSession, d: str) -> DataFrame:
    size = X.table(spark, d, "part").count()
    p = X.query_points(spark, d).select(F.col("point_id").alias("req_id"), (F.col("point_id") * 7919 % size).alias("start"))
    p = p.filter(f"start div 50 * 50 + 50 <= {size}")
    return p.select("req_id", F.sequence("start", F.col("start") + F.least(F.lit(10), 50 - F.col("start") % 50) - 1).alias("path"))


@query("path_totals", with_views("query_points edges_grid nodes_grid", f"{GRID_EDGES}, {WALK} select s.req_id, coalesce(sum(distance_cm), 0)::bigint as distance_cm, coalesce(sum(w), 0)::bigint as weight_cs from step s left join w on w.src = s.src and w.dst = s.src + 1 and i < n group by s.req_id"))
def _totals(spark: SparkSession, d: str) -> DataFrame:
    return routing.path_totals(walks(spark, d), grid_edges(spark, d))


@query("path_instructions", with_views("query_points edges_grid nodes_grid", f"{GRID_EDGES}, {WALK} select req_id, (i - 1)::int as step, name, case when i = 1 then 'Start' when i = n - 1 then 'Arrive' else 'Continue' end as instruction, distance_cm / 100.0::double as distance_m from step s join w on w.src = s.src and w.dst = s.src + 1 where i < n"))
def _instructions(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_segments(walks(spark, d), grid_edges(spark, d))


@query("path_coordinates", with_views("query_points nodes_grid", f"{WALK} select req_id, (i - 1)::int as step, lat, lon from step join nodes_grid on node_id = src"))
def _path_coordinates(spark: SparkSession, d: str) -> DataFrame:
    steps = walks(spark, d).select("req_id", F.posexplode("path").alias("step", "node_id"))
    return steps.join(X.nodes_grid(spark, d), "node_id").select("req_id", "step", "lat", "lon")


ENDS = "r as (select point_id as req_id, lat as lat1, lon as lon1, 47.1 + (point_id * 31 % 900) / 1000.0::double as lat2, 8.4 + (point_id * 17 % 900) / 1000.0::double as lon2 from query_points)"


def ends(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("point_id")
    return X.query_points(spark, d).select(p.alias("req_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (F.lit(47.1) + p * 31 % 900 / F.lit(1000.0)).alias("lat2"), (F.lit(8.4) + p * 17 % 900 / F.lit(1000.0)).alias("lon2"))


_FAR = hav("lat1", "lon1", "lat2", "lon2")


@query("candidate_levels", with_views("query_points", f"{ENDS}, m as (select req_id, case when {_FAR} < 5000 then 2 when {_FAR} < 50000 then 1 else 0 end as l from r) select req_id, (l - level)::int as tried, level::int as level from (select req_id, l, unnest(range(0, l + 1)) as level from m)"))
def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return routing.candidate_levels(ends(spark, d)).select("req_id", "tried", "level")


def _nearest_sql(name: str, level: int, at: str) -> str:
    size = C.TILE_SIZE_DEG[level]
    lat, lon = f"{at}_lat / 1e6::double", f"{at}_lon / 1e6::double"
    return f"""{name} as (select req_id, first(node_id order by dist, node_id) as {name} from (select req_id, node_id, round({hav(lat, lon, 'lv.lat_micro / 1e6::double', 'lv.lon_micro / 1e6::double')}, 6) as dist
        from (select *, {tile(lon, size)} + x.c as tx, {tile(lat, size)} + y.c as ty from c, (values (-1), (0), (1)) x(c), (values (-1), (0), (1)) y(c)) q
        join lv on lv.level = {level} and {tile('lv.lon_micro / 1e6::double', size)} = tx and {tile('lv.lat_micro / 1e6::double', size)} = ty) group by req_id)"""


@query(
    "hier_connectors",
    with_views(
        "query_points " + ETL,
        f"""{LEVELS}, c as (select point_id as req_id, lat_micro as start_lat, lon_micro as start_lon, 47100000 + point_id * 31 % 40000 as end_lat, 8400000 + point_id * 17 % 50000 as end_lon from query_points),
        {_nearest_sql('local_start', 2, 'start')}, {_nearest_sql('level_start', 1, 'start')}, {_nearest_sql('local_end', 2, 'end')}, {_nearest_sql('level_end', 1, 'end')}
        select * from local_start join level_start using (req_id) join local_end using (req_id) join level_end using (req_id)""",
    ),
)
def _connectors(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("point_id")
    asked = X.query_points(spark, d).select(p.alias("req_id"), F.col("lat_micro").alias("start_lat_micro"), F.col("lon_micro").alias("start_lon_micro"), (47_100_000 + p * 31 % 40_000).alias("end_lat_micro"), (8_400_000 + p * 17 % 50_000).alias("end_lon_micro"))
    lv = written(level_nodes(spark, d), "nodes")
    return routing.hier_connectors(asked, {k: lv.filter(F.col("level") == k) for k in (1, 2)}, 1)


@query("hierarchical_routes")
def _hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return routing.find_routes(ends(spark, d), level_graphs(spark, d))


@query("prune_to_bbox", with_views("nodes_grid", f"select node_id, {tile('lon')} as tile_x, {tile('lat')} as tile_y from nodes_grid where {tile('lon')} between 841 and 843 and {tile('lat')} between 4710 and 4712"))
def _prune(spark: SparkSession, d: str) -> DataFrame:
    x, y = grid.tile_key("lat", "lon")
    return grid.prune_to_bbox(X.nodes_grid(spark, d).select("node_id", x.alias("tile_x"), y.alias("tile_y")), 47.105, 47.125, 8.415, 8.435)


# One graph over all levels: a node is (level, node); nodes at the same place on adjacent levels are tied at no cost.
KEY = routing.LEVEL_KEY
MULTI = f"{LEVELS}, w as materialized (select level * {KEY} + src as src, level * {KEY} + dst as dst, min({WEIGHT}) as w from edges group by all union all select a.level * {KEY} + a.node_id, b.level * {KEY} + b.node_id, 0 from lv a join lv b using (lat_micro, lon_micro) where abs(a.level - b.level) = 1)"


@query("multi_level_costs", with_views(ETL, f"{MULTI}, {COSTS.format(src=2 * KEY + 7)} select id % {KEY} as node_id, min(g)::bigint as cost, (2 - max(id // {KEY}))::int as highest_first from t group by 1"))
def _multi_level(spark: SparkSession, d: str) -> DataFrame:
    key = lambda level, node: F.col(level).cast("long") * KEY + F.col(node)
    edges = written(graph_etl.with_weight(edges_of(spark, d)).withColumn("level", classify.hierarchy_level(F.col("road_class"))), "edges")
    ends = edges.select("level", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    ties = snap.level_transitions(ends.join(X.nodes_grid(spark, d), "node_id"))
    own = edges.select(key("level", "src").alias("src"), key("level", "dst").alias("dst"), "weight_cs")
    across = ties.select(key("src_level", "src").alias("src"), key("dst_level", "dst").alias("dst"), F.col("weight_cs").cast("long").alias("weight_cs"))
    costs = routing.one_to_all(own.unionByName(across), 2 * KEY + 7)
    level = F.expr(f"cast(node_id div {KEY} as int)")
    return costs.withColumn("level", level).groupBy((F.col("node_id") % KEY).alias("node_id")).agg(F.min("cost").alias("cost"), (2 - F.max("level")).alias("highest_first"))


MULTI_START = 2 * KEY + 7


def weighted_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """src, dst, weight_cs, distance_cm, level of the edges, and the nodes of each level (level and the columns of nodes_grid); both written once for all that is made of them."""
    edges = written(graph_etl.with_weight(edges_of(spark, d)).select("src", "dst", "weight_cs", "distance_cm", classify.hierarchy_level(F.col("road_class")).alias("level")), "edges")
    ends = edges.select("level", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return edges, written(ends.join(X.nodes_grid(spark, d), "node_id"), "level_nodes")


def multi_level_graph(spark: SparkSession, d: str, built: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """src, dst, weight_cs, distance_cm over (level, node) keys."""
    key = lambda level, node: F.col(level).cast("long") * KEY + F.col(node)
    edges, held = built or weighted_edges(spark, d)
    ties = written(snap.level_transitions(held), "ties")
    none = F.lit(0).cast("long")
    return edges.select(key("level", "src").alias("src"), key("level", "dst").alias("dst"), "weight_cs", "distance_cm").unionByName(ties.select(key("src_level", "src").alias("src"), key("dst_level", "dst").alias("dst"), none.alias("weight_cs"), none.alias("distance_cm")))


@query("multi_level_routes", with_views(ETL, f"{MULTI}, {COSTS.format(src=MULTI_START)} select c_custkey as req_id, id as dst, g::bigint as cost_cs, g::bigint as path_cs from customer, (select count(*) as n from part), t where id = {2 * KEY} + c_custkey * 7919 % n"))
def _multi_routes(spark: SparkSession, d: str) -> DataFrame:
    """Ways over all levels to every customer's node: the cost found, and what the edges of the path add up to."""
    graph = multi_level_graph(spark, d)
    asked = X.route_requests(spark, d).select("req_id", F.lit(MULTI_START).cast("long").alias("src"), (F.lit(2 * KEY).cast("long") + F.col("src")).alias("dst"))
    nodes = X.nodes_grid(spark, d).select(F.explode(F.array(*(F.lit(k * KEY).cast("long") + F.col("node_id") for k in C.TILE_SIZE_DEG))).alias("node_id"), "lat", "lon")
    found = written(routing.point_to_point(asked, graph, nodes).filter("cost_cs is not null"), "routes")
    return found.join(routing.path_totals(found, graph), "req_id").select("req_id", "dst", "cost_cs", F.col("weight_cs").alias("path_cs"))


CUSTOMER_NODES = "asked as (select c_custkey as req_id, c_custkey * 7919 % n as node_id from customer, (select count(*) as n from part))"


@query("heuristic_cs", with_views("nodes_grid", f"r as (select c_custkey as req_id, c_custkey * 7919 % n as src, c_custkey * 104729 % n as dst from customer, (select count(*) as n from part)) select req_id, trunc({hav('a.lat_micro / 1e6::double', 'a.lon_micro / 1e6::double', 'b.lat_micro / 1e6::double', 'b.lon_micro / 1e6::double')} / (130.0::double * 1000.0 / 3600.0) * 100.0)::bigint as least_cs from r join nodes_grid a on a.node_id = src join nodes_grid b on b.node_id = dst"))
def _heuristic(spark: SparkSession, d: str) -> DataFrame:
    n = X.nodes_grid(spark, d)
    end = lambda p: n.select(F.col("node_id").alias(p), F.col("lat_micro").alias(f"{p}_lat"), F.col("lon_micro").alias(f"{p}_lon"))
    return X.route_requests(spark, d).join(end("src"), "src").join(end("dst"), "dst").select("req_id", geo.heuristic_cs("src_lat", "src_lon", "dst_lat", "dst_lon").alias("least_cs"))


def _edges_from(crosses: bool) -> str:
    return with_views(ETL, f"{GRAPH}, {OWNED}, {TILED}, {CUSTOMER_NODES} select req_id, node_id, way_id, pos, reverse, dx as dst_tile_x, dy as dst_tile_y, di as dst_idx, distance_cm from asked join tiled on src = node_id where {'crosses' if crosses else 'not crosses'}")


def _node_edges(spark: SparkSession, d: str, crosses: bool) -> DataFrame:
    owned, tiled = level_parts(spark, d)
    asked = X.route_requests(spark, d).select("req_id", F.col("src").alias("node_id"))
    found = graph_etl.edges_for_node(asked, owned, tiled.drop("src", "dst"), crosses)
    return found.select("req_id", "node_id", "way_id", "pos", "reverse", "dst_tile_x", "dst_tile_y", "dst_idx", "distance_cm")


@query("edges_for_node", _edges_from(False))
def _edges_for_node(spark: SparkSession, d: str) -> DataFrame:
    return _node_edges(spark, d, False)


@query("cross_tile_edges_for_node", _edges_from(True))
def _cross_edges_for_node(spark: SparkSession, d: str) -> DataFrame:
    return _node_edges(spark, d, True)


def _partition_sql(level: int) -> str:
    """Common tables of one level's tiles, the last of them part<level>."""
    size = C.TILE_SIZE_DEG[level]
    n, e = f"own{level}", f"te{level}"
    return f"""{n} as (select node_id, {tile('lon', size)} as tile_x, {tile('lat', size)} as tile_y from nodes_grid where node_id in (select src from edges where level = {level} union select dst from edges where level = {level})),
        {e} as (select a.tile_x as tile_x, a.tile_y as tile_y, src, (a.tile_x, a.tile_y) <> (b.tile_x, b.tile_y) as crosses from edges join {n} a on a.node_id = src join {n} b on b.node_id = dst where level = {level}),
        part{level} as (select {level} as level, n.tile_x as tile_x, n.tile_y as tile_y, nodes, coalesce(same_edges, 0)::bigint as same_edges, coalesce(cross_edges, 0)::bigint as cross_edges, coalesce(boundary, 0)::bigint as boundary
            from (select tile_x, tile_y, count(*)::bigint as nodes from {n} group by all) n left join (select tile_x, tile_y, count(*) filter (not crosses) as same_edges, count(*) filter (crosses) as cross_edges,
            count(distinct src) filter (crosses) as boundary from {e} group by all) x on x.tile_x = n.tile_x and x.tile_y = n.tile_y)"""


PARTITIONS = f"{GRAPH}, " + ", ".join(_partition_sql(k) for k in C.TILE_SIZE_DEG)
ALL_PARTS = " union all ".join(f"select * from part{k}" for k in C.TILE_SIZE_DEG)


def all_levels(spark: SparkSession, d: str) -> dict[int, tuple[DataFrame, DataFrame]]:
    edges = written(edges_of(spark, d), "edges")
    out = {}
    for level in C.TILE_SIZE_DEG:
        own = graph_etl.at_level(edges, level)
        owned = graph_etl.routing_nodes(own, X.nodes_grid(spark, d), level)
        out[level] = (owned, graph_etl.tiled_edges(own, owned))
    return out


@query("partition_by_level", with_views(ETL, f"{PARTITIONS} {ALL_PARTS}"))
def _partition(spark: SparkSession, d: str) -> DataFrame:
    parts = [graph_etl.tile_summary(*x).select(F.lit(k).alias("level"), "tile_x", "tile_y", "nodes", "same_edges", "cross_edges", "boundary") for k, x in all_levels(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("write_read_routing_tiles", with_views(ETL, f"{PARTITIONS} select level, count(*)::bigint as tiles, sum(nodes)::bigint as nodes, sum(same_edges)::bigint as same_edges, sum(cross_edges)::bigint as cross_edges from ({ALL_PARTS}) group by level"))
def _routing_tiles(spark: SparkSession, d: str) -> DataFrame:
    levels = all_levels(spark, d)
    tagged = [[x.withColumn("level", F.lit(k)) for k, pair in levels.items() for x in [pair[i]]] for i in (0, 1)]
    nodes, edges = (x[0].unionByName(x[1]).unionByName(x[2]) for x in tagged)
    folder = new_folder(spark, "routing")
    readers.write_routing_tiles(nodes, edges, folder)
    nodes, same, cross = readers.read_routing_tiles(spark, folder, edges.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    counts = nodes.groupBy("level", "tile_x", "tile_y").agg(F.count("*").alias("n")).groupBy("level").agg(F.count("*").alias("tiles"), F.sum("n").alias("nodes"))
    n_of = lambda df, name: df.groupBy("level").agg(F.count("*").alias(name))
    return counts.join(n_of(same, "same_edges"), "level", "left").join(n_of(cross, "cross_edges"), "level", "left").fillna(0)


@query("route_with_endpoints", with_views("query_points nodes_grid", f"{WALK}, p as (select req_id, count(*) + 2 as n, first(lat order by i desc) as last_lat, first(lon order by i) as first_lon from step join nodes_grid on node_id = src group by req_id) select req_id, n::int as n, q.lat as from_lat, q.lon as from_lon, first_lon, last_lat, q.lat + 0.01::double as to_lat from p join query_points q on point_id = req_id"))
def _with_endpoints(spark: SparkSession, d: str) -> DataFrame:
    steps = walks(spark, d).select("req_id", F.posexplode("path").alias("step", "node_id")).join(X.nodes_grid(spark, d), "node_id")
    points = steps.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    ends_ = X.query_points(spark, d).select(F.col("point_id").alias("req_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), (F.col("lat") + F.lit(0.01)).alias("to_lat"), F.col("lon").alias("to_lon"))
    full = routing.with_endpoints(points.join(ends_, "req_id"))
    at = lambda i, f: F.element_at("points", i)[f]
    return full.select("req_id", F.size("points").alias("n"), at(1, "lat").alias("from_lat"), at(1, "lon").alias("from_lon"), at(2, "lon").alias("first_lon"), at(-2, "lat").alias("last_lat"), at(-1, "lat").alias("to_lat"))


SEEN = f"seen as (select point_id, unnest(generate_series({tile('lon - 0.015::double')}, {tile('lon + 0.015::double')}))::int as tile_x, {tile('lat - 0.015::double')} as y0, {tile('lat + 0.015::double')} as y1 from query_points), vis as (select point_id, tile_x, unnest(generate_series(y0, y1))::int as tile_y from seen), held as (select point_id + 1 as point_id, tile_x, tile_y from vis)"


@query("tiles_to_load_and_keep", with_views("query_points", f"{SEEN}, a as (select point_id, tile_x, tile_y from vis except select * from held), b as (select * from held intersect select point_id, tile_x, tile_y from vis) select point_id, 'load' as what, tile_x, tile_y from a union all select point_id, 'keep', tile_x, tile_y from b"))
def _load_and_keep(spark: SparkSession, d: str) -> DataFrame:
    """Each point's view after the one of the point before."""
    by = ["point_id", "tile_x", "tile_y"]
    visible = grid.visible_tiles(X.query_points(spark, d), "lat", "lon", C.VIEW_RADIUS_DEG).select(*by)
    return grid.load_and_keep(visible, visible.withColumn("point_id", F.col("point_id") + 1), by).select("point_id", "what", "tile_x", "tile_y")


@query("landed_ways", with_views("ways refs", "select way_id, name, count(ref)::bigint as refs, sum(ref * (pos + 1))::bigint as checked from ways join refs using (way_id) group by way_id, name"))
def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Ways landed as JSON lines and read back into the tables of the ETL."""
    refs = X.way_refs(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    folder = new_folder(spark, "landed")
    X.way_tags(spark, d).join(refs, "way_id").select(F.col("way_id").alias("id"), "refs", "tags").write.json(folder)
    tags, placed = readers.landed_ways(readers.read_landed(spark, folder, readers.WAY, "json"))
    return tags.join(placed, "way_id").groupBy("way_id", F.col("tags")["name"].alias("name")).agg(F.count("*").alias("refs"), F.sum(F.col("ref") * (F.col("pos") + 1)).alias("checked"))


# The front door: every way starts at one place, so that a search each for the tile, all levels and each upper level gives the oracle all costs.
DOOR_START = (47.1012, 8.4018)
_LAT2, _LON2 = "(lat_micro + [0, 5000, 12000, 500000][(point_id % 4 + 1)::int]) / 1e6::double", "lon_micro / 1e6::double"
DOOR = f"""r as materialized (select point_id as req_id, trunc({DOOR_START[0]}::double * 1e6::double)::int as start_lat, trunc({DOOR_START[1]}::double * 1e6::double)::int as start_lon, trunc(({_LAT2}) * 1e6::double)::int as end_lat, trunc(({_LON2}) * 1e6::double)::int as end_lon,
    {hav(f"{DOOR_START[0]}::double", f"{DOOR_START[1]}::double", _LAT2, _LON2)} as far from query_points), c as (select * from r)"""


def _search_sql(name: str, links: str, start: str) -> str:
    """Common table ``name``: id, g of the least costs from ``start`` along ``links`` (src, dst, w)."""
    return f"{name}(id, g) using key (id) as (select id, 0::bigint from ({start}) union (select w.dst, min(t.g + w.w) from {name} t join {links} w on t.id = w.src left join recurring.{name} r on r.id = w.dst where r.id is null or t.g + w.w < r.g group by w.dst))"


def _level_search(level: int) -> str:
    """Common tables of the ends on a level, and of the costs from the start's: way<level>."""
    a, b = f"start{level}", f"end{level}"
    own = f"links{level} as materialized (select src, dst, min({WEIGHT}) as w from edges where level = {level} group by all)"
    return f"{_nearest_sql(a, level, 'start')}, {_nearest_sql(b, level, 'end')}, {own}, {_search_sql(f'way{level}', f'links{level}', f'select distinct {a} as id from {a}')}"


def _in_tile_sql(name: str, at: str) -> str:
    own = lambda c: tile(f"{c} / 1e6::double")
    d = hav(f"{at}_lat / 1e6::double", f"{at}_lon / 1e6::double", "lat_micro / 1e6::double", "lon_micro / 1e6::double")
    return f"{name} as (select req_id, first(node_id order by round({d}, 6), node_id) as {name} from same join lv on level = 2 and {own('lat_micro')} = {own('end_lat')} and {own('lon_micro')} = {own('end_lon')} group by req_id)"


_OWN = lambda c: tile(f"{c} / 1e6::double")
_OWN_START, _OWN_END = (f"{_OWN(f'{x}_lat')} = {_OWN('end_lat')} and {_OWN(f'{x}_lon')} = {_OWN('end_lon')}" for x in ("start", "end"))


def door_tile_sql(mode: str) -> str:
    """Common tables of the ends in the end's tile, and of the costs from each tile's start: way_tile.  No edge leaves a tile here, so one search serves all tiles."""
    placed = f"held as materialized (select node_id, {_OWN('lat_micro')} as ty, {_OWN('lon_micro')} as tx from lv where level = 2)"
    links = f"tile_links as materialized (select src, dst, min({WEIGHT}) as w from edges join held a on a.node_id = src join held b on b.node_id = dst where level = 2 and a.ty = b.ty and a.tx = b.tx group by all)"
    return f"""same as materialized (select * from r where far < 5000 and {_OWN_START if mode == "exact" else _OWN_END}), {_in_tile_sql('tile_start', 'start')}, {_in_tile_sql('tile_end', 'end')},
    {placed}, {links}, {_search_sql('way_tile', 'tile_links', 'select distinct tile_start as id from tile_start')}"""


DOOR_LOCAL = f"{_nearest_sql('start2', 2, 'start')}, {_nearest_sql('end2', 2, 'end')}, {_search_sql('way2', 'w', f'select distinct {2 * KEY} + start2 as id from start2')}"


def door_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's way from DOOR_START: to its place, or to one 0.005, 0.012 or 0.5 degrees further north."""
    north = F.get(F.array(*map(F.lit, (0, 5_000, 12_000, 500_000))), (F.col("point_id") % 4).cast("int"))
    p = X.query_points(spark, d)
    return p.select(F.col("point_id").alias("req_id"), F.lit(DOOR_START[0]).alias("lat1"), F.lit(DOOR_START[1]).alias("lon1"), ((F.col("lat_micro") + north) / F.lit(1e6)).alias("lat2"), (F.col("lon_micro") / F.lit(1e6)).alias("lon2"))


def level_graphs(spark: SparkSession, d: str, built: tuple[DataFrame, DataFrame] | None = None) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Nodes and edges of each level."""
    edges, held = built or weighted_edges(spark, d)
    own = lambda df, level: df.filter(F.col("level") == level).drop("level")
    return {level: (own(held, level), own(edges, level)) for level in C.TILE_SIZE_DEG}


def level_places(spark: SparkSession, d: str) -> DataFrame:
    return X.nodes_grid(spark, d).select(F.explode(F.array(*(F.lit(k * KEY).cast("long") + F.col("node_id") for k in C.TILE_SIZE_DEG))).alias("node_id"), "lat", "lon")


@query("single_tile_routes", with_views("query_points " + ETL, f"{LEVELS}, {DOOR}, {door_tile_sql('end_tile')} select req_id, tile_start as src, tile_end as dst, g::bigint as cost_cs from tile_start join tile_end using (req_id) join way_tile on id = tile_end"))
def _tile_routes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = level_graphs(spark, d)[C.LOCAL]
    near = door_requests(spark, d).filter(geo.haversine("lat1", "lon1", "lat2", "lon2") < C.LOCAL_LIMIT_M)
    return front_door.single_tile_routes(near, nodes, edges, "end_tile").select("req_id", "src", "dst", "cost_cs")


@query("connected_routes", with_views("query_points " + ETL, f"{LEVELS}, {DOOR}, {DOOR_LOCAL.split(', way2(')[0]}, {_level_search(1)} select req_id, {2 * KEY} + start2 as first_node, case when end2 = end1 then {KEY} + end1 else {2 * KEY} + end2 end as last_node, g::bigint as cost_cs from start2 join end2 using (req_id) join end1 using (req_id) join way1 on id = end1"))
def _connected(spark: SparkSession, d: str) -> DataFrame:
    found = front_door.connected_routes(door_requests(spark, d), level_graphs(spark, d), C.ARTERIAL)
    return found.select("req_id", F.get("path", F.lit(0)).alias("first_node"), F.element_at("path", -1).alias("last_node"), "cost_cs")


def front_door_sql(mode: str) -> str:
    return with_views(
        "query_points " + ETL,
        f"""{MULTI}, {DOOR}, {door_tile_sql(mode)}, {DOOR_LOCAL}, {_level_search(1)}, {_level_search(0)},
        tried as (select r.req_id, far, a.g as by_tile, case when far < 5000 then b.g end as by_local, case when far < 50000 and end2.req_id is not null then p.g end as by_arterial, case when end2.req_id is not null then h.g end as by_highway from r
        left join tile_end using (req_id) left join way_tile a on a.id = tile_end left join end2 using (req_id) left join way2 b on b.id = {2 * KEY} + end2 left join end1 using (req_id) left join way1 p on p.id = end1 left join end0 using (req_id) left join way0 h on h.id = end0)
        select req_id, case when by_tile is not null then 'tile' when by_local is not null then 'local' when by_arterial is not null then 'arterial' else 'highway' end as how, coalesce(by_tile, by_local, by_arterial, by_highway)::bigint as cost_cs from tried where coalesce(by_tile, by_local, by_arterial, by_highway) is not null""",
    )


def front_door_routes(spark: SparkSession, d: str, mode: str) -> DataFrame:
    built = weighted_edges(spark, d)
    return front_door.find_route(door_requests(spark, d), level_graphs(spark, d, built), multi_level_graph(spark, d, built), level_places(spark, d), mode)


@query("front_door_routes", front_door_sql("exact"))
def _front_door(spark: SparkSession, d: str) -> DataFrame:
    return front_door_routes(spark, d, "exact").select("req_id", "how", "cost_cs")


@query("front_door_routes_in_end_tile", front_door_sql("end_tile"))
def _front_door_in_tile(spark: SparkSession, d: str) -> DataFrame:
    return front_door_routes(spark, d, "end_tile").select("req_id", "how", "cost_cs")
