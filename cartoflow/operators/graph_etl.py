"""Tagged ways to a routing graph: segments, edges, tile ownership, CSR offsets, name dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, geo, grid


#: Nodes that are sent to the segments of ways, not the other way, up to so many (counted first).
SENT_NODES = 1_500_000


def routable_ways(ways: DataFrame) -> DataFrame:
    """way_id, road_class, speed, oneway, name of ways with a routable highway."""
    tags = F.col("tags")
    out = ways.select("way_id", classify.road_class(classify.tag(tags, "highway")).alias("road_class"), classify.speed_kmh(tags).alias("speed"), classify.is_oneway(tags).alias("oneway"), classify.tag(tags, "name").alias("name"))
    return out.filter("road_class is not null")


def way_segments(refs: DataFrame, *own: str) -> DataFrame:
    """way_id, pos, src, dst: consecutive nodes of each way; and the columns ``own`` of its refs."""
    w = Window.partitionBy("way_id").orderBy("pos")
    return refs.select("way_id", "pos", F.col("ref").alias("src"), F.lead("ref").over(w).alias("dst"), *own).filter("dst is not null")


def needed_nodes(nodes: DataFrame, refs: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that a way of ``ways`` uses."""
    used = refs.join(ways.select("way_id"), "way_id", "left_semi").select(F.col("ref").alias("node_id"))
    return nodes.join(used, "node_id", "left_semi")


def graph_edges(ways: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, pos, reverse, src, dst, distance_cm, road_class, speed, oneway, name; both ends must exist.

    A way that is not one-way gives an edge back for each segment; both are made in one pass.
    """
    at = nodes.select("node_id", "lat", "lon")
    at = F.broadcast(at) if nodes.count() <= SENT_NODES else at
    segs = way_segments(refs).join(routable_ways(ways), "way_id")
    for end, p in (("src", "a"), ("dst", "b")):
        segs = segs.join(at.select(F.col("node_id").alias(end), F.col("lat").alias(f"lat_{p}"), F.col("lon").alias(f"lon_{p}")), end)
    meters = geo.haversine("lat_a", "lon_a", "lat_b", "lon_b")
    ways_there = F.when(~F.col("oneway"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    edges = segs.withColumn("distance_cm", (meters * 100.0).cast("long")).withColumn("reverse", F.explode(ways_there))
    end = lambda a, b: F.when(F.col("reverse"), F.col(b)).otherwise(F.col(a)).alias(a)
    return edges.select("way_id", "pos", "reverse", end("src", "dst"), end("dst", "src"), "distance_cm", "road_class", "speed", "oneway", "name")


def with_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight_cs", classify.edge_weight_cs(F.col("distance_cm"), F.col("speed")))


def at_level(edges: DataFrame, level: int) -> DataFrame:
    """Edges of one hierarchy level."""
    return edges.filter(classify.hierarchy_level(F.col("road_class")) == level)


def routing_nodes(edges: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """node_id, tile_x, tile_y, local_idx, lat_micro, lon_micro: nodes of the level's edges, numbered by id in their tile."""
    used = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    x, y = grid.tile_key("lat", "lon", level)
    w = Window.partitionBy("tile_x", "tile_y").orderBy("node_id")
    owned = nodes.join(used, "node_id", "left_semi").withColumns({"tile_x": x, "tile_y": y})
    return owned.select("node_id", "tile_x", "tile_y", (F.row_number().over(w) - 1).alias("local_idx"), geo.to_micro("lat").alias("lat_micro"), geo.to_micro("lon").alias("lon_micro"))


def tiled_edges(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """Edges with tile and index of both ends, and whether they cross tiles."""
    at = lambda end, p: owned.select(F.col("node_id").alias(end), F.col("tile_x").alias(f"{p}_tile_x"), F.col("tile_y").alias(f"{p}_tile_y"), F.col("local_idx").alias(f"{p}_idx"))
    out = edges.join(at("src", "src"), "src").join(at("dst", "dst"), "dst")
    return out.withColumn("crosses", (F.col("src_tile_x") != F.col("dst_tile_x")) | (F.col("src_tile_y") != F.col("dst_tile_y")))


EDGE_ORDER = ("way_id", "pos", "reverse")


def csr_offsets(owned: DataFrame, tiled: DataFrame, cap: int | None = None) -> DataFrame:
    """tile_x, tile_y, local_idx, edge_count, first_edge over same-tile edges; ``cap`` bounds the count of a node."""
    counts = tiled.filter(~F.col("crosses")).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edge_count"))
    n = F.coalesce("edge_count", F.lit(0))
    w = Window.partitionBy("tile_x", "tile_y").orderBy("local_idx").rowsBetween(Window.unboundedPreceding, -1)
    out = owned.join(counts, "node_id", "left").withColumn("edge_count", F.least(n, F.lit(cap)) if cap else n)
    return out.withColumn("first_edge", F.coalesce(F.sum("edge_count").over(w), F.lit(0))).select("tile_x", "tile_y", "local_idx", "edge_count", "first_edge")


def boundary_nodes(tiled: DataFrame) -> DataFrame:
    return tiled.filter("crosses").select(F.col("src_tile_x").alias("tile_x"), F.col("src_tile_y").alias("tile_y"), F.col("src_idx").alias("local_idx")).distinct()


def name_dictionary(tiled: DataFrame, cap: int = C.NAME_MAX) -> DataFrame:
    """tile_x, tile_y, name_id (1 to ``cap``), name: first seen first, edges that cross before the others."""
    rank = F.struct((~F.col("crosses")).cast("int").alias("r"), *EDGE_ORDER)
    first = tiled.filter("name is not null").groupBy(F.col("src_tile_x").alias("tile_x"), F.col("src_tile_y").alias("tile_y"), "name").agg(F.min(rank).alias("_first"))
    w = Window.partitionBy("tile_x", "tile_y").orderBy("_first")
    return first.select("tile_x", "tile_y", F.row_number().over(w).alias("name_id"), "name").filter(F.col("name_id") <= cap)


def tile_memory(owned: DataFrame, tiled: DataFrame, names: DataFrame, boundary: DataFrame) -> DataFrame:
    """Bytes of each tile: 16 a node, 12 a same-tile edge, 2 a boundary node, names, and 64."""
    by = ["tile_x", "tile_y"]
    nodes = owned.groupBy(*by).agg(F.count("*").alias("nodes"))
    edges = tiled.filter(~F.col("crosses")).groupBy(F.col("src_tile_x").alias("tile_x"), F.col("src_tile_y").alias("tile_y")).agg(F.count("*").alias("edges"))
    texts = names.groupBy(*by).agg(F.sum(F.octet_length("name")).alias("bytes"))
    ends = boundary.groupBy(*by).agg(F.count("*").alias("ends"))
    out = nodes.join(edges, by, "left").join(texts, by, "left").join(ends, by, "left").fillna(0)
    return out.select(*by, (F.col("nodes") * 16 + F.col("edges") * 12 + F.col("ends") * 2 + F.col("bytes") + 64).alias("memory_bytes"))


def edges_for_node(asked: DataFrame, owned: DataFrame, tiled: DataFrame, crosses: bool) -> DataFrame:
    """Edges of ``tiled`` that start at each asked node (columns of ``asked``, among them node_id), within its tile or out of it; an equi-join on tile and index."""
    at = owned.select("node_id", F.col("tile_x").alias("src_tile_x"), F.col("tile_y").alias("src_tile_y"), F.col("local_idx").alias("src_idx"))
    return asked.join(at, "node_id").join(tiled.filter(F.col("crosses") == crosses), ["src_tile_x", "src_tile_y", "src_idx"])


def tile_summary(owned: DataFrame, tiled: DataFrame) -> DataFrame:
    """tile_x, tile_y, nodes, same_edges, cross_edges and boundary nodes of each tile of a level; a tile exists if a node of the level lies in it."""
    by = ["tile_x", "tile_y"]
    counts = tiled.groupBy(F.col("src_tile_x").alias("tile_x"), F.col("src_tile_y").alias("tile_y")).agg(F.count_if(~F.col("crosses")).alias("same_edges"), F.count_if("crosses").alias("cross_edges"))
    ends = boundary_nodes(tiled).groupBy(*by).agg(F.count("*").alias("boundary"))
    return owned.groupBy(*by).agg(F.count("*").alias("nodes")).join(counts, by, "left").join(ends, by, "left").fillna(0)
