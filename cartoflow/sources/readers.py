"""GeoJSON and Overpass documents, tile indices and the sample grid as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, geometry

GEOJSON = "struct<type:string,features:array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
OVERPASS = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>>"
POINTS = "array<struct<lat:double,lon:double>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows of one column, doc."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def _points(coordinates: Column) -> Column:
    """[lon, lat] pairs as points; a position of another length fails the load."""
    pair = lambda c: F.when(F.size(c) == 2, F.struct(c[1].alias("lat"), c[0].alias("lon"))).otherwise(F.raise_error(F.lit("a position has two numbers")))
    return F.transform(coordinates, pair)


def geojson_roads(docs: DataFrame, column: str = "doc") -> DataFrame:
    """doc_no, feature_no, line_no, name, road_type, points.

    A LineString is a road, a MultiLineString one for each line; lines of fewer
    than two points and other geometries are passed over; a document that is not
    a feature collection, or a feature without geometry, fails the load.
    """
    parsed = docs.select(F.monotonically_increasing_id().alias("doc_no"), F.from_json(column, GEOJSON, {"mode": "FAILFAST"}).alias("g"))
    whole = F.when(F.col("g.features").isNull(), F.raise_error(F.lit("not a feature collection"))).otherwise(F.col("g.features"))
    each = parsed.select("doc_no", F.posexplode(whole).alias("feature_no", "f"))
    geometry_of = F.when(F.col("f.geometry").isNull(), F.raise_error(F.lit("a feature without geometry"))).otherwise(F.col("f.geometry"))
    each = each.select("doc_no", "feature_no", geometry_of.alias("geo"), F.col("f.properties").alias("properties"))
    line = F.from_json(F.col("geo.coordinates"), "array<array<double>>", {"mode": "FAILFAST"})
    many = F.from_json(F.col("geo.coordinates"), "array<array<array<double>>>", {"mode": "FAILFAST"})
    lines = F.when(F.col("geo.type") == "LineString", F.array(line)).when(F.col("geo.type") == "MultiLineString", many)
    roads = each.withColumn("lines", lines).select("doc_no", "feature_no", "properties", F.posexplode("lines").alias("line_no", "coordinates")).filter(F.size("coordinates") >= 2)
    return roads.select("doc_no", "feature_no", "line_no", F.try_element_at("properties", F.lit("name")).alias("name"), classify.road_type_loose(F.try_element_at("properties", F.lit("highway"))).alias("road_type"), _points(F.col("coordinates")).alias("points"))


def overpass_features(docs: DataFrame, column: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(roads, pois) of saved Overpass answers.

    A way tagged fuel or parking is a POI at the mean of its nodes; any other
    way with two resolvable nodes or more is a road; a node tagged fuel is a POI.
    """
    parsed = docs.select(F.monotonically_increasing_id().alias("doc_no"), F.from_json(column, OVERPASS, {"mode": "FAILFAST"}).alias("g"))
    each = parsed.select("doc_no", F.explode("g.elements").alias("e")).select("doc_no", "e.*")
    nodes = each.filter("type = 'node'").select("doc_no", F.col("id").alias("ref"), "lat", "lon")
    ways = each.filter("type = 'way'").select("doc_no", "id", "tags", "nodes")
    tags = F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    placed = ways.select("doc_no", "id", F.posexplode("nodes").alias("pos", "ref")).join(nodes, ["doc_no", "ref"]).groupBy("doc_no", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p"))
    placed = placed.select("doc_no", "id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    shaped = ways.select("doc_no", "id", tags.alias("tags")).join(placed, ["doc_no", "id"])
    amenity = classify.tag(F.col("tags"), "amenity")
    is_poi = classify.is_in(amenity, ("fuel", "parking"))
    kind = F.when(amenity == "fuel", C.POI_GAS).otherwise(C.POI_PARKING)
    roads = shaped.filter(~is_poi & (F.size("points") >= 2)).select("doc_no", "id", classify.tag(F.col("tags"), "name").alias("name"), classify.road_type_loose(classify.tag(F.col("tags"), "highway")).alias("road_type"), "points")
    center = geometry.centroid(F.col("points"))
    way_pois = shaped.filter(is_poi).select("doc_no", "id", classify.tag(F.col("tags"), "name").alias("name"), center["lat"].alias("lat"), center["lon"].alias("lon"), kind.alias("poi_type"))
    node_pois = each.filter("type = 'node'").withColumn("tags", tags).filter(classify.is_in(amenity, ("fuel",))).select("doc_no", "id", classify.tag(F.col("tags"), "name").alias("name"), "lat", "lon", F.lit(C.POI_GAS).alias("poi_type"))
    return roads, way_pois.unionByName(node_pois)


def sample_grid(spark: SparkSession, lat: float = 47.3769, lon: float = 8.5417, spacing: float = 0.001, reach: int = 10) -> DataFrame:
    """name, road_type, points: a grid of roads around a place and one diagonal."""
    i, far = F.col("id"), reach * spacing
    step = i.cast("double") * spacing
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    kind = F.when(i == 0, C.ROAD_PRIMARY).otherwise(C.ROAD_SECONDARY)
    steps = spark.range(-reach, reach + 1)
    south, north, west, east = F.lit(lat - far), F.lit(lat + far), F.lit(lon - far), F.lit(lon + far)
    across = steps.select(F.concat(F.lit("Horizontal "), i).alias("name"), kind.alias("road_type"), F.array(point(lat + step, west), point(lat + step, east)).alias("points"))
    along = steps.select(F.concat(F.lit("Vertical "), i).alias("name"), kind.alias("road_type"), F.array(point(south, lon + step), point(north, lon + step)).alias("points"))
    diagonal = spark.range(1).select(F.lit("Main Highway").alias("name"), F.lit(C.ROAD_HIGHLIGHT).alias("road_type"), F.array(point(south, west), point(north, east)).alias("points"))
    return across.unionByName(along).unionByName(diagonal)


def parse_tile_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """tile_x, tile_y of "x,y" lines; spaces are tolerated, blank, comment and malformed lines passed over."""
    field = lambda n: F.regexp_extract(F.col(column), r"^\s*(-?\d+)\s*,\s*(-?\d+)\s*$", n).try_cast("int")
    return lines.select(field(1).alias("tile_x"), field(2).alias("tile_y")).filter("tile_x is not null and tile_y is not null")


def parse_tile_names(names: DataFrame, column: str = "name") -> DataFrame:
    """tile_x, tile_y of file names tile_X_Y.bin."""
    field = lambda n: F.regexp_extract(F.col(column), r"^tile_(-?\d+)_(-?\d+)\.bin$", n).try_cast("int")
    return names.select(field(1).alias("tile_x"), field(2).alias("tile_y")).filter("tile_x is not null and tile_y is not null")


def write_tiles(df: DataFrame, path: str, cell: int = 10, keys: tuple[str, ...] = ("tile_x", "tile_y")) -> None:
    """Tiles as Parquet, partitioned by cells of ``cell`` x ``cell`` tiles and sorted by tile within a file."""
    cells = {"cell_x": F.floor(F.col(keys[0]) / cell).cast("int"), "cell_y": F.floor(F.col(keys[1]) / cell).cast("int")}
    df.withColumns(cells).repartition("cell_x", "cell_y").sortWithinPartitions("cell_x", "cell_y", *keys).write.mode("overwrite").partitionBy("cell_x", "cell_y").parquet(path)


def read_tiles(spark: SparkSession, path: str, tiles: list[tuple[int, int]] | None = None, cell: int = 10) -> DataFrame:
    """Tiles of a written table; with ``tiles``, those alone, partitions pruned by cell."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if tiles is None:
        return df
    cells = sorted({(x // cell, y // cell) for x, y in tiles})
    wanted = F.struct("cell_x", "cell_y").isin([F.struct(F.lit(x), F.lit(y)) for x, y in cells]) if cells else F.lit(False)
    return df.filter(F.col("cell_x").isin(*{x for x, _ in cells}) & F.col("cell_y").isin(*{y for _, y in cells}) & wanted & F.struct("tile_x", "tile_y").isin([F.struct(F.lit(x), F.lit(y)) for x, y in tiles]))


#: Landed map extracts: nodes, ways and relations as Parquet or JSON lines.
NODE = "id long, lat double, lon double, tags map<string,string>"
WAY = "id long, refs array<long>, tags map<string,string>"
RELATION = "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"


def read_landed(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Nodes, ways or relations (NODE, WAY, RELATION) of a landed extract; ``kind``: parquet or json; missing columns are null."""
    return spark.read.schema(schema).format(kind).load(path)


def landed_ways(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """way_id and tags, and way_id, pos, ref: the two tables that the ETL takes."""
    return ways.select(F.col("id").alias("way_id"), "tags"), ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "ref"))


def write_routing_tiles(nodes: DataFrame, edges: DataFrame, path: str, cell: int = 10) -> None:
    """Nodes (level, tile_x, tile_y, ...), edges within tiles and edges across (level, src_tile_x, src_tile_y, crosses, ...), by level and cell."""
    tables = {"nodes": (nodes, ("tile_x", "tile_y")), "edges": (edges.filter(~F.col("crosses")), ("src_tile_x", "src_tile_y")), "cross_edges": (edges.filter("crosses"), ("src_tile_x", "src_tile_y"))}
    for name, (df, keys) in tables.items():
        cells = {"cell_x": F.floor(F.col(keys[0]) / cell).cast("int"), "cell_y": F.floor(F.col(keys[1]) / cell).cast("int")}
        by = ["level", "cell_x", "cell_y"]
        df.withColumns(cells).repartition(*by).sortWithinPartitions(*by, *keys).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def read_routing_tiles(spark: SparkSession, path: str, edge_schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges within tiles, edges across; tables of the first version, without edges across, give none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/cross_edges")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    cross = spark.read.parquet(f"{path}/cross_edges") if there else spark.createDataFrame([], edge_schema)
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), cross
