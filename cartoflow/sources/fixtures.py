"""Map-like views over the synthetic tables; integer arithmetic gives every coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AMENITIES = ("fuel", "car_wash", "fast_food", "parking", "cafe", "bench")
PLACES = ("city", "town", "village", "hamlet", "island")
NATURALS = ("water", "wood", "grassland", "peak", "cliff")
LANDUSES = ("forest", "grass", "meadow", "reservoir", "industrial")
WATERWAYS = ("river", "stream", "canal", "riverbank", "ditch")
HIGHWAYS = ("motorway", "trunk_link", "primary", "secondary", "tertiary_link", "residential", "service", "unclassified", "footway")
SPEEDS = ("50", "50 km/h", "+50", " 50", "300", "none")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], key: Column) -> Column:
    """The value at ``key``; null past the end."""
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


def tag_map(**tags: Column) -> Column:
    """A map of the tags that are present."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in tags.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def degrees(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.col("lat_micro") / F.lit(1e6), "lon": F.col("lon_micro") / F.lit(1e6)})


def nodes_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lat_micro, lon_micro, lat, lon: 50 nodes a row, 0.001 degrees apart."""
    p = F.col("p_partkey")
    return degrees(table(spark, sf_dir, "part").select(p.alias("node_id"), (47_100_000 + F.expr("p_partkey div 50") * 1000).alias("lat_micro"), (8_400_000 + p % 50 * 1000).alias("lon_micro")))


def nodes_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return degrees(table(spark, sf_dir, "part").select(p.alias("node_id"), (46_800_000 + p * 7919 % 400_000).alias("lat_micro"), (8_200_000 + p * 104_729 % 500_000).alias("lon_micro")))


def edges_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of the grid, both directions."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    right = nodes.filter((F.col("p") + 1) % 50 != 0).select(F.col("p").alias("src"), (F.col("p") + 1).alias("dst"))
    down = nodes.select(F.col("p").alias("src"), (F.col("p") + 50).alias("dst"))
    one = right.unionByName(down).join(nodes.select(F.col("p").alias("dst")), "dst", "left_semi").select("src", "dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, lat_micro, lon_micro, lat, lon, heading."""
    c = F.col("c_custkey")
    return degrees(table(spark, sf_dir, "customer").select(c.alias("point_id"), (47_100_000 + c * 7919 % 40_000).alias("lat_micro"), (8_400_000 + c * 104_729 % 50_000).alias("lon_micro"), (c * 37 % 360).cast("double").alias("heading")))


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags."""
    k = F.col("o_orderkey")
    bare = k % 10 == 9
    other = F.expr("o_orderkey div 10")
    tags = tag_map(
        highway=F.when(~bare, pick(HIGHWAYS, k % 10)),
        oneway=F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "-1"),
        maxspeed=pick(SPEEDS, k % 7),
        name=F.when(k % 5 != 0, F.concat(F.lit("Street "), k % 23)),
        junction=F.when(k % 31 == 0, "roundabout"),
        waterway=F.when(bare, pick(WATERWAYS, other % 7)),
        natural=F.when(bare, pick(NATURALS, other % 11)),
        landuse=F.when(bare, pick(LANDUSES, other % 13)),
        leisure=F.when(bare & (other % 3 == 0), "park"),
        amenity=F.when(bare, pick(AMENITIES, other % 8)),
        shop=F.when(bare & (other % 9 == 0), "mall"),
        parking=F.when(bare & (other % 2 == 0), "underground"),
        bicycle=F.when(bare & (other % 4 == 0), "yes"),
    )
    return table(spark, sf_dir, "orders").select(k.alias("way_id"), tags.alias("tags"))


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, ref: the ordered nodes of each way, a row each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_partkey").alias("ref"))


def poi_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lat, lon, tags."""
    c = F.col("point_id")
    tags = tag_map(
        amenity=F.when(c % 2 == 0, pick(AMENITIES, c % 6)),
        shop=F.when(c % 6 == 1, "mall").when(c % 6 == 3, "bakery"),
        place=F.when(c % 10 == 5, pick(PLACES, F.expr("point_id div 10") % 5)),
        natural=F.when(c % 14 == 9, pick(NATURALS, F.expr("point_id div 14") % 5)),
        tourism=F.when(c % 22 == 7, "hotel"),
        railway=F.when(c % 26 == 11, "station").when(c % 26 == 13, "signal"),
        aeroway=F.when(c % 34 == 17, "aerodrome"),
        waterway=F.when(c % 38 == 19, "river"),
        highway=F.when(c % 46 == 21, "bus_stop"),
        parking=F.when(c % 4 == 0, "multi-storey"),
        bicycle=F.when(c % 8 == 0, "yes"),
        name=F.when(c % 3 != 0, F.concat(F.lit("Place "), c)),
    )
    return query_points(spark, sf_dir).select(F.col("point_id").alias("node_id"), "lat", "lon", tags.alias("tags"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id, area_type, points: a closed square around a grid centre, its first corner turned by the key."""
    s = F.col("s_suppkey")
    half = (1 + s % 5) * 3000
    lat, lon = 47_100_000 + s * 7919 % 40_000, 8_400_000 + s * 104_729 % 50_000
    corner = lambda dy, dx: F.struct(((lat + dy * half) / F.lit(1e6)).alias("lat"), ((lon + dx * half) / F.lit(1e6)).alias("lon"))
    ring = F.array(*(corner(dy, dx) for dy, dx in ((-1, -1), (-1, 1), (0, 2), (1, 1), (1, -1), (-1, -1))))
    return table(spark, sf_dir, "supplier").select(s.alias("area_id"), (s % 4).cast("int").alias("area_type"), ring.alias("points"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, name, lat, lon, category: part names, many of them repeated, and a few literal ones."""
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select((p + 100).alias("seq"), F.col("p_name").alias("name"), ((47_100_000 + p * 7919 % 40_000) / F.lit(1e6)).alias("lat"), ((8_400_000 + p * 104_729 % 50_000) / F.lit(1e6)).alias("lon"), (p % 5).cast("int").alias("category"))
    literal = spark.createDataFrame(LITERAL_PLACES, "seq long, name string, lat double, lon double, category int")
    return literal.unionByName(parts)


LITERAL_PLACES = [
    (1, "Zurich", 47.3769, 8.5417, 0),
    (2, "Zurich Airport", 47.4647, 8.5492, 3),
    (3, "Zug", 47.1724, 8.5172, 0),
    (4, "Bern", 46.9481, 7.4474, 0),
    (5, "Zürich", 47.3769, 8.5417, 0),
    (6, "St. Gallen", 47.4245, 9.3767, 0),
    (7, "  Hello  ", 47.0, 8.0, 255),
]


def gps_columns(events: DataFrame) -> DataFrame:
    """vehicle, ts, event_id, lat, lon, heading, accuracy_m of the events table or a stream of it."""
    e = F.col("event_id")
    accuracy = F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value"))
    return events.select(F.col("user_id").alias("vehicle"), F.col("ts").cast("timestamp").alias("ts"), "event_id", ((47_100_000 + e * 7919 % 40_000) / F.lit(1e6)).alias("lat"), ((8_400_000 + e * 104_729 % 50_000) / F.lit(1e6)).alias("lon"), (e * 37 % 360).cast("double").alias("heading"), accuracy.cast("double").alias("accuracy_m"))


def gps_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps_columns(table(spark, sf_dir, "events"))


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, src, dst: grid nodes, one request of every customer."""
    size, c = table(spark, sf_dir, "part").count(), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("req_id"), (c * 7919 % size).alias("src"), (c * 104_729 % size).alias("dst"))
