"""Place search over normalised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FETCH, SHOWN
from ..functions import classify, geo
from ..plans.storage import written


def extract_places(nodes: DataFrame) -> DataFrame:
    """seq, name, lat, lon, category of nodes with a name."""
    name = classify.tag(F.col("tags"), "name")
    return nodes.filter(F.coalesce(name, F.lit("")) != "").select(F.col("node_id").alias("seq"), name.alias("name"), "lat", "lon", classify.place_category(F.col("tags")).alias("category"))


def index(places: DataFrame) -> DataFrame:
    """Places with norm, the name in the form that is searched."""
    return places.withColumn("norm", classify.normalize_name(F.col("name")))


def write_index(places: DataFrame, path: str) -> None:
    """Sorted by norm across files, so that a prefix reads few row groups."""
    index(places).repartitionByRange("norm").sortWithinPartitions("norm", "seq").write.mode("overwrite").parquet(path)


def layout(indexed: DataFrame) -> DataFrame:
    """Entries with entry_id, their number in norm order, and name_offset, the bytes of the names before.

    Numbers run over range partitions: each is numbered by itself, and what the
    ones before hold (a row a partition on the driver) is added.
    """
    ordered = indexed.repartitionByRange("norm", "seq").sortWithinPartitions("norm", "seq").withColumn("part", F.spark_partition_id())
    rows = written(ordered.withColumn("bytes", F.octet_length("name").cast("long")), "entries")
    entries, size, before = 0, 0, []
    for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).orderBy("part").collect():
        before.append((r["part"], entries, size))
        entries, size = entries + r["n"], size + r["b"]
    start = rows.sparkSession.createDataFrame(before, "part int, first_entry long, first_byte long")
    w = Window.partitionBy("part").orderBy("norm", "seq")
    own = rows.join(F.broadcast(start), "part").withColumn("entry_id", F.col("first_entry") + F.row_number().over(w) - 1)
    own = own.withColumn("name_offset", F.col("first_byte") + F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.drop("part", "bytes", "first_entry", "first_byte")


def prefix_search(indexed: DataFrame, query: str, limit: int = FETCH) -> DataFrame:
    """The first ``limit`` entries in norm order, then by score, the bytes that a norm has beyond the query."""
    q = normalized(query)
    found = indexed.filter((F.length(q) > 0) & F.col("norm").startswith(q)).orderBy("norm", "seq").limit(limit)
    return found.withColumn("score", F.octet_length("norm") - F.octet_length(q)).orderBy("score", "norm", "seq")


def exact_search(indexed: DataFrame, query: str) -> DataFrame:
    """The first entry of the very norm, score 0."""
    return indexed.filter(F.col("norm") == normalized(query)).orderBy("seq").limit(1).withColumn("score", F.lit(0))


def normalized(query: str) -> Column:
    """A query in the form of the index: the same expression, folded to a literal, so that it still reaches the scan."""
    return classify.normalize_name(F.lit(query))


def search_nearby(indexed: DataFrame, query: str, lat: float, lon: float, shown: int = SHOWN) -> DataFrame:
    """The prefix's entries by great-circle distance, km."""
    found = prefix_search(indexed, query).withColumn("km", geo.haversine_km("lat", "lon", lat, lon))
    return found.orderBy(F.round("km", 6), "score", "norm", "seq").limit(shown)


def search_nearby_mobile(indexed: DataFrame, query: str, lat: float, lon: float, shown: int = SHOWN) -> DataFrame:
    """The prefix's entries by squared degrees, with planar km."""
    d = F.pow(F.col("lat") - lat, 2.0) + F.pow(F.col("lon") - lon, 2.0)
    found = prefix_search(indexed, query).withColumn("d2", d).withColumn("km", geo.distance_km_mobile("lat", "lon", lat, lon))
    return found.orderBy(F.round("d2", 12), "score", "norm", "seq").limit(shown)
