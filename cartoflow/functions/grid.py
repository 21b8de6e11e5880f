"""Tile keys, offsets inside tiles, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LOCAL, METERS_PER_DEGREE, OFFSET_SCALE, TILE_SIZE_DEG
from .geo import col


def tile_index(degrees, level: int = LOCAL) -> Column:
    """floor(degrees / size) in binary floating point, as the tile numbers are defined."""
    return F.floor(col(degrees) / F.lit(TILE_SIZE_DEG[level])).cast("int")


def tile_key(lat, lon, level: int = LOCAL) -> tuple[Column, Column]:
    """tile_x (longitude), tile_y (latitude)."""
    return tile_index(lon, level), tile_index(lat, level)


def tile_origin(tile_x, tile_y, level: int = LOCAL) -> tuple[Column, Column]:
    """Latitude and longitude of the lower left corner."""
    return col(tile_y) * F.lit(TILE_SIZE_DEG[level]), col(tile_x) * F.lit(TILE_SIZE_DEG[level])


def to_offset(degrees: Column, origin: Column) -> Column:
    """16-bit offset inside a Local tile, truncated and saturating."""
    raw = (degrees - origin) * OFFSET_SCALE / F.lit(TILE_SIZE_DEG[LOCAL])
    return F.least(F.greatest(raw, F.lit(-32768.0)), F.lit(32767.0)).cast("short")


def from_offset(offset: Column, origin: Column) -> Column:
    return origin + offset.cast("double") * F.lit(TILE_SIZE_DEG[LOCAL]) / OFFSET_SCALE


def span(low: Column, high: Column, level: int = LOCAL) -> Column:
    """Indices of all tiles from one coordinate to another, in either order."""
    a, b = tile_index(low, level), tile_index(high, level)
    return F.sequence(F.least(a, b), F.greatest(a, b))


def visible_tiles(df: DataFrame, lat: str, lon: str, radius: float, level: int = LOCAL) -> DataFrame:
    """A row for each tile within ``radius`` degrees of each point: tile_x, tile_y."""
    return df.withColumn("tile_x", F.explode(span(F.col(lon) - radius, F.col(lon) + radius, level))).withColumn("tile_y", F.explode(span(F.col(lat) - radius, F.col(lat) + radius, level)))


def neighbours(df: DataFrame, reach: int = 1) -> DataFrame:
    """A row for each of the tiles around (tile_x, tile_y), itself included; dy and dx tell which."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = df.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return around.withColumns({"tile_x": F.col("tile_x") + F.col("dx"), "tile_y": F.col("tile_y") + F.col("dy")})


def bbox_from_center(lat, lon, radius_m) -> tuple[Column, Column, Column, Column]:
    """min_lat, max_lat, min_lon, max_lon."""
    lat, lon, radius_m = col(lat), col(lon), col(radius_m)
    d_lat, d_lon = radius_m / METERS_PER_DEGREE, radius_m / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(lat)))
    return lat - d_lat, lat + d_lat, lon - d_lon, lon + d_lon


def bbox_expand(box: tuple[Column, Column, Column, Column], margin: float) -> tuple[Column, Column, Column, Column]:
    return box[0] - margin, box[1] + margin, box[2] - margin, box[3] + margin


def bbox_contains(box: tuple[Column, Column, Column, Column], lat, lon) -> Column:
    return col(lat).between(box[0], box[1]) & col(lon).between(box[2], box[3])


def prune_to_bbox(df: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float, level: int = LOCAL, cell: int = 10) -> DataFrame:
    """Rows whose tile_x and tile_y lie in the box; of a table partitioned by cells of ``cell`` x ``cell`` tiles only those partitions are read."""
    size = TILE_SIZE_DEG[level]
    index = lambda x: int((x / size) // 1)
    bounds = {"x": (index(min_lon), index(max_lon)), "y": (index(min_lat), index(max_lat))}
    for axis, (low, high) in bounds.items():
        df = df.filter(F.col(f"tile_{axis}").between(low, high))
        if f"cell_{axis}" in df.columns:
            df = df.filter(F.col(f"cell_{axis}").between(low // cell, high // cell))
    return df


def load_and_keep(visible: DataFrame, loaded: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and what, once each: "load" for visible tiles that are not loaded yet, "keep" for loaded ones that stay visible.

    Both sides meet in one grouping: tiles are many times what the planner counts for them, so that a join may send them to every task.
    """
    side = lambda df, seen: df.select(*by, F.lit(seen).alias("_seen"), F.lit(not seen).alias("_held"))
    both = side(visible, True).unionByName(side(loaded, False)).groupBy(*by).agg(F.max("_seen").alias("_seen"), F.max("_held").alias("_held"))
    return both.filter("_seen").select(*by, F.when(F.col("_held"), "keep").otherwise("load").alias("what"))
