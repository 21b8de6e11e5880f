"""Tag-driven classification: tags are a map column, results are codes or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def is_in(value: Column, values: tuple[str, ...]) -> Column:
    """False, not null, where the tag is absent."""
    return F.coalesce(value.isin(*values), F.lit(False))


def road_type(highway: Column) -> Column:
    """Render road type of a listed highway value; null otherwise."""
    return F.when(highway.isin(*C.RENDER_PRIMARY), C.ROAD_PRIMARY).when(highway.isin(*C.RENDER_SECONDARY), C.ROAD_SECONDARY)


def road_type_loose(highway: Column) -> Column:
    """As the GeoJSON and Overpass readers have it: whatever is not primary is secondary."""
    return F.when(is_in(highway, C.RENDER_PRIMARY), C.ROAD_PRIMARY).otherwise(C.ROAD_SECONDARY)


def _by_class(highway: Column, pick: int) -> Column:
    out = reduce(lambda w, c: w.when(highway.isin(*c[0]), F.lit(c[pick])), C.ROAD_CLASSES[1:], F.when(highway.isin(*C.ROAD_CLASSES[0][0]), F.lit(C.ROAD_CLASSES[0][pick])))
    return out


def road_class(highway: Column) -> Column:
    return _by_class(highway, 1)


def _of_class(code: Column, pick: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for c in C.ROAD_CLASSES for x in (c[1], c[pick]))), code)


def hierarchy_level(code: Column) -> Column:
    return _of_class(code, 2)


def default_speed(code: Column) -> Column:
    return _of_class(code, 3)


def tile_size_deg(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in C.TILE_SIZE_DEG.items() for x in (k, v))), level)


def tile_size_km(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in C.TILE_SIZE_KM.items() for x in (k, v))), level)


def is_oneway(tags: Column) -> Column:
    return is_in(tag(tags, "oneway"), ("yes", "1", "true")) | is_in(tag(tags, "highway"), ("motorway",)) | is_in(tag(tags, "junction"), ("roundabout",))


def speed_kmh(tags: Column) -> Column:
    """The tagged limit if it is a number of 0 to 255 (" km/h" aside), else the class default."""
    bare = F.regexp_replace(tag(tags, "maxspeed"), "( km/h)+$", "")
    number = F.when(F.rlike(bare, F.lit(r"^\+?[0-9]+$")), bare.try_cast("bigint"))
    return F.coalesce(F.when(number.between(0, 255), number.cast("int")), default_speed(road_class(tag(tags, "highway"))))


def waterway_type(tags: Column) -> Column:
    w = tag(tags, "waterway")
    return F.when(w == "river", C.WATER_RIVER).when(w == "stream", C.WATER_STREAM).when(w == "canal", C.WATER_CANAL)


def is_water(tags: Column) -> Column:
    return is_in(tag(tags, "natural"), ("water",)) | is_in(tag(tags, "waterway"), ("riverbank",)) | is_in(tag(tags, "landuse"), ("reservoir",)) | has(tags, "water")


def area_type(tags: Column) -> Column:
    """Water before forest before park before grass."""
    natural, landuse = tag(tags, "natural"), tag(tags, "landuse")
    return (
        F.when(is_water(tags), C.AREA_WATER)
        .when(is_in(natural, ("wood",)) | is_in(landuse, ("forest",)), C.AREA_FOREST)
        .when(is_in(tag(tags, "leisure"), ("park",)), C.AREA_PARK)
        .when(is_in(landuse, ("grass", "meadow")) | is_in(natural, ("grassland",)), C.AREA_GRASS)
    )


def poi_type(tags: Column) -> Column:
    amenity = tag(tags, "amenity")
    parking = (amenity == "parking") & ~has(tags, "bicycle") & is_in(tag(tags, "parking"), ("multi-storey", "underground"))
    by_amenity = F.when(amenity == "fuel", C.POI_GAS).when(amenity == "car_wash", C.POI_CAR_WASH).when(amenity == "fast_food", C.POI_FAST_FOOD).when(parking, C.POI_PARKING)
    return F.coalesce(by_amenity, F.when(tag(tags, "shop") == "mall", C.POI_MALL))


def is_render_way(tags: Column, in_water_relation: Column | None = None) -> Column:
    """Is the way of any use for rendering, so that its nodes are needed?"""
    wanted = road_type(tag(tags, "highway")).isNotNull() | poi_type(tags).isNotNull() | (tag(tags, "shop") == "mall") | area_type(tags).isNotNull() | waterway_type(tags).isNotNull()
    wanted = F.coalesce(wanted, F.lit(False))
    return wanted if in_water_relation is None else wanted | in_water_relation


def render_way(tags: Column, closed: Column) -> Column:
    """struct<kind, code>: a highway decides alone (an unlisted one drops the way); then waterway, area if closed, POI."""
    highway = tag(tags, "highway")
    pick = lambda kind, code: F.struct(F.lit(kind).alias("kind"), code.cast("int").alias("code"))
    road, water, area, poi = road_type(highway), waterway_type(tags), area_type(tags), poi_type(tags)
    return (
        F.when(highway.isNotNull(), F.when(road.isNotNull(), pick("road", road)))
        .when(water.isNotNull(), pick("waterway", water))
        .when(closed & area.isNotNull(), pick("area", area))
        .when(poi.isNotNull(), pick("poi", poi))
    )


def is_water_relation(tags: Column) -> Column:
    return is_in(tag(tags, "type"), ("multipolygon",)) & is_water(tags)


def place_category(tags: Column) -> Column:
    """place, then amenity and natural, decide alone when present; the other tags only when they match."""
    place, amenity, natural = tag(tags, "place"), tag(tags, "amenity"), tag(tags, "natural")
    transport = is_in(tag(tags, "aeroway"), ("aerodrome",)) | is_in(tag(tags, "railway"), ("station", "halt")) | is_in(tag(tags, "public_transport"), ("station",))
    return (
        F.when(place.isNotNull(), F.when(place.isin(*C.SETTLEMENT_PLACES), C.SETTLEMENT).otherwise(C.OTHER))
        .when(has(tags, "highway"), C.STREET)
        .when(amenity.isNotNull(), F.when(amenity.isin(*C.POI_AMENITIES), C.POI).otherwise(C.OTHER))
        .when(has(tags, "shop") | has(tags, "tourism"), C.POI)
        .when(transport, C.TRANSPORT)
        .when(natural.isNotNull(), F.when(natural.isin(*C.NATURAL_PLACES), C.NATURAL).otherwise(C.OTHER))
        .when(is_in(tag(tags, "waterway"), ("river", "stream")), C.NATURAL)
        .otherwise(C.OTHER)
    )


def gps_status(accuracy: Column) -> Column:
    """0 none, 1 poor, 2 good."""
    return F.when(accuracy < 0, 0).when(accuracy <= C.GOOD_ACCURACY_M, 2).when(accuracy <= C.POOR_ACCURACY_M, 1).otherwise(0)


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def category_label(category: Column, mobile: bool = False) -> Column:
    names = ("Settlement", "Street", "POI", "Transport", "Natural") if mobile else ("City/Town", "Street", "Point of Interest", "Transport", "Natural Feature")
    return reduce(lambda w, kv: w.when(category == kv[0], kv[1]), list(enumerate(names))[1:], F.when(category == 0, names[0])).otherwise("Place")


def distance_label(km: Column) -> Column:
    """Whole metres below 1 km, else kilometres with one decimal."""
    return F.when(km < 1, F.concat(F.round(km * 1000).cast("int"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", F.round(km, 1)), F.lit(" km")))


def road_stroke(code: Column) -> Column:
    return F.when(code == 0, 4).when(code == 1, 2).otherwise(6)


def waterway_stroke(code: Column) -> Column:
    return F.when(code == 0, 5).when(code == 1, 2).otherwise(4)


def travel_time_s(distance_cm: Column, speed: Column) -> Column:
    """Seconds; infinite at speed 0."""
    return F.when(speed > 0, distance_cm / F.lit(100000.0) / speed * 3600.0).otherwise(F.lit(float("inf")))


def edge_weight_cs(distance_cm: Column, speed: Column) -> Column:
    """Whole centiseconds, saturating at 32 bits."""
    return F.least(travel_time_s(distance_cm, speed) * 100.0, F.lit(float(C.WEIGHT_MAX))).cast("long")


def select_level(distance_m: Column) -> Column:
    return F.when(distance_m < C.LOCAL_LIMIT_M, C.LOCAL).when(distance_m < C.ARTERIAL_LIMIT_M, C.ARTERIAL).otherwise(C.HIGHWAY)


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), hits + misses), F.lit(0.0))


def normalize_name(name: Column) -> Column:
    """Letters, digits and spaces, lower-cased, trimmed; diacritics stay."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{IsAlphabetic}\p{N} ]", ""))
