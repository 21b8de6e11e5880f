"""DuckDB forms of the derived views and of recurring expressions, for the oracles."""

from __future__ import annotations

from ..constants import ROAD_CLASSES
from ..sources import fixtures as X


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pick(values, key: str) -> str:
    return f"[{quoted(values)}][({key}) + 1]"


DEG = "lat_micro / 1e6::double as lat, lon_micro / 1e6::double as lon"
_BARE = "o_orderkey % 10 = 9"
_OTHER = "(o_orderkey // 10)"
TAGS = ("highway", "oneway", "maxspeed", "name", "junction", "waterway", "nat", "landuse", "leisure", "amenity", "shop", "parking", "bicycle")

VIEWS = {
    "nodes_grid": f"select *, {DEG} from (select p_partkey as node_id, 47100000 + (p_partkey // 50) * 1000 as lat_micro, 8400000 + p_partkey % 50 * 1000 as lon_micro from part)",
    "nodes_scatter": f"select *, {DEG} from (select p_partkey as node_id, 46800000 + p_partkey * 7919 % 400000 as lat_micro, 8200000 + p_partkey * 104729 % 500000 as lon_micro from part)",
    "edges_grid": """select src, dst from (select p_partkey as src, p_partkey + 1 as dst from part where (p_partkey + 1) % 50 <> 0 union all select p_partkey, p_partkey + 50 from part) where dst in (select p_partkey from part)
        union all select dst, src from (select p_partkey as src, p_partkey + 1 as dst from part where (p_partkey + 1) % 50 <> 0 union all select p_partkey, p_partkey + 50 from part) where dst in (select p_partkey from part)""",
    "query_points": f"select *, {DEG}, (point_id * 37 % 360)::double as heading from (select c_custkey as point_id, 47100000 + c_custkey * 7919 % 40000 as lat_micro, 8400000 + c_custkey * 104729 % 50000 as lon_micro from customer)",
    "ways": f"""select o_orderkey as way_id, case when not ({_BARE}) then {pick(X.HIGHWAYS, "o_orderkey % 10")} end as highway,
        case when o_orderstatus = 'F' then 'yes' when o_orderstatus = 'P' then '-1' end as oneway, {pick(X.SPEEDS, "o_orderkey % 7")} as maxspeed,
        case when o_orderkey % 5 <> 0 then 'Street ' || (o_orderkey % 23) end as name, case when o_orderkey % 31 = 0 then 'roundabout' end as junction,
        case when {_BARE} then {pick(X.WATERWAYS, f"{_OTHER} % 7")} end as waterway, case when {_BARE} then {pick(X.NATURALS, f"{_OTHER} % 11")} end as nat,
        case when {_BARE} then {pick(X.LANDUSES, f"{_OTHER} % 13")} end as landuse, case when {_BARE} and {_OTHER} % 3 = 0 then 'park' end as leisure,
        case when {_BARE} then {pick(X.AMENITIES, f"{_OTHER} % 8")} end as amenity, case when {_BARE} and {_OTHER} % 9 = 0 then 'mall' end as shop,
        case when {_BARE} and {_OTHER} % 2 = 0 then 'underground' end as parking, case when {_BARE} and {_OTHER} % 4 = 0 then 'yes' end as bicycle from orders""",
    "refs": "select l_orderkey as way_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos, l_partkey as ref from lineitem",
    "poi_nodes": f"""select point_id as node_id, lat, lon, case when point_id % 2 = 0 then {pick(X.AMENITIES, "point_id % 6")} end as amenity,
        case when point_id % 6 = 1 then 'mall' when point_id % 6 = 3 then 'bakery' end as shop, case when point_id % 10 = 5 then {pick(X.PLACES, "(point_id // 10) % 5")} end as place,
        case when point_id % 14 = 9 then {pick(X.NATURALS, "(point_id // 14) % 5")} end as nat, case when point_id % 22 = 7 then 'hotel' end as tourism,
        case when point_id % 26 = 11 then 'station' when point_id % 26 = 13 then 'signal' end as railway, case when point_id % 34 = 17 then 'aerodrome' end as aeroway,
        case when point_id % 38 = 19 then 'river' end as waterway, case when point_id % 46 = 21 then 'bus_stop' end as highway, case when point_id % 4 = 0 then 'multi-storey' end as parking,
        case when point_id % 8 = 0 then 'yes' end as bicycle, case when point_id % 3 <> 0 then 'Place ' || point_id end as name from query_points""",
    "areas": """select area_id, area_type, list_transform([[-1, -1], [-1, 1], [0, 2], [1, 1], [1, -1], [-1, -1]], lambda d: struct_pack(lat := (la + d[1] * half) / 1e6::double, lon := (lo + d[2] * half) / 1e6::double)) as points
        from (select s_suppkey as area_id, (s_suppkey % 4)::int as area_type, (1 + s_suppkey % 5) * 3000 as half, 47100000 + s_suppkey * 7919 % 40000 as la, 8400000 + s_suppkey * 104729 % 50000 as lo from supplier)""",
    "places": "select seq::bigint as seq, name, lat::double as lat, lon::double as lon, category::int as category from (values " + ", ".join(str(p) for p in X.LITERAL_PLACES) + ") t(seq, name, lat, lon, category) union all select p_partkey + 100, p_name, (47100000 + p_partkey * 7919 % 40000) / 1e6::double, (8400000 + p_partkey * 104729 % 50000) / 1e6::double, (p_partkey % 5)::int from part",
    "gps": "select user_id as vehicle, ts, event_id, (47100000 + event_id * 7919 % 40000) / 1e6::double as lat, (8400000 + event_id * 104729 % 50000) / 1e6::double as lon, (event_id * 37 % 360)::double as heading, case when event_type = 'error' then -1.0 else value end::double as accuracy_m from events",
    "requests": "select c_custkey as req_id, c_custkey * 7919 % n as src, c_custkey * 104729 % n as dst from customer, (select count(*) as n from part) where c_custkey between 1 and 20",
}
_NEEDS = {"poi_nodes": ("query_points",)}


def with_views(names: str, body: str) -> str:
    """``body`` behind the views that it names; ``body`` may begin with further common tables, each "name as (...),"."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in (*_NEEDS.get(n, ()), n) if x not in wanted]
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n]})" for n in wanted) + (", " if not body.lstrip().lower().startswith("select") else " ") + body


def hav(lat1, lon1, lat2, lon2, r="6371000.0") -> str:
    return f"(2 * {r}::double) * asin(sqrt(least(1.0::double, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"


def tile(c: str, size: str = "0.01") -> str:
    return f"floor(({c}) / {size}::double)::int"


def offset(c: str, origin: str) -> str:
    return f"trunc(least(greatest((({c}) - ({origin})) * 3000 / 0.01::double, -32768), 32767))::smallint"


def by_class(highway: str, pick_: int) -> str:
    return "case " + " ".join(f"when {highway} in ({quoted(c[0])}) then {c[pick_]}" for c in ROAD_CLASSES) + " end"


def pmod(a: str, b: str) -> str:
    return f"((({a}) % {b}) + {b}) % {b}"
