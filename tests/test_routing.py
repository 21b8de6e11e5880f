"""Routes and streams against plain computations."""

import heapq

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartoflow.functions import grid
from cartoflow.operators import search, snap
from cartoflow.plans import batch, components, front_door, routing
from cartoflow.queries import ORACLES, QUERIES, graph_queries
from cartoflow.sources import fixtures as X
from cartoflow.sources import readers
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"


def dijkstra(edges, source):
    out, near = {}, {}
    for s, d, w in edges:
        near.setdefault(s, []).append((d, w))
    heap = [(0, source)]
    while heap:
        g, u = heapq.heappop(heap)
        if u not in out:
            out[u] = g
            for v, w in near.get(u, ()):
                heapq.heappush(heap, (g + w, v))
    return out


@pytest.fixture(scope="module")
def ladder(spark):
    """Two rows of six nodes, rungs between them, some of them slow, and a lone node."""
    places = {i: (46_500_000 + i // 6 * 2500, 9_300_000 + i % 6 * 4000) for i in range(12)} | {50: (46_900_000, 9_900_000)}
    nodes = spark.createDataFrame([(k, a, b, a / 1e6, b / 1e6) for k, (a, b) in places.items()], "node_id long, lat_micro int, lon_micro int, lat double, lon double")
    pairs = [(i, i + 1) for i in range(12) if i != 5 and i != 11] + [(i, i + 6) for i in range(6)]
    links = [(a, b, 10_000 + 700 * a, 900 + 137 * ((a * 5 + b) % 7)) for x, y in pairs for a, b in ((x, y), (y, x))]
    return nodes, spark.createDataFrame([(*e, None) for e in links], "src long, dst long, distance_cm long, weight_cs long, name string"), links


@pytest.mark.parametrize("broadcast", [1_000, 0])
def test_ladder_routes(spark, ladder, broadcast):
    nodes, edges, links = ladder
    asked = [(1, 0, 11), (2, 0, 1), (3, 4, 4), (4, 0, 50), (5, 9, 2)]
    found = {r.req_id: r for r in routing.point_to_point(spark.createDataFrame(asked, "req_id long, src long, dst long"), edges, nodes, broadcast_edges=broadcast).collect()}
    totals = {r.req_id: r for r in routing.path_totals(spark.createDataFrame(list(found.values()), routing.ROUTE), edges).collect()}
    for req, src, dst in asked:
        best = dijkstra([(a, b, w) for a, b, _, w in links], src).get(dst)
        assert found[req].cost_cs == best
        if best is not None:
            assert (found[req].path[0], found[req].path[-1], totals[req].weight_cs) == (src, dst, best)
            assert totals[req].distance_cm == sum(d for a, b, d, _ in links if (a, b) in set(zip(found[req].path, found[req].path[1:], strict=False)))
    assert (found[3].path, totals[3].distance_cm) == ([4], 0)


def test_bounds_are_told(spark, ladder):
    nodes, edges, _ = ladder
    with pytest.raises(RuntimeError, match="rounds"):
        routing.one_to_all(edges, 0, max_rounds=2)


def test_levels_on_a_path(spark):
    k = routing.LEVEL_KEY
    df = spark.createDataFrame([([2 * k + 1, k + 1, k + 2, 2 * k + 2],), ([5],)], "path array<long>")
    assert [r.levels_used for r in routing.levels_used(df).collect()] == [[1, 2], [0]]


def test_routing_tiles_of_the_first_version(spark, tmp_path):
    nodes = spark.createDataFrame([(2, 841, 4710, 1)], "level int, tile_x int, tile_y int, node_id long")
    edges = spark.createDataFrame([(2, 841, 4710, False, 1), (2, 841, 4710, True, 2)], "level int, src_tile_x int, src_tile_y int, crosses boolean, way_id long")
    readers.write_routing_tiles(nodes, edges, str(tmp_path / "r"))
    schema = "level int, src_tile_x int, src_tile_y int, crosses boolean, way_id long"
    assert [x.count() for x in readers.read_routing_tiles(spark, str(tmp_path / "r"), schema)] == [1, 1, 1]
    __import__("shutil").rmtree(tmp_path / "r" / "cross_edges")
    assert [x.count() for x in readers.read_routing_tiles(spark, str(tmp_path / "r"), schema)] == [1, 1, 0]


def test_boxes_prune_partitions(spark, tmp_path):
    t = spark.createDataFrame([(x, y, x * y) for x in range(8, 33) for y in range(8, 33)], "tile_x int, tile_y int, v int")
    readers.write_tiles(t, str(tmp_path / "t"))
    cut = grid.prune_to_bbox(spark.read.parquet(str(tmp_path / "t")), 0.115, 0.135, 0.215, 0.235)
    assert cut.count() == 9
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "cell_x" in plan.partition("PartitionFilters: [")[2].partition("]")[0]


def test_queries_are_normalised_like_the_index(spark):
    name = "\u092e\u0941\u0902\u092c\u0908 Stra\u00dfe-7"
    idx = search.index(spark.createDataFrame([(1, name, 0.0, 0.0, 0)], "seq long, name string, lat double, lon double, category int"))
    assert search.prefix_search(idx, name).count() == 1
    assert search.exact_search(idx, name).count() == 1
    assert search.prefix_search(idx, " -").count() == 0


def test_large_graphs_leave_the_corridor_where_that_is_cheaper(spark):
    places = {0: (47.0, 8.0), 1: (47.0, 8.01), 2: (47.0, 8.02), 3: (47.9, 8.0), 4: (47.9, 8.02), 5: (47.001, 8.0), 6: (46.0, 8.0), 7: (46.0, 9.0), 8: (46.0, 8.01)}
    nodes = spark.createDataFrame([(k, *v) for k, v in places.items()], "node_id long, lat double, lon double")
    links = [(0, 1, 900_000), (1, 2, 900_000), (0, 3, 300_000), (3, 4, 10_000), (4, 2, 300_000), (0, 5, 100), (6, 7, 200_000), (7, 8, 200_000), (1, 0, 900_000), (2, 5, 2_000_000)]
    edges = spark.createDataFrame([(a, b, 1, w) for a, b, w in links], "src long, dst long, distance_cm long, weight_cs long")
    # around a slow street, a close end that is proven at once, a way that only exists outside, no way, an end without a place
    asked = spark.createDataFrame([(1, 0, 2), (2, 0, 5), (3, 6, 8), (4, 5, 0), (5, 0, 99), (6, 0, 0)], "req_id long, src long, dst long")
    whole, cut = ({r.req_id: (list(r.path), r.cost_cs) for r in routing.point_to_point(asked, edges, nodes, broadcast_edges=n).collect()} for n in (1_000, 0))
    assert whole == cut
    assert cut[1] == ([0, 3, 4, 2], 610_000) and cut[3] == ([6, 7, 8], 400_000) and cut[4] == ([], None)


def test_corridors_cost_what_the_whole_graph_does(spark):
    edges = graph_queries.scatter_edges(spark, SF).withColumn("distance_cm", F.col("weight_cs"))
    asked = X.route_requests(spark, SF).filter("req_id < 12")
    whole, cut = ({r.req_id: r.cost_cs for r in routing.point_to_point(asked, edges, X.nodes_scatter(spark, SF), broadcast_edges=n).collect()} for n in (1_000_000, 0))
    assert whole == cut


def test_nearest_against_all_nodes(spark):
    """Near, far and no nodes around a point, ties to the smaller id."""
    rng = __import__("random").Random(4)
    nodes = [(i, 47_000_000 + rng.randrange(40_000), 8_000_000 + rng.randrange(40_000)) for i in range(60)]
    nodes += [(100 + i, *nodes[i][1:]) for i in range(5)]
    points = [(i, 47_000_000 + rng.randrange(-20_000, 60_000), 8_000_000 + rng.randrange(-20_000, 60_000)) for i in range(150)]
    schema = "node_id long, lat_micro int, lon_micro int"
    got = {r.point_id: r.node_id for r in snap.snap_nearest(spark.createDataFrame(points, schema.replace("node", "point")), spark.createDataFrame(nodes, schema)).collect()}
    from math import asin, cos, floor, radians, sin, sqrt

    def far(a, b):
        (la, lo), (lb, mo) = ((radians(x / 1e6) for x in p) for p in (a, b))
        return round(2 * 6_371_000.0 * asin(sqrt(sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin((mo - lo) / 2) ** 2)), 6)

    expected = {}
    for p, *at in points:
        cell = [floor(x / 1e6 / 0.01) for x in at]
        near = [(far(at, (a, b)), n) for n, a, b in nodes if abs(floor(a / 1e6 / 0.01) - cell[0]) <= 1 and abs(floor(b / 1e6 / 0.01) - cell[1]) <= 1]
        if near:
            expected[p] = min(near)[1]
    assert got == expected


def test_relaxation_is_optimal(spark):
    edges = graph_queries.scatter_edges(spark, SF)
    source = edges.first().src
    expected = dijkstra([(r.src, r.dst, r.weight_cs) for r in edges.collect()], source)
    assert {r.node_id: r.cost for r in routing.one_to_all(edges, source).collect()} == expected


def test_route_paths_cost_what_they_say(spark):
    edges = {(r.src, r.dst): r.weight_cs for r in graph_queries.grid_edges(spark, SF).collect()}
    plain = [(s, d, w) for (s, d), w in edges.items()]
    for r in QUERIES["route_paths"](spark, SF).collect():
        assert sum(edges[p] for p in zip(r.path, r.path[1:], strict=False)) == r.cost_cs
        assert dijkstra(plain, r.src)[r.dst] == r.cost_cs


def test_hierarchical_routes_take_the_first_level_that_works(spark):
    for r in QUERIES["hierarchical_routes"](spark, SF).collect():
        assert r.level in (0, 1, 2)
        assert len(r.path) >= 1


@pytest.mark.parametrize("name", ["route_paths", "route_segments"])
def test_every_customer_is_routed(spark, name):
    size = X.table(spark, SF, "part").count()
    asked = {r.c_custkey for r in X.table(spark, SF, "customer").collect()}
    still = {c for c in asked if c * 7919 % size == c * 104_729 % size} if name == "route_segments" else set()
    assert {r.req_id for r in QUERIES[name](spark, SF).select("req_id").distinct().collect()} == asked - still


def test_hierarchical_routes_go_beyond_the_first_customers(spark):
    found = [r.req_id for r in QUERIES["hierarchical_routes"](spark, SF).select("req_id").collect()]
    assert len(found) == len(set(found)) and max(found) > 20


def test_connectors_of_every_customer(spark):
    sf = SF.replace("0.001", "0.01")
    agree(spark, connect(sf), QUERIES["hier_connectors"], ORACLES["hier_connectors"], sf)


def test_tiles_survive_writing(spark, tmp_path):
    t = spark.createDataFrame([(x, y, x * y) for x in range(8, 13) for y in range(8, 13)], "tile_x int, tile_y int, v int")
    readers.write_tiles(t, str(tmp_path / "t"))
    got = readers.read_tiles(spark, str(tmp_path / "t"), [(9, 9), (10, 12)])
    assert sorted((r.tile_x, r.tile_y, r.v) for r in got.collect()) == [(9, 9, 81), (10, 12, 120)]
    assert readers.read_tiles(spark, str(tmp_path / "t")).count() == 25


def test_broken_geojson_fails(spark):
    for doc in ('{"type": "FeatureCollection"}', '{"features": [{"geometry": null}]}', '{"features": [{"geometry": {"type": "LineString", "coordinates": [[1, 2, 3], [4, 5, 6]]}}]}'):
        with pytest.raises(Exception):  # noqa: B017, PT011
            readers.geojson_roads(spark.createDataFrame([(doc,)], "doc string")).collect()


def test_fixture_points(spark):
    assert X.areas(spark, SF).filter("size(points) = 6").count() == 10


def test_routes_of_one_tile(spark, monkeypatch):
    """Only edges within the end's tile; many requests of a tile in several groups; the start moved there or the request left out."""
    monkeypatch.setattr(front_door, "REQUESTS_A_TASK", 2)
    micro = {1: (46_501_000, 9_301_000), 2: (46_501_000, 9_305_000), 3: (46_505_000, 9_309_000), 4: (46_505_000, 9_311_000), 5: (46_509_000, 9_301_000)}
    nodes = spark.createDataFrame([(k, *v) for k, v in micro.items()], "node_id long, lat_micro int, lon_micro int")
    links = [(1, 2, 100), (2, 3, 100), (1, 4, 1), (4, 3, 1), (3, 1, 70)]
    edges = spark.createDataFrame([(a, b, w, w) for a, b, w in links], "src long, dst long, weight_cs long, distance_cm long")
    place = lambda n: tuple(x / 1e6 for x in micro[n])
    asked = [(i, *place(1), *place(3)) for i in range(9)] + [(20, *place(4), *place(3)), (21, *place(1), *place(5)), (22, *place(1), 40.0, 9.0)]
    asked = spark.createDataFrame(asked, "req_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    exact, moved = ({r.req_id: (r.path, r.cost_cs) for r in front_door.single_tile_routes(asked, nodes, edges, m).collect()} for m in ("exact", "end_tile"))
    assert exact == {i: ([1, 2, 3], 200) for i in range(9)}
    assert moved == exact | {20: ([3], 0)}
    with pytest.raises(ValueError, match="mode"):
        front_door.single_tile_routes(asked, nodes, edges, "other")


def test_front_door_paths_are_what_they_cost(spark):
    k = routing.LEVEL_KEY
    whole = {}
    for r in graph_queries.multi_level_graph(spark, SF).collect():
        whole[r.src, r.dst] = min(whole.get((r.src, r.dst), 1 << 60), r.weight_cs)
    routes = graph_queries.front_door_routes(spark, SF, "end_tile")
    for r in routes.collect():
        steps = list(zip(r.path, r.path[1:], strict=False))
        if r.how in ("arterial", "highway"):
            level = {"arterial": 1, "highway": 0}[r.how]
            assert r.path[0] // k == 2 and {x // k for x in r.path[1:-1]} <= {level}
            steps = [s for s in steps if {x // k for x in s} == {level}]
        assert sum(whole[s] for s in steps) == r.cost_cs == round(r.time_s * 100)
    parts = front_door.door_segments(routes, graph_queries.level_graphs(spark, SF)[2][1].withColumn("name", F.lit("n")))
    assert {r.instruction for r in parts.filter("name is null").collect()} <= {"Start"}


def test_shared_searches_cost_what_dijkstra_says(spark, monkeypatch):
    """Separators of small regions, one-way and free edges, an island, ends that are no node, equal ends, one request twice."""
    monkeypatch.setattr(batch, "LEAST_REGION", 12)
    rng = __import__("random").Random(7)
    at = lambda i: (47.0 + i // 5 / 1000, 8.0 + i % 5 / 1000)
    pairs = [(i, i + 1) for i in range(200) if i % 5 != 4] + [(i, i + 5) for i in range(195)] + [(300, 301)]
    links = [(a, b, rng.choice((0, 0, 3, 7, 40))) for x, y in pairs for a, b in ((x, y), (y, x)) if rng.random() < 0.9]
    nodes = spark.createDataFrame([(i, *at(i)) for i in (*range(200), 300, 301)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(a, b, 1, w) for a, b, w in links], "src long, dst long, distance_cm long, weight_cs long")
    asked = [(i, rng.randrange(200), rng.randrange(200)) for i in range(400)] + [(500, 3, 301), (501, 999, 3), (502, 999, 999), (503, 3, None), (7, 0, 199), (7, 0, 199)]
    found = routing.point_to_point(spark.createDataFrame(asked, "req_id long, src long, dst long"), edges, nodes).collect()
    assert sorted((r.req_id, r.src, r.dst or -1) for r in found) == sorted((i, a, b or -1) for i, a, b in asked)
    least = {}
    for a, b, w in links:
        least[a, b] = min(least.get((a, b), w), w)
    costs = {s: dijkstra(links, s) for s in {a for _, a, _ in asked}}
    for r in found:
        assert r.cost_cs == costs[r.src].get(r.dst)
        if r.cost_cs is None:
            assert r.path == []
        else:
            assert (r.path[0], r.path[-1]) == (r.src, r.dst) and len(set(r.path)) <= len(r.path)
            assert sum(least[p] for p in zip(r.path, r.path[1:], strict=False)) == r.cost_cs


def test_shared_searches_are_few(spark, monkeypatch):
    """One search for all requests of a start: the number of nodes that each search alone would settle is not paid again."""
    calls = []
    spread = batch.spread
    monkeypatch.setattr(batch, "spread", lambda *a, **k: calls.append(1) or spread(*a, **k))
    plan = batch.Plan(np.arange(50), batch.Links(np.arange(49), np.arange(1, 50), np.ones(49, np.int64), 50), None, np.ones(50, np.int64), {}, True, 1)
    rows = np.arange(1, 50)
    table = pa.table({"req_id": rows, "region": np.ones(49, np.int64), "via": np.zeros(49, np.int64), "s": np.zeros(49, np.int64), "d": rows})
    out = pa.Table.from_batches(list(batch._paths(plan, table)))
    assert len(calls) == 1 and out.column("cost_cs").to_pylist() == list(range(1, 50)) and out.column("path").to_pylist()[-1] == list(range(50))


def test_graphs_of_a_few_million_edges_need_no_corridors():
    """Six copies of the multi-level graph at sf0.1 are about 4.5 million edges; arrays of that many are about 54 MB."""
    assert routing.BROADCAST_EDGES >= 5_000_000
    links = batch.Links(np.zeros(10, np.int64), np.zeros(10, np.int64), np.ones(10, np.int64), 1)
    assert links.to.itemsize + links.weight.itemsize <= 12


def test_places_are_asked_once(spark, monkeypatch):
    """Many points at one place: one of them meets the nodes, and each gets its row."""
    sizes, nearest = [], snap._nearest
    monkeypatch.setattr(snap, "_nearest", lambda points, *a: sizes.append(points.count()) or nearest(points, *a))
    points = spark.createDataFrame([(i, 47_000_100, 8_000_100) for i in range(50)] + [(99, -33_000_000, -70_000_000)], "point_id long, lat_micro int, lon_micro int")
    nodes = spark.createDataFrame([(4, 47_000_000, 8_000_000), (5, -33_000_001, -70_000_001)], "node_id long, lat_micro int, lon_micro int")
    found = {r.point_id: r.node_id for r in snap.snap_nearest(points, nodes).collect()}
    assert found == dict.fromkeys(range(50), 4) | {99: 5} and sizes[0] == 2


def test_steps_are_not_dealt_anew_and_classes_are_joined_before_tiles(spark):
    """No window over the steps of paths; a way's class comes along with its segments."""
    routes = spark.createDataFrame([(1, [1, 2, 3])], "req_id long, path array<long>")
    edges = spark.createDataFrame([(1, 2, 5, 100, "a"), (2, 3, 5, 200, None)], "src long, dst long, weight_cs long, distance_cm long, name string")
    segs = routing.route_segments(routes, edges)
    assert "Window" not in segs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.step, r.name, r.instruction, r.distance_m) for r in segs.collect()) == [(0, "a", "Start", 1.0), (1, None, "Arrive", 2.0)]
    plan = QUERIES["road_tiles_clipped"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]


def _counted(monkeypatch):
    asked, solve = [], routing.point_to_point
    monkeypatch.setattr(routing, "point_to_point", lambda requests, *a: asked.append(requests.count()) or solve(requests, *a))
    return asked


def _placed(spark, *nodes):
    return spark.createDataFrame([(i, y, x, y / 1e6, x / 1e6) for i, y, x in nodes], "node_id long, lat_micro int, lon_micro int, lat double, lon double")


LINKS = "src long, dst long, weight_cs long, distance_cm long"
ASKED = "req_id long, lat1 double, lon1 double, lat2 double, lon2 double"


def test_requests_with_the_same_ends_are_searched_once(spark, monkeypatch):
    asked, k = _counted(monkeypatch), 2 * routing.LEVEL_KEY
    nodes = _placed(spark, (1, 46_501_000, 9_301_000), (2, 46_501_000, 9_305_000))
    requests = spark.createDataFrame([(i, 46.501, 9.301, 46.501, 9.305) for i in range(6)], ASKED)
    found = front_door.local_routes(requests, nodes, spark.createDataFrame([(k + 1, k + 2, 7, 9)], LINKS), nodes.withColumn("node_id", F.col("node_id") + k)).collect()
    assert sorted(map(tuple, found)) == [(i, [k + 1, k + 2], 9, 7) for i in range(6)] and asked == [1]


def test_levels_are_asked_for_what_is_open(spark, monkeypatch):
    asked = _counted(monkeypatch)
    nodes = _placed(spark, (1, 46_501_000, 9_301_000), (2, 46_501_000, 9_305_000), (3, 46_505_000, 9_301_000))
    links = lambda *rows: spark.createDataFrame(rows, LINKS)
    graphs = {0: (nodes, links((1, 2, 1, 1))), 1: (nodes, links((1, 2, 1, 1), (1, 3, 2, 2))), 2: (nodes, links((1, 2, 5, 5)))}
    requests = spark.createDataFrame([(1, 46.501, 9.301, 46.501, 9.305), (2, 46.501, 9.301, 46.505, 9.301)], ASKED)
    found = routing.find_routes(requests, graphs).collect()
    assert sorted(map(tuple, found)) == [(1, 2, [1, 2], 5), (2, 1, [1, 3], 2)] and asked == [2, 1, 0]


def test_only_components_of_requests_are_searched(spark, monkeypatch):
    """Of a large graph the parts that no request can use are neither gathered nor searched; costs stay those of the whole graph."""
    rng = np.random.default_rng(11)
    links = [(100 * part + int(a), 100 * part + int(b), int(w)) for part in range(5) for a, b, w in zip(*rng.integers(0, 40, (2, 90)), rng.integers(0, 50, 90), strict=True)]
    edges = spark.createDataFrame([(a, b, w, w) for a, b, w in links], LINKS)
    nodes = _placed(spark, *((100 * part + i, 46_500_000 + 1000 * i, 9_300_000 + 1000 * part) for part in range(5) for i in range(40)))
    asked = [(i, 100 * int(part) + int(a), 100 * int(part if i % 3 else 4 - part) + int(b)) for i, (part, a, b) in enumerate(zip(rng.integers(0, 2, 60), *rng.integers(0, 40, (2, 60)), strict=True))]
    requests = spark.createDataFrame(asked, "req_id long, src long, dst long")
    seen, solve = [], batch.solve
    monkeypatch.setattr(batch, "solve", lambda r, best, n: seen.extend({x.src // 100 for x in best.collect()}) or solve(r, best, n))
    monkeypatch.setattr(routing, "WHOLE_EDGES", 10)
    monkeypatch.setattr(components, "HELD_EDGES", 16)
    found = {r.req_id: r.cost_cs for r in routing.point_to_point(requests, edges, nodes).collect()}
    assert found == {i: dijkstra(links, a).get(b) for i, a, b in asked} and seen and set(seen) == {0, 1}


def test_level_edges_are_written_with_what_routes_need(spark):
    """The names and classes of ways do not lie on disk for every edge."""
    edges, held = graph_queries.weighted_edges(spark, SF)
    assert edges.columns == ["src", "dst", "weight_cs", "distance_cm", "level"] and set(held.columns) >= {"level", "node_id", "lat_micro", "lon_micro"}


def test_levels_search_only_components_of_requests(spark, monkeypatch):
    """Each level of find_routes is cut to the components of what is open on it."""
    monkeypatch.setattr(routing, "WHOLE_EDGES", 1)
    seen, cheapest = [], routing.cheapest_edges
    monkeypatch.setattr(routing, "cheapest_edges", lambda edges: seen.append(sorted((r.src, r.dst) for r in edges.collect())) or cheapest(edges))
    nodes = _placed(spark, (1, 46_501_000, 9_301_000), (2, 46_501_000, 9_305_000), (3, 46_701_000, 9_701_000), (4, 46_701_000, 9_705_000))
    graph = spark.createDataFrame([(1, 2, 1, 1), (3, 4, 1, 1), (4, 3, 1, 1)], LINKS)
    found = routing.find_routes(spark.createDataFrame([(1, 46.501, 9.301, 46.501, 9.305)], ASKED), {2: (nodes, graph), 1: (nodes, graph), 0: (nodes, graph)}).collect()
    assert [tuple(r) for r in found] == [(1, 2, [1, 2], 1)] and seen == [[(1, 2)], [], []]
