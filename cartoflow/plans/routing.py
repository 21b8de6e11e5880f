"""Routes: level choice, one-to-all costs by relaxation, point-to-point search inside tasks, path totals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, geo
from ..operators.snap import snap_nearest
from . import batch, components
from .storage import written

#: Edges of a graph that is sent to every task, as arrays of 12 bytes an edge and direction; a larger one is cut to a corridor for each request first.
BROADCAST_EDGES = 6_000_000
#: Edges, parallel ones included, of which all are used; of more only the components that requests can use.
WHOLE_EDGES = 1_000_000
#: Edges with their names that are sent to the steps of paths, not the other way.
SENT_EDGES = 1_000_000
#: Degrees by which a request's corridor is wider than the box of its ends.
CORRIDOR_DEG = 0.05


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """src, dst, weight_cs, distance_cm of the cheapest of parallel edges, the first of equals."""
    best = F.min(F.struct("weight_cs", "distance_cm"))
    return edges.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", "b.weight_cs", "b.distance_cm")


def one_to_all(edges: DataFrame, source: int, max_rounds: int = 100_000) -> DataFrame:
    """node_id, cost: least cost from ``source`` by frontier relaxation.

    A round joins only the nodes that have just become cheaper with the edges;
    best costs so far are a written table, which cuts the lineage.
    """
    edges = written(edges.groupBy("src", "dst").agg(F.min("weight_cs").alias("w")), "edges")
    best = edges.sparkSession.createDataFrame([(source, 0)], "node_id long, cost long")
    frontier = best
    for _ in range(max_rounds):
        offers = frontier.join(edges, frontier["node_id"] == edges["src"]).groupBy(F.col("dst").alias("node_id")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        merged = written(best.join(offers, "node_id", "full_outer").select("node_id", F.least("cost", "offer").alias("cost"), F.coalesce(F.col("offer") < F.col("cost"), F.col("cost").isNull()).alias("fresh")), "costs")
        best, frontier = merged.select("node_id", "cost"), merged.filter("fresh").select("node_id", "cost")
        if not frontier.head(1):
            return best
    raise RuntimeError(f"costs still fall after {max_rounds} rounds")


def shortest(adjacency: dict[int, list[tuple[int, int]]], src: int, dst: int, max_nodes: int | None = None) -> tuple[list[int], int | None, int]:
    """Path, cost and nodes settled, by Dijkstra's search; no path: ([], None, settled)."""
    cost, parent, done = {src: 0}, {}, set()
    heap = [(0, src)]
    while heap and (max_nodes is None or len(done) < max_nodes):
        g, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == dst:
            path = [u]
            while path[-1] != src:
                path.append(parent[path[-1]])
            return path[::-1], g, len(done)
        for v, w in adjacency.get(u, ()):
            if v not in done and (v not in cost or g + w < cost[v]):
                cost[v], parent[v] = g + w, u
                heapq.heappush(heap, (g + w, v))
    return [], None, len(done)


ROUTE = batch.ROUTE


def _solve(adjacency: dict[int, list[tuple[int, int]]], rows: pd.DataFrame, max_nodes: int | None) -> pd.DataFrame:
    out = []
    for r in rows.itertuples():
        path, cost, explored = shortest(adjacency, r.src, r.dst, max_nodes)
        out.append((r.req_id, r.src, r.dst, path, cost, explored))
    done = pd.DataFrame(out, columns=["req_id", "src", "dst", "path", "cost_cs", "explored"])
    return done.astype({"cost_cs": "Int64"})


def _adjacency(pdf: pd.DataFrame) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for s, d, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight_cs"].tolist(), strict=True):
        out.setdefault(s, []).append((d, w))
    return out


def point_to_point(requests: DataFrame, edges: DataFrame, nodes: DataFrame, max_nodes: int | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """req_id, src, dst, path, cost_cs (null: no path), explored for requests (req_id, src, dst).

    Of more than WHOLE_EDGES edges only the components that hold both ends of a
    request are taken.  A graph of up to ``broadcast_edges`` edges (counted first)
    goes to every task as arrays, and searches are shared between requests (``batch.solve``); of a
    larger one each request gets the edges in the box of its ends, widened by
    CORRIDOR_DEG; where a path that leaves the box may cost less, the whole graph
    is relaxed.  ``max_nodes`` bounds the nodes that the search of a request
    settles, one at a time in a task; it is off unless it is given.
    """
    if edges.count() > WHOLE_EDGES and (kept := components.usable_nodes(requests, edges)) is not None:
        edges, nodes = components.among(edges, kept, "src"), components.among(nodes, kept, "node_id")
    best = written(cheapest_edges(edges).select("src", "dst", "weight_cs"), "cheapest")
    small = best.count() <= broadcast_edges
    if small and max_nodes is None:
        return batch.solve(requests, best, nodes)
    if small:
        graph = edges.sparkSession.sparkContext.broadcast(_adjacency(best.toPandas()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield _solve(graph.value, rows, max_nodes)

        return requests.select("req_id", "src", "dst").repartition("req_id").mapInPandas(run, ROUTE)

    at = nodes.select("node_id", "lat", "lon")
    end = lambda p: at.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    asked = requests.select("req_id", "src", "dst").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    placed = written(best.join(end("src"), "src", "left").join(end("dst"), "dst", "left"), "placed")
    tried = written(_in_corridors(asked, placed, _pace(placed), max_nodes), "corridors")
    late = tried.filter("not proven")
    done = tried.filter("proven").drop("proven")
    return done.unionByName(relaxed(late.select("req_id", "src", "dst", "cost_cs"), placed)) if late.head(1) else done


def _pace(placed: DataFrame) -> float:
    """Least weight of a metre, a little less for rounding; 0 where an edge has no place, as nothing can be said then."""
    meters = geo.haversine("src_lat", "src_lon", "dst_lat", "dst_lon")
    found = placed.select("weight_cs", meters.alias("m")).agg(F.min(F.when(F.col("m") > 0, F.col("weight_cs") / F.col("m"))).alias("least"), F.count(F.when(F.col("m").isNull(), 1)).alias("lost")).first()
    return 0.0 if found["lost"] or found["least"] is None else max(0.0, found["least"]) * (1 - 1e-6)


def _in_corridors(asked: DataFrame, placed: DataFrame, pace: float, max_nodes: int | None) -> DataFrame:
    """ROUTE and proven, of each request within its corridor.

    Proven: no path that leaves the corridor can cost less.  Each edge out of it
    costs, besides its weight, at least ``pace`` for every metre that is left to
    the request's end.
    """
    size = C.TILE_SIZE_DEG[C.ARTERIAL]
    cell = lambda c: F.floor(F.col(c) / size)
    low = lambda a, b: F.floor((F.least(a, b) - CORRIDOR_DEG) / size)
    high = lambda a, b: F.floor((F.greatest(a, b) + CORRIDOR_DEG) / size)
    boxes = asked.filter("src_lat is not null and src_lon is not null and dst_lat is not null and dst_lon is not null").select("req_id", low("src_lon", "dst_lon").alias("x0"), high("src_lon", "dst_lon").alias("x1"), low("src_lat", "dst_lat").alias("y0"), high("src_lat", "dst_lat").alias("y1"), F.col("dst_lat").alias("to_lat"), F.col("dst_lon").alias("to_lon"))
    cells = boxes.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    within = F.coalesce(cell("dst_lon").between(F.col("x0"), F.col("x1")) & cell("dst_lat").between(F.col("y0"), F.col("y1")), F.lit(False))
    rest = F.coalesce(F.floor(geo.haversine("dst_lat", "dst_lon", "to_lat", "to_lon") * pace), F.lit(0))
    corridor = cells.join(placed.withColumn("cx", cell("src_lon")).withColumn("cy", cell("src_lat")), ["cx", "cy"]).select(F.col("req_id").alias("_req"), "src", "dst", "weight_cs", F.when(within, -1).otherwise(rest).cast("long").alias("rest"))
    known = asked.select("req_id", "src", "dst", F.expr("src_lat is not null and src_lon is not null and dst_lat is not null and dst_lon is not null").alias("known"))

    def search(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        adjacency, out = _adjacency(near), float("inf")  # out: beyond the rim
        done = _solve(adjacency, rows, max_nodes)
        for v, w in dict(zip(near["dst"].tolist(), near["rest"].tolist(), strict=True)).items():
            if w >= 0:
                adjacency.setdefault(v, []).append((out, w))
        proven = []
        for r, cost, explored in zip(rows.itertuples(), done["cost_cs"].tolist(), done["explored"].tolist(), strict=True):
            around = shortest(adjacency, r.src, out, 1 << 62)[1]
            over = max_nodes is not None and pd.isna(cost) and explored >= max_nodes  # the whole graph has as many nodes to settle
            proven.append(bool(over or (r.known and (around is None or (not pd.isna(cost) and cost <= around)))))
        return done.assign(proven=proven)

    return known.groupBy("req_id").cogroup(corridor.groupBy("_req")).applyInPandas(search, f"{ROUTE}, proven boolean")


def relaxed(requests: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """ROUTE of requests (req_id, src, dst, cost_cs of a path known or null) on the whole graph, by frontier relaxation of all requests at once.

    Nodes that cost more than the known path are left out.  explored counts the
    nodes reached; max_nodes bounds searches in a task and does not hold here.
    """
    asked = written(requests.select("req_id", "src", "dst", F.col("cost_cs").alias("known")), "asked")
    steps = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("to"), "weight_cs")
    best = written(asked.select("req_id", F.col("src").alias("node_id"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("parent")), "reached")
    frontier = best
    bound = asked.select("req_id", "known")
    for _ in range(max_rounds):
        offers = frontier.join(steps, "node_id").join(bound, "req_id").withColumn("offer", F.col("cost") + F.col("weight_cs")).filter("known is null or offer <= known")
        offers = offers.groupBy("req_id", F.col("to").alias("node_id")).agg(F.min(F.struct("offer", F.col("node_id").alias("via"))).alias("o"))
        fresh = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.offer") < F.col("cost")))
        pick = lambda new, old: F.when(F.col("fresh"), F.col(new)).otherwise(F.col(old)).alias(old)
        merged = written(best.join(offers, ["req_id", "node_id"], "full_outer").withColumn("fresh", fresh).select("req_id", "node_id", pick("o.offer", "cost"), pick("o.via", "parent"), "fresh"), "reached")
        best, frontier = merged.drop("fresh"), merged.filter("fresh").drop("fresh")
        if not frontier.head(1):
            break
    else:
        raise RuntimeError(f"costs still fall after {max_rounds} rounds")

    def trace(rows: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        r = next(rows.itertuples())
        cost = dict(zip(reached["node_id"].tolist(), reached["cost"].tolist(), strict=True))
        parent = dict(zip(reached["node_id"].tolist(), reached["parent"].astype("Int64").tolist(), strict=True))
        path = [r.dst] if r.dst in cost else []
        while path and path[-1] != r.src:
            path.append(parent[path[-1]])
        done = pd.DataFrame([(r.req_id, r.src, r.dst, path[::-1], cost.get(r.dst), len(cost))], columns=["req_id", "src", "dst", "path", "cost_cs", "explored"])
        return done.astype({"cost_cs": "Int64"})

    return asked.groupBy("req_id").cogroup(best.groupBy("req_id")).applyInPandas(trace, ROUTE)


def path_steps(routes: DataFrame) -> DataFrame:
    """req_id, step, src, dst: consecutive nodes of each path."""
    return _steps(routes).drop("_last")


def _steps(routes: DataFrame) -> DataFrame:
    """path_steps and _last, the number of the last step."""
    pair = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))
    return routes.filter(F.size("path") >= 2).select("req_id", (F.size("path") - 2).alias("_last"), F.posexplode(pair).alias("step", "p")).select("req_id", "step", "p.src", "p.dst", "_last")


def path_totals(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """req_id, distance_cm, weight_cs summed over the cheapest edge of each step; 0 for a path of one node.

    Up to SENT_EDGES steps (counted first) are sent to the edges, of which only those on a path are dealt anew.
    """
    steps = path_steps(routes)
    if steps.count() <= SENT_EDGES:
        edges = edges.join(F.broadcast(steps.select("src", "dst").distinct()), ["src", "dst"], "left_semi")
    totals = steps.join(cheapest_edges(edges), ["src", "dst"]).groupBy("req_id").agg(F.sum("distance_cm").alias("distance_cm"), F.sum("weight_cs").alias("weight_cs"))
    return routes.filter(F.size("path") >= 1).select("req_id").join(totals, "req_id", "left").fillna(0)


def with_endpoints(paths: DataFrame) -> DataFrame:
    """``points`` (array<struct<lat,lon>>) with the place that a route is asked from (from_lat, from_lon) before it and the one it goes to (to_lat, to_lon) after it."""
    end = lambda p: F.array(F.struct(F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon")))
    return paths.withColumn("points", F.concat(end("from"), F.col("points"), end("to")))


#: Nodes of a graph over all levels are level * LEVEL_KEY + node.
LEVEL_KEY = 1_000_000_000


def levels_used(routes: DataFrame) -> DataFrame:
    """Routes with levels_used, the levels that lie on the path of a graph over all levels, in order."""
    return routes.withColumn("levels_used", F.array_sort(F.array_distinct(F.transform("path", lambda x: F.floor(x / LEVEL_KEY).cast("int")))))


def route_segments(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """req_id, step, name, instruction, distance_m of each path step.

    Steps are many times the edges, so up to SENT_EDGES of these (counted first) go to the steps, which are not dealt anew.
    """
    best = written(edges.groupBy("src", "dst").agg(F.min(F.struct("weight_cs", "distance_cm", "name")).alias("b")), "best")
    steps = _steps(routes).join(F.broadcast(best) if best.count() <= SENT_EDGES else best, ["src", "dst"])
    what = F.when(F.col("step") == 0, "Start").when(F.col("step") == F.col("_last"), "Arrive").otherwise("Continue")
    return steps.select("req_id", "step", F.col("b.name").alias("name"), what.alias("instruction"), (F.col("b.distance_cm") / 100.0).alias("distance_m"))


def candidate_levels(requests: DataFrame) -> DataFrame:
    """A row for each level that may be tried for a request (lat1, lon1, lat2, lon2), tried 0 first: the level of its distance, then higher ones."""
    meters = geo.haversine("lat1", "lon1", "lat2", "lon2")
    out = requests.withColumn("distance_m", meters).withColumn("_l", classify.select_level(F.col("distance_m")))
    return out.select("*", F.posexplode(F.when(F.col("_l") > 0, F.sequence(F.col("_l"), F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))).alias("tried", "level")).drop("_l")


def hier_connectors(requests: DataFrame, nodes_by_level: dict[int, DataFrame], level: int) -> DataFrame:
    """req_id, local_start, level_start, level_end, local_end: both ends snapped on Local and on ``level``; requests that miss one go."""
    places = {end: (F.col(f"{end}_lat_micro"), F.col(f"{end}_lon_micro")) for end in ("start", "end")}
    out = requests.select("req_id")
    for name, at in (("local", C.LOCAL), ("level", level)):
        for end, hit in _snap_ends(requests, places, nodes_by_level[at], at).items():
            out = out.join(hit.withColumnRenamed("node_id", f"{name}_{end}"), "req_id")
    return out.select("req_id", "local_start", "level_start", "local_end", "level_end")


def _snap_ends(requests: DataFrame, places: dict[str, tuple[Column, Column]], nodes: DataFrame, level: int) -> dict[str, DataFrame]:
    """req_id, node_id for each of ``places`` (name to microdegrees) of requests, all looked for at once."""
    points = F.explode(F.array(*(F.struct(F.lit(end).alias("end"), lat.alias("lat_micro"), lon.alias("lon_micro")) for end, (lat, lon) in places.items()))).alias("p")
    asked = requests.select("req_id", points).select(F.struct("req_id", "p.end").alias("who"), "p.lat_micro", "p.lon_micro")
    hits = written(snap_nearest(asked, nodes, level, "who").select("who.req_id", "who.end", "node_id"), "hits")
    return {end: hits.filter(F.col("end") == end).select("req_id", "node_id") for end in places}


def find_routes(requests: DataFrame, graphs: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """req_id, level, path, cost_cs for requests (req_id, lat1, lon1, lat2, lon2): the first level, from the one of the
    distance upwards, on which both ends snap and a path exists.  ``graphs``: level to (nodes, edges).

    A level is only asked for what those before it have left open.
    """
    meters = geo.haversine("lat1", "lon1", "lat2", "lon2")
    todo = written(requests.dropDuplicates(["req_id"]).withColumn("_level", classify.select_level(meters)), "asked")
    done = None
    for level, (nodes, edges) in sorted(graphs.items(), key=lambda x: -x[0]):
        here = todo.filter((F.col("_level") >= level) | (F.lit(level) == C.HIGHWAY))
        ends = here.select("req_id")
        places = {end: (geo.to_micro(f"lat{n}"), geo.to_micro(f"lon{n}")) for end, n in (("src", 1), ("dst", 2))}
        for end, hit in _snap_ends(here, places, nodes, level).items():
            ends = ends.join(hit.withColumnRenamed("node_id", end), "req_id")
        solved = written(point_to_point(written(ends, "ends"), edges, nodes).filter("cost_cs is not null").select("req_id", F.lit(level).alias("level"), "path", "cost_cs"), "solved")
        done = solved if done is None else done.unionByName(solved)
        todo = written(todo.join(solved, "req_id", "left_anti"), "asked")
    return done
