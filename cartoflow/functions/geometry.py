"""Geometry on nested points (array<struct<lat,lon>>) and on segment columns, without Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLOSE_EPS

#: Rounds of outcode clipping: each end is moved to two borders at most; two more settle rounding at a corner.
CLIP_ROUNDS = 6
#: Rounds as columns in generated code; more in one stage are too large for the compiler.
COLUMN_ROUNDS = 2


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def is_closed(points: Column) -> Column:
    """Three points or more, and first and last within CLOSE_EPS on each axis."""
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    return F.when(F.size(points) >= 3, (F.abs(first["lat"] - last["lat"]) < CLOSE_EPS) & (F.abs(first["lon"] - last["lon"]) < CLOSE_EPS)).otherwise(F.lit(False))


def segments(points: Column) -> Column:
    """Consecutive pairs as array<struct<lat1,lon1,lat2,lon2>>."""
    pair = lambda i: F.struct(F.get(points, i - 1)["lat"].alias("lat1"), F.get(points, i - 1)["lon"].alias("lon1"), F.get(points, i)["lat"].alias("lat2"), F.get(points, i)["lon"].alias("lon2"))
    return F.when(F.size(points) >= 2, F.transform(F.sequence(F.lit(1), F.size(points) - 1), pair)).otherwise(F.array().cast("array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>"))


def centroid(points: Column) -> Column:
    """Mean of the vertices; a closing vertex counts twice."""
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[f]) / F.size(points)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def bbox(points: Column) -> Column:
    of = lambda f: F.transform(points, lambda p: p[f])
    return F.struct(F.array_min(of("lat")).alias("min_lat"), F.array_max(of("lat")).alias("max_lat"), F.array_min(of("lon")).alias("min_lon"), F.array_max(of("lon")).alias("max_lon"))


def outcode(lat: Column, lon: Column) -> Column:
    """1 left, 2 right, 4 bottom, 8 top of the box in min_lat, max_lat, min_lon, max_lon."""
    x = F.when(lon < F.col("min_lon"), 1).when(lon > F.col("max_lon"), 2).otherwise(0)
    y = F.when(lat < F.col("min_lat"), 4).when(lat > F.col("max_lat"), 8).otherwise(0)
    return x + y


def _clip_round(df: DataFrame) -> DataFrame:
    """Move one end of a segment to the border that its outcode names first: top, bottom, right, left; ends on one side of the box stay."""
    at_lat = lambda b: F.col("lon1") + (F.col("lon2") - F.col("lon1")) * (F.col(b) - F.col("lat1")) / F.nullif(F.col("lat2") - F.col("lat1"), F.lit(0.0))
    at_lon = lambda b: F.col("lat1") + (F.col("lat2") - F.col("lat1")) * (F.col(b) - F.col("lon1")) / F.nullif(F.col("lon2") - F.col("lon1"), F.lit(0.0))
    df = df.withColumns({"_a": outcode(F.col("lat1"), F.col("lon1")), "_b": outcode(F.col("lat2"), F.col("lon2"))})
    df = df.withColumn("_o", F.when(F.col("_a").bitwiseAND(F.col("_b")) != 0, 0).when(F.col("_a") != 0, F.col("_a")).otherwise(F.col("_b")))
    top, bottom, right = (F.col("_o").bitwiseAND(F.lit(b)) != 0 for b in (8, 4, 2))
    df = df.withColumns(
        {
            "_y": F.when(top, F.col("max_lat")).when(bottom, F.col("min_lat")).when(right, at_lon("max_lon")).when(F.col("_o") != 0, at_lon("min_lon")),
            "_x": F.when(top, at_lat("max_lat")).when(bottom, at_lat("min_lat")).when(right, F.col("max_lon")).when(F.col("_o") != 0, F.col("min_lon")),
        }
    )
    first, second = (F.col("_o") != 0) & (F.col("_a") != 0), (F.col("_o") != 0) & (F.col("_a") == 0)
    moved = {"lat1": (first, "_y"), "lon1": (first, "_x"), "lat2": (second, "_y"), "lon2": (second, "_x")}
    return df.withColumns({c: F.when(w, F.col(v)).otherwise(F.col(c)) for c, (w, v) in moved.items()}).drop("_a", "_b", "_o", "_y", "_x")


def _settled(end: Column) -> Column:
    """The remaining rounds on struct<lat1,lon1,lat2,lon2> as one fold, for the few segments that need more than COLUMN_ROUNDS."""

    def step(e: Column, a: Column, b: Column) -> Column:
        lat1, lon1, lat2, lon2 = (e[c] for c in ("lat1", "lon1", "lat2", "lon2"))
        out = F.when(a != 0, a).otherwise(b)
        at_lat = lambda v: lon1 + (lon2 - lon1) * (F.col(v) - lat1) / F.nullif(lat2 - lat1, F.lit(0.0))
        at_lon = lambda v: lat1 + (lat2 - lat1) * (F.col(v) - lon1) / F.nullif(lon2 - lon1, F.lit(0.0))
        top, bottom, right = (out.bitwiseAND(F.lit(v)) != 0 for v in (8, 4, 2))
        y = F.when(top, F.col("max_lat")).when(bottom, F.col("min_lat")).when(right, at_lon("max_lon")).otherwise(at_lon("min_lon"))
        x = F.when(top, at_lat("max_lat")).when(bottom, at_lat("min_lat")).when(right, F.col("max_lon")).otherwise(F.col("min_lon"))
        ends = lambda p, q, r, s: F.struct(p.alias("lat1"), q.alias("lon1"), r.alias("lat2"), s.alias("lon2"))
        moved = F.when(a != 0, ends(y, x, lat2, lon2)).otherwise(ends(lat1, lon1, y, x))
        return F.when((a == 0) & (b == 0) | (a.bitwiseAND(b) != 0), e).otherwise(moved)

    codes = lambda e: F.struct(outcode(e["lat1"], e["lon1"]).alias("a"), outcode(e["lat2"], e["lon2"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(COLUMN_ROUNDS + 1), F.lit(CLIP_ROUNDS)), end, lambda e, _: let(codes(e), lambda c: step(e, c["a"], c["b"])))


def clip_segments(df: DataFrame) -> DataFrame:
    """Rows with lat1, lon1, lat2, lon2 clipped to their box; rows outside go.

    The first rounds are columns in generated code, which settle nearly all
    segments; only the others go through a fold.  ``explode`` ends the chain, so
    that no filter on a round's columns is pushed back through all rounds.
    """
    df = df.withColumns({c: F.col(c).cast("double") for c in ("lat1", "lon1", "lat2", "lon2")})
    # ends on one side of the box are told apart before the rounds
    df = df.filter(outcode(F.col("lat1"), F.col("lon1")).bitwiseAND(outcode(F.col("lat2"), F.col("lon2"))) == 0)
    for _ in range(COLUMN_ROUNDS):
        df = _clip_round(df)
    df = df.withColumns({"_a": outcode(F.col("lat1"), F.col("lon1")), "_b": outcode(F.col("lat2"), F.col("lon2"))})
    end = F.struct("lat1", "lon1", "lat2", "lon2")
    within = lambda e: (outcode(e["lat1"], e["lon1"]) == 0) & (outcode(e["lat2"], e["lon2"]) == 0)
    open_ = (F.col("_a").bitwiseAND(F.col("_b")) == 0) & (F.col("_a") + F.col("_b") != 0)
    df = df.withColumn("_rest", F.when(open_, F.filter(F.array(_settled(end)), within)))
    kept = F.when((F.col("_a") == 0) & (F.col("_b") == 0), F.array(end)).otherwise(F.col("_rest"))
    return df.withColumn("_e", F.explode(kept)).withColumns({c: F.col(f"_e.{c}") for c in ("lat1", "lon1", "lat2", "lon2")}).drop("_e", "_a", "_b", "_rest")


def _clip_edge(points: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """One Sutherland-Hodgman pass; for each vertex: its edge's crossing, then the next vertex, as far as they are inside."""
    other = "lon" if axis == "lat" else "lat"
    inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)

    def crossing(p: Column, q: Column) -> Column:
        t = (bound - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
        value = {axis: bound, other: p[other] + t * (q[other] - p[other])}
        return F.struct(value["lat"].alias("lat"), value["lon"].alias("lon"))

    def emit(pts: Column) -> Column:
        def at(p: Column, i: Column) -> Column:
            q = F.get(pts, (i + 1) % F.size(pts))
            return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(crossing(p, q))).when(inside(q), F.array(crossing(p, q), q)).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))

        return F.flatten(F.transform(pts, at))

    return let(points, emit)


def clip_polygon(points: Column, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    for axis, bound, above in (("lat", min_lat, True), ("lat", max_lat, False), ("lon", min_lon, True), ("lon", max_lon, False)):
        points = _clip_edge(points, axis, bound, above)
    return points


def triangulate_fan(points: Column) -> Column:
    """Triangles (p0, pi, pi+1)."""
    tri = lambda i: F.struct(F.get(points, F.lit(0)).alias("a"), F.get(points, i).alias("b"), F.get(points, i + 1).alias("c"))
    return F.when(F.size(points) >= 3, F.transform(F.sequence(F.lit(1), F.size(points) - 2), tri))


def segment_visible(x1: Column, y1: Column, x2: Column, y2: Column, size: float, margin: float) -> Column:
    """Does the segment's box meet the screen, widened by ``margin``?"""
    low, high = -margin, size + margin
    return (F.greatest(x1, x2) >= low) & (F.least(x1, x2) <= high) & (F.greatest(y1, y2) >= low) & (F.least(y1, y2) <= high)


def point_visible(x: Column, y: Column, size: float, margin: float) -> Column:
    return x.between(-margin, size + margin) & y.between(-margin, size + margin)
