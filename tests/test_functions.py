"""Facts and properties of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflow import constants as C
from cartoflow.functions import classify, geo, geometry, grid
from cartoflow.operators import render_etl
from cartoflow.queries import QUERIES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distances(spark):
    zurich, bern = (47.3769, 8.5417), (46.9481, 7.4474)
    assert abs(value(spark, geo.haversine(*zurich, *bern)) - 95_000) < 5_000
    assert abs(value(spark, geo.haversine(47.0, 8.0, 47.001, 8.0)) - 111) < 5
    exact, flat = value(spark, geo.haversine(*zurich, *bern)), value(spark, geo.approx_distance(*zurich, *bern))
    assert abs(exact - flat) / exact < 0.01
    assert value(spark, geo.haversine(47.0, 8.0, -47.0, -172.0)) == pytest.approx(math.pi * C.EARTH_RADIUS_M, rel=1e-6)


def test_bearing_and_angles(spark):
    assert value(spark, geo.bearing(47.0, 8.0, 48.0, 8.0)) == pytest.approx(0)
    assert value(spark, geo.bearing(0.0, 8.0, 0.0, 9.0)) == pytest.approx(90)
    assert value(spark, geo.smooth_angle(10.0, 20.0, 0.5)) == pytest.approx(15)
    assert value(spark, geo.smooth_angle(350.0, 10.0, 0.5)) % 360 == pytest.approx(0)


def test_viewport_round_trip(spark):
    sx, sy = geo.world_to_screen(100.0, 50.0, 1 / 1.5, 30.0, 400.0)
    x, y = geo.screen_to_world(sx, sy, 1 / 1.5, 30.0, 400.0)
    assert value(spark, x) == pytest.approx(100, abs=0.01)
    assert value(spark, y) == pytest.approx(50, abs=0.01)


def test_tiles(spark):
    x, y = grid.tile_key(47.1415, 8.4320)
    assert (value(spark, x), value(spark, y)) == (843, 4714)
    assert value(spark, grid.tile_index(0.29)) == 28  # binary floating point
    lat, _ = grid.tile_origin(F.lit(843), F.lit(4714))
    back = grid.from_offset(grid.to_offset(F.lit(47.1415), lat), lat)
    assert abs(value(spark, back) - 47.1415) < 1e-4
    assert value(spark, grid.to_offset(F.lit(90.0), F.lit(0.0))) == 32767
    assert value(spark, geo.to_micro(1e9)) == 2147483647


def test_time_and_levels(spark):
    assert value(spark, classify.travel_time_s(F.lit(100_000), F.lit(80))) == pytest.approx(45, abs=0.1)
    assert value(spark, classify.edge_weight_cs(F.lit(100_000), F.lit(0))) == C.WEIGHT_MAX
    assert [value(spark, classify.select_level(F.lit(m))) for m in (4_000.0, 25_000.0, 100_000.0)] == [2, 1, 0]


@pytest.mark.parametrize(("tagged", "speed"), [("50", 50), ("50 km/h", 50), ("+50", 50), (" 50", 80), ("300", 80), ("none", 80), (None, 80), ("0", 0), ("70 km/h km/h", 70)])
def test_speed(spark, tagged, speed):
    tags = F.create_map(F.lit("highway"), F.lit("primary"), F.lit("maxspeed"), F.lit(tagged).cast("string"))
    assert value(spark, classify.speed_kmh(tags)) == speed


def test_names(spark):
    for name, norm in [("Zürich", "zürich"), ("New York", "new york"), ("St. Gallen", "st gallen"), ("  Hello  ", "hello")]:
        assert value(spark, classify.normalize_name(F.lit(name))) == norm


def test_unlisted_highway_drops_the_way(spark):
    tags = F.create_map(F.lit("highway"), F.lit("footway"), F.lit("natural"), F.lit("water"))
    assert value(spark, classify.render_way(tags, F.lit(True))) is None


def test_clipped_segments_stay_inside_and_keep_their_length(spark):
    rows = [(i, 47.0 + i * 0.0031 % 0.05, 8.0 + i * 0.0047 % 0.05, 47.0 + i * 0.0073 % 0.05, 8.0 + i * 0.0011 % 0.05) for i in range(60)]
    segs = spark.createDataFrame(rows, "id int, lat1 double, lon1 double, lat2 double, lon2 double")
    cut = geometry.clip_segments(render_etl.with_tile_box(render_etl.segment_tiles(segs)))
    parts = cut.collect()
    assert all(r.min_lat <= v <= r.max_lat for r in parts for v in (r.lat1, r.lat2))
    assert all(r.min_lon <= v <= r.max_lon for r in parts for v in (r.lon1, r.lon2))
    whole = sum(math.hypot(a[3] - a[1], a[4] - a[2]) for a in rows)
    assert sum(math.hypot(r.lat2 - r.lat1, r.lon2 - r.lon1) for r in parts) == pytest.approx(whole, rel=1e-6)


def test_triangles_and_rings(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0))))
    assert len(value(spark, geometry.triangulate_fan(ring))) == 2
    assert value(spark, geometry.is_closed(ring)) is True
    p = lambda *xs: [{"lat": float(a), "lon": float(b)} for a, b in xs]
    members = [(1, 0, p((0, 0), (0, 1))), (1, 1, p((1, 1), (0, 1))), (1, 2, p((1, 1), (0, 0))), (2, 0, p((0, 0), (5, 5)))]
    rings = render_etl.assemble_rings(spark.createDataFrame(members, "rel_id long, member_no int, points array<struct<lat:double,lon:double>>")).collect()
    assert [(r.rel_id, len(r.points)) for r in rings] == [(1, 4)]


def test_tiles_to_load_and_keep_need_no_join(spark):
    """Each tile once, as sets have it; no side is sent to every task, whatever the planner takes its size for."""
    tiles = lambda *rows: spark.createDataFrame(rows, "point_id long, tile_x int, tile_y int")
    out = grid.load_and_keep(tiles((1, 0, 0), (1, 0, 0), (1, 0, 1), (2, 5, 5)), tiles((1, 0, 1), (1, 0, 1), (2, 9, 9)), ["point_id", "tile_x", "tile_y"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, "load"), (1, 0, 1, "keep"), (2, 5, 5, "load")]
    plan = QUERIES["tiles_to_load_and_keep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_clipping_by_arrays_is_clipping_by_columns(spark, monkeypatch):
    """The same tiles and offsets as column by column, also for upright, level, long and single-point segments, and in small parts."""
    monkeypatch.setattr(render_etl, "HELD_TILES", 50)
    rng = np.random.default_rng(5)
    rows = [(i, 47 + a / 1000, 8 + b / 1000, 47 + c / 1000, 8 + d / 1000) for i, (a, b, c, d) in enumerate(rng.integers(-60, 60, (200, 4)).tolist())]
    rows += [(300, 47.005, 8.02, 47.305, 8.02), (301, 47.01, 8.0, 47.01, 8.2), (302, 47.03, 8.03, 47.03, 8.03), (303, -0.01, -0.02, 0.01, 0.02), (304, None, 8.0, 47.0, 8.1)]
    segs = spark.createDataFrame(rows, "way_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    found = render_etl.clipped_segments(segs)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    offset = lambda c, o: grid.to_offset(F.col(c), F.col(o)).alias(c)
    cut = geometry.clip_segments(render_etl.with_tile_box(render_etl.segment_tiles(segs.filter("lat1 is not null"))))  # an end without a place is in no tile
    expected = cut.select("way_id", "tile_x", "tile_y", offset("lon1", "min_lon"), offset("lat1", "min_lat"), offset("lon2", "min_lon"), offset("lat2", "min_lat"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
