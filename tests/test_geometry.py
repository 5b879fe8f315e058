import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo, hexgrid
from landgrid.functions.kernels import halve, hull, shared_areas
from landgrid.operators import cells, spatial
from tests import brute

POLYGON = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def overlap(a, b):
    return shared_areas(pa.array([a], POLYGON), pa.array([b], POLYGON))[0]


def test_overlap_of_concave_and_convex_matches_clipping():
    rng = brute.seeded()
    for _ in range(200):
        a = brute.star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.5, 2), rng.randint(5, 25))
        b = brute.regular(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.5, 2), rng.randint(3, 9), rng.uniform(0, 1))
        assert overlap(brute.rings(a), brute.rings(b)) == pytest.approx(brute.convex_overlap(a, b), abs=1e-9)


def test_overlap_with_hole_and_parts():
    shell, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 7), (7, 7), (7, 3)]
    second = [(20, 0), (22, 0), (22, 2), (20, 2)]
    window = [(5, 5), (21, 5), (21, -5), (5, -5)][::-1]
    # The window shares 5x5 of the shell less 2x2 of its hole, and 1x2 of the second part.
    assert overlap(brute.rings(shell, hole, second), brute.rings(window)) == pytest.approx(25 - 4 + 2)


def test_touching_and_missing_shapes_do_not_overlap():
    a, b = [(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (2, 0), (2, 1), (1, 1)]
    out = shared_areas(pa.array([brute.rings(a), [], None], POLYGON), pa.array([brute.rings(b)] * 3, POLYGON))
    assert list(out) == [0, 0, 0]


def test_halving_keeps_the_area():
    rng = brute.seeded(3)
    ring = brute.star(rng, 0, 0, 5, 900)
    closed = np.array([*ring, ring[0]])
    pieces = list(halve([closed], 128))
    assert all(sum(len(r) for r in p) <= 128 for p in pieces)
    total = sum(brute.shoelace([tuple(q) for q in r[:-1]]) for p in pieces for r in p)
    assert total == pytest.approx(brute.shoelace(ring))


def test_hull_is_convex_and_holds_all_points():
    points = np.random.default_rng(1).normal(size=(300, 2))
    ring = [tuple(p) for p in hull(points)[:-1]]
    for a, b in zip(ring, ring[1:] + ring[:1]):
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for p in points)


def test_projection_against_known_points_and_back(spark):
    # The origin of the projection, and a degree of the central meridian.
    rows = [(-73.0, 4.0), (-73.0, 5.0), (-75.57, 6.25), (-67.0, -4.0), (-79.0, 12.0)]
    df = spark.createDataFrame(rows, "lng double, lat double").withColumn("p", geo.project(F.col("lng"), F.col("lat")))
    df = df.withColumn("b", geo.unproject(F.col("p.x"), F.col("p.y")))
    out = df.collect()
    assert (out[0].p.x, out[0].p.y) == pytest.approx((5_000_000, 2_000_000), abs=1e-6)
    arc = geo.SCALE * (geo.meridian_arc(math.radians(5)) - geo.meridian_arc(math.radians(4)))
    assert out[1].p.y - 2_000_000 == pytest.approx(arc, abs=1e-6)
    for r in out:
        assert (r.b.x, r.b.y) == pytest.approx((r.lng, r.lat), abs=2e-7)


def test_missing_places_stay_missing(spark):
    df = spark.createDataFrame([(None, 4.0)], "lng double, lat double")
    lng, lat = F.col("lng"), F.col("lat")
    out = df.select(
        geo.haversine_m(lng, lat, F.lit(0.0), F.lit(0.0)), hexgrid.point_to_cell(lng, lat, 8),
        geo.tile_of(lng, lat, F.lit(3)), spatial.overlap_pct(F.lit(1.0), lng),
    ).first()
    assert list(out) == [None] * 4


def test_hexagons_have_the_published_area_and_six_neighbours(spark):
    df = spark.createDataFrame([(-74.0, 4.6), (-76.5, 3.4)], "lng double, lat double")
    for level in (6, 7, 8, 9):
        c = hexgrid.point_to_cell(F.col("lng"), F.col("lat"), level)
        row = df.select(
            geo.area(hexgrid.plane_boundary(c, level)).alias("a"), hexgrid.neighbours(c).alias("n"), c.alias("c"),
            hexgrid.disk(c, 2).alias("d"), hexgrid.level_of(c).alias("l"),
        ).first()
        assert row.a / 1e6 == pytest.approx(hexgrid.CELL_AREA_KM2[level])
        assert len(set(row.n)) == 6 and row.c not in row.n
        assert len(set(row.d)) == 19 and set(row.n) < set(row.d) and row.l == level


def test_cover_has_exactly_the_cells_whose_centre_is_inside(spark):
    ring = [(-74.3, 4.2), (-73.9, 4.1), (-73.8, 4.6), (-74.1, 4.4), (-74.35, 4.55)]
    df = spark.createDataFrame([(1, brute.rings(ring))], f"id int, rings {geo.POLYGON_TYPE}")
    got = {r.cell for r in spatial.polygon_cells(df, "rings", 7).collect()}
    grid = [(-74.5 + i * 0.004, 4.0 + j * 0.004) for i in range(200) for j in range(175)]
    points = spark.createDataFrame(grid, "lng double, lat double")
    around = points.select(hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 7).alias("c")).distinct()
    plane = df.select(geo.project_rings(F.col("rings")).alias("p")).first().p[0]
    plane = [(p.x, p.y) for p in plane[:-1]]
    centers = around.select("c", hexgrid.plane_center(F.col("c"), 7).alias("m")).collect()
    assert got == {r.c for r in centers if brute.inside(plane, r.m.x, r.m.y)}


def test_cell_shares_match_clipping_of_hexagons(spark):
    box = [(-74.2, 4.3), (-74.0, 4.3), (-74.0, 4.5), (-74.2, 4.5)]
    shape = spark.createDataFrame([(1, brute.rings(box))], f"piece int, o_rings {geo.POLYGON_TYPE}")
    overlays = shape.selectExpr("1 as source_id", "'protected_area' as layer", "'a' as layer_key", "'x' as level", "1 as level_rank", "o_rings")
    grid = [(-74.3 + i * 0.01, 4.2 + j * 0.01) for i in range(40) for j in range(40)]
    hexes = spark.createDataFrame(grid, "lng double, lat double").select(
        hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 8).alias("cell")
    ).distinct().withColumn("rings", hexgrid.boundary(F.col("cell"), 8))
    got = {r.cell: r.pct for r in cells.overlay_shares(hexes, overlays, "cell", "rings").collect()}
    for r in hexes.collect():
        ring = [(p.x, p.y) for p in r.rings[0][:-1]]
        want = brute.convex_overlap(ring, box) / abs(brute.shoelace(ring)) * 100
        assert got.get(r.cell, 0.0) == pytest.approx(want, abs=6e-4)


def test_clean_polygon_turns_closes_and_drops(spark):
    rows = [
        (brute.rings([(0, 0), (0, 2), (2, 2), (2, 0)])[0][:-1],),  # clockwise and open
        ([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}],),  # no surface
    ]
    df = spark.createDataFrame([([r[0]],) for r in rows], f"rings {geo.POLYGON_TYPE}")
    out = [r[0] for r in df.select(geo.area(geo.clean_polygon(F.col("rings")))).collect()]
    assert out == [4.0, None]


def test_line_midpoint_and_segments(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 3.0, "y": 1.0}]
    df = spark.createDataFrame([(1, line)], f"id int, line {geo.RING_TYPE}")
    mid = df.select(geo.line_midpoint(F.col("line")).alias("m")).first().m
    assert (mid.x, mid.y) == pytest.approx((2.0, 0.0))
    pieces = spatial.line_segments(df, "line", 0.5).select("segment.*").collect()
    assert len(pieces) == 8 and max(abs(p.x2 - p.x1) for p in pieces) <= 0.5 + 1e-12


def test_point_on_surface_is_inside(spark):
    c_shape = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10)]
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]
    df = spark.createDataFrame([(brute.rings(c_shape),), (brute.rings(square, hole),), (brute.rings(square),), (None,)], f"r {geo.POLYGON_TYPE}")
    out = df.select("r", geo.point_on_surface(F.col("r")).alias("p")).collect()
    assert brute.inside(c_shape, out[0].p.x, out[0].p.y)
    assert brute.inside(square, out[1].p.x, out[1].p.y) and not brute.inside(hole, out[1].p.x, out[1].p.y)
    assert (out[2].p.x, out[2].p.y) == (2, 2) and out[3].p is None
