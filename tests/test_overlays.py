"""Overlay on pieces, and the strip kernels, against clipping and the product of all edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landgrid.functions import kernels
from landgrid.operators import cells, overlays
from tests import brute

POLYGON = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
SHAPE = "array<array<struct<x:double,y:double>>>"


def _circle(points, cx=0.0, cy=0.0, r=1.0, rough=0.0):
    rng = random.Random(points)
    turn = [2 * math.pi * k / points for k in range(points)]
    return [(cx + r * (1 + rough * rng.gauss(0, 1)) * math.cos(t), cy + r * (1 + rough * rng.gauss(0, 1)) * math.sin(t)) for t in turn]


def test_large_shapes_meet_few_edges():
    shapes = pa.array([brute.rings(_circle(100_000))], POLYGON)
    row, x1, y1, x2, y2 = kernels._edges(shapes)
    side = row, np.minimum(x1, x2), np.maximum(x1, x2)
    pairs = sum(len(i) for i, _ in kernels._meetings(side, side, 1))
    assert pairs < 10 * 100_000
    assert kernels.shared_areas(shapes, shapes)[0] == pytest.approx(math.pi, rel=1e-6)
    assert not kernels.crossing_rows(row, x1, y1, x2, y2, 1)[0]
    coast = pa.array([brute.rings(_circle(20_000, 0.3, rough=0.001))], POLYGON)
    lens = 2 * math.acos(0.15) - 0.3 * math.sqrt(1 - 0.15**2)
    assert kernels.shared_areas(shapes, coast)[0] == pytest.approx(lens, abs=2e-3)


def test_meetings_are_the_edges_that_share_a_column():
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 12, 900)), np.sort(rng.integers(0, 12, 700))
    sides = []
    for row in rows:
        lo = rng.choice([0.0, 0.25, 1.0, 5.0], len(row)) + rng.random(len(row)) * (rng.random(len(row)) < 0.7)
        sides.append((row, lo, lo + rng.choice([0.0, 0.01, 3.0], len(row))))
    got = sorted((int(i), int(j)) for a, b in kernels._meetings(*sides, 14) for i, j in zip(a, b, strict=True))
    (r, lo, hi), (s, other_lo, other_hi) = sides
    i, j = np.nonzero((r[:, None] == s) & (np.maximum(lo[:, None], other_lo) <= np.minimum(hi[:, None], other_hi)))
    assert got == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_crossing_rows_equal_all_pairs():
    rng = random.Random(6)
    shapes = [[(rng.random(), rng.random()) for _ in range(rng.randint(3, 7))] for _ in range(200)]
    row, x1, y1, x2, y2 = kernels._edges(pa.array([brute.rings(s) for s in shapes], POLYGON))
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    found = kernels.crossing_rows(row, x1, y1, x2, y2, len(shapes))
    for k in range(len(shapes)):
        own = [((x1[i], y1[i]), (x2[i], y2[i])) for i in np.flatnonzero(row == k)]
        crossed = any(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 for n, (a, b) in enumerate(own) for c, d in own[n + 1 :])
        assert found[k] == crossed


def _grid(n, side):
    return [(x * n + y, brute.rings([(x * side, y * side), ((x + 1) * side, y * side), ((x + 1) * side, (y + 1) * side), (x * side, (y + 1) * side)])) for x in range(n) for y in range(n)]


def test_overlay_on_pieces_settles_inner_cells(spark, monkeypatch):
    ring, hole = _circle(12_000, 1.0, 1.0, 0.9), _circle(3_000, 1.0, 1.0, 0.4)[::-1]
    grid = spark.createDataFrame([(k, r) for k, r in _grid(20, 0.1)] + [(999, None), (998, [])], f"cell bigint, c_rings {SHAPE}")
    land = spark.createDataFrame([("a", brute.rings(ring, hole)), ("b", brute.rings([(0.0, 0.0), (2.0, 0.0), (2.0, 0.05), (0.0, 0.05)])), ("none", None)], f"source string, o_rings {SHAPE}")
    got = {(r["cell"], r["source"]): r["area"] for r in overlays.piece_overlaps(grid, land, "c_rings", "o_rings").groupBy("cell", "source").agg(F.sum("overlap").alias("area")).collect()}
    whole = pa.array([brute.rings(ring, hole)], POLYGON)
    for k, r in _grid(20, 0.1):
        want = kernels.shared_areas(pa.array([r], POLYGON), whole)[0]
        assert got.get((k, "a"), 0.0) == pytest.approx(want, abs=1e-9)
        assert got.get((k, "b"), 0.0) == pytest.approx(0.005 if k % 20 == 0 else 0.0, abs=1e-9)
    assert sum(v for (_, s), v in got.items() if s == "a") == pytest.approx(math.pi * (0.81 - 0.16), rel=1e-4)
    assert overlays.pieces(land, "o_rings").select(F.max(overlays.point_count(F.col("o_rings")))).first()[0] <= overlays.PIECE_POINTS


def test_few_pairs_reach_the_kernel():
    boxes = np.array([[-0.1, -0.1, 0.1, 0.1], [0.9, -0.1, 1.1, 0.1], [2.0, 2.0, 2.1, 2.1], [-0.9, 0.8, -0.8, 0.9], [-0.05, -0.02, 0.02, 0.05]])
    shape = brute.rings(_circle(500), _circle(100, r=0.2)[::-1])
    border, inside = kernels.border_pairs(boxes, pa.array([shape] * 5, POLYGON))
    assert border.tolist() == [False, True, False, False, False] and not inside.any()
    border, inside = kernels.border_pairs(np.array([[0.4, 0.1, 0.5, 0.2], [-0.6, -0.3, -0.5, 0.3]]), pa.array([shape] * 2, POLYGON))
    assert not border.any() and inside.all()


def test_shares_of_large_overlays_equal_those_of_whole_ones(spark):
    grid = spark.createDataFrame(_grid(6, 0.4), f"cell bigint, c_rings {SHAPE}")
    rows = [(1, "s", "protected_area", "k", "l", 1, brute.rings(_circle(4_000, 1.2, 1.2, 0.8))), (2, "s", "protected_area", "k", "l", 1, brute.rings(_circle(50, 0.3, 0.3, 0.2)))]
    land = spark.createDataFrame(rows, f"piece_id bigint, source_id string, layer string, layer_key string, level string, level_rank int, o_rings {SHAPE}")
    got = {r["cell"]: r["pct"] for r in cells.overlay_shares(grid, land, "cell", "c_rings").collect()}
    for k, shape in _grid(6, 0.4):
        area = sum(kernels.shared_areas(pa.array([shape], POLYGON), pa.array([r[-1]], POLYGON))[0] for r in rows)
        assert got.get(k, 0.0) == pytest.approx(min(100.0, area / 0.16 * 100), abs=1e-3)
