"""Searches and overlays that settle rows without listing their pairs, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import areas, cells, scoring, spatial
from tests import brute

SEGMENT = "struct<x1:double,y1:double,x2:double,y2:double>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _metres(x, y, s):
    kx, ky = geo.METRES_PER_DEGREE * math.cos(math.radians(y)), geo.METRES_PER_DEGREE
    ax, ay, dx, dy = (s[0] - x) * kx, (s[1] - y) * ky, (s[2] - s[0]) * kx, (s[3] - s[1]) * ky
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(ax + t * dx, ay + t * dy)


def _streets(spark, n=160):
    rng = random.Random(4)
    classes = ["primary", "secondary", "residential", None]
    rows = [("primary", True, (-74.0, 4.0, -74.0, 4.0)), ("primary", None, None)]
    for k in range(n):
        # A crowded place, and a wide one.
        x, y, size = (-74.0, 4.0, 0.002) if k % 2 else (-74.4, 4.2, 0.2)
        p, q = [(x + rng.random() * size, y + rng.random() * size) for _ in range(2)]
        rows.append((classes[k % 4], None if k % 7 == 0 else k % 3 == 0, (*p, *q)))
    return rows, spark.createDataFrame(rows, f"class string, is_paved boolean, segment {SEGMENT}")


def _places(spark, n=120):
    rng = random.Random(5)
    rows = [(k, -74.0 + rng.random() * 0.004, 4.0 + rng.random() * 0.004) if k % 2 else (k, -74.5 + rng.random() * 0.5, 4.1 + rng.random() * 0.4) for k in range(n)]
    # A repeated row, an id at two places, an id without place, one far from everything.
    rows += [rows[1], (2, -74.0, 4.001), (900, None, 4.0), (901, -70.0, 9.0)]
    return rows, spark.createDataFrame(rows, "id long, lng double, lat double")


def _least(places, roads, wanted, reach):
    out = {}
    for k, x, y in places:
        for c, paved, s in roads:
            if s and x is not None and wanted(c, paved) and (m := _metres(x, y, s)) <= reach:
                out[k] = min(out.get(k, m), m)
    return out


def test_points_take_their_least_distances_where_they_meet(spark):
    (streets, roads), (rows, points) = _streets(spark), _places(spark)
    plan = plan_of(spatial.least_distances(points, roads, [2_000.0], "id", {"any_m": F.lit(True)}, ("lng", "lat"), "segment"))
    # Both sides by bucket, what a point has found by its id: no pair is shuffled; and no lambda is run for a pair.
    assert plan.count("Exchange hashpartitioning(_ix") + plan.count("Exchange hashpartitioning(id") <= 4 and "SortAggregate" not in plan
    assert "lambda" not in plan_of(points.select(geo.point_segment_m(F.col("lng"), F.col("lat"), F.lit(None).cast(SEGMENT))))
    got = cells.road_distances(points, roads, "id", ("lng", "lat")).collect()
    assert len(got) == len(rows)
    for name, wanted in (("dist_primary_road_m", lambda c, p: c == "primary"), ("dist_paved_road_m", lambda c, p: p)):
        want = _least(rows, streets, wanted, 15_000)
        assert {r.id: r[name] for r in got if r[name] is not None} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


@pytest.mark.parametrize("crowded", [[], [40.0, 160.0, 640.0]])
def test_road_access_meets_only_kinds_a_point_lacks(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "_crowded_radii", lambda *a, **k: crowded)
    (streets, roads), (rows, points) = _streets(spark), _places(spark)
    got = areas.road_access(points, roads, "id", 9_000.0).collect()
    kinds = {
        "dist_primary_m": lambda c, p: c == "primary", "dist_secondary_m": lambda c, p: c == "secondary",
        "dist_paved_m": lambda c, p: p, "dist_any_m": lambda c, p: True,
    }
    for name, wanted in kinds.items():
        want = _least(rows, streets, wanted, 9_000.0)
        assert {r.id: r[name] for r in got if r[name] is not None} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert {r.id for r in got} == set(_least(rows, streets, lambda c, p: True, 9_000.0)) and len(got) == len({r.id for r in got})


def test_drivers_need_no_rank_beyond_the_best(spark):
    rng = random.Random(6)
    rows = []
    for template in ("gym", "hotel", "tiny", None):
        for k in range(9 if template == "tiny" else 150):
            score = None if k % 11 == 0 else float(rng.randint(0, 9))
            rows.append((template, None if k % 13 == 0 else k, score, k % 7 == 0, [("a", float(rng.randint(0, 99)), 0.5), ("b", None if k % 2 else 3.0, 0.25)]))
    one = "template string, unit long, score double, excluded boolean, factors array<struct<indicator:string,score:double,weight:double>>"
    # A cell that comes twice or three times keeps a row for each of its ranks, as the join gave it.
    for more in ([], rows[20:60] + rows[150:170] + rows[20:30]):
        scored = spark.createDataFrame(rows + more, one).repartition(3)
        want = scoring.ranking_drivers(scoring.rank_cells(scored, "unit", ["template"]), 5).collect()
        best = scoring.rank_cells(scored, "unit", ["template"], most=5)
        assert sorted(map(tuple, scoring.ranking_drivers(best, 5).collect())) == sorted(map(tuple, want))
        every = scoring.rank_cells(scored, "unit", ["template"]).collect()
        show = lambda r: (str(r.template), r.unit if r.unit is not None else -1, r.score or 0, min(r["rank"] or 0, 6))
        assert sorted(map(show, best.collect())) == sorted(map(show, every))
        if not more:
            # Rows with factors are neither shuffled nor sorted.
            assert "SortMergeJoin" not in plan_of(best) and "Exchange hashpartitioning" not in plan_of(best)
    # Without groups all rows are ranked together.
    plain, best = scoring.rank_cells(scored, "unit"), scoring.rank_cells(scored, "unit", most=60)
    assert "n_ranked" not in plain.columns
    assert {(r.unit, r["rank"]) for r in best.where("rank <= 60").collect()} == {(r.unit, r["rank"]) for r in plain.where("rank <= 60").collect()}


def test_worst_hazards_list_few_of_the_sources_that_cover_a_place(spark):
    rng = random.Random(7)
    shape = "array<array<struct<x:double,y:double>>>"
    box = lambda x, y, w, h: brute.rings([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    spot = lambda: (-74.0 + rng.random(), 4.0 + rng.random())
    land = []
    for k in range(240):
        (x, y), w, h = spot(), rng.choice([0.02, 0.3, 1.5]), rng.choice([0.02, 0.3, 1.5])
        rings = brute.rings([(x, y), (x + w, y), (x, y + h)]) if k % 9 == 0 else box(x - w / 2, y - h / 2, w, h)
        rank = rng.choice([None, 0, 2, 3, 4, 5])
        land.append((k % 50, "hazard" if k % 5 else "soil", rng.choice(["flood", "seismic"]), rng.choice([f"l{rank}", "b", None]), rank, rings))
    land.append((300, "hazard", "flood", "x", 9, None))
    land.append((301, "hazard", "flood", "y", 9, box(-80.0, 9.0, 0.5, 0.5)))
    own = [(k, box(*spot(), *rng.choice([(0.004, 0.006), (0.004, 0.006), (0.3, 0.1)]))) for k in range(300)]
    own += [own[0], (301, brute.rings([(-73.9, 4.2), (-73.2, 4.3), (-73.5, 4.9)])), (302, None), (303, box(-60.0, 4.0, 0.1, 0.1))]
    overlays = spark.createDataFrame(land, f"source_id long, layer string, layer_key string, level string, level_rank int, o_rings {shape}")
    shapes = spark.createDataFrame(own, f"id long, rings {shape}")
    every = cells.overlay_shares(shapes, overlays, "id", "rings")
    some = cells.overlay_shares(shapes, overlays, "id", "rings", strongest=True)
    flags = lambda df: {r.id: r.hazard_flags for r in cells.worst_hazards(df, "id").collect()}
    assert flags(some) == flags(every) != {}
    # Hundreds of equal sources around a place make no more pairs than one.
    cover = spark.range(400).selectExpr("id as source_id", "'hazard' as layer", "'flood' as layer_key", "'a' as level", "3 as level_rank")
    cover = cover.withColumn("o_rings", geo.rectangle(F.lit(-75.0), F.lit(3.0), F.lit(-72.0), F.lit(6.0)))
    assert cells.overlay_shares(shapes, cover, "id", "rings").count() > 50 * cells.overlay_shares(shapes, cover, "id", "rings", strongest=True).count()
    nothing = cells.overlay_shares(shapes, cover.limit(0), "id", "rings", strongest=True)
    assert nothing.count() == 0 and nothing.columns == some.columns
