"""Steps whose rows grow with the tables: no broadcast of exploded rows, no kernel and no shuffle for plain pairs."""

import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import areas, cells, scoring, snapshots, spatial
from landgrid.plans import dossiers
from landgrid.registry import load
from landgrid.registry.base import Tables
from tests import brute

SHAPE = geo.POLYGON_TYPE


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def squares(spark, n, name, half=0.05):
    x, y = F.col("id") % 10 * 0.1 - 74, F.floor(F.col("id") / 10) * 0.1 + 4
    rings = geo.rectangle(x - half, y - half, x + half, y + half)
    return spark.range(n).select(F.col("id").alias(f"{name}_id"), rings.alias(f"{name}_rings"))


def points(spark, n):
    return spark.range(n).select(F.col("id").alias("p_id"), (F.col("id") % 10 * 0.1 - 74).alias("lng"), (F.floor(F.col("id") / 10) * 0.1 + 4).alias("lat"))


def test_changed_shapes_are_not_broadcast(spark, tmp_path):
    rows = [(k, f"n{k}", "b", "t", k % 7 + 1, float(k)) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = load()["geometry_changes"].build(Tables(spark, str(tmp_path)))
    assert "BroadcastExchange" not in plan_of(out)
    assert 0 < out.count() <= 60


def test_polygons_around_points_are_not_broadcast(spark):
    blocks = squares(spark, 50, "b").withColumn("b_area", geo.area(F.col("b_rings")))
    out = spatial.smallest_holder(points(spark, 50), blocks, "p_id", "b_id", "b_area", rings="b_rings")
    assert "SortMergeJoin" in plan_of(out)
    assert {(r.p_id, r.b_id) for r in out.collect()} == {(k, k) for k in range(50)}


def test_pairs_of_points_and_holders_are_not_sorted(spark):
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]
    shapes = [("b", 4.0, box(0.0, 0.0, 2.0)), ("a", 4.0, box(0.0, 0.0, 2.0)), ("a", 4.0, box(0.0, 0.0, 2.0)), ("c", 1.0, box(1.0, 1.0, 1.0)),
              ("t", 0.5, [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]), ("h", 0.25, [*box(3.0, 0.0, 1.0), [(3.25, 0.25), (3.25, 0.75), (3.75, 0.75), (3.75, 0.25), (3.25, 0.25)]]),
              ("u", None, box(5.0, 0.0, 1.0)), ("v", 0.1, box(5.0, 0.0, 1.0)), (None, 0.2, box(7.0, 0.0, 1.0)), ("w", 0.2, box(7.0, 0.0, 1.0)), ("n", 0.0, None)]
    flat = spark.createDataFrame(shapes, f"b_id string, b_area double, b_rings {SHAPE}")
    spots = [(k, x / 4, y / 4) for k, (x, y) in enumerate((x, y) for x in range(-1, 34) for y in range(-1, 10))]
    at = spark.createDataFrame([*spots, (None, 0.5, 0.5), (None, 1.5, 1.5), (7000, None, 1.0), (7001, 0.25, 0.25), (7001, 0.25, 0.25)], "p_id long, lng double, lat double")
    out = spatial.smallest_holder(at, flat, "p_id", "b_id", "b_area", rings="b_rings")
    # A sorting aggregate keeps all pairs of a task, a hash map a number a point.
    assert "SortAggregate" not in plan_of(out)
    order = lambda r: (r.b_area is not None, r.b_area, r.b_id is not None, r.b_id)
    held = {}
    for r in spatial.points_in_polygons(at, flat, "p_id", rings="b_rings").collect():
        held[r.p_id] = min(held.get(r.p_id, r), r, key=order)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(held) and dict(got) == {k: r.b_id for k, r in held.items()}
    assert set(dict(got).values()) == {"a", "c", "t", "h", "u", None}
    empty = spatial.smallest_holder(at, flat.where("false"), "p_id", "b_id", "b_area", rings="b_rings")
    assert empty.columns == ["p_id", "b_id"] and empty.count() == 0
    assert "b_rings" in spatial.points_in_polygons(at, flat.where("false"), "p_id", rings="b_rings").columns


def test_road_pieces_around_points_are_not_broadcast(spark):
    roads = spark.range(5).select(
        F.lit("primary").alias("class"), F.lit(True).alias("is_paved"),
        F.struct(F.lit(-74.0).alias("x1"), (F.col("id") * 0.1 + 4.01).alias("y1"), F.lit(-73.1).alias("x2"), (F.col("id") * 0.1 + 4.01).alias("y2")).alias("segment"))
    met = spatial.within_distance(points(spark, 50), roads, 2000.0, "p_id", ("lng", "lat"), right_segment="segment")
    assert "SortMergeJoin" in plan_of(met)
    got = areas.road_access(points(spark, 50), roads, "p_id").collect()
    assert len(got) == 50 and all(r.dist_any_m == pytest.approx(0.01 * geo.METRES_PER_DEGREE, rel=1e-3) for r in got)


def test_covered_cells_are_not_broadcast(spark):
    b = squares(spark, 20, "b")
    covered = spatial.polygon_cells(b, "b_rings", 7).select("cell").distinct()
    heights = covered.select("cell", F.lit(2.0).alias("elevation_mean_m"), F.lit(1.0).alias("slope_mean_pct"), F.lit(3.0).alias("slope_max_pct"))
    out = cells.relief(b, heights, "b_id", "b_rings", 7)
    assert "BroadcastExchange" not in plan_of(out)
    assert {(r.b_id, r.elevation_mean_m, r.slope_max_pct) for r in out.collect()} == {(k, 2.0, 3.0) for k in range(20)}


def test_dossiers_list_their_overlaps_once(spark):
    parcels = squares(spark, 4, "b").selectExpr("b_id as parcel_key", "cast(b_id as string) as npn", "b_rings as rings", "-74D as lng", "4D as lat", "1D as area_m2", "1D as area_reported_m2", "'01' as muni_code")
    layers = squares(spark, 2, "b").selectExpr("'hazard' as kind", "concat('k', b_id) as code", "cast(null as string) as label", "b_rings as l_rings")
    near = spark.createDataFrame([(1, -74.0, 4.0)], "id long, f_lng double, f_lat double")
    roads = spark.createDataFrame([("primary", True, (-74.0, 4.0, -73.9, 4.0))], "class string, is_paved boolean, segment struct<x1:double,y1:double,x2:double,y2:double>")
    moved = spark.createDataFrame([("1",)], "npn string")
    managed = spark.createDataFrame([("01", "01", "covered")], "muni_code string, dept_code string, coverage_status string")
    out = dossiers.parcel_dossiers(parcels, layers, {"poi": near}, roads, moved, managed, {"hazard": "hazard"})
    listed = plan_of(out.select("parcel_key", "hazard", "n_overlaps", "max_overlap_pct"))
    assert listed.count(", Inner, ((") <= 1
    got = {r.parcel_key: (r.hazard, r.n_overlaps, r.max_overlap_pct) for r in out.collect()}
    assert got == {0: ("k0", 1, 100.0), 1: ("k1", 1, 100.0), 2: (None, 0, None), 3: (None, 0, None)}


def test_rectangles_share_a_box_and_other_shapes_meet_the_kernel(spark):
    a, b = squares(spark, 30, "a", 0.06), squares(spark, 30, "b", 0.03)
    plain = spatial.polygon_overlaps(a, b, "a_id", "a_rings", "b_rings")
    assert "ArrowEvalPython" not in plan_of(plain)
    # From another corner, clockwise, with an extra point, slanting, in two parts.
    x, y = -74.0, 4.0
    box = [(x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y + 0.1)]
    shapes = [box, box[1:] + box[:1], [*box[:2], (x + 0.1, y + 0.05), *box[2:]], [(x, y), (x + 0.1, y), (x + 0.05, y + 0.1)]]
    rows = [(k, brute.rings(s)) for k, s in enumerate(shapes)] + [(9, brute.rings(box, [(x + 1, y), (x + 1.1, y), (x + 1.1, y + 0.1), (x + 1, y + 0.1)])), (10, None), (11, [])]
    some = spark.createDataFrame(rows, f"a_id long, a_rings {SHAPE}")
    assert [r[0] for r in some.orderBy("a_id").select(geo.is_rectangle(F.col("a_rings"))).collect()] == [True, True, False, False, False, False, False]
    got = {(r.a_id, r.b_id): r.overlap for r in spatial.polygon_overlaps(some, b, "a_id", "a_rings", "b_rings").collect()}
    own = {k: [(p.x, p.y) for p in r[0][:-1]] for k, r in b.collect()}
    for k, s in enumerate(shapes):
        for j, q in own.items():
            want = brute.convex_overlap(s, q)
            assert got.get((k, j), 0.0) == pytest.approx(want, abs=1e-12)
    assert not {10, 11} & {k for k, _ in got}


def test_shares_of_single_rows_are_not_added_up(spark):
    fields = ["layer", "layer_key", "level", "level_rank"]
    land = squares(spark, 30, "o", 0.06).selectExpr("o_id as source_id", "'protected_area' as layer", "'k' as layer_key", "'x' as level", "1 as level_rank", "o_rings")
    grid = squares(spark, 30, "c", 0.05)
    out = cells.overlay_shares(grid, land, "c_id", "c_rings")
    assert "HashAggregate(keys=[c_id" not in plan_of(out)
    # Two rows of a source, and of a key, and keys without a name add up as before.
    twice = land.unionByName(land.where("source_id = 3")).withColumn("source_id", F.when(F.col("source_id") > 5, F.col("source_id")))
    keyed = grid.unionByName(grid.where("c_id = 7")).withColumn("c_id", F.when(F.col("c_id") > 1, F.col("c_id")))
    got = cells.overlay_shares(keyed, twice, "c_id", "c_rings").collect()
    s = keyed.withColumn("_area", geo.area(F.col("c_rings")))
    pairs = spatial.polygon_overlaps(s.withColumn("_n", F.monotonically_increasing_id()), twice, "_n", "c_rings", "o_rings")
    want = pairs.groupBy("c_id", "source_id", *fields).agg(F.sum("overlap").alias("o"), F.first("_area").alias("a")).select("c_id", "source_id", spatial.overlap_pct(F.col("o"), F.col("a")).alias("pct")).collect()
    order = lambda rows: sorted((str(r.c_id), str(r.source_id), round(r.pct, 2)) for r in rows)
    assert order(got) == order(want)


def test_ranking_drivers_do_not_gather_a_template_in_one_task(spark):
    rows = [("hotel" if k % 2 else "gym", k // 2 + 1, [("a", float(k), 0.5), ("b", 1.0, 0.5)]) for k in range(60)]
    ranked = spark.createDataFrame(rows, "template string, rank long, factors array<struct<indicator:string,score:double,weight:double>>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scoring.ranking_drivers(ranked)
        assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
        got = {(r.template, r.indicator): (r.top_mean, r.overall_mean) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {("gym", "a"): (2.0, 29.0), ("gym", "b"): (1.0, 1.0), ("hotel", "a"): (3.0, 30.0), ("hotel", "b"): (1.0, 1.0)}


def test_rows_of_active_cuts_stay_where_they_are(spark):
    facts = spark.range(40).select("id", (F.col("id") % 4).alias("snapshot_id"))
    cuts = spark.createDataFrame([(1, True), (2, False), (3, True), (3, True), (None, True)], "snapshot_id long, is_active boolean")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = snapshots.active_rows(facts, cuts)
        assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
        assert {r.id for r in out.collect()} == {k for k in range(40) if k % 4 in (1, 3)} and out.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
