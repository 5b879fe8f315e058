"""Steps that list no pairs of rows where fewer will do, with the results of those that did."""

import re

import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo, pii
from landgrid.operators import areas, cells, privacy, search, spatial, tiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_ranked_by_text_before_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "trigram_pairs", None)  # pairs of rows are never listed
    asked = spark.createDataFrame([(1, "01", "Cra 5 # 3-20"), (1, "01", "Cra 5 # 3-21"), (2, "01", "Cra 5 # 3-20"), (3, None, "Cra 5 # 3-20"), (None, "01", "Cra 5 # 3-20")], "address_id long, muni_code string, raw string")
    labels = [(f"r{k}", "01", "Cra 5 # 3-20") for k in range(4)] + [("r0", "01", "Cra 5 # 3-20"), (None, "01", "Cra 5 # 3-21"), ("far", "02", "Cra 5 # 3-20")]
    parcels = spark.createDataFrame(labels, "ref string, muni_code string, label string")
    points = spark.createDataFrame([("p", "01", "Cra 5 # 3-20")], "ref string, muni_code string, label string")
    rows = search.match_addresses(asked, points, parcels, limit=3).collect()
    got = {(r.address_id, r.place): (r.source, r.ref, r.similarity) for r in rows}
    same = [("address_point", "p", 1.0), ("parcel", "r0", 1.0), ("parcel", "r0", 1.0)]
    assert len(rows) == 9 and [got[2, k] for k in (1, 2, 3)] == same == [got[None, k] for k in (1, 2, 3)]
    # Both texts of the first one count: an equal row of the other text comes before the named parcels.
    assert [got[1, k] for k in (1, 2, 3)] == [("address_point", "p", 1.0), ("parcel", None, 1.0), ("parcel", "r0", 1.0)]


def test_values_are_searched_by_shorter_ways_with_the_same_finds(spark):
    texts = ["", " ", "a@b.co", "x" * 300 + "@b.co and 900.123.456-7", "@b.co", "a@b", "900.123.456-7", "9900123456-7", "call (601) 234 5678", "+57 300 123 4567",
             "3001234567", "13001234567", "1.234.567", "1.234.567,8", "123456", "Ana María Gómez Ruiz", "xAna Luisa Gomez", "Ángela Pérez Ñáñez", "ana luisa",
             "1" * 20, "1" * 30 + "\n", "1" * 30 + " 123456", "2024-01-02 123456", "12.5", None, "{" + "0" * 8 + "-0000-0000-0000-" + "0" * 12 + "}", "y" * 80 + " 3001234567"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    text = F.trim("t")
    skip = text == ""
    for pattern in pii.HARMLESS:
        skip = skip | text.rlike(pattern)
    plain = F.when(skip, None)
    for rule, pattern in pii.VALUE_RULES:
        plain = plain.when(text.rlike(pattern), rule)
    rows = df.select("k", plain.alias("a"), pii.value_rule(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {None, *[rule for rule, _ in pii.VALUE_RULES]}
    clean = privacy.sanitize(df.withColumnRenamed("t", "texto"), ["texto"])
    # The scan of a whole word before the sign, once for each of its letters, is gone.
    assert pii.EMAIL not in plan_of(clean) and re.escape("@") in re.escape(plan_of(clean))


def test_circles_are_drawn_once_and_not_shuffled(spark):
    rows = [(1, 1, "radius", None, -74.0, 4.0, 500.0, None, None, None), (2, 2, "isochrone", None, -74.0, 4.0, None, 15, "walk", None), (3, 3, "municipality", None, None, None, None, None, None, "01")]
    spec = spark.createDataFrame(rows, "scope_id long, position long, kind string, rings array<array<struct<x:double,y:double>>>, lng double, lat double, radius_m double, minutes int, mode string, muni_code string")
    munis = spark.createDataFrame([("02", None)], "muni_code string, rings array<array<struct<x:double,y:double>>>")
    out = areas.scopes_from(spec, munis)
    assert plan_of(out).upper().count("ATAN2") <= 2
    got = {r.scope_id: r for r in out.collect()}
    assert [got[k].warning for k in (1, 2, 3)] == [None, "circle_for_travel_time", "no_outline"]
    ring = got[1].scope_rings[0]
    assert len(ring) == 65 and ring[0] == ring[-1] and len(set(ring)) == 64
    far = out.where("scope_id < 3").select("scope_id", F.explode(F.col("scope_rings")[0]).alias("p")).select("scope_id", geo.haversine_m(F.lit(-74.0), F.lit(4.0), F.col("p.x"), F.col("p.y")).alias("m"))
    assert all(r.m == pytest.approx({1: 500.0, 2: 1125.0}[r.scope_id]) for r in far.collect())


def test_distances_of_points_are_kept_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SAMPLE", 1.0)
    monkeypatch.setattr(spatial, "CROWD", 0.0001)
    points = spark.range(60).select("id", (F.col("id") % 10 * 0.013 - 74).alias("lng"), (F.floor(F.col("id") / 10) * 0.017 + 4).alias("lat"))
    line = lambda k: F.struct((-74.05 + k * 0.003).alias("x1"), (F.lit(3.95) + k * 0.001).alias("y1"), (-73.85 - k * 0.002).alias("x2"), (F.lit(4.2) - k * 0.005).alias("y2"))
    roads = spark.range(40).select(F.lit("primary").alias("class"), F.lit(True).alias("is_paved"), line(F.col("id")).alias("segment"))
    out = cells.road_distances(points, roads, "id", ("lng", "lat"))
    assert "min(struct" not in plan_of(out)
    every = points.crossJoin(roads).withColumn("m", geo.point_segment_m(F.col("lng"), F.col("lat"), F.col("segment")))
    want = {r.id: r.m for r in every.groupBy("id").agg(F.min("m").alias("m")).collect()}
    assert {r.id: r.dist_paved_road_m for r in out.collect()} == want


@pytest.mark.parametrize("bound", [1_000_000, 300])
def test_runs_stay_with_their_shape(spark, monkeypatch, bound):
    monkeypatch.setattr(tiles, "RUNS_A_TASK", bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corner = lambda dx, dy: F.struct((F.col("id") * 0.01 - 74 + dx).alias("x"), (F.lit(4.0) + dy).alias("y"))
        k = F.when(F.col("id") == 0, 2.0).otherwise(1.0)
        ring = F.array(corner(-0.04 * k, -0.03 * k), corner(0.05 * k, -0.01 * k), corner(-0.01 * k, 0.04 * k), corner(-0.04 * k, -0.03 * k))
        shapes = spark.range(30).select(F.concat(F.lit("n"), "id").alias("npn"), F.array(ring).alias("rings"))
        out = tiles.assign_tiles(shapes, "parcel", "npn", "rings", [14, 16])
        if bound > 300:
            # One shuffle of the shapes and one of the names that join their runs.
            assert plan_of(out).count("Exchange hashpartitioning") == 2
        got = {tuple(r) for r in out.select("npn", "z", "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = shapes.select("npn", "rings", F.explode(F.array(F.lit(14), F.lit(16))).alias("z"))
    plain = tiles.covering_runs(rows.withColumn("id", F.concat_ws(":", "npn", "z")), "id", "rings")
    want = {(r.id.split(":")[0], r.z, x, r.y) for r in plain.collect() for x in range(r.low, r.high + 1)}
    assert got == want and len(got) == out.count()
