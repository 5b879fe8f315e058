"""Shapes of many parts, far neighbours, close values, checksums, cut alerts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.functions import address, geo, pii
from landgrid.functions.kernels import halve
from landgrid.operators import ingest, parcels, privacy, ranking, spatial
from landgrid.session import cut_lineage, scratch
from landgrid.sources import writers
from landgrid.streaming import usage as streams

RINGS = "rings array<array<struct<x:double,y:double>>>"


def square(x, y, side, reverse=False):
    ring = [(float(a), float(b)) for a, b in [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]
    return ring[::-1] if reverse else ring


U_SHAPE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (7.0, 10.0), (7.0, 3.0), (3.0, 3.0), (3.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


@pytest.mark.parametrize(("rings", "area", "parts"), [
    ([square(0, 0, 1), square(5, 5, 2)], 5.0, 2),
    ([square(0, 0, 1, True), square(5, 5, 2, True)], 5.0, 2),
    ([square(0, 0, 10), square(2, 2, 3), square(6, 6, 2, True)], 87.0, 1),
    ([square(3, 3, 1), square(0, 0, 10), square(2, 2, 3)], 92.0, 2),
    ([U_SHAPE, square(4, 5, 2)], 72.0 + 4, 2),
    ([U_SHAPE[:-1], square(1, 1, 1)], 71.0, 1),
])
def test_clean_polygon_keeps_all_parts(spark, rings, area, parts):
    df = spark.createDataFrame([(rings,)], RINGS).select(geo.clean_polygon(F.col("rings")).alias("rings"))
    once = df.select(geo.area(F.col("rings")).alias("a"), "rings", F.size(geo.parts(F.col("rings"))).alias("n")).first()
    assert once.a == pytest.approx(area) and once.n == parts
    again = df.select(geo.clean_polygon(F.col("rings")).alias("rings")).first()
    assert again.rings == once.rings
    line = writers.feature_lines(df, "rings", [], ["s"]).first().value
    shape = json.loads(line)["geometry"]
    assert shape["type"] == "MultiPolygon" and len(shape["coordinates"]) == parts
    assert sum(map(len, shape["coordinates"])) == len(once.rings)


def test_no_shape_left(spark):
    df = spark.createDataFrame([([],), (None,), ([[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]],)], RINGS)
    assert [r[0] for r in df.select(geo.clean_polygon(F.col("rings"))).collect()] == [None, None, None]


def test_parcel_queries_use_the_outline(spark):
    cuts = spark.createDataFrame([(1, True)], "snapshot_id long, is_active boolean")
    rows = [(1, "A", "01", "01001", 1, 5.0, 5.0, [U_SHAPE]), (2, "B", "01", "01001", 1, 5.0, 5.0, [square(4, 4, 2)])]
    own = spark.createDataFrame(rows, f"parcel_key long, npn string, dept_code string, muni_code string, snapshot_id long, lng double, lat double, {RINGS}")
    gap = parcels.ParcelQuery(department="01", within=[square(4, 4, 2)])
    assert [r.npn for r in parcels.filter_parcels(own, cuts, gap).collect()] == ["B"]
    corner = parcels.ParcelQuery(department="01", bbox=(9.0, 9.0, 12.0, 12.0))
    assert [r.npn for r in parcels.filter_parcels(own, cuts, corner).collect()] == ["A"]


def test_nearest_is_found_at_any_distance(spark):
    left = spark.createDataFrame([(1, -75.0, 4.0), (2, -179.0, -40.0), (3, 150.0, 60.0)], "p long, lng double, lat double")
    right = spark.createDataFrame([(7, -60.0, 10.0), (8, 100.0, -30.0), (9, -70.0, -50.0)], "f long, f_lng double, f_lat double")
    found = {r.p: (r.f, r.distance_m) for r in spatial.nearest_anywhere(left, right, "p", "f", left_xy=("lng", "lat"), right_xy=("f_lng", "f_lat")).collect()}

    def metres(a, b, c, d):
        a, b, c, d = np.radians([a, b, c, d])
        return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2))

    for p, x, y in [tuple(r) for r in left.collect()]:
        best = min((metres(x, y, fx, fy), f) for f, fx, fy in [tuple(r) for r in right.collect()])
        assert found[p][0] == best[1] and found[p][1] == pytest.approx(best[0], rel=1e-9)


def test_close_values_spread_over_bands(spark):
    rows = [(k % 2, 2000.0 + (k * 7919 % 5000) / 500) for k in range(5000)]
    df = spark.createDataFrame(rows, "g long, v double")
    counts = cut_lineage(df.groupBy("g", "v").count())
    sizes = ranking.with_bands(counts, ["g"], "v").groupBy("g", "_band").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 60 and sizes[1] > 300
    got = {r.g: r.m for r in ranking.grouped_percentiles(df, ["g"], "v", {"m": 0.3}).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g], 30))


def test_halve():
    ring = np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 2 * np.pi, 5000)])
    pieces = list(halve([ring], 128))
    assert max(sum(map(len, p)) for p in pieces) <= 128
    with pytest.raises(ValueError, match="cannot be cut"):
        list(halve([np.zeros((200, 2))], 128))


def test_checksum_sees_moved_nulls_and_repeats(spark):
    schema = "a string, b string"
    sums = [ingest.row_checksum(spark.createDataFrame(rows, schema)).first().checksum for rows in ([(None, "x")], [("x", None)], [(None, "x")] * 2, [("y", "z"), (None, "x")], [(None, "x"), ("y", "z")])]
    assert len(set(sums[:4])) == 4 and sums[3] == sums[4]


def test_long_texts_are_sanitised(spark):
    text = "w " * 5000 + "a.b@example.org"
    df = spark.createDataFrame([(text, "n")], "texto string, nombre string")
    assert privacy.sanitize(df).first().texto == "[REDACTADO:email]"
    assert pii.name_rule_of("Correo Electrónico") == "exact"


def test_cut_alerts_fire_once(spark, tmp_path):
    schema = "dataset_id string, cut_date string"
    spark.createDataFrame([("a", "2024"), ("a", "2024"), ("b", "2024")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    alerts = spark.createDataFrame([(1, "new_cut", "a"), (2, "new_cut", "b"), (3, "area_change", "a")], "alert_id long, kind string, dataset_id string")

    def run():
        cuts = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.watch_cuts(cuts, alerts, str(tmp_path / "sent"), str(tmp_path / "log")).awaitTermination()
        return sorted((r.alert_id, r.cut_date) for r in spark.read.parquet(str(tmp_path / "sent")).collect())

    assert run() == [(1, "2024"), (2, "2024")]
    spark.createDataFrame([("a", "2024"), ("a", "2025")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, "2024"), (1, "2025"), (2, "2024")]


def test_scratch_drops_its_tables(spark):
    with scratch(spark):
        kept = cut_lineage(spark.range(5))
        assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)exist|file"):
        kept.collect()


@pytest.mark.parametrize(("raw", "canonical"), [
    ("Cra. 45 No 12 - 34 Sur", "CARRERA 45 # 12-34 SUR"),
    ("kr 7 bis N° 45 A-12", "CARRERA 7 BIS # 45A-12"),
    ("Cl 45BIS # 3A - 5 apto 301", "CALLE 45 BIS # 3A-5 APTO 301"),
    ("Ak 68 Nro.13 20", "AVENIDA CARRERA 68 # 13 20"),
    ("Barrio San-Juan Mz 4 Lt 2", "BARRIO SAN-JUAN MANZANA 4 LOTE 2"),
    ("Dg 4 S", "DIAGONAL 4S"),
    ("", ""),
    (None, None),
])
def test_canonical_addresses(spark, raw, canonical):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(address.canonical(F.col("raw"))).first()[0] == canonical
