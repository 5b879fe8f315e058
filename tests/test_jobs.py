import glob

from pyspark.sql import functions as F

from landgrid.operators import changes, usage
from landgrid.registry.base import Tables
from landgrid.sources import writers
from landgrid.streaming import usage as streams

SF = "/root/testdata/sf0.001"


def test_registry_is_complete(spark):
    import __spark_entry__ as entry

    builders, oracles = entry.queries(), entry.oracle_sql()
    assert len(builders) > 170 and set(oracles) <= set(builders)
    assert entry.entry(spark).count() == 25


def test_change_kinds_and_missing_values(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None), ("c", None, "z")], "npn string, built_area_m2 double, economic_use string")
    new = spark.createDataFrame([("b", 2.0, None), ("c", 3.0, "z"), ("d", 4.0, "w")], "npn string, built_area_m2 double, economic_use string")
    got = {(r.npn, r.change_type): r.detail for r in changes.parcel_changes(old, new).collect()}
    assert set(got) == {("a", "removed"), ("c", "attrs_changed"), ("d", "created")}
    assert '"to":3.0' in got["c", "attrs_changed"] and "economic_use" not in got["c", "attrs_changed"]


def test_buildings_without_reference_match_each_other(spark):
    old = spark.createDataFrame([(1, None), (2, 1)], "parcel_key int, building_ref int")
    new = spark.createDataFrame([(1, None), (2, 2)], "parcel_key int, building_ref int")
    got = changes.building_changes(old, new, removed=True).collect()
    assert sorted((r.parcel_key, r.building_ref, r.change_type) for r in got) == [(2, 1, "building_removed"), (2, 2, "building_added")]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = Tables(spark, SF).usage
    twice = events.unionByName(events.where("event_id % 20 = 0"))
    twice.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))
    once = streams.charge_once(stream).select("event_id", "amount")
    streams.run_to_table(once, str(tmp_path / "once"), str(tmp_path / "log1"))
    got = spark.read.parquet(str(tmp_path / "once"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, usage.charge_once(twice).select("event_id", "amount").collect()))
    for _ in range(2):  # a second run finds nothing new and adds nothing
        streams.monthly_usage(stream, str(tmp_path / "months"), str(tmp_path / "log2")).awaitTermination()
    months = streams.read_monthly_usage(spark.read.parquet(str(tmp_path / "months")))
    batch = twice.groupBy("org_id", "metric", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.sum("amount").alias("used"))
    assert sorted(map(tuple, months.collect())) == sorted(map(tuple, batch.collect()))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None, 1.5), ("c", "x", None)], "t string, n string, v double")
    writers.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["note"])
    raw = open(glob.glob(str(tmp_path / "csv" / "part-*.txt"))[0], "rb").read().decode("utf-8")
    assert raw == '﻿# note\r\nt;n;v\r\n"a;b";NO_DISPONIBLE;1.5\r\nc;x;NO_DISPONIBLE\r\n'


def test_rebuilt_cells_add_up(spark):
    """Totals over all cells equal totals over the parcels, and every cell's shares stay within bounds."""
    from landgrid.registry.spatial import rebuild

    t = Tables(spark, SF)
    cells = rebuild(t).cache()
    totals = cells.agg(F.sum("n_parcels").alias("n"), F.round(F.sum("parcel_area_sum_m2"), 2).alias("a"), F.count(F.lit(1)).alias("c"), F.countDistinct("cell").alias("d")).first()
    want = t.parcel.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_m2"), 2).alias("a")).first()
    assert (totals.n, totals.a) == (want.n, want.a) and totals.c == totals.d
    assert cells.where("protected_pct < 0 or protected_pct > 100 or road_access_score < 0 or road_access_score > 100").count() == 0
    assert cells.where("dist_paved_road_m is null and road_access_score <> 0").count() == 0
