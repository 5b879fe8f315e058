"""Differences between two cuts, their rollups, and alerts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.functions.kernels import overlap_area
from landgrid.operators import spatial
from landgrid.operators.skew import shuffled

COMPARED = ["area_reported_m2", "built_area_m2", "economic_use", "cadastral_value", "address"]
CHANGE_TYPES = ["created", "removed", "attrs_changed", "geometry_changed", "building_added"]
SAME_SHAPE_IOU = 0.98


def parcel_changes(old: DataFrame, new: DataFrame, key: str = "npn", compared: list[str] | None = None) -> DataFrame:
    """Rows ``key, change_type, detail`` for two cuts of the same table.

    One full outer join on the key yields every kind of change: parcels on one
    side only, and pairs with a compared column that differs, NULLs included.
    When both sides carry ``rings``, pairs of different shape with an overlap
    ratio below the limit are geometry changes and carry ``geom_iou``.
    """
    names = [c for c in (compared or COMPARED) if c in old.columns and c in new.columns]
    shown = [c for c in ("area_m2", "economic_use", "zone") if c in old.columns and c in new.columns]
    shaped = "rings" in old.columns and "rings" in new.columns
    kept = [*dict.fromkeys([*names, *shown, *(["rings"] if shaped else [])])]
    a = old.select(F.col(key), F.struct(*kept).alias("o"))
    b = new.select(F.col(key), F.struct(*kept).alias("n"))
    # A filter on one kind of change may turn this into a join that Spark would broadcast.
    both = a.join(shuffled(b), key, "full_outer")
    paired = F.col("o").isNotNull() & F.col("n").isNotNull()

    def whole(side: str) -> Column:
        return F.to_json(F.struct(*[F.col(f"{side}.{c}") for c in shown]))

    changed = F.lit(False)
    for c in names:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    pair = [
        F.when(
            ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")),
            F.struct(F.col(f"o.{c}").alias("from"), F.col(f"n.{c}").alias("to")),
        ).alias(c)
        for c in names
    ]
    kinds = [
        F.when(F.col("o").isNull(), F.struct(F.lit("created").alias("t"), whole("n").alias("d"))),
        F.when(F.col("n").isNull(), F.struct(F.lit("removed").alias("t"), whole("o").alias("d"))),
        F.when(paired & changed, F.struct(F.lit("attrs_changed").alias("t"), F.to_json(F.struct(*pair)).alias("d"))),
    ]
    attribute = both.select(key, F.explode(F.array_compact(F.array(*kinds))).alias("c")).select(
        key, F.col("c.t").alias("change_type"), F.col("c.d").alias("detail"),
        F.lit(None).cast("double").alias("geom_iou"),
    )
    if not shaped:
        return attribute
    differs = (F.col("o.rings") != F.col("n.rings")) & F.col("o.rings").isNotNull() & F.col("n.rings").isNotNull()
    area_o, area_n = geo.area(F.col("o.rings")), geo.area(F.col("n.rings"))
    shape = (
        both.where(paired & differs)
        .withColumn("_shared", overlap_area(F.col("o.rings"), F.col("n.rings")))
        .withColumn("geom_iou", spatial.iou(F.col("_shared"), area_o, area_n))
        .where(F.coalesce("geom_iou", F.lit(0.0)) < SAME_SHAPE_IOU)
        .select(
            key, F.lit("geometry_changed").alias("change_type"),
            F.to_json(F.struct(F.round(area_o, 2).alias("areaFrom"), F.round(area_n, 2).alias("areaTo"))).alias("detail"),
            "geom_iou",
        )
    )
    return attribute.unionByName(shape)


def building_changes(old: DataFrame, new: DataFrame, removed: bool = False) -> DataFrame:
    """Buildings only in the new cut; with ``removed`` also those only in the old one.

    A building is its parcel and reference; NULL references match each other.
    """
    keys = ["parcel_key", "building_ref"]

    def only(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = (F.col("parcel_key") == F.col("_parcel_key")) & F.col("building_ref").eqNullSafe(F.col("_building_ref"))
        return left.join(r, same, "left_anti").withColumn("change_type", F.lit(kind))

    out = only(new, old, "building_added")
    return out.unionByName(only(old, new, "building_removed")) if removed else out


def change_summary(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Changes per type, one column per type."""
    counts = [F.count_if(F.col("change_type") == c).alias(c) for c in CHANGE_TYPES]
    return changes.groupBy(*(keys or [])).agg(*counts)


def municipality_dynamics(changes: DataFrame) -> DataFrame:
    """Changes per municipality and pair of cuts, one column per type."""
    keys = ["muni_code", "from_snapshot", "to_snapshot"]
    table = changes.groupBy(*keys).pivot("change_type", CHANGE_TYPES).count()
    return table.fillna(0, CHANGE_TYPES)


def merge_dynamics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of dynamics rows; the new row replaces the old one."""
    keys = ["muni_code", "from_snapshot", "to_snapshot"]
    return old.join(new, keys, "left_anti").unionByName(new)


def changes_in_areas(changes: DataFrame, scopes: DataFrame, change_id: str, types: list[str] | None = None) -> DataFrame:
    """Changes whose point falls in a scope, with ``scope_id``.

    Rows without a place cannot be ruled out of any scope; they come once, with
    a NULL scope.
    """
    wanted = changes.where(F.col("change_type").isin(types)) if types else changes
    placed = spatial.points_in_polygons(wanted, scopes, change_id, rings="scope_rings").drop("scope_rings")
    unplaced = wanted.where("lng is null").withColumn("scope_id", F.lit(None).cast("string"))
    return placed.unionByName(unplaced.select(placed.columns))


def parcel_history(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes with the dates of both cuts."""
    dates = snapshots.select("snapshot_id", "cut_date")
    old = dates.select(F.col("snapshot_id").alias("from_snapshot"), F.col("cut_date").alias("from_cut"))
    new = dates.select(F.col("snapshot_id").alias("to_snapshot"), F.col("cut_date").alias("to_cut"))
    return changes.join(old, "from_snapshot", "left").join(new, "to_snapshot")


def parcel_series(parcels: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Area per readable cut of each key with the change since the cut before."""
    cuts = snapshots.where(F.col("status").isin("published", "superseded")).select("snapshot_id", "cut_date")
    order = Window.partitionBy(key).orderBy("cut_date", "area_m2")
    return (
        parcels.join(cuts, "snapshot_id")
        .withColumn("area_delta_m2", F.round(F.col("area_m2") - F.lag("area_m2").over(order), 2))
        .select(key, "cut_date", "area_m2", "area_delta_m2")
    )


def evaluate_alerts(alerts: DataFrame, changes: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Alerts with something to report.

    ``alerts`` has ``alert_id, kind, muni_code, npn, dataset_id``. Kinds:
    parcel_change and area_change count changes of the parcel or municipality,
    new_buildings counts added buildings, new_cut names a dataset's newest cut
    and is left out without ``cuts``.
    Changes are counted per key before they meet the alerts.
    """
    by_npn = changes.groupBy("npn").agg(F.count(F.lit(1)).alias("n"))
    by_muni = changes.groupBy("muni_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("change_type") == "building_added").alias("built")
    )
    base = alerts.select("alert_id", "kind", "muni_code", "npn", "dataset_id")
    parcel = base.where("kind = 'parcel_change'").join(by_npn, "npn").select("alert_id", "kind", "n")
    area = base.where("kind = 'area_change'").join(by_muni, "muni_code").select("alert_id", "kind", "n")
    built = base.where("kind = 'new_buildings'").join(by_muni, "muni_code").select(
        "alert_id", "kind", F.col("built").alias("n")
    )
    out = parcel.unionByName(area).unionByName(built)
    if cuts is not None:
        cut = base.where("kind = 'new_cut'").join(cuts.where("from_id is not null"), "dataset_id")
        out = out.unionByName(cut.select("alert_id", "kind", F.lit(1).cast("bigint").alias("n")))
    return out.where("n > 0")
