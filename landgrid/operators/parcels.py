"""Declarative parcel queries, municipality rollups and coverage."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import codes, geo
from landgrid.functions.text import fold, jaccard, trigrams
from landgrid.operators import spatial
from landgrid.operators.snapshots import active_rows

# Public names of filters and sort keys and the columns they mean.
FILTERS = {"area_m2": "area_m2", "built_area_m2": "built_area_m2", "cadastral_value": "cadastral_value"}
SORTS = {**FILTERS, "npn": "npn"}
TEXT_FILTERS = ["sector", "neighborhood", "block_or_vereda"]
ZONES = {"urbano": "01", "rural": "02"}
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
ADDRESS_SIMILARITY = 0.30


@dataclass
class Near:
    """Parcels with (or, inverted, without) a feature of a layer within reach."""

    layer: str
    max_m: float
    classes: list[str] = field(default_factory=list)
    invert: bool = False


@dataclass
class ParcelQuery:
    department: str | None = None
    municipality: str | None = None
    cut_date: str | None = None
    zone: str | None = None
    ranges: dict[str, dict[str, float]] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)
    economic_use: list[str] = field(default_factory=list)
    address_like: str | None = None
    has_building: bool | None = None
    floors: dict[str, float] = field(default_factory=dict)
    homogeneous_zone: list[str] = field(default_factory=list)
    bbox: tuple[float, float, float, float] | None = None
    within: list | None = None
    near: list[Near] = field(default_factory=list)
    sort: str = "area_m2:desc"
    limit: int = 100
    cursor: str | None = None

    def check(self) -> None:
        if not (self.department or self.municipality):
            raise ValueError("a query needs a department or a municipality")
        for name, bounds in [*self.ranges.items(), ("floors", self.floors)]:
            if name != "floors" and name not in FILTERS:
                raise ValueError(f"unknown filter {name}")
            if not set(bounds) <= set(COMPARISONS) or (name != "floors" and not bounds):
                raise ValueError(f"bad range for {name}")
        if not set(self.texts) <= set(TEXT_FILTERS):
            raise ValueError("unknown text filter")
        key, _, direction = self.sort.partition(":")
        if key not in SORTS or direction not in ("", "asc", "desc"):
            raise ValueError(f"cannot sort by {self.sort}")
        if any(n.max_m <= 0 for n in self.near):
            raise ValueError("near clauses need a positive distance")
        if self.limit <= 0:
            raise ValueError("bad limit")


def in_range(col: Column, bounds: dict[str, float]) -> Column:
    """All given comparisons hold."""
    out = F.lit(True)
    for name, value in bounds.items():
        out = out & COMPARISONS[name](col, F.lit(value))
    return out


def has_building(built: Column, wanted: bool) -> Column:
    any_built = F.coalesce(built, F.lit(0.0)) > 0
    return any_built if wanted else ~any_built


def encode_cursor(value, npn: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, npn]).encode()).decode()


def decode_cursor(cursor: str) -> tuple:
    try:
        value, npn = json.loads(base64.urlsafe_b64decode(cursor))
    except Exception as error:
        raise ValueError("bad cursor") from error
    return value, npn


def after_cursor(sort: Column, npn: Column, descending: bool, cursor: str) -> Column:
    """Rows after the cursor in (value, npn) order with NULL values last."""
    value, key = decode_cursor(cursor)
    later_key = npn < key if descending else npn > key
    if value is None:
        return sort.isNull() & later_key
    later = sort < value if descending else sort > value
    return sort.isNull() | later | ((sort == value) & later_key)


def in_scope(parcels: DataFrame, snapshots: DataFrame, q: ParcelQuery) -> DataFrame:
    """Parcels of the mandatory scope and cut; a municipality implies its department."""
    if q.municipality:
        parcels = parcels.where(
            (F.col("dept_code") == q.municipality[:2]) & (F.col("muni_code") == q.municipality)
        )
    else:
        parcels = parcels.where(F.col("dept_code") == q.department)
    if q.cut_date:
        cuts = snapshots.where(F.col("cut_date") == F.lit(q.cut_date).cast("date"))
        return parcels.join(cuts.select("snapshot_id"), "snapshot_id", "left_semi")
    return active_rows(parcels, snapshots)


def filter_parcels(
    parcels: DataFrame,
    snapshots: DataFrame,
    q: ParcelQuery,
    layers: dict[str, DataFrame] | None = None,
    buildings: DataFrame | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """All parcels the query asks for, without order or limit.

    Parcels carry their outline as ``rings``. ``layers`` holds near layers with ``f_lng, f_lat`` (or ``segment``) and
    ``category``; ``zones`` has ``zone_code, zone_rings``. Cheap column filters
    come first, then the spatial semi joins on what is left.
    """
    q.check()
    df = in_scope(parcels, snapshots, q)
    if q.zone:
        df = df.where(F.col("zone") == ZONES[q.zone])
    for name, bounds in q.ranges.items():
        df = df.where(in_range(F.col(FILTERS[name]), bounds))
    for name, value in q.texts.items():
        df = df.where(F.col(name) == value)
    if q.economic_use:
        df = df.where(fold(F.col("economic_use")).isin([u.upper() for u in q.economic_use]))
    if q.address_like:
        wanted = trigrams(F.lit(q.address_like))
        df = df.where(jaccard(trigrams(F.col("address")), wanted) >= ADDRESS_SIMILARITY)
    if q.has_building is not None:
        df = df.where(has_building(F.col("built_area_m2"), q.has_building))
    if q.bbox:
        xmin, ymin, xmax, ymax = q.bbox
        own = geo.box(F.col("rings"))
        df = df.where(
            (own["xmin"] <= xmax) & (own["xmax"] >= xmin) & (own["ymin"] <= ymax) & (own["ymax"] >= ymin)
        )
    if q.floors:
        tall = buildings.where(in_range(F.col("floors"), q.floors)).select("parcel_key", "snapshot_id")
        df = df.join(tall, ["parcel_key", "snapshot_id"], "left_semi")
    if q.homogeneous_zone:
        wanted = zones.where(F.col("zone_code").isin(q.homogeneous_zone))
        df = _touching(df, wanted, "zone_rings")
    if q.within is not None:
        shape = ", ".join(
            "array(" + ", ".join(f"named_struct('x', double({x}), 'y', double({y}))" for x, y in ring) + ")"
            for ring in q.within
        )
        scope = df.sparkSession.range(1).select(F.expr(f"array({shape})").alias("scope_rings"))
        df = _touching(df, scope, "scope_rings")
    for clause in q.near:
        layer = layers[clause.layer]
        if clause.classes:
            layer = layer.where(F.col("category").isin(clause.classes))
        shape = {"right_segment": "segment"} if "segment" in layer.columns else {"right_xy": ("f_lng", "f_lat")}
        df = spatial.near(df, layer, clause.max_m, "parcel_key", clause.invert, left_xy=("lng", "lat"), **shape)
    return df


def _touching(parcels: DataFrame, shapes: DataFrame, rings: str) -> DataFrame:
    """Parcels whose outline shares surface with any of the shapes."""
    own = parcels.select("parcel_key", F.col("rings").alias("_own"))
    hits = spatial.polygon_overlaps(own, shapes.select(rings), "parcel_key", "_own", rings)
    return parcels.join(hits.select("parcel_key").distinct(), "parcel_key", "left_semi")


def query_parcels(parcels: DataFrame, snapshots: DataFrame, q: ParcelQuery, **sources) -> DataFrame:
    """One page of matching parcels and one row more when another page follows."""
    df = filter_parcels(parcels, snapshots, q, **sources)
    key, _, direction = q.sort.partition(":")
    sort, descending = F.col(SORTS[key]), direction != "asc"
    if q.cursor:
        df = df.where(after_cursor(sort, F.col("npn"), descending, q.cursor))
    if descending:
        return df.orderBy(sort.desc_nulls_last(), F.col("npn").desc()).limit(q.limit + 1)
    return df.orderBy(sort.asc_nulls_last(), F.col("npn")).limit(q.limit + 1)


def count_parcels(parcels: DataFrame, snapshots: DataFrame, q: ParcelQuery) -> DataFrame:
    """One row with the number of parcels in the scope and shape; other filters do not count."""
    scope = ParcelQuery(q.department, q.municipality, q.cut_date, within=q.within)
    return filter_parcels(parcels, snapshots, scope).agg(F.count(F.lit(1)).alias("n"))


def with_names(parcels: DataFrame, municipalities: DataFrame, departments: DataFrame) -> DataFrame:
    """Parcels with municipality and department names; both name tables are small."""
    return parcels.join(municipalities.select("muni_code", "muni_name"), "muni_code").join(
        departments.select("dept_code", "dept_name"), "dept_code"
    )


def by_old_code(searched: DataFrame, parcels: DataFrame) -> DataFrame:
    """Parcels whose twenty-digit old code equals the digits of a search text."""
    wanted = searched.select("query", codes.digits(F.col("query")).alias("npn_old")).where(
        codes.is_old_code(F.col("query"))
    )
    return wanted.join(parcels, "npn_old")


def units_of(parcels: DataFrame) -> DataFrame:
    """Units of shared buildings next to the code of the whole parcel."""
    unit = codes.is_unit(F.col("npn"))
    return parcels.where(unit).withColumn("matrix_npn", codes.matrix_code(F.col("npn")))


def municipality_summary(
    municipalities: DataFrame,
    departments: DataFrame,
    managers: DataFrame,
    parcels: DataFrame,
    schools: DataFrame,
    health: DataFrame,
    snapshots: DataFrame,
) -> DataFrame:
    """One row per municipality; children are counted per municipality before they join."""
    counted = (
        active_rows(parcels, snapshots)
        .groupBy("muni_code")
        .agg(
            F.count(F.lit(1)).alias("n_parcels"),
            F.count_if(F.col("zone") == "01").alias("n_urban"),
            F.count_if(F.col("zone") == "02").alias("n_rural"),
            F.sum("area_m2").alias("area_sum_m2"),
            F.sum("built_area_m2").alias("built_area_sum_m2"),
        )
    )
    n_schools = schools.groupBy("muni_code").agg(F.count(F.lit(1)).alias("n_schools"))
    n_health = health.groupBy("muni_code").agg(F.count(F.lit(1)).alias("n_health"))
    joined = municipalities.join(departments, "dept_code")
    for child in (managers, counted, n_schools, n_health):
        joined = joined.join(child, "muni_code", "left")
    zero = ["n_parcels", "n_urban", "n_rural", "n_schools", "n_health"]
    return joined.fillna(0, zero)


def coverage(municipalities: DataFrame, managers: DataFrame, parcels: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Cadastre coverage of every municipality."""
    n = active_rows(parcels, snapshots).groupBy("muni_code").agg(F.count(F.lit(1)).alias("n_parcels"))
    return (
        municipalities.select("muni_code", "dept_code")
        .join(managers, "muni_code", "left")
        .join(n, "muni_code", "left")
        .select(
            "muni_code",
            "dept_code",
            F.coalesce("manager_name", F.lit("No determinado")).alias("manager_name"),
            "is_igac",
            F.coalesce("coverage_status", F.lit("unknown")).alias("coverage_status"),
            F.coalesce("n_parcels", F.lit(0)).alias("n_parcels"),
        )
    )


def coverage_by_department(cover: DataFrame) -> DataFrame:
    """Municipalities, those of the national manager, and those with parcels, by department."""
    return cover.groupBy("dept_code").agg(
        F.count(F.lit(1)).alias("municipalities"),
        F.count_if(F.coalesce("is_igac", F.lit(False))).alias("national_manager"),
        F.count_if(F.col("n_parcels") > 0).alias("with_parcels"),
        F.sum("n_parcels").alias("n_parcels"),
    )


def mark_coverage(managers: DataFrame, loaded: DataFrame) -> DataFrame:
    """Managers with the newest cut and the sorted union of old and newly loaded layers."""
    fresh = loaded.groupBy("muni_code").agg(
        F.max("cut_date").alias("_cut"), F.collect_set("layer").alias("_layers")
    )
    none = F.array().cast("array<string>")
    layers = F.array_sort(
        F.array_union(F.coalesce("available_layers", none), F.coalesce("_layers", none))
    )
    return (
        managers.join(fresh, "muni_code", "left")
        .withColumn("last_cut_date", F.greatest("last_cut_date", "_cut"))
        .withColumn("available_layers", layers)
        .drop("_cut", "_layers")
    )
