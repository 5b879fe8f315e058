"""Checks of loaded tables as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import codes, geo
from landgrid.functions.kernels import self_crossing

FINDING = "check_name string, severity string, passed boolean, affected bigint"


def count_findings(df: DataFrame, checks: list[tuple[str, str, Column]], by: list[str] | None = None) -> DataFrame:
    """Findings of many conditions that count bad rows, in one pass over the table.

    A check is a name, the severity when rows fail, and the condition of a bad
    row. With ``by``, one set of findings per group.
    """
    keys = by or []
    counted = df.groupBy(*keys).agg(*[F.count_if(bad).alias(name) for name, _, bad in checks])
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.when(F.col(name) > 0, severity).otherwise("info").alias("severity"),
            (F.col(name) == 0).alias("passed"),
            F.col(name).alias("affected"),
        )
        for name, severity, _ in checks
    ]
    return counted.select(*keys, F.explode(F.array(*rows)).alias("f")).select(*keys, "f.*")


def outside(lng: Column, lat: Column, envelope=geo.ENVELOPE) -> Column:
    return lng.isNotNull() & lat.isNotNull() & ~geo.in_envelope(lng, lat, envelope)


def cadastre_findings(parcels: DataFrame, by: list[str] | None = None, code: str = "npn") -> DataFrame:
    """Code, place, area and partition checks of a cadastre cut."""
    checks = [
        ("bad_code", "error", codes.reason_invalid(F.col(code)).isNotNull()),
        ("outside_envelope", "error", outside(F.col("lng"), F.col("lat"), geo.ENVELOPE_CADASTRE)),
        ("missing_geometry", "warning", F.col("lng").isNull()),
        ("zero_area", "warning", F.col("area_m2").isNull() | (F.col("area_m2") <= 0)),
        ("wrong_partition", "error", F.substring("muni_code", 1, 2) != F.col("dept_code")),
    ]
    return count_findings(parcels, checks, by)


def zero_area_severity(affected: Column, total: Column) -> Column:
    """error when more than five in a hundred rows have no area."""
    return F.when(affected / total > 0.05, "error").otherwise("warning")


def zero_area_finding(parcels: DataFrame, by: list[str]) -> DataFrame:
    bad = F.col("area_m2").isNull() | (F.col("area_m2") <= 0)
    return (
        parcels.groupBy(*by)
        .agg(F.count_if(bad).alias("affected"), F.count(F.lit(1)).alias("total"))
        .withColumn("severity", zero_area_severity(F.col("affected"), F.col("total")))
        .withColumn("passed", F.col("affected") == 0)
    )


def duplicate_codes(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """Codes that occur more than once in a cut."""
    return parcels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def samples(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """One row with the first ``limit`` values, for a finding's sample; a sampling operator, so the limit is its point."""
    first = df.select(column).orderBy(column).limit(limit)
    return first.agg(F.sort_array(F.collect_list(column)).alias("sample"))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is not in the table; parents are reduced to their keys."""
    return children.join(parents.select(*keys), keys, "left_anti")


def unknown_municipalities(parcels: DataFrame, municipalities: DataFrame) -> DataFrame:
    return parcels.select("muni_code").distinct().join(municipalities, "muni_code", "left_anti")


def geometry_findings(shapes: DataFrame, rings: str = "rings", srid: str | None = None, expected: int = 4326) -> DataFrame:
    """Invalid, empty and wrongly referenced shapes."""
    polygon = F.col(rings)
    unclosed = F.exists(polygon, lambda r: (F.size(r) < 4) | (r[0] != F.element_at(r, -1)))
    checks = [
        ("empty_geometry", "warning", polygon.isNull() | (F.size(polygon) == 0)),
        ("invalid_geometry", "error", F.col("_crossing") | unclosed),
    ]
    if srid:
        checks.append(("srid_mismatch", "error", F.col(srid) != expected))
    return count_findings(shapes.withColumn("_crossing", self_crossing(polygon)), checks)


def precision_finding(points: DataFrame, limit_pct: float = 20.0) -> DataFrame:
    """Share of points with two decimals or fewer."""
    coarse = geo.coarse_coordinate(F.col("lng"), F.col("lat"))
    counted = points.where("lng is not null").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(coarse).alias("affected")
    )
    pct = F.when(F.col("total") > 0, F.col("affected") / F.col("total") * 100).otherwise(0.0)
    return counted.select(
        F.lit("coordinate_precision").alias("check_name"), "affected", F.round(pct, 4).alias("pct"),
        (pct <= limit_pct).alias("passed"),
    )


def field_availability(df: DataFrame) -> DataFrame:
    """Rows, empty rows and the share of filled rows for every column, in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in df.columns]
    return counted.select("_n", F.explode(F.array(*rows)).alias("f")).select(
        "f.field", F.col("_n").alias("total"), (F.col("_n") - F.col("f.filled")).alias("missing"),
        F.round(F.when(F.col("_n") > 0, F.col("f.filled") / F.col("_n") * 100), 4).alias("filled_pct"),
    )


def level_domain(hazards: DataFrame, level: str, rank: Column) -> DataFrame:
    """Levels that no rank is known for, with their rows."""
    unmapped = hazards.where(F.col(level).isNotNull() & rank.isNull())
    return unmapped.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def layer_coverage(touched: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Municipalities a layer touches out of all; one row."""
    n = touched.select("muni_code").distinct().agg(F.count(F.lit(1)).alias("touched"))
    total = municipalities.agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("total", total.scalar()).withColumn(
        "passed", F.col("touched") >= F.col("total")
    )
