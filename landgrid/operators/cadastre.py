"""Cadastre layers: parcels, buildings, hierarchy, perimeters, streets and address points.

A code that comes in several polygons keeps one row per polygon in the parts
table. The parcel table has one row per code with sums over its parts and the
shape that they make together. A shape of more points than a row may hold
stays out of that row and comes from ``multipart`` over the parts, in several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import codes, geo, hexgrid
from landgrid.functions.text import fold
from landgrid.operators.ingest import optional
from landgrid.operators.shapes import MOST_POINTS, gathered_rings, with_pieces

# Texts that say there is no address, and the start of one that is usable.
NO_ADDRESS = ["NS", "N/S", "SN", "S/N", "SIN NOMENCLATURA", ".", "-"]
STREET = (
    "(?i)(^|[^a-zA-Z])(calle|carrera|avenida|diagonal|transversal|circular|circunvalar|autopista|via"
    "|kilometro|km|cl|cr|kr|ac|ak|dg|tv|tr|av)[\\s.]*[0-9]"
)
FIVE_DIGITS = "^[0-9]{5}$"


def blank(col: Column) -> Column:
    return F.when(F.trim(col) != "", F.trim(col))


def parcel_parts(raw: DataFrame) -> DataFrame:
    """Polygons with a valid code, cleaned and measured, one row each."""
    parts = raw.withColumn("npn", F.trim("codigo")).where(codes.is_code(F.col("npn")))
    parts = parts.withColumn("rings", geo.clean_polygon(F.col("rings"))).where("rings is not null")
    return parts.withColumn("part_area_m2", geo.area(geo.project_rings(F.col("rings"))))


def _whole_shape(size: Column) -> Column:
    """Aggregate over ``with_pieces``: the shape of a code; NULL where it takes several rows."""
    return F.when(F.max("pieces") == 1, gathered_rings("rings", size, F.col("pieces") == 1)).alias("rings")


def parcels(raw: DataFrame, zone: str, cut_date: str, most_points: int = MOST_POINTS) -> DataFrame:
    """One row per code with the segments of the code, sums, the largest part's centre and the shape.

    ``rings`` holds all parts, the largest first. It is NULL where they have more than ``most_points``
    points; ``shapes.multipart(parcel_parts(raw), ["npn"])`` gives those in ``shape_rows`` rows.
    """
    p = with_pieces(parcel_parts(raw), ["npn"], most_points=most_points)
    size = F.col("part_area_m2")
    grouped = p.groupBy("npn").agg(
        F.min(blank(optional(raw, "codigo_anterior"))).alias("npn_old"),
        F.count(F.lit(1)).alias("parts"),
        F.round(F.sum(size), 2).alias("area_m2"),
        F.max(optional(raw, "numero_subterraneos", "int")).alias("basements"),
        F.max_by(geo.point_on_surface(F.col("rings")), size).alias("place"),
        F.max("pieces").alias("shape_rows"), _whole_shape(size),
    )
    seg = codes.parts(F.col("npn"))
    out = grouped.select(
        "npn", F.when(F.length("npn_old") <= 20, F.col("npn_old")).alias("npn_old"),
        codes.dept_code(F.col("npn")).alias("dept_code"), codes.muni_code(F.col("npn")).alias("muni_code"),
        F.lit(zone).alias("zone"),
        *[seg[name].alias(f"{name}_code") for name in ("sector", "commune", "neighborhood", "block", "parcel", "condition", "building", "floor", "unit")],
        codes.is_unit(F.col("npn")).alias("is_ph"), codes.matrix_code(F.col("npn")).alias("matrix_npn"),
        "area_m2", "parts", "basements", "place", "rings", "shape_rows", F.lit(cut_date).cast("date").alias("valid_from"),
    )
    at = lambda level: hexgrid.point_to_cell(F.col("place.x"), F.col("place.y"), level)
    return out.withColumns({"cell_r8": at(8), "cell_r9": at(9)})


def parcel_load_report(raw: DataFrame) -> DataFrame:
    """Rows read, skipped by reason and merged, in one row; a shape of which cleaning leaves nothing is none."""
    code, has_shape = F.trim("codigo"), geo.clean_polygon(F.col("rings")).isNotNull()
    good = codes.is_code(code) & has_shape
    return raw.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(~F.coalesce(codes.is_code(code), F.lit(False))).alias("bad_code"),
        F.count_if(~F.coalesce(has_shape, F.lit(False))).alias("no_geometry"),
        F.countDistinct(F.when(good, code)).alias("parcels"),
    )


def buildings(raw: DataFrame) -> DataFrame:
    """Buildings with their parcel's code; floors of zero or over two hundred become NULL."""
    npn = F.coalesce(blank(optional(raw, "terreno_codigo")), blank(F.col("codigo")))
    floors = optional(raw, "numero_pisos", "int")
    ref = F.concat_ws("-", optional(raw, "codigo_edificacion"), blank(optional(raw, "identificador")))
    kept = raw.withColumn("parcel_npn", npn).where(codes.is_code(F.col("parcel_npn")) & F.col("rings").isNotNull())
    return kept.select(
        "parcel_npn", codes.dept_code(F.col("parcel_npn")).alias("dept_code"),
        codes.muni_code(F.col("parcel_npn")).alias("muni_code"),
        F.when(ref != "", ref).alias("building_ref"),
        F.when(floors.between(1, 200), floors).alias("floors"),
        geo.clean_polygon(F.col("rings")).alias("rings"),
    ).where("rings is not null")


def hierarchy(raw: DataFrame, most_points: int = MOST_POINTS) -> DataFrame:
    """Blocks, neighbourhoods, sectors or veredas: one row per municipality and code, with sums and the shape as in ``parcels``."""
    muni = F.coalesce(blank(optional(raw, "codigo_municipio")), F.substring("codigo", 1, 5))
    kept = raw.where(blank(F.col("codigo")).isNotNull()).select(
        muni.alias("muni_code"), F.trim("codigo").alias("code"), blank(optional(raw, "nombre")).alias("name"),
        geo.clean_polygon(F.col("rings")).alias("rings"),
    ).where(F.col("muni_code").rlike(FIVE_DIGITS) & F.col("rings").isNotNull())
    sized = kept.withColumn("size", geo.area(geo.project_rings(F.col("rings"))))
    return with_pieces(sized, ["muni_code", "code"], most_points=most_points).groupBy("muni_code", "code").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("parts"), F.round(F.sum("size"), 2).alias("area_m2"),
        F.max("pieces").alias("shape_rows"), _whole_shape(F.col("size")),
    )


def urban_perimeters(raw: DataFrame) -> DataFrame:
    return raw.where(F.trim("codigo_municipio").rlike(FIVE_DIGITS)).select(
        F.trim("codigo_municipio").alias("muni_code"), blank(optional(raw, "nombre_geografico")).alias("name"),
        geo.clean_polygon(F.col("rings")).alias("rings"),
    ).where("rings is not null")


def street_names(raw: DataFrame) -> DataFrame:
    kept = raw.where(F.trim("codigo_municipio").rlike(FIVE_DIGITS) & (F.size("line") >= 2))
    name = blank(F.col("texto"))
    return kept.where(name.isNotNull()).select(
        F.trim("codigo_municipio").alias("muni_code"), name.alias("name"), fold(name).alias("name_fold"), "line"
    )


def address_points(raw: DataFrame) -> DataFrame:
    """Usable address labels at the middle of their line, with the parcel's code when valid."""
    label, npn = F.trim("texto"), blank(optional(raw, "terreno_codigo"))
    usable = raw.where(label.rlike(STREET) & F.trim("codigo_municipio").rlike(FIVE_DIGITS))
    return usable.select(
        F.trim("codigo_municipio").alias("muni_code"), label.alias("label"), fold(label).alias("label_fold"),
        F.when(codes.is_code(npn), npn).alias("parcel_npn"), geo.line_midpoint(F.col("line")).alias("place"),
    ).where("place is not null")


def address_usefulness(raw: DataFrame) -> DataFrame:
    """How many address texts are usable, and how many say there is none."""
    label = F.trim("texto")
    return raw.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(label.rlike(STREET)).alias("usable"),
        F.count_if(F.upper(label).isin(NO_ADDRESS)).alias("no_address"),
    ).withColumn("useful_pct", F.round(F.when(F.col("source_rows") > 0, F.col("usable") / F.col("source_rows") * 100), 4))
