"""From landed rows to target tables: mapping, declared geometry and per-target rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import geo, hexgrid
from landgrid.functions.catalogue import HAZARD_RANKS, NON_STRICT_CATEGORIES
from landgrid.functions.normalize import lookup
from landgrid.functions.text import decimal_from_text, fold, int_from_text, number_from_text, padded_code, strip_accents

# Fixed values of the target tables.
NATURES = {"PRIVADA": "privado", "PUBLICA": "publico", "MIXTA": "mixto"}
FINE_LEVEL = 9


def optional(df: DataFrame, name: str, type_name: str = "string") -> Column:
    """The column, or a typed NULL when the source does not have it."""
    return F.col(name).cast(type_name) if name in df.columns else F.lit(None).cast(type_name).alias(name)


def payload_text(field: str, payload: str = "payload") -> Column:
    """Text of one field of a payload map."""
    return F.try_element_at(F.col(payload), F.lit(field))


FIELD_KINDS = {
    "text": lambda c: c,
    "number": number_from_text,
    "int": int_from_text,
    "muni_code": padded_code,
    "decimal": decimal_from_text,
}


def map_fields(df: DataFrame, mapping: dict[str, tuple[str | None, str]], payload: str = "payload") -> DataFrame:
    """Target columns from ``{target: (source field or None, kind)}``; other columns stay.

    A target without a source field is a typed NULL.
    """
    out = {}
    for target, (field, kind) in mapping.items():
        text = payload_text(field, payload) if field else F.lit(None).cast("string")
        out[target] = FIELD_KINDS[kind](text)
    return df.withColumns(out)


def declared_point(lng_text: Column, lat_text: Column) -> Column:
    """Struct ``x, y`` from two text columns; NULL for 0,0 and for degrees that do not exist."""
    lng, lat = decimal_from_text(lng_text), decimal_from_text(lat_text)
    fine = lng.between(-180, 180) & lat.between(-90, 90) & ~((lng == 0) & (lat == 0))
    return F.when(fine, geo.point(lng, lat))


def inside_or_null(place: Column, envelope=geo.ENVELOPE) -> Column:
    return F.when(geo.in_envelope(place["x"], place["y"], envelope), place)


def with_place(df: DataFrame, place: str = "place", cell: str = "cell") -> DataFrame:
    """Drop places outside the national envelope and add the fine cell."""
    kept = df.withColumn(place, inside_or_null(F.col(place)))
    return kept.withColumn(
        cell, hexgrid.point_to_cell(F.col(f"{place}.x"), F.col(f"{place}.y"), FINE_LEVEL)
    )


def _blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def schools(staged: DataFrame) -> DataFrame:
    """One row per school code of the newest year, the one with most pupils.

    Rows without a code are told apart by a digest of their payload.
    """
    newest = staged.agg(F.max("year")).scalar()
    digest = F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))))
    current = staged.where(F.col("year").isNull() | (F.col("year") == newest)).withColumn(
        "_key", F.coalesce("dane_code", digest)
    )
    row = F.struct(*[F.col(c) for c in staged.columns])
    order = F.struct(F.coalesce("enrollment", F.lit(-1)), digest)
    picked = current.groupBy("_key").agg(F.max_by(row, order).alias("r")).select("r.*")
    lower = lambda c: _blank_to_null(F.lower(F.col(c)))
    return picked.withColumns(
        {
            "name": F.coalesce("name", F.lit("Sin nombre")),
            "sector": F.replace(lower("sector"), F.lit(" "), F.lit("_")),
            "location_kind": lower("location_kind"),
        }
    )


def health_facilities(staged: DataFrame) -> DataFrame:
    """Facilities without a published name show their level instead."""
    unnamed = F.concat(_blank_to_null(F.col("level")), F.lit(" (nombre no publicado)"))
    return staged.withColumns(
        {
            "name": F.coalesce(_blank_to_null(F.col("name")), unnamed, F.lit("Sin nombre")),
            "nature": lookup(fold(F.col("nature")), NATURES),
        }
    )


def populated_places(staged: DataFrame, municipalities: DataFrame) -> DataFrame:
    known = staged.join(municipalities.select("muni_code"), "muni_code", "left_semi")
    kind = F.when(fold(F.col("kind")) == "CM", "cabecera").otherwise("centro_poblado")
    return known.withColumn("kind", kind).where(F.col("place").isNotNull() & (F.trim("name") != ""))


def cadastral_managers(staged: DataFrame, municipalities: DataFrame, old: DataFrame) -> DataFrame:
    """One manager per municipality merged over the old table; old links of the national manager go."""
    fresh = staged.where("muni_code is not null and trim(manager_name) <> ''")
    picked = fresh.groupBy("muni_code").agg(F.min("manager_name").alias("_name")).join(
        municipalities.select("muni_code"), "muni_code", "left_semi"
    )
    merged = old.join(picked, "muni_code", "full_outer")
    changed, national = F.col("_name").isNotNull(), fold(F.col("_name")) == "IGAC"
    url = F.when(changed & ~national & F.col("manager_url").contains("igac.gov.co"), None).otherwise(F.col("manager_url"))
    return merged.select(
        "muni_code",
        F.coalesce("_name", "manager_name").alias("manager_name"),
        F.when(changed, national).otherwise(F.col("is_igac")).alias("is_igac"),
        F.coalesce("coverage_status", F.lit("unknown")).alias("coverage_status"),
        url.alias("manager_url"),
    )


def update_boundaries(municipalities: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Municipalities with new outlines and areas; the old centre point stays."""
    new = boundaries.select(F.trim("code").alias("muni_code"), geo.clean_polygon(F.col("rings")).alias("_rings"))
    joined = municipalities.join(new.where("_rings is not null"), "muni_code", "left")
    km2 = F.round(geo.area_m2(F.col("_rings")) / 1e6, 4)
    return joined.withColumns(
        {
            "rings": F.coalesce("_rings", "rings"),
            "centroid": F.coalesce("centroid", geo.point_on_surface(F.col("_rings"))),
            "area_km2": F.coalesce(km2, F.col("area_km2")),
        }
    ).drop("_rings")


def census_blocks(staged: DataFrame) -> DataFrame:
    """Blocks with a surface; a missing code becomes the payload's digest."""
    digest = F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))))
    clean = staged.withColumns(
        {
            "code": F.coalesce("code", digest),
            "kind": F.coalesce("kind", F.lit("urbano")),
            "rings": geo.clean_polygon(F.col("rings")),
        }
    ).where("rings is not null")
    return clean.withColumn("place", geo.point_on_surface(F.col("rings")))


def folded_level(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(col)), "\\s+", " "))


def hazard_rank(level: Column) -> Column:
    """1 to 5 for known levels, NULL for the rest."""
    return lookup(folded_level(level), HAZARD_RANKS)


def is_restrictive(category: Column) -> Column:
    """TRUE unless the category admits regulated use; unknown counts as restrictive."""
    known = F.coalesce(category, F.lit(""))
    return ~folded_level(known).isin(NON_STRICT_CATEGORIES)


def protected_areas(staged: DataFrame) -> DataFrame:
    return staged.withColumns(
        {
            "name": F.coalesce("name", F.lit("Área protegida sin nombre")),
            "is_restrictive": is_restrictive(F.col("category")),
        }
    )


def hazards(staged: DataFrame) -> DataFrame:
    return staged.withColumns(
        {"kind": F.coalesce("kind", F.lit("mass_movement")), "level_rank": hazard_rank(F.col("level"))}
    )


def row_checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum and row count of a table.

    Every row is hashed with SHA-256 as JSON that keeps NULLs. The checksum is the SHA-256 of
    the sums of the eight words of all row hashes, so equal rows count as often as they occur.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return df.agg(F.sha2(F.concat_ws(",", *sums), 256).alias("checksum"), F.count(F.lit(1)).alias("rows"))
