"""Indicators, use profiles and business templates as data.

Everything below is a fixed value: names, limits, scores and weights that
results depend on. The rules that read them are in ``normalize`` and
``operators.scoring``.
"""

from __future__ import annotations

OVERLAP_TOUCHING_PCT = 1
OVERLAP_INSIDE_PCT = 10
SLOPE_STEPS = [(3, 100), (7, 92), (12, 78), (25, 55), (45, 25)]
MIN_CONFIDENCE = 0.5
FAVORABLE = 70
CONDITIONED = 45

CAPABILITY_AGRO = {"1": 100, "2": 92, "3": 80, "4": 65, "5": 45, "6": 35, "7": 20, "8": 5}
CAPABILITY_SOLAR = {"1": 20, "2": 25, "3": 35, "4": 55, "5": 75, "6": 90, "7": 100, "8": 60}
VOCATION_AGRO = {
    "agricola": 100, "agroforestal": 80, "ganadera": 70, "forestal_produccion": 55,
    "forestal_protectora": 20, "conservacion": 5, "zonas_urbanas": 10, "cuerpo_de_agua": 0,
}
VOCATION_URBAN = {
    "agricola": 35, "agroforestal": 55, "ganadera": 65, "forestal_produccion": 55,
    "forestal_protectora": 15, "conservacion": 5, "zonas_urbanas": 100, "cuerpo_de_agua": 0,
}
USE_CONFLICT = {
    "uso_adecuado": 100, "subutilizacion_ligera": 80, "subutilizacion_moderada": 70,
    "subutilizacion_severa": 55, "sobreutilizacion_ligera": 55, "sobreutilizacion_moderada": 35,
    "sobreutilizacion_severa": 10, "sin_conflicto_definido": 60,
}
HAZARD_SCORES = {"muy_baja": 100, "baja": 85, "media": 55, "alta": 20, "muy_alta": 5}
HAZARD_FLAGS = {"muy_baja": "ok", "baja": "ok", "media": "caution", "alta": "blocker", "muy_alta": "blocker"}
SEISMIC_FLAGS = {"muy_baja": "ok", "baja": "ok", "media": "ok", "alta": "caution", "muy_alta": "caution"}
HAZARD_RANKS = {"muy baja": 1, "baja": 2, "media": 3, "moderada": 3, "intermedia": 3, "alta": 4, "muy alta": 5}
RESTRICTIVE_CATEGORIES = [
    "parque_nacional_natural", "santuario_de_fauna_y_flora", "santuario_de_flora",
    "santuario_de_fauna", "area_natural_unica", "via_parque", "reserva_natural_de_la_nacion",
    "parque_natural_regional", "reserva_forestal_protectora", "distrito_de_conservacion_de_suelos",
]
NON_STRICT_CATEGORIES = [
    "distritos regionales de manejo integrado", "distritos nacionales de manejo integrado",
    "distritos de conservacion de suelos", "areas de recreacion",
    "reserva natural de la sociedad civil",
]
PROTECTED_CATEGORY = {
    "ninguna": 100, "distrito_de_manejo_integrado": 45, "area_de_recreacion": 45,
    "reserva_natural_de_la_sociedad_civil": 50, "distrito_regional_de_manejo_integrado": 45,
    "distrito_de_conservacion_de_suelos": 15, "reserva_forestal_protectora": 10,
    "parque_natural_regional": 5, "via_parque": 5, "area_natural_unica": 5,
    "santuario_de_fauna": 5, "santuario_de_flora": 5, "santuario_de_fauna_y_flora": 5,
    "reserva_natural_de_la_nacion": 5, "parque_nacional_natural": 0,
}
POT_URBAN = {
    "suelo_urbano": 100, "suelo_de_expansion_urbana": 80, "suelo_suburbano": 65,
    "centro_poblado_rural": 55, "suelo_rural": 25, "suelo_de_proteccion": 0,
}
POT_RURAL = {
    "suelo_rural": 100, "suelo_suburbano": 60, "centro_poblado_rural": 45,
    "suelo_de_expansion_urbana": 30, "suelo_urbano": 10, "suelo_de_proteccion": 5,
}
POT_LOGISTICS = {
    "suelo_suburbano": 100, "suelo_urbano": 85, "suelo_de_expansion_urbana": 70,
    "centro_poblado_rural": 40, "suelo_rural": 35, "suelo_de_proteccion": 0,
}
POT_FLAGS = {
    "suelo_urbano": "ok", "suelo_de_expansion_urbana": "caution", "suelo_suburbano": "caution",
    "centro_poblado_rural": "ok", "suelo_rural": "ok", "suelo_de_proteccion": "blocker",
}
CAPABILITY_FLAGS = {
    "1": "ok", "2": "ok", "3": "ok", "4": "ok", "5": "caution", "6": "caution",
    "7": "caution", "8": "blocker",
}
VOCATION_FLAGS = {
    "agricola": "ok", "agroforestal": "ok", "ganadera": "ok", "forestal_produccion": "ok",
    "forestal_protectora": "caution", "conservacion": "blocker", "zonas_urbanas": "ok",
    "cuerpo_de_agua": "blocker",
}
CONFLICT_FLAGS = {
    "uso_adecuado": "ok", "subutilizacion_ligera": "ok", "subutilizacion_moderada": "ok",
    "subutilizacion_severa": "caution", "sobreutilizacion_ligera": "caution",
    "sobreutilizacion_moderada": "caution", "sobreutilizacion_severa": "caution",
    "sin_conflicto_definido": "ok",
}
PROTECTED_FLAGS = {"ninguna": "ok", **{k: "blocker" for k in RESTRICTIVE_CATEGORIES}}

BUILDING_USES = [
    "vivienda_unifamiliar", "vivienda_multifamiliar", "bodega_logistica", "colegio",
    "comercio_local", "industria", "turismo_rural", "solar_fotovoltaico",
]
FARMING_USES = ["agricultura", "ganaderia"]
ALL_USES = BUILDING_USES + FARMING_USES
HEAVY_USES = ["bodega_logistica", "industria"]

NEUTRAL = ("always_ok",)

# id: (unit, value type, score rule, flag rule, uses that require it)
INDICATORS = {
    "slope_mean_pct": ("%", "number", ("stepped", SLOPE_STEPS), ("above", 25, 45), BUILDING_USES),
    "elevation_mean_m": ("m", "number", ("band", -10, 0, 2600, 3600), ("band", (0, 2600), (-10, 3600)), []),
    "land_capability_class": ("class", "category", ("categorical", CAPABILITY_AGRO), ("category", CAPABILITY_FLAGS, "unknown"), FARMING_USES),
    "land_vocation": (None, "category", ("categorical", VOCATION_AGRO), ("category", VOCATION_FLAGS, "caution"), FARMING_USES),
    "land_use_conflict": (None, "category", ("categorical", USE_CONFLICT), ("category", CONFLICT_FLAGS, "caution"), []),
    "solar_irradiance_kwh_m2_day": ("kWh/m2/day", "number", ("linear", 3.2, 6.2), ("below", 4), []),
    "hazard_landslide_level": (None, "category", ("categorical", HAZARD_SCORES), ("category", HAZARD_FLAGS, "caution"), BUILDING_USES),
    "hazard_seismic_level": (None, "category", ("categorical", HAZARD_SCORES), ("category", SEISMIC_FLAGS, "caution"), []),
    "hazard_flood_level": (None, "category", ("categorical", HAZARD_SCORES), ("category", HAZARD_FLAGS, "caution"), BUILDING_USES),
    "protected_area_overlap_pct": ("%", "number", ("stepped", [(1, 100), (10, 60), (50, 25), (100, 0)]), ("above", 1, None), ALL_USES),
    "protected_area_category": (None, "category", ("categorical", PROTECTED_CATEGORY, 30), ("category", PROTECTED_FLAGS, "caution"), []),
    "ethnic_territory_overlap_pct": ("%", "number", ("stepped", [(1, 100), (10, 40), (100, 0)]), ("above", 1, 10), ALL_USES),
    "mining_title_present": (None, "boolean", ("boolean", 30, 100), ("boolean", "caution", "ok"), []),
    "inside_agricultural_frontier": (None, "boolean", ("boolean", 100, 20), ("boolean", "ok", "caution"), FARMING_USES),
    "inside_urban_perimeter": (None, "boolean", ("boolean", 100, 40), ("boolean", "ok", "caution"), []),
    "pot_classification": (None, "category", ("categorical", POT_URBAN), ("category", POT_FLAGS, "caution"), []),
    "distance_primary_road_m": ("m", "number", ("linear_inverse", 0, 10000), ("above", 5000, None), HEAVY_USES),
    "distance_secondary_road_m": ("m", "number", ("linear_inverse", 0, 5000), ("above", 2500, None), []),
    "distance_paved_road_m": ("m", "number", ("linear_inverse", 0, 3000), ("above", 1500, None), []),
    "distance_municipal_seat_m": ("m", "number", ("linear_inverse", 0, 30000), ("above", 15000, None), []),
    "distance_school_m": ("m", "number", ("linear_inverse", 0, 3000), ("above", 1500, None), []),
    "distance_health_facility_m": ("m", "number", ("linear_inverse", 0, 10000), ("above", 5000, None), []),
    "road_access_index": ("points", "number", ("linear", 0, 100), ("below", 40), []),
    "population_density_per_km2": ("per km2", "number", ("linear", 0, 15000), NEUTRAL, []),
    "school_age_population": ("people", "number", ("linear", 0, 1500), NEUTRAL, []),
    "school_seats_per_100_school_age": ("seats", "number", ("linear_inverse", 0, 110), NEUTRAL, []),
    "commerce_poi_density_per_km2": ("per km2", "number", ("linear", 0, 400), NEUTRAL, []),
    "competitor_density_per_km2": ("per km2", "number", ("linear_inverse", 0, 40), NEUTRAL, []),
    "tourism_poi_density_per_km2": ("per km2", "number", ("linear", 0, 60), NEUTRAL, []),
    "parcel_density_per_km2": ("per km2", "number", ("linear", 0, 2000), NEUTRAL, []),
    "parcel_area_m2": ("m2", "number", ("linear", 72, 600), NEUTRAL, []),
    "built_area_m2": ("m2", "number", ("linear", 0, 1000), NEUTRAL, []),
    "large_parcels_count": ("parcels", "number", ("linear", 0, 15), ("below", 1), []),
    "land_cadastral_value_per_m2": ("COP/m2", "number", ("linear_inverse", 20000, 3000000), NEUTRAL, []),
}

# Hard filters of templates: name, or (name, limit).
PROTECTED = "protected_area"
ETHNIC = "ethnic_territory"
POT_PROTECTION = "pot_protection"
FLOOD = "high_flood"
URBAN_ONLY = "inside_urban_perimeter"
ONE_LARGE_LOT = ("min_large_parcels", 1)

# id: (cell level, weights, hard filters, score rules that replace the catalogue's)
TEMPLATES = {
    "colegio": (8, {
        "school_age_population": 0.28, "school_seats_per_100_school_age": 0.22,
        "large_parcels_count": 0.18, "road_access_index": 0.14, "population_density_per_km2": 0.08,
        "distance_paved_road_m": 0.06, "hazard_flood_level": 0.04,
    }, [PROTECTED, ETHNIC, POT_PROTECTION, ("max_slope", 25), ONE_LARGE_LOT], {}),
    "retail_barrio": (9, {
        "population_density_per_km2": 0.3, "commerce_poi_density_per_km2": 0.2,
        "competitor_density_per_km2": 0.15, "road_access_index": 0.15,
        "inside_urban_perimeter": 0.1, "parcel_density_per_km2": 0.1,
    }, [URBAN_ONLY, ETHNIC, PROTECTED], {}),
    "supermercado": (8, {
        "population_density_per_km2": 0.26, "road_access_index": 0.18,
        "competitor_density_per_km2": 0.16, "large_parcels_count": 0.14,
        "commerce_poi_density_per_km2": 0.1, "distance_paved_road_m": 0.08,
        "land_cadastral_value_per_m2": 0.08,
    }, [ETHNIC, PROTECTED, POT_PROTECTION, FLOOD, ONE_LARGE_LOT], {}),
    "farmacia": (9, {
        "population_density_per_km2": 0.28, "commerce_poi_density_per_km2": 0.2,
        "competitor_density_per_km2": 0.2, "road_access_index": 0.12,
        "distance_health_facility_m": 0.12, "inside_urban_perimeter": 0.08,
    }, [URBAN_ONLY, ETHNIC, PROTECTED], {}),
    "clinica_ips": (8, {
        "population_density_per_km2": 0.24, "distance_health_facility_m": 0.2,
        "road_access_index": 0.16, "large_parcels_count": 0.12, "distance_paved_road_m": 0.1,
        "parcel_density_per_km2": 0.08, "hazard_flood_level": 0.06,
        "land_cadastral_value_per_m2": 0.04,
    }, [ETHNIC, PROTECTED, POT_PROTECTION, FLOOD, ("max_slope", 25)],
        {"distance_health_facility_m": (("linear", 0, 10000), NEUTRAL)}),
    "bodega_logistica": (7, {
        "distance_primary_road_m": 0.28, "large_parcels_count": 0.2, "road_access_index": 0.16,
        "slope_mean_pct": 0.12, "land_cadastral_value_per_m2": 0.1,
        "distance_municipal_seat_m": 0.08, "hazard_flood_level": 0.06,
    }, [ETHNIC, PROTECTED, POT_PROTECTION, FLOOD, ("max_slope", 15), ONE_LARGE_LOT], {}),
    "restaurante": (9, {
        "population_density_per_km2": 0.24, "commerce_poi_density_per_km2": 0.24,
        "competitor_density_per_km2": 0.14, "road_access_index": 0.12,
        "tourism_poi_density_per_km2": 0.12, "inside_urban_perimeter": 0.08,
        "parcel_density_per_km2": 0.06,
    }, [ETHNIC, PROTECTED], {}),
    "gimnasio": (9, {
        "population_density_per_km2": 0.3, "competitor_density_per_km2": 0.22,
        "commerce_poi_density_per_km2": 0.16, "road_access_index": 0.14,
        "inside_urban_perimeter": 0.1, "land_cadastral_value_per_m2": 0.08,
    }, [URBAN_ONLY, ETHNIC, PROTECTED], {}),
    "vivienda_vis": (8, {
        "large_parcels_count": 0.22, "land_cadastral_value_per_m2": 0.2, "road_access_index": 0.14,
        "distance_school_m": 0.1, "slope_mean_pct": 0.1, "hazard_flood_level": 0.08,
        "pot_classification": 0.08, "distance_health_facility_m": 0.08,
    }, [ETHNIC, PROTECTED, POT_PROTECTION, FLOOD, ("max_slope", 25), ONE_LARGE_LOT], {}),
    "hotel": (8, {
        "tourism_poi_density_per_km2": 0.26, "road_access_index": 0.14,
        "distance_paved_road_m": 0.12, "distance_municipal_seat_m": 0.12,
        "competitor_density_per_km2": 0.12, "commerce_poi_density_per_km2": 0.1,
        "protected_area_overlap_pct": 0.08, "elevation_mean_m": 0.06,
    }, [ETHNIC, PROTECTED, POT_PROTECTION, ("max_slope", 35)], {}),
}

AREA_LOGISTICS = ("linear", 1000, 20000)
AREA_FARM = ("linear", 5000, 500000)
RURAL_CHANGES = {
    "parcel_area_m2": (AREA_FARM, None),
    "pot_classification": (("categorical", POT_RURAL), None),
    "inside_urban_perimeter": (("boolean", 20, 100), ("boolean", "caution", "ok")),
}
YARD_CHANGES = {
    "parcel_area_m2": (AREA_LOGISTICS, None),
    "pot_classification": (("categorical", POT_LOGISTICS), None),
    "land_vocation": (("categorical", VOCATION_URBAN), None),
}

# use: (weights, blocker rules, (score rule, flag rule) that replace the catalogue's)
USE_PROFILES = {
    "vivienda_unifamiliar": ({
        "slope_mean_pct": 0.14, "hazard_landslide_level": 0.12, "hazard_flood_level": 0.12,
        "pot_classification": 0.1, "inside_urban_perimeter": 0.08, "distance_paved_road_m": 0.07,
        "protected_area_overlap_pct": 0.06, "ethnic_territory_overlap_pct": 0.06,
        "distance_school_m": 0.06, "distance_health_facility_m": 0.05, "road_access_index": 0.05,
        "parcel_area_m2": 0.05, "population_density_per_km2": 0.04,
    }, [PROTECTED], {}),
    "vivienda_multifamiliar": ({
        "slope_mean_pct": 0.12, "hazard_landslide_level": 0.11, "hazard_flood_level": 0.11,
        "pot_classification": 0.12, "inside_urban_perimeter": 0.1, "parcel_area_m2": 0.08,
        "road_access_index": 0.07, "population_density_per_km2": 0.06,
        "protected_area_overlap_pct": 0.05, "ethnic_territory_overlap_pct": 0.05,
        "distance_paved_road_m": 0.05, "commerce_poi_density_per_km2": 0.05,
        "distance_health_facility_m": 0.03,
    }, [PROTECTED], {"parcel_area_m2": (("linear", 300, 3000), None)}),
    "bodega_logistica": ({
        "distance_primary_road_m": 0.2, "parcel_area_m2": 0.15, "slope_mean_pct": 0.12,
        "road_access_index": 0.11, "pot_classification": 0.1, "hazard_flood_level": 0.09,
        "hazard_landslide_level": 0.06, "distance_paved_road_m": 0.05,
        "protected_area_overlap_pct": 0.04, "land_vocation": 0.04,
        "ethnic_territory_overlap_pct": 0.02, "land_cadastral_value_per_m2": 0.02,
    }, [PROTECTED], YARD_CHANGES),
    "agricultura": ({
        "land_capability_class": 0.2, "land_vocation": 0.13, "inside_agricultural_frontier": 0.12,
        "slope_mean_pct": 0.1, "land_use_conflict": 0.08, "parcel_area_m2": 0.08,
        "protected_area_overlap_pct": 0.06, "ethnic_territory_overlap_pct": 0.05,
        "distance_secondary_road_m": 0.05, "elevation_mean_m": 0.04,
        "distance_municipal_seat_m": 0.03, "pot_classification": 0.03,
        "inside_urban_perimeter": 0.03,
    }, [PROTECTED, "agricultural_frontier"], RURAL_CHANGES),
    "ganaderia": ({
        "land_vocation": 0.18, "land_capability_class": 0.15, "inside_agricultural_frontier": 0.12,
        "slope_mean_pct": 0.1, "land_use_conflict": 0.1, "parcel_area_m2": 0.08,
        "protected_area_overlap_pct": 0.06, "ethnic_territory_overlap_pct": 0.05,
        "distance_secondary_road_m": 0.05, "distance_municipal_seat_m": 0.04,
        "elevation_mean_m": 0.03, "pot_classification": 0.02, "inside_urban_perimeter": 0.02,
    }, [PROTECTED, "agricultural_frontier"], RURAL_CHANGES),
    "colegio": ({
        "school_age_population": 0.18, "school_seats_per_100_school_age": 0.15,
        "parcel_area_m2": 0.12, "road_access_index": 0.1, "slope_mean_pct": 0.08,
        "distance_paved_road_m": 0.07, "pot_classification": 0.07, "hazard_flood_level": 0.06,
        "hazard_landslide_level": 0.06, "population_density_per_km2": 0.05,
        "protected_area_overlap_pct": 0.03, "ethnic_territory_overlap_pct": 0.03,
    }, [PROTECTED], {"parcel_area_m2": (("linear", 2500, 20000), None)}),
    "comercio_local": ({
        "population_density_per_km2": 0.18, "commerce_poi_density_per_km2": 0.15,
        "road_access_index": 0.12, "pot_classification": 0.1, "inside_urban_perimeter": 0.1,
        "competitor_density_per_km2": 0.08, "distance_paved_road_m": 0.08, "slope_mean_pct": 0.05,
        "hazard_flood_level": 0.05, "parcel_area_m2": 0.04, "hazard_landslide_level": 0.03,
        "protected_area_overlap_pct": 0.01, "ethnic_territory_overlap_pct": 0.01,
    }, [PROTECTED], {}),
    "industria": ({
        "distance_primary_road_m": 0.18, "parcel_area_m2": 0.14, "slope_mean_pct": 0.12,
        "pot_classification": 0.12, "road_access_index": 0.1, "hazard_flood_level": 0.08,
        "hazard_landslide_level": 0.07, "protected_area_overlap_pct": 0.06,
        "ethnic_territory_overlap_pct": 0.04, "land_vocation": 0.04,
        "distance_municipal_seat_m": 0.03, "land_cadastral_value_per_m2": 0.02,
    }, [PROTECTED], YARD_CHANGES),
    "turismo_rural": ({
        "tourism_poi_density_per_km2": 0.18, "protected_area_overlap_pct": 0.1,
        "distance_secondary_road_m": 0.1, "distance_paved_road_m": 0.08, "road_access_index": 0.08,
        "distance_municipal_seat_m": 0.08, "elevation_mean_m": 0.08, "slope_mean_pct": 0.08,
        "hazard_landslide_level": 0.07, "hazard_flood_level": 0.06, "parcel_area_m2": 0.05,
        "ethnic_territory_overlap_pct": 0.04,
    }, [PROTECTED], {"parcel_area_m2": (("linear", 500, 50000), None)}),
    "solar_fotovoltaico": ({
        "solar_irradiance_kwh_m2_day": 0.22, "slope_mean_pct": 0.18, "parcel_area_m2": 0.12,
        "distance_primary_road_m": 0.1, "land_capability_class": 0.1,
        "protected_area_overlap_pct": 0.08, "hazard_flood_level": 0.06,
        "hazard_landslide_level": 0.05, "ethnic_territory_overlap_pct": 0.05,
        "road_access_index": 0.04,
    }, [PROTECTED], {
        "parcel_area_m2": (AREA_LOGISTICS, None),
        "land_capability_class": (("categorical", CAPABILITY_SOLAR), NEUTRAL),
    }),
}

# Measures of the yearly education sheet: column, indicator, unit, higher is better.
EDUCATION_MEASURES = [
    ("poblacion_5_16", "school_age_population", "personas", None),
    ("tasa_matriculacion_5_16", "education_enrollment_rate", "%", True),
    ("cobertura_neta", "education_net_coverage", "%", True),
    ("cobertura_bruta", "education_gross_coverage", "%", True),
    ("desercion", "education_dropout_rate", "%", False),
    ("aprobacion", "education_pass_rate", "%", True),
    ("reprobacion", "education_fail_rate", "%", False),
    ("repitencia", "education_repetition_rate", "%", False),
]

COMMERCE_CATEGORIES = ["comercio", "alimentacion", "servicios"]
TOURISM_CATEGORIES = ["turismo", "alojamiento"]
