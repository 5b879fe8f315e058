import pytest
from pyspark.sql import functions as F

from landgrid.functions import address, catalogue as cat, codes, dates, normalize, pii, text
from landgrid.operators import scoring
from landgrid.operators.parcels import ParcelQuery, after_cursor, encode_cursor


def values(spark, rows, type_name, build):
    df = spark.createDataFrame([(r,) for r in rows], f"v {type_name}")
    return [r[0] for r in df.select(build(F.col("v")).alias("o")).collect()]


def test_numeric_scores_at_the_borders(spark):
    nan, inf = float("nan"), float("inf")
    assert values(spark, [None, nan, inf, -5.0, 0.0, 5.0, 10.0, 99.0], "double", lambda v: normalize.linear(v, 0, 10)) == [None, None, None, 0, 0, 50, 100, 100]
    assert values(spark, [None, 0.0, 2.5, 10.0], "double", lambda v: normalize.linear_inverse(v, 0, 10)) == [None, 100, 75, 0]
    steps = [(3, 100), (7, 92)]
    assert values(spark, [None, 3.0, 3.1, 7.0, 7.1], "double", lambda v: normalize.stepped(v, steps)) == [None, 100, 92, 92, 0]
    assert values(spark, [8.0], "double", lambda v: normalize.stepped(v, steps, None)) == [None]
    assert values(spark, [None, -10.0, -5.0, 0.0, 50.0, 75.0, 100.0], "double", lambda v: normalize.band(v, -10, 0, 50, 100)) == [None, 0, 50, 100, 100, 50, 0]
    with pytest.raises(ValueError):
        normalize.linear(F.lit(1), 2, 2)
    with pytest.raises(ValueError):
        normalize.stepped(F.lit(1), [(3, 1), (2, 1)])


def test_category_and_boolean_scores(spark):
    table = {"muy_alta": 5, "baja": 85}
    assert values(spark, [None, " ", "Muy Alta", "BAJA", "otra"], "string", lambda v: normalize.categorical(v, table)) == [None, None, 5, 85, None]
    assert values(spark, [None, "otra", "baja"], "string", lambda v: normalize.categorical(v, table, 30)) == [None, 30, 85]
    assert values(spark, ["Sí", "no", "quizá", None], "string", lambda v: normalize.boolean(v, 80, None)) == [80, None, None, None]


def test_road_and_school_age_rules(spark):
    assert values(spark, [None, 0.0, 100.0, 5000.0, 2550.0], "double", lambda v: normalize.road_access(v, whole=True)) == [None, 100, 100, 0, 50]
    assert values(spark, [None], "double", lambda v: normalize.road_access(v, missing_as=5000)) == [0]
    assert values(spark, [{"5_9": 10, "15_19": 5}, {}, None], "map<string,int>", normalize.school_age) == [12, None, None]


def test_weights():
    assert sum(scoring.normalize_weights({"a": 2, "b": 6}).values()) == pytest.approx(1)
    assert scoring.normalize_weights({"a": 0, "b": 0}) == {"a": 0.5, "b": 0.5}
    weights, ignored = scoring.apply_overrides({"a": 1.0, "b": 1.0}, {"a": 3.0, "x": 1.0, "b": -1.0})
    assert weights == {"a": 0.75, "b": 0.25} and ignored == ["x", "b"]
    for _, weights, _, _ in cat.TEMPLATES.values():
        assert sum(weights.values()) == pytest.approx(1) and set(weights) <= set(cat.INDICATORS)
    for use, (weights, _, own) in cat.USE_PROFILES.items():
        assert sum(weights.values()) == pytest.approx(1) and set(own) <= set(weights)
        assert {i for i, s in cat.INDICATORS.items() if use in s[4]} <= set(weights)
    assert len(cat.INDICATORS) == 34 and len(cat.TEMPLATES) == 10 and len(cat.USE_PROFILES) == 10


def test_composite_policies(spark):
    df = spark.createDataFrame([(80.0, 40.0, None), (None, 40.0, None), (None, None, None)], "a double, b double, c double")
    weights = {"a": 0.5, "b": 0.25, "c": 0.25}
    names = {k: k for k in weights}
    run = lambda **o: [tuple(r) for r in df.select(*[F.expr(v).alias(k) for k, v in scoring.combine(names, weights, **o).items()]).collect()]
    assert run() == [(66.7, 0.75, ["c"]), (None, 0.25, ["a", "c"]), (None, 0.0, ["a", "b", "c"])]
    assert run(min_confidence=0.2)[1][0] == 40.0
    assert [r[0] for r in run(policy="null_result")] == [None, None, None]


@pytest.mark.parametrize("overlap, category, blocked", [
    (None, None, None), (10.0, "Parque Nacional Natural", False), (10.1, None, True), (50.0, "ninguna", False),
    (50.0, "Parque Nacional Natural", True), (50.0, "area de recreacion", False),
])
def test_protected_rule_is_three_valued(spark, overlap, category, blocked):
    df = spark.createDataFrame([(overlap, category)], "protected_area_overlap_pct double, protected_area_category string")
    assert scoring.with_keys(df).select(scoring.protected_blocks()).first()[0] is blocked


def test_verdicts(spark):
    best = {
        "slope_mean_pct": 1.0, "hazard_landslide_level": "baja", "hazard_flood_level": "baja", "pot_classification": "suelo urbano",
        "inside_urban_perimeter": True, "distance_paved_road_m": 0.0, "protected_area_overlap_pct": 0.0, "protected_area_category": "ninguna",
        "ethnic_territory_overlap_pct": 0.0, "distance_school_m": 0.0, "distance_health_facility_m": 0.0, "road_access_index": 100.0,
        "parcel_area_m2": 600.0, "population_density_per_km2": 15000.0,
    }
    cases = [best, {**best, "slope_mean_pct": 30.0}, {**best, "slope_mean_pct": None}, {**best, "slope_mean_pct": 50.0}, {**best, "protected_area_overlap_pct": 80.0, "protected_area_category": None}]
    types = {n: scoring.COLUMN_TYPES[cat.INDICATORS[n][1]] for n in best}
    rows = [(i, *[c[n] for n in best]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} {t}" for n, t in types.items()))
    out = {r.id: r for r in scoring.suitability(df, ["id"], ["vivienda_unifamiliar"]).collect()}
    assert [out[i].verdict for i in range(5)] == ["favorable", "condicionado", "sin_datos", "desfavorable", "desfavorable"]
    assert out[2].missing == ["slope_mean_pct"] and out[2].score is None and out[1].cautions == ["slope_mean_pct"]
    assert out[3].blockers == ["slope_mean_pct"] and out[4].blockers[0] == "protected_area"


def test_codes(spark):
    whole = "050010100020300450006000000000"
    unit = whole[:21] + "901020304"
    rows = [whole, "05-001-01-00-02-03-0045-0006-0-00-00-0000", unit, whole[:20], "00" + whole[2:], "05000" + whole[5:], "x", None]
    assert values(spark, rows, "string", codes.reason_invalid) == [None, None, None, "old_format", "department_00", "municipality_000", "not_30_digits", "missing"]
    assert values(spark, rows[:4], "string", codes.is_unit) == [False, False, True, None]
    assert values(spark, [unit], "string", codes.matrix_code) == [whole]
    parts = values(spark, [whole], "string", codes.parts)[0]
    assert "".join(parts) == whole and parts.block == "0045"


@pytest.mark.parametrize("raw, canonical, way, number, cross, plate, quadrant", [
    ("Cra. 45 # 12-34 Sur", "CARRERA 45 # 12-34 SUR", "CARRERA", "45", "12", "34", "SUR"),
    ("calle 45 a no. 12 - 34", "CALLE 45A # 12-34", "CALLE", "45A", "12", "34", None),
    ("KR 7 N° 72 - 41", "CARRERA 7 # 72-41", "CARRERA", "7", "72", "41", None),
    ("Av. 68 Nro 13-20", "AVENIDA 68 # 13-20", "AVENIDA", "68", "13", "20", None),
    ("Finca La Esperanza", "FINCA LA ESPERANZA", None, None, None, None, None),
])
def test_addresses(spark, raw, canonical, way, number, cross, plate, quadrant):
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("c", address.canonical(F.col("raw")))
    r = df.select("c", address.parts_of(F.col("c")).alias("p")).first()
    assert r.c == canonical
    assert (r.p.way_type, r.p.way_number, r.p.cross_number, r.p.plate, r.p.quadrant) == (way, number, cross, plate, quadrant)


def test_personal_names_and_values(spark):
    names = ["PROPIETARIO", "nombre", "nombre_municipio", "primer_nombre_x", "url_descarga_documento", "telefono_contacto", "area_m2", "matricula", "fecha_firma", "Correo Electrónico"]
    assert values(spark, names, "string", pii.name_rule) == ["exact", "exact", None, "person_name", None, "phone", None, None, None, "exact"]
    rows = ["a.b@c.co", "900.123.456-7", "llamar 3001234567", "cc 1.020.345.678", "Juan Carlos Pérez", "0" * 30, "2024-05-06", "12.5", "x" * 501 + " a@b.co", None]
    assert values(spark, rows, "string", pii.value_rule) == ["email", "co_nit", "co_phone", "co_cedula", "person_full_name", None, None, None, "email", None]
    assert [pii.name_rule_of(n) for n in names] == ["exact", "exact", None, "person_name", None, "phone", None, None, None, "exact"]
    assert values(spark, ["12345678"], "string", lambda v: pii.value_rule(v, F.lit("codigo_dane"))) == [None]


def test_text_and_numbers(spark):
    assert values(spark, ["Bogotá, D.C.", "Peñón", None], "string", text.fold) == ["BOGOTA, D.C.", "PENON", None]
    assert values(spark, ["SANTA FE DE BOGOTÁ", "LA UNIÓN"], "string", text.title_case) == ["Santa Fe de Bogotá", "La Unión"]
    assert values(spark, ["4,5", "-74.1", "1,234,5", " ", "x"], "string", text.decimal_from_text) == [4.5, -74.1, 1.2345, None, None]
    assert values(spark, ["5001", " 05001 ", "123456", ""], "string", text.padded_code) == ["05001", "05001", "123456", None]


def test_cut_dates_and_freshness(spark):
    df = spark.createDataFrame([("mensual", 35), ("mensual", 36), ("mensual", 54), ("anual", None), ("rara", 91)], "f string, d int")
    states = [r[0] for r in df.select(dates.freshness_state(F.col("d"), F.col("f"))).collect()]
    assert states == ["al-dia", "revisar", "vencido", "sin-corte", "revisar"]
    day = F.lit("2024-08-17").cast("date")
    row = spark.range(1).select(*[dates.cut_date(day, F.lit(f)).cast("string") for f in ("mensual", "trimestral", "semestral", "anual", "eventual")]).first()
    assert list(row) == ["2024-08-01", "2024-07-01", "2024-07-01", "2024-01-01", "2024-08-17"]


def test_parcel_query_rules(spark):
    for bad in (dict(), dict(department="05", sort="distance:asc"), dict(department="05", ranges={"area_m2": {}}), dict(department="05", ranges={"x": {"gt": 1}})):
        with pytest.raises(ValueError):
            ParcelQuery(**bad).check()
    rows = [("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", None), ("e", None)]
    df = spark.createDataFrame(rows, "npn string, v double")
    seen, cursor = [], None
    while True:
        page = df.where(after_cursor(F.col("v"), F.col("npn"), True, cursor)) if cursor else df
        page = page.orderBy(F.col("v").desc_nulls_last(), F.col("npn").desc()).limit(2).collect()
        if not page:
            break
        seen += [r.npn for r in page]
        cursor = encode_cursor(page[-1].v, page[-1].npn)
    assert seen == ["a", "c", "b", "e", "d"]


def test_zone_factors(spark):
    from landgrid.operators import zones

    rows = [("t", 1, [("a", 10.0, 0.5), ("b", None, 0.5)]), ("t", 2, [("a", 20.0, 0.5), ("b", None, 0.5)]), ("t", 3, [("a", 90.0, 0.5), ("b", 4.0, 0.5)])]
    ranked = spark.createDataFrame(rows, "template string, cell long, factors array<struct<indicator:string,score:double,weight:double>>")
    parts = spark.createDataFrame([("t", 1, 1), ("t", 2, 1), ("t", 3, 3)], "template string, cell long, component long")
    out = zones.zone_factors(zones.zone_members(ranked, parts, ["template"]), ["template"]).collect()
    got = {(r.component, r.indicator): (r.mean_score, r.cells_with_data) for r in out}
    assert got == {(1, "a"): (15.0, 2), (1, "b"): (None, 0), (3, "a"): (90.0, 1), (3, "b"): (4.0, 1)}
