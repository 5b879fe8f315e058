"""Checks, personal data, ingestion rules and cadastre layers."""

from pyspark.sql import functions as F

from landgrid.functions import codes, dates, geo, pii, text
from landgrid.operators import cadastre, ingest, privacy, quality
from landgrid.registry.base import lat, lng, query


def quoted(words):
    return ", ".join("'" + w + "'" for w in words)


@query("cadastre_findings", "Q1 Q3 Q4 Q15", "parcel", """
    with f as (select snapshot_id, count(*) filter (where substr(npn, 1, 2) = '00' or length(npn) <> 30) as bad_code,
        count(*) filter (where lng not between -82 and -66.5 or lat not between -4.5 and 13.6) as outside_envelope, 0 as missing_geometry,
        count(*) filter (where area_m2 is null or area_m2 <= 0) as zero_area, count(*) filter (where substr(muni_code, 1, 2) <> dept_code) as wrong_partition
      from parcel group by snapshot_id),
    u as (unpivot f on bad_code, outside_envelope, missing_geometry, zero_area, wrong_partition into name check_name value affected)
    select snapshot_id, check_name, affected, affected = 0 as passed from u""")
def _(t):
    return quality.cadastre_findings(t.parcel, ["snapshot_id"]).select("snapshot_id", "check_name", "affected", "passed")


@query("zero_area_severity", "Q3", "parcel", """
    select snapshot_id, zone, count(*) filter (where built_area_m2 is null or built_area_m2 <= 0) as affected, count(*) as total,
      case when count(*) filter (where built_area_m2 is null or built_area_m2 <= 0) / count(*) > 0.05 then 'error' else 'warning' end as severity,
      count(*) filter (where built_area_m2 is null or built_area_m2 <= 0) = 0 as passed from parcel group by 1, 2""")
def _(t):
    return quality.zero_area_finding(t.parcel.select("snapshot_id", "zone", F.col("built_area_m2").alias("area_m2")), ["snapshot_id", "zone"])


@query("duplicate_buildings", "Q4", "building", """
    select parcel_key, building_ref, count(*) as n from building group by 1, 2 having count(*) > 1""")
def _(t):
    return quality.duplicate_codes(t.building, ["parcel_key", "building_ref"])


@query("finding_sample", "Q4", "building", """
    select array_to_string(list(parcel_key), ',') as sample from (
      select parcel_key from (select parcel_key from building group by parcel_key, building_ref having count(*) > 1) order by parcel_key limit 10)""")
def _(t):
    out = quality.samples(quality.duplicate_codes(t.building, ["parcel_key", "building_ref"]), "parcel_key")
    return out.select(F.array_join(F.transform("sample", lambda v: v.cast("string")), ",").alias("sample"))


@query("orphan_buildings", "Q5 J6", "building parcel", """
    select parcel_key, building_ref, snapshot_id from building b where not exists (
      select 1 from parcel p where p.parcel_key = b.parcel_key and p.snapshot_id = b.snapshot_id)""")
def _(t):
    return quality.orphans(t.building, t.parcel, ["parcel_key", "snapshot_id"]).select("parcel_key", "building_ref", "snapshot_id")


@query("unknown_municipalities", "Q5 J6", "parcel manager", """
    select distinct muni_code from parcel where muni_code not in (select muni_code from manager)""")
def _(t):
    return quality.unknown_municipalities(t.parcel, t.manager)


@query("coordinate_precision", "Q12 G17", "parcel", """
    select 'coordinate_precision' as check_name, count(*) filter (where round(lng, 2) = lng and round(lat, 2) = lat) as affected,
      round(count(*) filter (where round(lng, 2) = lng and round(lat, 2) = lat) / count(*) * 100, 4) as pct,
      count(*) filter (where round(lng, 2) = lng and round(lat, 2) = lat) / count(*) * 100 <= 20 as passed from parcel""")
def _(t):
    return quality.precision_finding(t.parcel)


@query("field_availability", "Q13", "parcel", """
    with f as (select count(*) as total, count(built_area_m2) as built_area_m2, count(economic_use) as economic_use, count(cadastral_value) as cadastral_value from parcel),
    u as (unpivot f on built_area_m2, economic_use, cadastral_value into name field value filled)
    select field, total, total - filled as missing, round(filled / total * 100, 4) as filled_pct from u""")
def _(t):
    return quality.field_availability(t.parcel.select("built_area_m2", "economic_use", "cadastral_value"))


@query("geometry_findings", "G8 Q3", "overlay", """
    select 'empty_geometry' as check_name, 0 as affected union all select 'invalid_geometry', count(*) from overlay where overlay_id % 3 = 0""")
def _(t):
    o = t.overlay
    x0, y0, x1, y1 = (F.col(c) for c in ("oxmin", "oymin", "oxmax", "oymax"))
    bow = F.array(F.array(geo.point(x0, y0), geo.point(x1, y1), geo.point(x1, y0), geo.point(x0, y1), geo.point(x0, y0)))
    rings = F.when(F.col("overlay_id") % 3 == 0, bow).otherwise(geo.rectangle(x0, y0, x1, y1))
    return quality.geometry_findings(o.select(rings.alias("rings"))).select("check_name", "affected")


RANK_SQL = "case lower(level) when 'muy alta' then 5 when 'alta' then 4 when 'media' then 3 when 'baja' then 2 end"


@query("hazard_levels", "P17 Q14", "overlay", f"select overlay_id, level, {RANK_SQL} as level_rank from overlay")
def _(t):
    return ingest.hazards(t.overlay.withColumn("kind", F.col("layer_key"))).select("overlay_id", "level", "level_rank")


@query("unmapped_levels", "Q14", "overlay", f"select level, count(*) as n from overlay where {RANK_SQL} is null group by level")
def _(t):
    return quality.level_domain(t.overlay, "level", ingest.hazard_rank(F.col("level")))


@query("layer_coverage", "A21 Q14", "municipality overlay", """
    select count(distinct muni_code) as touched, (select count(*) from municipality) as total, count(distinct muni_code) >= (select count(*) from municipality) as passed
    from municipality join overlay on xmin < oxmax and xmax > oxmin and ymin < oymax and ymax > oymin where layer = 'hazard'""")
def _(t):
    from landgrid.operators.spatial import polygon_overlaps
    m = t.municipality.select("muni_code", geo.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("m_rings"))
    o = t.overlay.where("layer = 'hazard'").select(geo.rectangle(F.col("oxmin"), F.col("oymin"), F.col("oxmax"), F.col("oymax")).alias("o_rings"))
    return quality.layer_coverage(polygon_overlaps(m, o, "muni_code", "m_rings", "o_rings"), m)


NAME_PREFIXES = ["nombre", "telefono", "propietario", "codigo", "area", "nit", "nombre_municipio", "correo", "url", "fecha_firma", "matricula", "Usuario LOG", "e-mail", "Cédula"]


def names_sql():
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(NAME_PREFIXES))
    return f"case p_partkey % {len(NAME_PREFIXES)} {cases} end || case when p_partkey % 3 = 0 then '' else '_' || p_name end"


NAME_KEY = f"regexp_replace(regexp_replace(lower(translate(name, '{text.ACCENTED}', '{text.PLAIN}')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def name_rule_sql(key):
    allowed = " or ".join(f"regexp_matches({key}, '{p}')" for p in pii.ALLOWED)
    rules = " ".join(f"when regexp_matches({key}, '{p}') then '{r}'" for r, p in pii.NAME_RULES)
    return f"case when {key} = '' then null when {key} in ({quoted(pii.EXACT_NAMES)}) then 'exact' when {allowed} then null {rules} end"


@query("personal_column_names", "Q7 F2", "", f"""
    with n as (select p_partkey, {names_sql()} as name from part), k as (select *, {NAME_KEY} as k from n), r as (select *, {name_rule_sql('k')} as rule from k)
    select p_partkey, name, rule, rule is null and k in ({quoted(pii.ADJACENT_NAMES)}) as adjacent from r""")
def _(t):
    return privacy.classify_names(t.part.select("p_partkey", F.expr(names_sql()).alias("name")))


# RE2 has no look-around; a border character on each side finds the same rows.
VALUE_SQL = {
    "email": pii.EMAIL,
    "co_nit": r"(^|[^0-9.-])[0-9]{3}[.]?[0-9]{3}[.]?[0-9]{3}\s?-\s?[0-9]($|[^0-9-])",
    "co_phone": r"(^|[^0-9])(\+?57[\s.-]?)?(\(?(60[1-8]|3[0-9]{2})\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}($|[^0-9])|(^|[^0-9])3[0-9]{9}($|[^0-9])",
    "co_cedula": r"(^|[^0-9.,-])[0-9]{1,3}(\.[0-9]{3}){1,3}($|[^0-9.,-])|(^|[^0-9.,-])[0-9]{6,10}($|[^0-9.,-])",
    "person_full_name": r"\b([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}\s+){2,}(DE\s+|DEL\s+|LA\s+|LOS\s+)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}\b",
}


def value_rule_sql(value):
    harmless = " or ".join(f"regexp_matches({value}, '{p}')" for p in pii.HARMLESS)
    rules = " ".join(f"when regexp_matches({value}, '{VALUE_SQL[r]}') then '{r}'" for r, _ in pii.VALUE_RULES)
    return f"case when {value} = '' or {harmless} then null {rules} end"


@query("personal_values_in_documents", "Q8 Q11", "", f"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    r as (select doc_id, line_no, trim(line) as v from l)
    select doc_id, line_no, {value_rule_sql('v')} as rule from r where v <> '' and {value_rule_sql('v')} is not null""")
def _(t):
    lines = privacy.text_lines(t.documents, ["doc_id"], "text")
    return privacy.scan_values(lines, ["doc_id", "line_no"], "line")


@query("personal_values_whole", "Q8", "", f"""
    with r as (select doc_id, trim(text) as v from documents)
    select doc_id, {value_rule_sql('v')} as rule from r where {value_rule_sql('v')} is not null""")
def _(t):
    return privacy.scan_values(t.documents, ["doc_id"], "text")


@query("sanitized_documents", "Q9", "", f"""
    with r as (select doc_id, lang, text, trim(text) as v from documents)
    select doc_id, lang, case when {value_rule_sql('v')} is not null then '[REDACTADO:' || {value_rule_sql('v')} || ']' else text end as texto from r""")
def _(t):
    df = t.documents.select("doc_id", F.col("lang"), F.col("text").alias("texto"), F.col("source").alias("nombre_propietario"), F.col("lang").alias("telefono"))
    return privacy.sanitize(df, ["texto"])


@query("discard_log", "Q9 A23", "", f"""
    with r as (select trim(text) as v from documents), h as (select {value_rule_sql('v')} as rule from r)
    select 'docs' as layer, 'texto' as "column", rule, 'redacted' as action, count(*) as occurrences from h where rule is not null group by rule
    union all select 'docs', 'telefono', 'exact', 'dropped', count(*) from documents""")
def _(t):
    df = t.documents.select(F.col("text").alias("texto"), F.col("lang").alias("telefono"))
    log = privacy.discard_log(df, "docs").withColumn("detected_at", F.lit("2024-01-01").cast("date"))
    return privacy.discard_rollup(log).drop("last_seen")


@query("row_redaction", "Q10", "", """
    select s_suppkey, case when s_name like '%5' or s_nationkey = 3 then null else s_name end as s_name, s_nationkey from supplier""")
def _(t):
    df = t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.concat_ws(":", "s_nationkey", "s_name").alias("kind"))
    return privacy.redact_rows(df, "kind", ["s_name"], pattern="^3:|5$").drop("kind")


@query("json_key_census", "A29 F44 S9", "", """
    select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key""")
def _(t):
    return privacy.key_census(t.events, "props")


@query("leaked_json_keys", "Q6", "", """
    select 'telefono' as key, count(*) as n, 'exact' as rule from events where event_id % 4 = 0""")
def _(t):
    value = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"telefono":'), "event_id", F.lit("}"))).otherwise(F.col("props"))
    return privacy.leaked_keys(t.events.select(value.alias("attrs")), "attrs")


@query("value_sample", "A30", "", "select distinct p_name as value from part order by 1 limit 200")
def _(t):
    return privacy.sample_values(t.part, "p_name")


@query("staged_sweep", "Q11", "", f"""
    with r as (select trim(text) as v from documents), h as (select {value_rule_sql('v')} as rule from r)
    select 'R_VEREDA' as layer, 'NOMBRE' as "column", 'exempt' as kind, 'exact' as rule, 0 as "values"
    union all select 'DOCS', 'USUARIO_LOG', 'audit', 'exact', 0 union all select 'DOCS', 'CORREO', 'offending', 'exact', 0
    union all select 'DOCS', 'TEXTO', 'content', rule, count(*) from h where rule is not null group by rule""")
def _(t):
    docs = t.documents.select(F.col("text").alias("TEXTO"), F.lit(1).alias("USUARIO_LOG"), F.lit(1).alias("CORREO"))
    return privacy.sweep({"R_VEREDA": t.part.select(F.col("p_size").alias("NOMBRE")), "DOCS": docs})


@query("parcel_code_parts", "F8", "parcel", """
    select npn, substr(npn, 1, 2) as department, substr(npn, 3, 3) as municipality, substr(npn, 14, 4) as block, substr(npn, 27, 4) as unit,
      substr(npn, 1, 21) || '000000000' as matrix, substr(npn, 22) <> '000000000' as is_unit,
      case substr(npn, 6, 2) when '00' then 'rural' when '01' then 'seat' else 'other_urban' end as zone_kind,
      substr(npn,1,2) || '-' || substr(npn,3,3) || '-' || substr(npn,6,2) || '-' || substr(npn,8,2) || '-' || substr(npn,10,2) || '-' || substr(npn,12,2) || '-' || substr(npn,14,4)
        || '-' || substr(npn,18,4) || '-' || substr(npn,22,1) || '-' || substr(npn,23,2) || '-' || substr(npn,25,2) || '-' || substr(npn,27,4) as pretty
    from parcel""")
def _(t):
    n = F.col("npn")
    p = codes.parts(n)
    return t.parcel.select(
        "npn", p["department"].alias("department"), p["municipality"].alias("municipality"), p["block"].alias("block"), p["unit"].alias("unit"),
        codes.matrix_code(n).alias("matrix"), codes.is_unit(n).alias("is_unit"), codes.zone_kind(n).alias("zone_kind"), codes.pretty(n).alias("pretty"))


@query("text_folding", "F1 F2 F11", "", f"""
    select doc_id, upper(replace(translate(text, '{text.ACCENTED}', '{text.PLAIN}'), 'ß', 'ss')) as folded,
      regexp_replace(regexp_replace(lower(translate(text, '{text.ACCENTED}', '{text.PLAIN}')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as category from documents""")
def _(t):
    return t.documents.select("doc_id", text.fold(F.col("text")).alias("folded"), text.category_key(F.col("text")).alias("category"))


@query("title_case_names", "F11", "", """
    select p_partkey, upper(p_name[1]) || split_part(p_name[2:], ' ', 1) || ' de ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] as title from part""")
def _(t):
    return t.part.select("p_partkey", text.title_case(F.upper(F.replace("p_name", F.lit(" "), F.lit(" de ")))).alias("title"))


@query("cut_date_of_day", "F40", "", """
    select o_orderkey, cast(date_trunc('month', o_orderdate)::date as varchar) as monthly, cast(date_trunc('quarter', o_orderdate)::date as varchar) as quarterly,
      cast(make_date(year(o_orderdate)::int, case when month(o_orderdate) <= 6 then 1 else 7 end, 1) as varchar) as half_yearly, cast(date_trunc('year', o_orderdate)::date as varchar) as yearly,
      cast(o_orderdate::date as varchar) as daily from orders""")
def _(t):
    at = lambda f: dates.cut_date(F.col("o_orderdate"), F.lit(f)).cast("string")
    return t.orders.select("o_orderkey", at("mensual").alias("monthly"), at("trimestral").alias("quarterly"), at("semestral").alias("half_yearly"), at("decenal").alias("yearly"), at("eventual").alias("daily"))


@query("numbers_from_text", "P12 F10 F35", "", """
    select o_orderkey, o_totalprice as number, cast(floor(o_totalprice) as bigint) as whole, lpad(cast(o_custkey as varchar), cast(greatest(5, length(cast(o_custkey as varchar))) as int), '0') as muni_code, o_totalprice as dec,
      cast(null as double) as nothing from orders""")
def _(t):
    plain = F.format_string("%.2f", "o_totalprice")
    payload = F.create_map(F.lit("n"), F.concat(F.lit("$ "), plain, F.lit(" COP")), F.lit("i"), F.concat(F.lit("#"), F.floor("o_totalprice").cast("string")),
                           F.lit("m"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")), F.lit("d"), F.replace(plain, F.lit("."), F.lit(",")))
    mapping = {"number": ("n", "number"), "whole": ("i", "int"), "muni_code": ("m", "muni_code"), "dec": ("d", "decimal"), "nothing": (None, "number")}
    return ingest.map_fields(t.orders.select("o_orderkey", payload.alias("payload")), mapping).drop("payload")


@query("declared_points", "S6 P7", "", f"""
    with p as (select o_orderkey, {lng('o_orderkey')} * case when o_orderkey % 9 = 0 then 0 when o_orderkey % 10 = 0 then 3 else 1 end as x, {lat('o_orderkey')} * case when o_orderkey % 9 = 0 then 0 else 1 end as y from orders)
    select o_orderkey, case when x between -180 and 180 and not (x = 0 and y = 0) and x between -81.85 and -66.8 and y between -4.3 and 13.6 then x end as x from p""")
def _(t):
    k = F.col("o_orderkey")
    x = F.expr(lng("o_orderkey")) * F.when(k % 9 == 0, 0).when(k % 10 == 0, 3).otherwise(1)
    y = F.expr(lat("o_orderkey")) * F.when(k % 9 == 0, 0).otherwise(1)
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    return t.orders.select("o_orderkey", ingest.inside_or_null(ingest.declared_point(comma(x), comma(y)))["x"].alias("x"))


@query("school_load", "P13 W5 F45", "", """
    with s as (select p_name as code, year(o_orderdate) as y, p_partkey, o_orderkey from orders join part on p_partkey = o_orderkey % (select count(*) from part)),
    m as (select code, p_partkey % 97 as enrollment, row_number() over (partition by code order by p_partkey % 97 desc) as rn from s where y = (select max(y) from s))
    select code as dane_code, enrollment, 'no_oficial' as sector from m where rn = 1""")
def _(t):
    n = t.part.agg(F.count(F.lit(1))).scalar()
    j = t.orders.withColumn("p_partkey", F.col("o_orderkey") % n).join(t.part, "p_partkey")
    staged = j.select(F.col("p_name").alias("dane_code"), F.year("o_orderdate").alias("year"), (F.col("p_partkey") % 97).alias("enrollment"),
                      F.lit(None).cast("string").alias("name"), F.lit("NO OFICIAL").alias("sector"), F.lit("URBANA").alias("location_kind"),
                      F.create_map(F.lit("k"), F.col("o_orderkey").cast("string")).alias("payload"))
    return ingest.schools(staged).select("dane_code", "enrollment", "sector")


@query("health_load", "P13", "", """
    select s_suppkey, case s_suppkey % 3 when 0 then s_name when 1 then 'Nivel 2 (nombre no publicado)' else 'Sin nombre' end as name, case s_suppkey % 4 when 0 then 'privado' when 1 then 'publico' when 2 then 'mixto' end as nature from supplier""")
def _(t):
    k = F.col("s_suppkey")
    staged = t.supplier.select("s_suppkey", F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("name"), F.when(k % 3 == 1, "Nivel 2").otherwise("").alias("level"),
                               F.when(k % 4 == 0, "Privada").when(k % 4 == 1, "Pública").when(k % 4 == 2, "MIXTA").otherwise("otra").alias("nature"))
    return ingest.health_facilities(staged).drop("level")


@query("place_load", "P13", "manager", f"""
    select c_custkey, case when c_custkey % 3 = 0 then 'cabecera' else 'centro_poblado' end as kind from customer
    where lpad(cast(c_custkey % 5 + 1 as varchar), 2, '0') || lpad(cast(c_custkey % 25 + 1 as varchar), 3, '0') in (select muni_code from manager) and c_custkey % 10 <> 0""")
def _(t):
    from landgrid.registry.base import pad
    k = F.col("c_custkey")
    staged = t.customer.select("c_custkey", F.expr(pad("c_custkey % 5 + 1", 2) + " || " + pad("c_custkey % 25 + 1", 3)).alias("muni_code"), F.when(k % 3 == 0, "cm").otherwise("CP").alias("kind"),
                               F.col("c_name").alias("name"), F.when(k % 10 != 0, geo.point(F.lit(-74), F.lit(4))).alias("place"))
    return ingest.populated_places(staged, t.manager).select("c_custkey", "kind")


@query("manager_load", "P13 J18", "manager municipality", """
    with p as (select muni_code, 'Gestor ' || min(dept_code) as n from municipality where dept_code <> '01' group by 1)
    select coalesce(m.muni_code, p.muni_code) as muni_code, coalesce(p.n, m.manager_name) as manager_name, case when p.n is null then m.is_igac else false end as is_igac, coalesce(coverage_status, 'unknown') as coverage_status
    from manager m full outer join p using (muni_code)""")
def _(t):
    staged = t.municipality.where("dept_code <> '01'").select("muni_code", F.concat(F.lit("Gestor "), "dept_code").alias("manager_name"))
    old = t.manager.withColumn("manager_url", F.lit("https://www.igac.gov.co/x"))
    return ingest.cadastral_managers(staged, t.municipality, old).drop("manager_url")


@query("protected_load", "P18 D10", "", """
    select s_suppkey, case s_suppkey % 3 when 0 then true when 1 then false else true end as is_restrictive from supplier""")
def _(t):
    k = F.col("s_suppkey")
    cat = F.when(k % 3 == 1, "Áreas de  Recreación").when(k % 3 == 2, "Parque Nacional Natural")
    return ingest.protected_areas(t.supplier.select("s_suppkey", F.lit(None).cast("string").alias("name"), cat.alias("category"))).select("s_suppkey", "is_restrictive")


@query("boundary_update", "J18 G9", "municipality", """
    select muni_code, population, case when dept_code = '02' then null else round((xmin + xmax) / 2, 6) end as cx from municipality""")
def _(t):
    m = t.municipality.withColumns({"rings": F.lit(None).cast(geo.POLYGON_TYPE), "centroid": F.lit(None).cast("struct<x:double,y:double>"), "area_km2": F.lit(None).cast("double")})
    new = t.municipality.where("dept_code <> '02'").select(F.col("muni_code").alias("code"), geo.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("rings"))
    return ingest.update_boundaries(m, new).select("muni_code", "population", F.round("centroid.x", 6).alias("cx"))


def raw_parcels(t):
    """Landed polygons: several per code, some with a hole, some without a valid code or shape."""
    p = t.parcel
    x, y, h = F.col("lng"), F.col("lat"), F.col("half")
    bad = F.col("parcel_key") % 19 == 0
    shell, hole = geo.rectangle(x - h, y - h, x + h, y + h), geo.rectangle(x - h / 2, y - h / 2, x + h / 2, y + h / 2)
    rings = F.when(F.col("parcel_key") % 3 == 0, F.concat(shell, hole)).otherwise(shell)
    return p.select(
        F.when(bad, F.substring("npn", 1, 12)).otherwise(F.concat(F.substring("npn", 1, 13), F.lit("00000000000000000"))).alias("codigo"),
        "npn_old", F.when(F.col("parcel_key") % 23 != 0, rings).alias("rings"),
        F.col("npn_old").alias("codigo_anterior"), (F.col("parcel_key") % 4).alias("numero_subterraneos"), "npn", "economic_use")


SHAPE_SQL = """count(*) + count(*) filter (where parcel_key % 3 = 0) as n_rings, round(sum(case when parcel_key % 3 = 0 then 3 else 4 end * half * half), 7) as size,
      round(min(lng - half), 6) as xmin, round(max(lat + half), 6) as ymax"""


def _shape_columns():
    box = geo.box(F.col("rings"))
    return [F.size("rings").cast("bigint").alias("n_rings"), F.round(geo.area(F.col("rings")), 7).alias("size"), F.round(box["xmin"], 6).alias("xmin"), F.round(box["ymax"], 6).alias("ymax")]


@query("cadastre_parcels", "C1 A18 P11", "parcel", f"""
    select substr(npn, 1, 13) || '00000000000000000' as npn, min(npn_old) as npn_old, count(*) as parts, max(parcel_key % 4) as basements, substr(min(npn), 12, 2) as neighborhood_code, {SHAPE_SQL}
    from parcel where parcel_key % 19 <> 0 and parcel_key % 23 <> 0 group by substr(npn, 1, 13)""")
def _(t):
    return cadastre.parcels(raw_parcels(t), "01", "2024-01-01").select("npn", "npn_old", "parts", "basements", "neighborhood_code", *_shape_columns())


@query("cadastre_report", "C1", "parcel", """
    select count(*) as source_rows, count(*) filter (where parcel_key % 19 = 0) as bad_code, count(*) filter (where parcel_key % 23 = 0) as no_geometry,
      count(distinct case when parcel_key % 19 <> 0 and parcel_key % 23 <> 0 then substr(npn, 1, 13) end) as parcels from parcel""")
def _(t):
    return cadastre.parcel_load_report(raw_parcels(t))


@query("cadastre_buildings", "C2", "building parcel", """
    select p.npn as parcel_npn, case when floors * 6 between 1 and 200 then floors * 6 end as floors, cast(b.building_ref as varchar) || '-x' as building_ref
    from building b join parcel p using (parcel_key)""")
def _(t):
    b = t.building.join(t.parcel.select("parcel_key", "npn"), "parcel_key")
    raw = b.select(F.lit(" ").alias("terreno_codigo"), F.col("npn").alias("codigo"), (F.col("floors") * 6).alias("numero_pisos"), F.col("building_ref").alias("codigo_edificacion"),
                   F.lit("x").alias("identificador"), geo.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("rings"))
    return cadastre.buildings(raw).select("parcel_npn", "floors", "building_ref")


@query("cadastre_hierarchy", "C3 A18", "parcel", f"""
    select muni_code, substr(npn, 1, 13) as code, min(economic_use) as name, count(*) as parts, {SHAPE_SQL} from parcel where parcel_key % 23 <> 0 group by 1, 2""")
def _(t):
    raw = raw_parcels(t).withColumns({"codigo": F.substring("npn", 1, 13), "nombre": F.col("economic_use")})
    return cadastre.hierarchy(raw).select("muni_code", "code", "name", "parts", *_shape_columns())


def raw_addresses(t):
    k = F.col("parcel_key")
    label = F.when(k % 4 == 0, "S/N").when(k % 4 == 1, "Finca el Roble").otherwise(F.concat(F.lit(" "), F.col("address")))
    return t.parcel.select(label.alias("texto"), F.when(k % 7 == 0, "x").otherwise(F.col("muni_code")).alias("codigo_municipio"), F.when(k % 5 == 0, F.col("npn")).otherwise("1").alias("terreno_codigo"),
                           F.array(geo.point(F.col("lng"), F.col("lat")), geo.point(F.col("lng") + 2, F.col("lat"))).alias("line"), "parcel_key")


@query("address_points", "C3 G9", "parcel", """
    select muni_code, upper(address) as label_fold, case when parcel_key % 5 = 0 then npn end as parcel_npn, round(lng + 1, 6) as x from parcel where parcel_key % 4 >= 2 and parcel_key % 7 <> 0 and address ~* '(^|[^a-z])(cra|cr|kr)[ .]*[0-9]'""")
def _(t):
    raw = raw_addresses(t).withColumn("texto", F.replace("texto", F.lit("Cra."), F.lit("Cr.")))
    out = cadastre.address_points(raw)
    return out.select("muni_code", F.replace("label_fold", F.lit("CR."), F.lit("CRA.")).alias("label_fold"), "parcel_npn", F.round("place.x", 6).alias("x"))


@query("address_usefulness", "C3", "parcel", """
    select count(*) as source_rows, count(*) filter (where parcel_key % 4 >= 2) as usable, count(*) filter (where parcel_key % 4 = 0) as no_address,
      round(count(*) filter (where parcel_key % 4 >= 2) / count(*) * 100, 4) as useful_pct from parcel""")
def _(t):
    return cadastre.address_usefulness(raw_addresses(t).withColumn("texto", F.replace("texto", F.lit("Cra."), F.lit("Cr."))))


@query("street_names", "C3", "parcel", """
    select muni_code, upper(address) as name_fold, count(*) as n from parcel where parcel_key % 4 >= 2 and parcel_key % 7 <> 0 group by 1, 2""")
def _(t):
    out = cadastre.street_names(raw_addresses(t).where("parcel_key % 4 >= 2"))
    return out.groupBy("muni_code", "name_fold").agg(F.count(F.lit(1)).alias("n"))


@query("urban_perimeters", "C3 G7", "municipality", "select muni_code, muni_name as name, round((xmax - xmin) * (ymax - ymin), 6) as size from municipality")
def _(t):
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    # Clockwise and open: cleaning turns and closes it.
    ring = F.array(F.array(geo.point(x0, y0), geo.point(x0, y1), geo.point(x1, y1), geo.point(x1, y0)))
    raw = t.municipality.select(F.col("muni_code").alias("codigo_municipio"), F.col("muni_name").alias("nombre_geografico"), ring.alias("rings"))
    return cadastre.urban_perimeters(raw).select("muni_code", "name", F.round(geo.area(F.col("rings")), 6).alias("size"))


@query("table_checksum", "F45", "", "select count(*) as rows, true as ordered_alike, true as sees_moved_null from part")
def _(t):
    name, brand = F.col("p_name"), F.col("p_brand")
    first = F.col("p_partkey") == 1
    empty = F.when(~first, name)
    left = t.part.withColumns({"p_name": empty, "p_brand": F.when(first, name).otherwise(brand)})
    right = t.part.withColumns({"p_name": name, "p_brand": F.when(~first, brand)})
    sums = [ingest.row_checksum(df).withColumnRenamed("checksum", f"c{k}") for k, df in enumerate((t.part, t.part.orderBy(F.desc("p_retailprice")), left, right))]
    joined = sums[0]
    for other in sums[1:]:
        joined = joined.join(other, "rows")
    return joined.select("rows", (F.col("c0") == F.col("c1")).alias("ordered_alike"), (F.col("c2") != F.col("c3")).alias("sees_moved_null"))
