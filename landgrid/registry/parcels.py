"""Parcel queries, rollups and coverage."""

from pyspark.sql import functions as F

from landgrid.operators import parcels as ops
from landgrid.operators.parcels import Near, ParcelQuery
from landgrid.registry.base import query

ACTIVE = "snapshot_id in (select snapshot_id from snapshot where is_active)"


@query("municipality_summary", "A1 J1 J2", "department municipality manager parcel health snapshot", f"""
    with p as (select muni_code, count(*) as n_parcels, count(*) filter (where zone = '01') as n_urban, count(*) filter (where zone = '02') as n_rural,
                      sum(area_m2) as area_sum_m2, sum(built_area_m2) as built_area_sum_m2 from parcel where {ACTIVE} group by muni_code),
    h as (select muni_code, count(*) as n_health from health group by muni_code),
    s as (select muni_code, count(*) as n_schools from (select muni_code from parcel where zone = '02') group by muni_code)
    select m.muni_code, m.muni_name, d.dept_name, g.manager_name, g.coverage_status, coalesce(n_parcels, 0) as n_parcels, coalesce(n_urban, 0) as n_urban,
           coalesce(n_rural, 0) as n_rural, round(area_sum_m2, 2) as area_sum_m2, round(built_area_sum_m2, 2) as built_area_sum_m2,
           coalesce(n_schools, 0) as n_schools, coalesce(n_health, 0) as n_health
    from municipality m join department d using (dept_code) left join manager g using (muni_code) left join p using (muni_code) left join s using (muni_code) left join h using (muni_code)""")
def _(t):
    schools = t.parcel.where("zone = '02'").select("muni_code")
    out = ops.municipality_summary(t.municipality, t.department, t.manager, t.parcel, schools, t.health, t.snapshot)
    return out.select(
        "muni_code", "muni_name", "dept_name", "manager_name", "coverage_status", "n_parcels", "n_urban", "n_rural",
        F.round("area_sum_m2", 2).alias("area_sum_m2"), F.round("built_area_sum_m2", 2).alias("built_area_sum_m2"),
        "n_schools", "n_health",
    )


@query("parcel_names", "J1", "parcel municipality department snapshot", f"""
    select p.parcel_key, p.npn, m.muni_name, d.dept_name from parcel p join municipality m using (muni_code)
    join department d on d.dept_code = p.dept_code where {ACTIVE}""")
def _(t):
    from landgrid.operators.snapshots import active_rows
    out = ops.with_names(active_rows(t.parcel, t.snapshot), t.municipality, t.department)
    return out.select("parcel_key", "npn", "muni_name", "dept_name")


@query("parcel_query_page", "P1 P2 P3 P4 P5 P8 L1 L7", "parcel snapshot", f"""
    select parcel_key, npn, area_m2, economic_use from parcel
    where dept_code = '02' and {ACTIVE} and zone = '01' and area_m2 >= 50000 and area_m2 < 400000
      and upper(economic_use) in ('1-URGENT', '2-HIGH') and built_area_m2 > 0
    order by area_m2 desc nulls last, npn desc limit 51""")
def _(t):
    q = ParcelQuery(department="02", zone="urbano", ranges={"area_m2": {"gte": 50000.0, "lt": 400000.0}},
                    economic_use=["1-urgent", "2-high"], has_building=True, limit=50)
    return ops.query_parcels(t.outlined, t.snapshot, q).select("parcel_key", "npn", "area_m2", "economic_use")


@query("parcel_query_cursor", "P9 D3", "parcel snapshot", """
    select npn, cadastral_value from parcel where dept_code = '03' and muni_code = '03013' and
      snapshot_id in (select snapshot_id from snapshot where cut_date = date '1998-01-01')
      and (cadastral_value is null or cadastral_value < 900000 or (cadastral_value = 900000 and npn < '0'))
    order by cadastral_value desc nulls last, npn desc limit 501""")
def _(t):
    q = ParcelQuery(municipality="03013", cut_date="1998-01-01", sort="cadastral_value:desc", limit=500,
                    cursor=ops.encode_cursor(900000.0, "0"))
    return ops.query_parcels(t.outlined, t.snapshot, q).select("npn", "cadastral_value")


@query("parcel_query_box", "P6", "parcel snapshot", f"""
    select npn from parcel where dept_code = '01' and {ACTIVE} and lng - half <= -70 and lng + half >= -76
      and lat - half <= 8 and lat + half >= 1""")
def _(t):
    q = ParcelQuery(department="01", bbox=(-76.0, 1.0, -70.0, 8.0))
    return ops.filter_parcels(t.outlined, t.snapshot, q).select("npn")


@query("parcel_query_floors", "J3", "parcel building snapshot", f"""
    select npn from parcel p where dept_code = '04' and {ACTIVE} and exists (
      select 1 from building b where b.parcel_key = p.parcel_key and b.snapshot_id = p.snapshot_id and b.floors >= 10 and b.floors <= 40)""")
def _(t):
    q = ParcelQuery(department="04", floors={"gte": 10, "lte": 40})
    return ops.filter_parcels(t.outlined, t.snapshot, q, buildings=t.building).select("npn")


@query("parcel_query_near", "J5", "parcel poi health snapshot", f"""
    select npn from parcel p where dept_code = '05' and {ACTIVE}
      and exists (select 1 from poi where category in ('machinery', 'building') and abs(f_lat - p.lat) < 0.2
         and 2 * 6371008.8 * asin(least(sqrt(pow(sin(radians(f_lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(f_lat)) * pow(sin(radians(f_lng - p.lng) / 2), 2)), 1)) <= 15000)
      and not exists (select 1 from health where abs(f_lat - p.lat) < 0.2
         and 2 * 6371008.8 * asin(least(sqrt(pow(sin(radians(f_lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(f_lat)) * pow(sin(radians(f_lng - p.lng) / 2), 2)), 1)) <= 20000)""")
def _(t):
    q = ParcelQuery(department="05", near=[Near("poi", 15000, ["machinery", "building"]), Near("health_facility", 20000, invert=True)])
    return ops.filter_parcels(t.outlined, t.snapshot, q, layers={"poi": t.poi, "health_facility": t.health}).select("npn")


@query("parcel_query_zones", "J4", "parcel overlay snapshot", f"""
    select npn from parcel p where dept_code = '02' and {ACTIVE} and exists (
      select 1 from overlay where layer_key in ('k1', 'k2') and lng - half < oxmax and lng + half > oxmin and lat - half < oymax and lat + half > oymin)""")
def _(t):
    from landgrid.functions.geo import rectangle
    zones = t.overlay.select(F.col("layer_key").alias("zone_code"),
                             rectangle(F.col("oxmin"), F.col("oymin"), F.col("oxmax"), F.col("oymax")).alias("zone_rings"))
    q = ParcelQuery(department="02", homogeneous_zone=["k1", "k2"])
    return ops.filter_parcels(t.outlined, t.snapshot, q, zones=zones).select("npn")


@query("parcel_query_within", "P1", "parcel snapshot", f"""
    select npn from parcel where dept_code = '03' and {ACTIVE} and lng - half < -71 and lng + half > -75 and lat - half < 9 and lat + half > 2""")
def _(t):
    ring = [(-75, 2), (-71, 2), (-71, 9), (-75, 9), (-75, 2)]
    return ops.filter_parcels(t.outlined, t.snapshot, ParcelQuery(department="03", within=[ring])).select("npn")


@query("parcel_scope_count", "P10 S10", "parcel snapshot", f"select count(*) as n from parcel where dept_code = '01' and {ACTIVE}")
def _(t):
    return ops.count_parcels(t.outlined, t.snapshot, ParcelQuery(department="01", zone="rural"))


@query("parcels_by_old_code", "C14", "parcel", """
    select l.npn_old as query, p.npn, p.parcel_key from parcel l join parcel p using (npn_old)""")
def _(t):
    asked = t.parcel.select(F.concat(F.substring("npn_old", 1, 8), F.lit("-"), F.substring("npn_old", 9, 12)).alias("query"))
    out = ops.by_old_code(asked, t.parcel)
    return out.select(F.replace("query", F.lit("-"), F.lit("")).alias("query"), "npn", "parcel_key")


@query("parcel_units", "C15", "parcel", """
    select parcel_key, npn, substr(npn, 1, 21) || '000000000' as matrix_npn from parcel where substr(npn, 22, 9) <> '000000000'""")
def _(t):
    return ops.units_of(t.parcel).select("parcel_key", "npn", "matrix_npn")


COVER_SQL = f"""
    with n as (select muni_code, count(*) as n_parcels from parcel where {ACTIVE} group by muni_code),
    c as (select m.muni_code, m.dept_code, coalesce(g.manager_name, 'No determinado') as manager_name, g.is_igac,
      coalesce(g.coverage_status, 'unknown') as coverage_status, coalesce(n.n_parcels, 0) as n_parcels
      from municipality m left join manager g using (muni_code) left join n using (muni_code)) """


@query("coverage", "A31", "municipality manager parcel snapshot", COVER_SQL + "select * from c")
def _(t):
    return ops.coverage(t.municipality, t.manager, t.parcel, t.snapshot)


@query("coverage_by_department", "A20", "municipality manager parcel snapshot", COVER_SQL + """
    select dept_code, count(*) as municipalities, count(*) filter (where is_igac) as national_manager,
      count(*) filter (where n_parcels > 0) as with_parcels, cast(sum(n_parcels) as bigint) as n_parcels from c group by dept_code""")
def _(t):
    return ops.coverage_by_department(ops.coverage(t.municipality, t.manager, t.parcel, t.snapshot))


@query("mark_coverage", "C16 U4 F46", "manager parcel snapshot", """
    with l as (select muni_code, cut_date, 'layer_' || zone as layer from parcel join snapshot using (snapshot_id)),
    f as (select muni_code, max(cut_date) as cut, list(distinct layer) as ls from l group by muni_code)
    select muni_code, cast(greatest(date '1999-12-31', f.cut) as varchar) as last_cut_date,
      array_to_string(list_sort(list_distinct(list_concat(['layer_00', 'layer_02'], coalesce(f.ls, [])))), ',') as layers
    from manager left join f using (muni_code)""")
def _(t):
    managers = t.manager.withColumn("available_layers", F.array(F.lit("layer_02"), F.lit("layer_00"))).withColumn(
        "last_cut_date", F.lit("1999-12-31").cast("date"))
    loaded = t.parcel.join(t.snapshot.select("snapshot_id", "cut_date"), "snapshot_id").select(
        "muni_code", "cut_date", F.concat(F.lit("layer_"), "zone").alias("layer"))
    out = ops.mark_coverage(managers, loaded)
    return out.select("muni_code", F.col("last_cut_date").cast("string").alias("last_cut_date"),
                      F.array_join("available_layers", ",").alias("layers"))
