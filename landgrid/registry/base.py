"""Query registry and the stand-in tables the checks run on.

A stand-in is one SELECT over the driver's tables whose text runs unchanged in
Spark SQL and in DuckDB. Queries read stand-ins as DataFrames; the matching
oracle SQL reads them as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import geo

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "conversations"]


def idiv(a: str, n: int) -> str:
    return f"cast(floor(({a}) / {n}) as bigint)"


def pad(a: str, n: int) -> str:
    return f"lpad(cast({a} as string), {n}, '0')"


def lng(key: str) -> str:
    return f"(cast(-79 as double) + cast((({key}) * 7919) % 12000 as double) / cast(1000 as double))"


def lat(key: str) -> str:
    return f"(cast(-4 as double) + cast((({key}) * 10473) % 16000 as double) / cast(1000 as double))"


MUNI_OF_CUSTOMER = f"{pad('o_custkey % 5 + 1', 2)} || {pad('o_custkey % 25 + 1', 3)}"

STANDINS = {
    "department": f"select {pad('r_regionkey + 1', 2)} as dept_code, r_name as dept_name from {{region}}",
    "municipality": f"""
        select {pad('n_regionkey + 1', 2)} || {pad('n_nationkey + 1', 3)} as muni_code,
               n_name as muni_name, {pad('n_regionkey + 1', 2)} as dept_code,
               cast(n_nationkey * 1000 + 500 as bigint) as population,
               {lng('n_nationkey * 37')} as seat_lng, {lat('n_nationkey * 37')} as seat_lat,
               {lng('n_nationkey * 37')} - 1.5 as xmin, {lat('n_nationkey * 37')} - 1.5 as ymin,
               {lng('n_nationkey * 37')} + 1.5 as xmax, {lat('n_nationkey * 37')} + 1.5 as ymax
        from {{nation}}""",
    "manager": f"""
        select {pad('n_regionkey + 1', 2)} || {pad('n_nationkey + 1', 3)} as muni_code,
               'Manager ' || cast(n_regionkey as string) as manager_name,
               (n_nationkey % 2 = 0) as is_igac,
               case when n_nationkey % 3 = 0 then 'covered' when n_nationkey % 3 = 1 then 'partial' end as coverage_status
        from {{nation}} where n_nationkey % 4 <> 3""",
    # One parcel per order; the cut is the year of the order.
    "parcel": f"""
        select o_orderkey as parcel_key,
               {MUNI_OF_CUSTOMER} || '0' || cast(o_orderkey % 3 as string)
                 || {pad(idiv('o_orderkey', 100000000), 2)} || '00' || {pad('o_orderkey % 97', 2)}
                 || {pad(idiv("o_orderkey", 10000) + " % 10000", 4)} || {pad('o_orderkey % 10000', 4)}
                 || case when o_orderkey % 5 = 0 then '901' || '02' || {pad('o_orderkey % 50', 4)} else '000000000' end as npn,
               {pad('o_orderkey', 20)} as npn_old,
               {pad('o_custkey % 5 + 1', 2)} as dept_code,
               {MUNI_OF_CUSTOMER} as muni_code,
               case when o_orderstatus = 'F' then '02' else '01' end as zone,
               o_totalprice as area_m2,
               case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then cast(0 as double) else o_totalprice * 0.5 end as built_area_m2,
               case when o_orderkey % 13 = 0 then null else o_orderpriority end as economic_use,
               case when o_orderkey % 17 = 0 then null else o_totalprice * 4 end as cadastral_value,
               'Cra. ' || cast(o_orderkey % 170 + 1 as string) || ' No ' || cast(o_orderkey % 90 + 1 as string) || ' - ' || cast(o_orderkey % 60 + 1 as string) as address,
               {lng('o_orderkey')} as lng, {lat('o_orderkey')} as lat,
               cast(2 + o_orderkey % 5 as double) / cast(1000 as double) as half,
               cast(year(o_orderdate) as bigint) as snapshot_id
        from {{orders}}""",
    "snapshot": """
        select cast(year(o_orderdate) as bigint) as snapshot_id,
               case when year(o_orderdate) % 2 = 0 then 'cadastre_a' else 'cadastre_b' end as dataset_id,
               make_date(cast(year(o_orderdate) as int), 1, 1) as cut_date,
               cast(count(*) as bigint) as row_count,
               (year(o_orderdate) >= 2000) as is_active,
               (year(o_orderdate) = 1996) as is_synthetic,
               case when year(o_orderdate) >= 2000 then 'published' when year(o_orderdate) = 1997 then 'failed' else 'superseded' end as status
        from {orders} group by year(o_orderdate)""",
    "building": """
        select l_orderkey as parcel_key, cast(l_linenumber as bigint) as building_ref,
               cast(l_quantity as bigint) as floors, l_extendedprice as built_area_m2,
               l_returnflag as building_use, cast(year(l_shipdate) as bigint) as snapshot_id,
               l_partkey as part_key, l_suppkey as supp_key
        from {lineitem}""",
    "poi": f"""
        select c_custkey as poi_id, c_name as name, lower(c_mktsegment) as category,
               {lng('c_custkey')} as f_lng, {lat('c_custkey')} as f_lat, c_acctbal as weight
        from {{customer}}""",
    "health": f"""
        select s_suppkey as health_id, s_name as name, cast(s_suppkey % 3 as string) as category,
               {pad('s_nationkey % 5 + 1', 2)} || {pad('s_nationkey + 1', 3)} as muni_code,
               case when s_suppkey % 6 = 0 then null else {lng('s_suppkey * 13')} end as f_lng,
               case when s_suppkey % 6 = 0 then null else {lat('s_suppkey * 13')} end as f_lat
        from {{supplier}}""",
    "census": f"""
        select p_partkey as block_id, cast(p_size * 10 as bigint) as pop_total,
               cast(p_size * 3 as bigint) as households, cast(p_size * 4 as bigint) as dwellings,
               cast(p_size as bigint) as age_5_9, cast(p_size * 2 as bigint) as age_10_14, cast(p_size % 7 as bigint) as age_15_19,
               {lng('p_partkey * 7')} - cast(20 + p_partkey % 50 as double) / cast(1000 as double) as xmin,
               {lat('p_partkey * 7')} - cast(20 + p_partkey % 50 as double) / cast(1000 as double) as ymin,
               {lng('p_partkey * 7')} + cast(20 + p_partkey % 50 as double) / cast(1000 as double) as xmax,
               {lat('p_partkey * 7')} + cast(20 + p_partkey % 50 as double) / cast(1000 as double) as ymax
        from {{part}}""",
    # Rectangles of up to a degree that stand for protected areas, hazards and soils.
    "overlay": f"""
        select s_suppkey as overlay_id,
               case s_suppkey % 4 when 0 then 'protected_area' when 1 then 'hazard' when 2 then 'land_capability' else 'ethnic_territory' end as layer,
               case s_suppkey % 4 when 1 then case s_suppkey % 8 when 1 then 'flood' else 'seismic' end when 2 then cast(s_suppkey % 8 + 1 as string) else 'k' || cast(s_suppkey % 5 as string) end as layer_key,
               case s_suppkey % 5 when 0 then 'Muy alta' when 1 then 'Alta' when 2 then 'Media' when 3 then 'Baja' else 'Sin dato' end as level,
               {lng('s_suppkey * 29')} - cast(20 + s_suppkey % 50 as double) / cast(100 as double) as oxmin,
               {lat('s_suppkey * 29')} - cast(20 + s_suppkey % 50 as double) / cast(100 as double) as oymin,
               {lng('s_suppkey * 29')} + cast(20 + s_suppkey % 50 as double) / cast(100 as double) as oxmax,
               {lat('s_suppkey * 29')} + cast(20 + s_suppkey % 50 as double) / cast(100 as double) as oymax
        from {{supplier}}""",
    "cut_a": """
        select p_partkey as npn, p_brand as economic_use, p_retailprice as area_reported_m2,
               cast(p_size as bigint) as built_area_m2, p_type as zone
        from {part} where p_partkey % 10 <> 0""",
    "cut_b": """
        select p_partkey as npn, p_brand as economic_use,
               case when p_partkey % 5 = 0 then p_retailprice + 1 else p_retailprice end as area_reported_m2,
               case when p_partkey % 11 = 0 then null else cast(p_size as bigint) end as built_area_m2, p_type as zone
        from {part} where p_partkey % 10 <> 1""",
    "indicator": f"""
        select {MUNI_OF_CUSTOMER} as muni_code,
               case when o_orderstatus = 'F' then 'education_dropout_rate' when o_orderstatus = 'O' then 'education_pass_rate' else 'education_net_coverage' end as indicator,
               cast(year(o_orderdate) as string) as period,
               case when o_custkey % 25 = 7 then null else round(sum(o_totalprice), 2) end as value
        from {{orders}} group by 1, 2, 3, o_custkey % 25""",
    "usage": """
        select event_id, cast(ts as timestamp) as ts, cast(user_id % 50 as bigint) as org_id, user_id, event_type as metric,
               cast(floor(value) as bigint) as amount, value
        from {events}""",
    # One unit per order with a value, or none, for most indicators.
    "unit": """
        select o_orderkey as unit_key, cast(o_custkey % 60 as double) as slope_mean_pct,
               case when o_orderkey % 9 = 0 then null else cast(o_custkey * 3 as double) end as elevation_mean_m,
               case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 8 + 1 as string) end as land_capability_class,
               case o_orderkey % 6 when 0 then 'Agrícola' when 1 then 'ganadera' when 2 then 'Conservación' when 3 then 'agroforestal' when 4 then 'otra' end as land_vocation,
               case o_orderkey % 5 when 0 then 'uso adecuado' when 1 then 'Sobreutilización severa' when 2 then 'subutilizacion_ligera' end as land_use_conflict,
               case o_orderkey % 7 when 0 then 'Alta' when 1 then null when 2 then 'Media' else 'Muy Baja' end as hazard_landslide_level,
               case o_orderkey % 11 when 0 then 'Muy alta' when 1 then null when 2 then 'Media' else 'Baja' end as hazard_flood_level,
               case when o_orderkey % 13 = 0 then null else cast(case when o_orderkey % 4 = 0 then o_custkey % 100 else 0 end as double) end as protected_area_overlap_pct,
               case o_orderkey % 3 when 0 then 'Parque Nacional Natural' when 1 then 'Área de recreación' end as protected_area_category,
               case when o_orderkey % 17 = 0 then null else cast(case when o_orderkey % 8 = 0 then o_custkey % 30 else 0 end as double) end as ethnic_territory_overlap_pct,
               case o_orderkey % 4 when 0 then true when 1 then false when 2 then true end as inside_agricultural_frontier,
               case o_orderkey % 5 when 0 then false when 1 then null else true end as inside_urban_perimeter,
               case o_orderkey % 6 when 0 then 'Suelo urbano' when 1 then 'Suelo rural' when 2 then 'Suelo de protección' when 3 then 'Suelo suburbano' end as pot_classification,
               cast(o_custkey * 11 % 12000 as double) as distance_primary_road_m, cast(o_custkey * 7 % 6000 as double) as distance_secondary_road_m,
               case when o_orderkey % 19 = 0 then null else cast(o_custkey * 5 % 4000 as double) end as distance_paved_road_m,
               cast(o_custkey * 23 % 33000 as double) as distance_municipal_seat_m, cast(o_custkey * 3 % 3500 as double) as distance_school_m,
               cast(o_custkey * 13 % 11000 as double) as distance_health_facility_m,
               case when o_orderkey % 23 = 0 then null else cast(o_custkey % 101 as double) end as road_access_index,
               floor(o_totalprice / 32) as population_density_per_km2, cast(o_custkey % 1600 as double) as school_age_population,
               cast(o_custkey % 120 as double) as school_seats_per_100_school_age, cast(o_custkey % 420 as double) as commerce_poi_density_per_km2,
               cast(o_custkey % 70 as double) as tourism_poi_density_per_km2, cast(o_custkey % 2100 as double) as parcel_density_per_km2,
               floor(o_totalprice / 10) as parcel_area_m2, cast(o_custkey % 17 as double) as large_parcels_count
        from {orders}""",
    "ledger": """
        select cast(event_id as string) as entry_id, cast(user_id % 50 as bigint) as owner_id,
               case event_type when 'signup' then 'plan_grant' when 'purchase' then 'purchase' when 'view' then 'debit' when 'click' then 'refund' else 'expiry' end as kind,
               case when event_type in ('view', 'error') then -cast(floor(value) as bigint) - 1 else cast(floor(value) as bigint) + 1 end as amount, cast(ts as timestamp) as ts
        from {events}""",
}


class Query:
    def __init__(self, build: Callable, oracle: str | None, covers: str):
        self.build, self.oracle, self.covers = build, oracle, covers


QUERIES: dict[str, Query] = {}


class Tables:
    """The driver's tables and the stand-ins of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def outlined(self) -> DataFrame:
        """Parcels with their outline, the square that stands for it here."""
        x, y, half = F.col("lng"), F.col("lat"), F.col("half")
        return self.parcel.withColumn("rings", geo.rectangle(x - half, y - half, x + half, y + half))

    def __getattr__(self, name: str) -> DataFrame:
        if name in STANDINS:
            text = STANDINS[name]
            used = {t: self.raw(t) for t in TABLES if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        return self.raw(name)


def standin_sql(*names: str) -> str:
    plain = {t: t for t in TABLES}
    return "with " + ", ".join(f"{n} as ({STANDINS[n].format(**plain)})" for n in names)


def query(name: str, covers: str, uses: str = "", oracle: str | None = None):
    """Register a query; ``uses`` names the stand-ins its oracle SQL reads."""
    def add(build: Callable[[Tables], DataFrame]):
        text = oracle
        if oracle is not None and uses:
            body = oracle.strip()
            joiner = ", " if body.startswith("with ") else " "
            body = body[5:] if body.startswith("with ") else body
            text = standin_sql(*uses.split()) + joiner + body
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = Query(build, text, covers)
        return build
    return add
