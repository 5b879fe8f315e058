"""Spatial joins, cells, areas and tiles."""

from pyspark.sql import functions as F

from landgrid.functions import geo, hexgrid
from landgrid.operators import areas, cells, parcels, shapes, spatial
from landgrid.registry.base import lat, lng, query

HAV = "2 * 6371008.8 * asin(least(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)), 1))"


def hav(lat1, lat2, lng1, lng2):
    return HAV.format(a=lat1, b=lat2, c=lng1, d=lng2)


def box(df, x0, y0, x1, y1, name, *keep):
    return df.select(*keep, geo.rectangle(F.col(x0), F.col(y0), F.col(x1), F.col(y1)).alias(name))


def munis(t):
    return box(t.municipality, "xmin", "ymin", "xmax", "ymax", "rings", "muni_code", "seat_lng", "seat_lat")


def overlays(t, *keep):
    return box(t.overlay, "oxmin", "oymin", "oxmax", "oymax", "o_rings", *keep)


def owned(t):
    """Parcels with their outline."""
    return t.outlined


INSIDE = "lng >= xmin and lng < xmax and lat >= ymin and lat < ymax"
SHARED = "(least(lng + half, {x1}) - greatest(lng - half, {x0})) * (least(lat + half, {y1}) - greatest(lat - half, {y0}))"
OVER = SHARED.format(x0="oxmin", x1="oxmax", y0="oymin", y1="oymax")
TOUCH = "lng - half < oxmax and lng + half > oxmin and lat - half < oymax and lat + half > oymin"


@query("municipality_at_parcels", "J8 J17 F46", "parcel municipality", f"""
    select parcel_key, min(muni) as muni_code from (select parcel_key, m.muni_code as muni from parcel join municipality m on {INSIDE}) group by 1""")
def _(t):
    m = munis(t).select(F.col("muni_code"), F.col("rings").alias("m_rings"), F.lit(9.0).alias("m_area"))
    return spatial.smallest_holder(t.parcel.select("parcel_key", "lng", "lat"), m, "parcel_key", "muni_code", "m_area", rings="m_rings")


@query("smallest_block_at_poi", "J8", "poi census", """
    select poi_id, arg_min(block_id, (round((xmax - xmin) * (ymax - ymin), 9), block_id)) as block_id from poi
    join census on f_lng >= xmin and f_lng < xmax and f_lat >= ymin and f_lat < ymax group by 1""")
def _(t):
    blocks = box(t.census, "xmin", "ymin", "xmax", "ymax", "b_rings", "block_id").withColumn("b_area", F.round(geo.area(F.col("b_rings")), 9))
    return spatial.smallest_holder(t.poi.select("poi_id", "f_lng", "f_lat"), blocks, "poi_id", "block_id", "b_area", x="f_lng", y="f_lat", rings="b_rings")


@query("parcel_overlaps", "J9 G3 G4 C12", "parcel overlay", f"""
    select parcel_key, overlay_id, round(least(greatest({OVER} / (4 * half * half) * 100, 0), 100), 3) as overlap_pct from parcel join overlay on {TOUCH}
    where {OVER} > 1e-11 * 4 * half * half""")
def _(t):
    pairs = spatial.polygon_overlaps(owned(t).select("parcel_key", "half", "rings"), overlays(t, "overlay_id"), "parcel_key", "rings", "o_rings")
    return pairs.select("parcel_key", "overlay_id", spatial.overlap_pct(F.col("overlap"), 4 * F.col("half") * F.col("half")).alias("overlap_pct"))


@query("overlay_maxima", "A6 J10", "parcel overlay", f"""
    with p as (select parcel_key, layer, round(least(sum({OVER}) / (4 * half * half) * 100, 100), 3) as pct from parcel join overlay on {TOUCH} where {OVER} > 1e-11 * 4 * half * half group by parcel_key, layer, overlay_id, half)
    select parcel_key, max(case when layer = 'protected_area' then pct end) as protected_pct, max(case when layer = 'ethnic_territory' then pct end) as ethnic_pct from p
    where layer in ('protected_area', 'ethnic_territory') group by 1""")
def _(t):
    return cells.layer_maxima(shares(t), "parcel_key", {"protected_area": "protected_pct", "ethnic_territory": "ethnic_pct"})


def shares(t, **options):
    from landgrid.operators.ingest import hazard_rank
    o = overlays(t, "layer", "layer_key", "level", F.col("overlay_id").alias("source_id")).withColumn("level_rank", hazard_rank(F.col("level")))
    return cells.overlay_shares(owned(t).select("parcel_key", "rings"), o, "parcel_key", "rings", **options)


@query("worst_hazards", "A7", "parcel overlay", f"""
    with h as (select parcel_key, layer_key, arg_max(level, (case level when 'Muy alta' then 5 when 'Alta' then 4 when 'Media' then 3 when 'Baja' then 2 else 0 end, level)) as level
      from parcel join overlay on {TOUCH} where layer = 'hazard' group by 1, 2)
    select parcel_key, max(case when layer_key = 'flood' then level end) as flood, max(case when layer_key = 'seismic' then level end) as seismic from h group by 1""")
def _(t):
    w = cells.worst_hazards(shares(t, strongest=True), "parcel_key")
    at = lambda k: F.try_element_at("hazard_flags", F.lit(k))
    return w.select("parcel_key", at("flood").alias("flood"), at("seismic").alias("seismic"))


@query("capability_mix", "A8 U1", "parcel overlay", f"""
    with p as (select parcel_key, layer_key, overlay_id, round(least(sum({OVER}) / (4 * half * half) * 100, 100), 3) as pct from parcel join overlay on {TOUCH} where layer = 'land_capability' group by 1, 2, 3, half)
    select parcel_key, layer_key, round(least(sum(pct), 100), 2) as pct from p group by 1, 2""")
def _(t):
    mix = cells.category_mix(shares(t), "parcel_key", "land_capability", "mix")
    return mix.select("parcel_key", F.explode("mix").alias("layer_key", "pct"))


@query("layer_union_overlaps", "U1 C12", "parcel overlay", f"""
    select parcel_key, layer as kind, 'k' || layer_key as code, round(least({OVER} / (4 * half * half) * 100, 100), 3) as overlap_pct from parcel join overlay on {TOUCH}
    where layer in ('hazard', 'land_capability') and {OVER} > 1e-11 * 4 * half * half""")
def _(t):
    o = overlays(t, "layer", "layer_key").select("layer", F.concat(F.lit("k"), "layer_key").alias("code"), F.lit(None).cast("string").alias("label"), F.col("o_rings").alias("l_rings"))
    layers = areas.union_layers({k: o.where(F.col("layer") == k) for k in ("hazard", "land_capability")})
    return areas.overlaps_of(owned(t), layers, "parcel_key", "rings").select("parcel_key", "kind", "code", "overlap_pct")


@query("inside_urban_perimeter", "C12", "parcel overlay", f"""
    with u as (select *, lpad(cast(overlay_id % 5 + 1 as varchar), 2, '0') || lpad(cast(overlay_id % 25 + 1 as varchar), 3, '0') as u_muni from overlay where overlay_id < 25),
    s as (select parcel_key, least(sum({OVER}) / (4 * half * half) * 100, 100) as pct from parcel join u on muni_code = u_muni and {TOUCH} group by parcel_key, half)
    select p.parcel_key, case when muni_code in (select u_muni from u) then coalesce(pct, 0) > 50 end as inside_urban_perimeter from parcel p left join s using (parcel_key)""")
def _(t):
    from landgrid.registry.base import pad
    o = overlays(t, "overlay_id").where("overlay_id < 25").select(F.expr(pad("overlay_id % 5 + 1", 2) + " || " + pad("overlay_id % 25 + 1", 3)).alias("muni_code"), F.col("o_rings").alias("rings"))
    return areas.inside_urban(owned(t), o, "parcel_key", "rings")


@query("nearest_poi", "J11 A14", "health poi", f"""
    with d as (select health_id, poi_id, {hav('h.f_lat', 'p.f_lat', 'h.f_lng', 'p.f_lng')} as m from health h join poi p on abs(h.f_lat - p.f_lat) < 0.9)
    select health_id, arg_min(poi_id, (m, poi_id)) as poi_id, round(min(m), 3) as distance_m from d where m <= 80000 group by 1""")
def _(t):
    h = t.health.select("health_id", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    out = spatial.nearest(h, t.poi, [10_000, 80_000], "health_id", "poi_id", left_xy=("lng", "lat"), right_xy=("f_lng", "f_lat"))
    return out.withColumn("distance_m", F.round("distance_m", 3))


@query("nearest_anywhere", "J12", "poi municipality", f"""
    with d as (select poi_id, muni_code, {hav('f_lat', 'seat_lat', 'f_lng', 'seat_lng')} as m from poi join municipality on true)
    select poi_id, arg_min(muni_code, (m, muni_code)) as muni_code, round(min(m), 3) as distance_m from d group by 1""")
def _(t):
    out = spatial.nearest_anywhere(t.poi.select("poi_id", "f_lng", "f_lat"), t.municipality, "poi_id", "muni_code", left_xy=("f_lng", "f_lat"), right_xy=("seat_lng", "seat_lat"))
    return out.withColumn("distance_m", F.round("distance_m", 3))


@query("nearby_top_k", "J13 L3", "municipality poi health", f"""
    with d as (select muni_code, 'poi' as layer, cast(poi_id as varchar) as id, {hav('seat_lat', 'f_lat', 'seat_lng', 'f_lng')} as m from municipality join poi on abs(seat_lat - f_lat) < 1
      union all select m.muni_code, 'health', cast(health_id as varchar), {hav('seat_lat', 'f_lat', 'seat_lng', 'f_lng')} from municipality m join health on abs(seat_lat - f_lat) < 1),
    r as (select *, row_number() over (partition by muni_code, layer order by m, id) as place from d where m <= 100000)
    select muni_code, layer, id, round(m, 3) as distance_m, place from r where place <= 5""")
def _(t):
    text = lambda df, key: df.select(F.col(key).cast("string").alias("id"), "name", "category", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    out = spatial.top_k_near(t.municipality, {"poi": text(t.poi, "poi_id"), "health": text(t.health, "health_id")}, 100_000, 5, "muni_code", ("seat_lng", "seat_lat"))
    return out.select("muni_code", "layer", "id", F.round("distance_m", 3).alias("distance_m"), "place")


@query("near_anti", "J5", "poi health", f"""
    select poi_id from poi p where not exists (select 1 from health h where abs(h.f_lat - p.f_lat) < 0.3 and {hav('p.f_lat', 'h.f_lat', 'p.f_lng', 'h.f_lng')} <= 20000)""")
def _(t):
    h = t.health.select(F.col("f_lng").alias("h_lng"), F.col("f_lat").alias("h_lat"))
    return spatial.near(t.poi, h, 20_000, "poi_id", invert=True, left_xy=("f_lng", "f_lat"), right_xy=("h_lng", "h_lat")).select("poi_id")


ROAD_SQL = f"""roads as (select s_suppkey as road_id, case s_suppkey % 4 when 0 then 'primary' when 1 then 'secondary' when 2 then 'residential' else 'tertiary' end as class, s_suppkey % 3 <> 0 as is_paved,
      {lng('s_suppkey * 41')} as x1, {lat('s_suppkey * 41')} as y1, {lng('s_suppkey * 41')} + 0.5 as x2, {lat('s_suppkey * 41')} + 0.3 as y2 from supplier)"""


def roads(t):
    r = t.supplier.select(
        F.col("s_suppkey").alias("road_id"), F.when(F.col("s_suppkey") % 4 == 0, "primary").when(F.col("s_suppkey") % 4 == 1, "secondary").when(F.col("s_suppkey") % 4 == 2, "residential").otherwise("tertiary").alias("class"),
        (F.col("s_suppkey") % 3 != 0).alias("is_paved"), F.expr(lng("s_suppkey * 41")).alias("x"), F.expr(lat("s_suppkey * 41")).alias("y"))
    line = F.array(geo.point(F.col("x"), F.col("y")), geo.point(F.col("x") + 0.5, F.col("y") + 0.3))
    return spatial.line_segments(r.withColumn("line", line), "line").drop("x", "y")


SEG = """case when l2 > 0 then sqrt(pow(ax + least(greatest(-(ax * dx + ay * dy) / l2, 0), 1) * dx, 2) + pow(ay + least(greatest(-(ax * dx + ay * dy) / l2, 0), 1) * dy, 2)) end"""
PER_DEGREE = repr(geo.METRES_PER_DEGREE)


@query("road_access", "A13 J11 G2", "poi", f"""
    with {ROAD_SQL}, v as (select poi_id, class, is_paved, (x1 - f_lng) * {PER_DEGREE} * cos(radians(f_lat)) as ax, (y1 - f_lat) * {PER_DEGREE} as ay, (x2 - x1) * {PER_DEGREE} * cos(radians(f_lat)) as dx, (y2 - y1) * {PER_DEGREE} as dy
      from poi join roads on f_lat > y1 - 0.2 and f_lat < y2 + 0.2 and f_lng > x1 - 0.2 and f_lng < x2 + 0.2),
    w as (select *, dx * dx + dy * dy as l2 from v), d as (select poi_id, class, is_paved, {SEG} as m from w)
    select poi_id, round(min(m) filter (where class = 'primary'), 3) as dist_primary_m, round(min(m) filter (where class in ('secondary', 'tertiary')), 3) as dist_secondary_m,
      round(min(m) filter (where is_paved), 3) as dist_paved_m, round(min(m), 3) as dist_any_m from d where m <= 10000 group by 1""")
def _(t):
    out = areas.road_access(t.poi.select("poi_id", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat")), roads(t), "poi_id")
    return out.select("poi_id", *[F.round(c, 3).alias(c) for c in ("dist_primary_m", "dist_secondary_m", "dist_paved_m", "dist_any_m")])


@query("nearest_roads", "J11", "parcel", f"""
    with {ROAD_SQL}, v as (select parcel_key, class, is_paved, (x1 - lng) * {PER_DEGREE} * cos(radians(lat)) as ax, (y1 - lat) * {PER_DEGREE} as ay, (x2 - x1) * {PER_DEGREE} * cos(radians(lat)) as dx, (y2 - y1) * {PER_DEGREE} as dy
      from parcel join roads on lat > y1 - 0.2 and lat < y2 + 0.2 and lng > x1 - 0.2 and lng < x2 + 0.2),
    w as (select *, dx * dx + dy * dy as l2 from v), d as (select parcel_key, class, is_paved, {SEG} as m from w)
    select parcel_key, round(min(m) filter (where class = 'primary'), 2) as dist_primary_road_m, round(min(m) filter (where is_paved), 2) as dist_paved_road_m from d where m <= 15000 group by 1
    having min(m) filter (where is_paved) is not null""")
def _(t):
    points = t.parcel.select("parcel_key", "lng", "lat")
    out = cells.road_distances(points, roads(t), "parcel_key", ("lng", "lat")).where("dist_paved_road_m is not null")
    return out.select("parcel_key", F.round("dist_primary_road_m", 2).alias("dist_primary_road_m"), F.round("dist_paved_road_m", 2).alias("dist_paved_road_m"))


@query("nearest_facilities", "A14", "poi health", f"""
    with d as (select poi_id, {hav('p.f_lat', 'h.f_lat', 'p.f_lng', 'h.f_lng')} as m from poi p join health h on abs(p.f_lat - h.f_lat) < 0.3)
    select p.poi_id, round(min(m) filter (where m <= 20000), 3) as dist_health_m from poi p left join d using (poi_id) group by 1""")
def _(t):
    points = t.poi.select("poi_id", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    out = areas.nearest_facilities(points, {"health": t.health.withColumnRenamed("health_id", "id")}, "poi_id")
    return out.select("poi_id", F.round("dist_health_m", 3).alias("dist_health_m"))


@query("resolved_points", "C23 J12", "poi municipality parcel", f"""
    with held as (select poi_id, min(muni_code) as muni_code from poi join municipality on f_lng >= xmin and f_lng < xmax and f_lat >= ymin and f_lat < ymax group by 1),
    near as (select poi_id, arg_min(muni_code, (m, muni_code)) as muni_code from (select poi_id, muni_code, {hav('f_lat', 'seat_lat', 'f_lng', 'seat_lng')} as m from poi join municipality on true where poi_id not in (select poi_id from held)) where m <= 80000 group by 1),
    pp as (select poi_id, arg_min(npn, (area_m2, npn)) as npn from poi join parcel on f_lng >= lng - half and f_lng < lng + half and f_lat >= lat - half and f_lat < lat + half group by 1)
    select poi.poi_id, coalesce(held.muni_code, near.muni_code) as muni_code, case when held.muni_code is not null then 'polygon' when near.muni_code is not null then 'nearest' end as match, npn
    from poi left join held using (poi_id) left join near using (poi_id) left join pp using (poi_id)""")
def _(t):
    points = t.poi.select("poi_id", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    cover = t.manager.select("muni_code", "coverage_status", F.lit(1).alias("n_parcels"))
    # All stand-in municipalities have the same size, so the lower code wins.
    flat = munis(t).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: geo.point(p["x"], p["y"]))))
    return areas.resolve_points(points, flat, owned(t), cover, "poi_id").select("poi_id", "muni_code", "match", "npn")


def scopes(t):
    return box(t.municipality, "xmin", "ymin", "xmax", "ymax", "scope_rings", F.col("muni_code").alias("scope_id"), F.col("population").alias("position"))


PX = "lng - half < xmax and lng + half > xmin and lat - half < ymax and lat + half > ymin"


def footprints(t):
    b = t.building.join(t.parcel.select("parcel_key", "lng", "lat"), "parcel_key")
    return box(b.selectExpr("*", "lng - 0.001 as x0", "lng + 0.001 as x1", "lat - 0.001 as y0", "lat + 0.001 as y1"), "x0", "y0", "x1", "y1", "b_rings",
               F.concat_ws("-", "parcel_key", "building_ref", "part_key").alias("building_id"), "parcel_key", F.col("built_area_m2").alias("footprint_m2"))


@query("parcel_stats_in_areas", "A10 L5 D4", "parcel building municipality", f"""
    with h as (select m.muni_code as scope_id, p.* from municipality m join parcel p on {PX}),
    s as (select scope_id, count(*) as n_parcels, count(*) filter (where zone = '01') as n_urban, round(sum(area_m2), 2) as area_sum_m2, round(quantile_cont(area_m2, 0.5), 4) as area_median_m2,
      max(u.n) as top_use from h join (select scope_id as s2, max(n) as n from (select scope_id, coalesce(economic_use, 'NO_DISPONIBLE') as u, count(*) as n from h group by 1, 2) group by 1) u on u.s2 = scope_id group by 1),
    b as (select m.muni_code as scope_id, count(*) as n_buildings, count(distinct b.parcel_key) as n_with_building from building b join parcel p using (parcel_key)
      join municipality m on least(lng + 0.001, xmax) - greatest(lng - 0.001, xmin) > 1e-12 and least(lat + 0.001, ymax) - greatest(lat - 0.001, ymin) > 1e-12 group by 1)
    select m.muni_code as scope_id, coalesce(n_parcels, 0) as n_parcels, coalesce(n_urban, 0) as n_urban, area_sum_m2, area_median_m2, top_use, coalesce(n_buildings, 0) as n_buildings, coalesce(n_with_building, 0) as n_with_building,
      coalesce(n_parcels, 0) - coalesce(n_with_building, 0) as large_lots from municipality m left join s on s.scope_id = m.muni_code left join b on b.scope_id = m.muni_code""")
def _(t):
    out = areas.parcel_stats(owned(t), footprints(t), scopes(t))
    return out.select("scope_id", "n_parcels", "n_urban", F.round("area_sum_m2", 2).alias("area_sum_m2"), F.round("area_median_m2", 4).alias("area_median_m2"),
                      F.array_max(F.map_values("use_counts")).alias("top_use"), "n_buildings", "n_with_building", "large_lots")


def blocks(t):
    bands = F.create_map(F.lit("5_9"), F.col("age_5_9"), F.lit("10_14"), F.col("age_10_14"), F.lit("15_19"), F.col("age_15_19"))
    return box(t.census, "xmin", "ymin", "xmax", "ymax", "block_rings", "block_id", "pop_total", "households", "dwellings", bands.alias("age_bands"))


BLOCK_SHARE = "least(round((least(c.xmax, m.xmax) - greatest(c.xmin, m.xmin)) * (least(c.ymax, m.ymax) - greatest(c.ymin, m.ymin)) / ((c.xmax - c.xmin) * (c.ymax - c.ymin)) * 100, 3), 100) / 100"
BLOCK_TOUCH = "c.xmin < m.xmax and c.xmax > m.xmin and c.ymin < m.ymax and c.ymax > m.ymin"


@query("population_in_areas", "A11 A4", "census municipality", f"""
    with h as (select m.muni_code as scope_id, c.*, {BLOCK_SHARE} as f from census c join municipality m on {BLOCK_TOUCH})
    select scope_id, cast(round(sum(pop_total * f)) as bigint) as pop_total, cast(round(sum(households * f)) as bigint) as households, count(*) as n_blocks, cast(round(sum(age_10_14 * f)) as bigint) as band_10_14 from h group by 1""")
def _(t):
    out = areas.population_in(blocks(t), scopes(t))
    return out.select("scope_id", "pop_total", "households", "n_blocks", F.try_element_at("age_bands", F.lit("10_14")).alias("band_10_14"))


@query("population_per_shape", "A4 J10", "census municipality", f"""
    with h as (select m.muni_code, c.*, {BLOCK_SHARE} as f from census c join municipality m on {BLOCK_TOUCH})
    select muni_code, cast(round(sum(pop_total * f)) as bigint) as pop, cast(round(sum((age_5_9 + age_10_14 + age_15_19 * cast(0.4 as double)) * f)) as bigint) as pop_school_age from h group by 1""")
def _(t):
    b = blocks(t).withColumn("school_age", cells.school_age_of())
    return cells.population(munis(t), b, "muni_code", "rings").select("muni_code", "pop", "pop_school_age")


def places(t):
    h = t.health.select("health_id", "muni_code", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    p = t.poi.select("poi_id", "category", F.col("f_lng").alias("lng"), F.col("f_lat").alias("lat"))
    s = t.parcel.where("zone = '02'").select(F.col("parcel_key").alias("school_id"), F.floor("area_m2").alias("enrollment"), "lng", "lat")
    return s, h, p


@query("facilities_in_areas", "A12 A5", "parcel health poi municipality", """
    with s as (select m.muni_code as scope_id, count(*) as n, sum(cast(floor(area_m2) as bigint)) as e from municipality m join parcel on lng >= xmin and lng < xmax and lat >= ymin and lat < ymax where zone = '02' group by 1),
    h as (select m.muni_code as scope_id, count(*) as n from municipality m join health on f_lng >= xmin and f_lng < xmax and f_lat >= ymin and f_lat < ymax group by 1),
    p as (select m.muni_code as scope_id, count(*) filter (where category = 'building') as n from municipality m join poi on f_lng >= xmin and f_lng < xmax and f_lat >= ymin and f_lat < ymax group by 1),
    u as (select m.muni_code as scope_id, count(*) as n from municipality m join municipality o on m.xmin < o.xmax and m.xmax > o.xmin and m.ymin < o.ymax and m.ymax > o.ymin join health x on x.muni_code = o.muni_code and f_lng is null group by 1)
    select m.muni_code as scope_id, coalesce(s.n, 0) as n_schools, cast(s.e as bigint) as school_enrollment, coalesce(h.n, 0) as n_health, coalesce(u.n, 0) as n_health_unlocated, nullif(p.n, 0) as buildings
    from municipality m left join s on s.scope_id = m.muni_code left join h on h.scope_id = m.muni_code left join p on p.scope_id = m.muni_code left join u on u.scope_id = m.muni_code""")
def _(t):
    out = areas.facilities_in(*places(t), munis(t), scopes(t))
    return out.select("scope_id", "n_schools", "school_enrollment", "n_health", "n_health_unlocated", F.try_element_at("poi_counts", F.lit("building")).alias("buildings"))


SCOPE_OVER = "(least(xmax, oxmax) - greatest(xmin, oxmin)) * (least(ymax, oymax) - greatest(ymin, oymin)) / ((xmax - xmin) * (ymax - ymin)) * 100"


@query("area_analysis", "C11 P24 C20 C19", "parcel census poi overlay municipality", f"""
    with p as (select m.muni_code as scope_id, count(*) as n_parcels, round(sum(area_m2), 2) as area_sum_m2 from municipality m join parcel on {PX} group by 1),
    c as (select m.muni_code as scope_id, cast(round(sum(pop_total * {BLOCK_SHARE})) as bigint) as pop_total from census c join municipality m on {BLOCK_TOUCH} group by 1),
    f as (select m.muni_code as scope_id, count(*) as n_poi from municipality m join poi on f_lng >= xmin and f_lng < xmax and f_lat >= ymin and f_lat < ymax group by 1),
    l as (select m.muni_code as scope_id, layer, layer_key, least(round(sum(round({SCOPE_OVER}, 3)), 3), 100) as pct from municipality m join overlay
      on oxmin < xmax and oxmax > xmin and oymin < ymax and oymax > ymin group by 1, 2, 3),
    o as (select scope_id, count(*) filter (where layer = 'land_capability') as n_soils, count(*) filter (where layer = 'hazard') as n_hazards,
      count(*) filter (where layer in ('protected_area', 'ethnic_territory')) as n_protected, round(sum(pct), 1) as pct_sum, max(pct) filter (where layer = 'hazard') as top_hazard from l group by 1)
    select m.muni_code as scope_id, m.population as position, coalesce(n_parcels, 0) as n_parcels, area_sum_m2, pop_total, n_poi,
      coalesce(n_soils, 0) as n_soils, coalesce(n_hazards, 0) as n_hazards, coalesce(n_protected, 0) as n_protected, pct_sum, top_hazard,
      concat_ws('|', case when n_parcels is null then case when m.muni_code < '03' then 'parcels:other_manager' else 'parcels:no_parcels_loaded' end end, case when pop_total is null then 'population:no_census_blocks' end,
        case when coalesce(n_soils, 0) = 0 then 'soils:no_soil_survey' end, case when coalesce(n_hazards, 0) = 0 then 'hazards:no_hazard_layer' end,
        'pot:no_zoning_plan', 'relief:no_elevation_model') as missing
    from municipality m left join p on p.scope_id = m.muni_code left join c on c.scope_id = m.muni_code left join f on f.scope_id = m.muni_code left join o on o.scope_id = m.muni_code""")
def _(t):
    s, h, p = places(t)
    elevation = t.parcel.where("false").selectExpr("parcel_key as cell", "half as elevation_mean_m", "half as slope_mean_pct", "half as slope_max_pct")
    coverage = t.municipality.select("muni_code", F.when(F.col("muni_code") < "03", "none").otherwise("covered").alias("coverage_status"))
    layers = overlays(t, F.col("layer").alias("kind"), F.col("layer_key").alias("code"), F.col("layer_key").alias("label")).withColumnRenamed("o_rings", "l_rings")
    sources = {"parcels": owned(t), "buildings": footprints(t), "blocks": blocks(t), "schools": s, "health": h, "pois": p, "municipalities": munis(t),
               "layers": layers, "elevation": elevation, "roads": roads(t), "coverage": coverage}
    out = areas.compare_areas(areas.analyze_areas(scopes(t).withColumn("muni_code", F.col("scope_id")), sources))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    n_poi = F.aggregate(F.map_values("poi_counts"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    size = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).cast("bigint").alias(f"n_{name}")
    every = F.transform(F.flatten(F.array("soils", "hazards", "protected")), lambda e: e["overlap_pct"])
    return out.select(
        "scope_id", "position", "n_parcels", F.round("area_sum_m2", 2).alias("area_sum_m2"), "pop_total", n_poi.alias("n_poi"), size("soils"), size("hazards"), size("protected"),
        F.round(add(every), 1).alias("pct_sum"), F.get("hazards", F.lit(0))["overlap_pct"].alias("top_hazard"),
        F.array_join(F.transform("missing", lambda m: F.concat_ws(":", m["section"], m["reason"])), "|").alias("missing"))


@query("area_scopes", "G13 J19 F14", "", """
    select c_custkey as scope_id, case c_custkey % 3 when 0 then 64 when 1 then 64 else 4 end as corners, case c_custkey % 3 when 1 then 'circle_for_travel_time' end as warning,
      round(case c_custkey % 3 when 0 then 500 + c_custkey when 1 then 4.5 * 1000 / 60 * 15 end, 4) as radius_m from customer""")
def _(t):
    k = F.col("c_custkey")
    spec = t.customer.select(k.alias("scope_id"), k.alias("position"), F.when(k % 3 == 0, "radius").when(k % 3 == 1, "isochrone").otherwise("polygon").alias("kind"),
                             geo.rectangle(F.lit(-75.0), F.lit(4.0), F.lit(-74.0), F.lit(5.0)).alias("rings"), F.expr(lng("c_custkey")).alias("lng"), F.expr(lat("c_custkey")).alias("lat"),
                             (F.lit(500.0) + k).alias("radius_m"), F.lit(15).alias("minutes"), F.lit("walk").alias("mode"), F.lit(None).cast("string").alias("muni_code"))
    # Shapes are not shuffled: their size and first corner are taken where they are drawn.
    drawn = areas.scopes_from(spec, munis(t)).select("scope_id", "warning", (F.size(F.col("scope_rings")[0]) - 1).alias("corners"), F.col("scope_rings")[0][0].alias("corner"))
    out = drawn.join(spec.select("scope_id", "kind", "lng", "lat"), "scope_id")
    corner = F.col("corner")
    reach = F.when(F.col("kind") != "polygon", F.round(geo.haversine_m(F.col("lng"), F.col("lat"), corner["x"], corner["y"]), 4))
    return out.select("scope_id", "corners", "warning", reach.alias("radius_m"))


@query("area_discrepancy", "C21", "parcel", """
    select parcel_key, case when built_area_m2 > 0 then abs(area_m2 * 0.52 - built_area_m2) / built_area_m2 * 100 > 10 end as flag from parcel""")
def _(t):
    return t.parcel.select("parcel_key", areas.area_discrepancy(F.col("area_m2") * 0.52, F.col("built_area_m2")).alias("flag"))


A, E2, EP2 = repr(geo.SEMI_MAJOR), repr(geo.E2), repr(geo.EP2)


def projected_sql(table, x, y, keep):
    """Transverse Mercator easting and northing of two columns, step by step."""
    m0, m2, m4, m6 = (repr(v) for v in geo.M_COEF)
    return f"""select {keep}, 5000000 + 0.9992 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {EP2}::double) * pow(a, 5) / 120) as x,
      2000000 + 0.9992 * ({A}::double * ({m0}::double * phi - {m2}::double * sin(2 * phi) + {m4}::double * sin(4 * phi) - {m6}::double * sin(6 * phi)) - {geo.ORIGIN_ARC!r}::double
        + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {EP2}::double) * pow(a, 6) / 720)) as y
      from (select *, radians({y}) as phi, radians({x} + 73) * cos(radians({y})) as a, pow(tan(radians({y})), 2) as t, {EP2}::double * pow(cos(radians({y})), 2) as c,
        {A}::double / sqrt(1 - {E2}::double * pow(sin(radians({y})), 2)) as n from {table})"""


@query("projected_points", "G15", "parcel", f"""
    with p as ({projected_sql('parcel', 'lng', 'lat', 'parcel_key')}) select parcel_key, round(x, 4) as x, round(y, 4) as y from p""")
def _(t):
    return t.parcel.select("parcel_key", geo.project(F.col("lng"), F.col("lat")).alias("p")).select("parcel_key", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def cell_sql(table, x, y, keep, level):
    s = hexgrid.edge_m(level)
    third = repr(hexgrid.ROOT3 / 3)
    return f"""select {keep}, case when dq > dr and dq > dt then -r - t else q end as q, case when dq > dr and dq > dt then r when dr > dt then -q - t else r end as r from (
      select *, abs(q - fq) as dq, abs(r - fr) as dr, abs(t - ft) as dt from (select *, floor(fq + 0.5) as q, floor(fr + 0.5) as r, floor(ft + 0.5) as t from (
      select *, -fq - fr as ft from (select {keep}, (x * {third}::double - y / 3) / {s!r}::double as fq, (y * ({2.0 / 3!r}::double)) / {s!r}::double as fr from ({projected_sql(table, x, y, keep)})))))"""


PACKED = "(8::bigint << 58) + ((q::bigint + 268435456) << 29) + (r::bigint + 268435456)"


@query("parcel_cells", "G11", "parcel", f"with c as ({cell_sql('parcel', 'lng', 'lat', 'parcel_key', 8)}) select parcel_key, {PACKED} as cell from c")
def _(t):
    return t.parcel.select("parcel_key", hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 8).alias("cell"))


COARSE = "(6::bigint << 58) + ((q::bigint + 268435456) << 29) + (r::bigint + 268435456)"


@query("cell_cadastre", "A2 A3 D1", "parcel", f"""
    with c as ({cell_sql('parcel', 'lng', 'lat', 'parcel_key', 6)}), p as (select {COARSE} as cell, parcel.* from c join parcel using (parcel_key))
    select cell, count(*) as n_parcels, round(sum(area_m2), 2) as area_sum, count(*) filter (where area_m2 > 1000 and coalesce(built_area_m2, 0) = 0) as n_large_lots, min(area_m2) as area_min,
      round(quantile_cont(area_m2, 0.25), 4) as area_p25, round(quantile_cont(area_m2, 0.5), 4) as area_median, max(area_m2) as area_max, count(distinct coalesce(economic_use, 'NO_DISPONIBLE')) as uses from p group by cell""")
def _(t):
    p = t.parcel.withColumn("cell", hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 6))
    out = cells.cadastre_stats(p, ["cell"]).join(cells.use_counts(p, ["cell"]), "cell")
    return out.select("cell", "n_parcels", F.round("parcel_area_sum_m2", 2).alias("area_sum"), "n_large_lots", "area_min", F.round("area_p25", 4).alias("area_p25"),
                      F.round("area_median", 4).alias("area_median"), "area_max", F.size("use_counts").alias("uses"))


@query("cell_facilities", "A5", "poi", f"""
    with c as ({cell_sql('poi', 'f_lng', 'f_lat', 'poi_id', 6)}) select {COARSE} as cell, category, count(*) as n from c join poi using (poi_id) group by 1, 2""")
def _(t):
    p = t.poi.withColumn("cell", hexgrid.point_to_cell(F.col("f_lng"), F.col("f_lat"), 6))
    return cells.count_map(p, ["cell"], F.col("category"), "m").select("cell", F.explode("m").alias("category", "n"))


@query("cell_centers", "G11", "parcel", f"""
    with c as ({cell_sql('parcel', 'lng', 'lat', 'parcel_key', 8)}) select parcel_key, round({hexgrid.edge_m(8)!r}::double * {hexgrid.ROOT3!r}::double * (q + r / 2), 3) as x, round({hexgrid.edge_m(8)!r}::double * 1.5 * r, 3) as y from c""")
def _(t):
    c = hexgrid.plane_center(hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 8), 8)
    return t.parcel.select("parcel_key", c.alias("c")).select("parcel_key", F.round("c.x", 3).alias("x"), F.round("c.y", 3).alias("y"))


@query("covered_cells", "G12 J16 A9")
def _(t):
    b = box(t.census, "xmin", "ymin", "xmax", "ymax", "rings", "block_id")
    elevation = t.parcel.withColumn("cell", hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 7)).groupBy("cell").agg(
        F.avg("area_m2").alias("elevation_mean_m"), F.avg("half").alias("slope_mean_pct"), F.max("half").alias("slope_max_pct"))
    return cells.relief(b, elevation, "block_id", "rings", 7)


@query("rebuilt_cells", "C8 G12 A4 A6 A7 A8 J10 J11")
def _(t):
    return rebuild(t)


def rebuild(t):
    from landgrid.operators.ingest import hazard_rank
    # One municipality has no outline and takes the hull of its parcels.
    x, y = F.col("seat_lng"), F.col("seat_lat")
    m = t.municipality.withColumn("rings", F.when(F.col("muni_code") != "01001", geo.rectangle(x - 0.5, y - 0.5, x + 0.5, y + 0.5)))
    s, h, p = places(t)
    o = overlays(t, "layer", "layer_key", "level", F.col("overlay_id").alias("source_id")).withColumn("level_rank", hazard_rank(F.col("level")))
    b = blocks(t).withColumn("school_age", cells.school_age_of())
    elevation = t.parcel.withColumn("cell", hexgrid.point_to_cell(F.col("lng"), F.col("lat"), 6)).groupBy("cell").agg(F.avg("area_m2").alias("elevation_mean_m"), F.avg("half").alias("slope_mean_pct"))
    return cells.rebuild_cells(m, t.parcel, b, s, h, p, o, elevation, roads(t), 6)


@query("dissolved_area", "A17", "", """
    with c as (select distinct cast(o_orderkey as bigint) // 120 as q, o_orderkey % 120 as r, (cast(o_orderkey as bigint) // 120) // 60 as grp from orders),
    n as (select grp, count(*) as n from c group by 1),
    h as (select a.grp, count(*) as n from c a join c b on b.grp = a.grp and b.q = a.q + 1 and b.r = a.r group by 1),
    v as (select a.grp, count(*) as n from c a join c b on b.grp = a.grp and b.q = a.q and b.r = a.r + 1 group by 1),
    f as (select a.grp, count(*) as n from c a join c b on b.grp = a.grp and b.q = a.q + 1 and b.r = a.r join c d on d.grp = a.grp and d.q = a.q and d.r = a.r + 1 join c e on e.grp = a.grp and e.q = a.q + 1 and e.r = a.r + 1 group by 1)
    select n.grp, round(n.n * 0.25, 6) as area, round((4 * n.n - 2 * coalesce(h.n, 0) - 2 * coalesce(v.n, 0)) * 0.5, 6) as perimeter,
      cast(n.n - coalesce(h.n, 0) - coalesce(v.n, 0) + coalesce(f.n, 0) as bigint) as shells_less_holes
    from n left join h using (grp) left join v using (grp) left join f using (grp)""")
def _(t):
    q, r = F.floor(F.col("o_orderkey") / 120), F.col("o_orderkey") % 120
    sq = t.orders.select(F.floor(q / 60).alias("grp"), geo.rectangle(q * 0.5, r * 0.5, q * 0.5 + 0.5, r * 0.5 + 0.5).alias("rings"))
    shape = shapes.dissolve(sq, ["grp"])
    side = F.expr("aggregate(transform(rings, g -> aggregate(sequence(2, size(g)), 0D, (s, k) -> s + sqrt(power(element_at(g, k).x - element_at(g, k - 1).x, 2) + power(element_at(g, k).y - element_at(g, k - 1).y, 2)))), 0D, (s, x) -> s + x)")
    signs = F.aggregate(F.transform("rings", lambda g: F.when(geo.ring_signed_area(g) > 0, 1).otherwise(-1)), F.lit(0), lambda n, s: n + s)
    one = shape.select("grp", geo.area(F.col("rings")).alias("area"), side.alias("perimeter"), signs.alias("signs"))
    return one.groupBy("grp").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("perimeter"), 6).alias("perimeter"), F.sum("signs").alias("shells_less_holes"))


@query("parcel_hulls", "A19", "parcel", """
    select muni_code, min(lng) as xmin, max(lng) as xmax, min(lat) as ymin, max(lat) as ymax from parcel group by muni_code""")
def _(t):
    hulls = spatial.convex_hulls(t.parcel, ["muni_code"], "lng", "lat").withColumn("b", geo.box(F.col("rings")))
    return hulls.select("muni_code", "b.xmin", "b.xmax", "b.ymin", "b.ymax")


@query("subdivided_shapes", "G10 G1", "overlay", "select overlay_id, round((oxmax - oxmin) * (oymax - oymin), 6) as area from overlay")
def _(t):
    x0, y0, x1, y1 = (F.col(c) for c in ("oxmin", "oymin", "oxmax", "oymax"))
    steps = F.sequence(F.lit(0), F.lit(99))
    side = lambda xa, ya, xb, yb: F.transform(steps, lambda i: geo.point(xa + (xb - xa) * i / 100, ya + (yb - ya) * i / 100))
    ring = F.concat(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0), F.array(geo.point(x0, y0)))
    pieces = spatial.subdivide(t.overlay.select("overlay_id", F.array(ring).alias("rings")), "rings")
    return pieces.groupBy("overlay_id").agg(F.round(F.sum(geo.area(F.col("rings"))), 6).alias("area"))


@query("boxes_in_envelope", "G14 P7", "overlay", """
    select overlay_id, greatest(oxmin, -81.85) as xmin, greatest(oymin, -4.3) as ymin, least(oxmax, -66.8) as xmax, least(oymax, 13.6) as ymax, case when (oxmax - oxmin) * 100 > 100 then 0.0005 when (oxmax - oxmin) * 100 > 10 then 0.0001 else 0 end as tolerance from overlay""")
def _(t):
    b = overlays(t, "overlay_id", "oxmin", "oxmax").select("overlay_id", geo.clamp_box(geo.box(F.col("o_rings"))).alias("b"), geo.densify_tolerance((F.col("oxmax") - F.col("oxmin")) * 100).alias("tolerance"))
    return b.select("overlay_id", "b.*", "tolerance")
