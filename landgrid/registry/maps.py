"""Map data, tiles, readers and exports."""

import uuid

from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import osm, tiles
from landgrid.registry.base import lat, lng, pad, query
from landgrid.session import ensure_checkpoint_dir
from landgrid.sources import readers, writers

SURFACES = ["asphalt", "Concrete ", "gravel", "asphalt;gravel", "lava", "dirt/sand"]


def ways(t):
    k = F.col("o_orderkey")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), F.when(k % 3 == 0, pick(["primary", "residential", "footway", "track"], k)),
            F.lit("surface"), pick(SURFACES, k), F.lit("lanes"), pick(["2", "x", "30", "4;2"], k), F.lit("maxspeed"), pick(["50", "30 mph", "999", "80 km/h"], k),
            F.lit("amenity"), F.when(k % 3 == 1, pick(["bank", "school", "cafe", "weird"], k)), F.lit("shop"), F.when(k % 5 == 2, pick(["tea", "vacant", "toys"], k)),
            F.lit("name"), pick(["Calle Real", " ", "llame al 3001234567", "a@b.co"], k), F.lit("contact:phone"), F.lit("1"), F.lit("cuisine"), F.lit("x")),
        lambda key, value: value.isNotNull())
    return t.orders.select(k.alias("way_id"), tags.alias("tags"), F.sequence(k, k + k % 4 + 1).alias("refs"))


def nodes(t):
    k = "o_orderkey"
    return t.orders.where("o_orderkey % 11 <> 0").select(F.col(k).alias("node_id"), F.expr(lng(k)).alias("lng"), F.expr(lat(k)).alias("lat"), F.lit(None).cast("map<string,string>").alias("tags"))


@query("road_attributes", "F15 C26", "", """
    select o_orderkey as way_id, case o_orderkey % 4 when 0 then 'primary' when 1 then 'residential' else 'track' end as class, case o_orderkey % 6 when 0 then true when 1 then true when 2 then false when 3 then true when 5 then false end as is_paved,
      case o_orderkey % 4 when 0 then 2 when 3 then 4 end as lanes, case o_orderkey % 4 when 0 then 50 when 1 then 48 when 3 then 80 end as max_speed_kmh from orders where o_orderkey % 3 = 0 and o_orderkey % 4 <> 2""")
def _(t):
    return osm.roads(ways(t)).select("way_id", "class", "is_paved", "lanes", "max_speed_kmh")


@query("poi_classes", "F16 C26", "", """
    with k as (select o_orderkey as k, case when o_orderkey % 3 = 1 then case o_orderkey % 4 when 0 then 'financiero' when 2 then 'alimentacion' end end as a, case when o_orderkey % 5 = 2 then case o_orderkey % 3 when 0 then 'alimentacion' when 2 then 'comercio' end end as s from orders)
    select k as way_id, coalesce(a, s) as category, case when coalesce(a, s) is not null then 'poi' when k % 3 = 1 then case k % 4 when 1 then 'excluded' else 'unmapped' end when k % 5 = 2 then 'excluded' else 'none' end as verdict from k""")
def _(t):
    return osm.classify_pois(ways(t)).select("way_id", "category", "verdict")


@query("kept_tags", "F17 C26", "", """
    select o_orderkey as way_id, case when o_orderkey % 4 = 0 then 'Calle Real' end as name, 'x' as cuisine, 1 as kept from orders""")
def _(t):
    kept = osm.keep_tags(F.col("tags"), osm.POI_TAGS)
    return ways(t).select("way_id", osm.safe_name(osm.tag("name")).alias("name"), F.try_element_at(kept, F.lit("cuisine")).alias("cuisine"), F.size(kept).alias("kept"))


@query("dropped_tags", "F17", "", "select 'contact:phone' as key, 'phone' as rule, count(*) as n from orders")
def _(t):
    return osm.dropped_tags(ways(t), osm.POI_TAGS)


@query("assembled_ways", "J20", "", f"""
    with r as (select o_orderkey as way_id, unnest(range(o_orderkey, o_orderkey + o_orderkey % 4 + 2)) as n from orders), m as (select max(o_orderkey) as top from orders),
    g as (select way_id, count(*) filter (where n % 11 <> 0 and n <= top) as points, count(*) filter (where n % 11 = 0 or n > top) as missing_nodes, avg(case when n % 11 <> 0 and n <= top then {lng('n')} end) as lng from r, m group by 1)
    select way_id, points, missing_nodes, round(lng, 6) as lng from g""")
def _(t):
    out = osm.assemble_ways(ways(t), nodes(t))
    return out.select("way_id", F.size("line").alias("points"), "missing_nodes", F.round("lng", 6).alias("lng"))


@query("map_load_report", "A22", "", f"""
    select case o_orderkey % 4 when 0 then 'primary' when 1 then 'residential' else 'track' end as class, count(*) as n, count(*) filter (where o_orderkey % 4 <> 1) as named, count(distinct o_orderkey % 25) as municipalities
    from orders where o_orderkey % 3 = 0 and o_orderkey % 4 <> 2 group by 1""")
def _(t):
    r = osm.roads(ways(t)).withColumn("muni_code", F.expr(pad("way_id % 25", 3)))
    return osm.load_report(r, ["class"])


@query("enriched_map", "C26 J17 J20 A22")
def _(t):
    from landgrid.registry.spatial import munis
    road_rows, pois = osm.enrich(ways(t), nodes(t), munis(t))
    a = osm.load_report(road_rows, ["class"])
    b = osm.load_report(pois, ["category"]).withColumnRenamed("category", "class")
    return a.unionByName(b)


@query("parcel_tiles", "S19 S20", "parcel", """
    with z as (select unnest([12, 14, 15]) as z), p as (select npn, z, lng - half as a, lat + half as b, lng + half as c, lat - half as d, pow(2, z) as n from parcel, z where z >= 14),
    q as (select npn, z, floor((a + 180) / 360 * n) as x0, floor((c + 180) / 360 * n) as x1, floor((1 - ln(tan(radians(b)) + 1 / cos(radians(b))) / pi()) / 2 * n) as y0, floor((1 - ln(tan(radians(d)) + 1 / cos(radians(d))) / pi()) / 2 * n) as y1 from p)
    select npn, z, cast(sum((x1 - x0 + 1) * (y1 - y0 + 1)) as bigint) as tiles, cast(min(x0) as bigint) as x, cast(min(y0) as bigint) as y from q group by 1, 2""")
def _(t):
    out = tiles.assign_tiles(t.outlined, "parcel", "npn", "rings", [12, 14, 15])
    return out.groupBy("npn", "z").agg(F.count(F.lit(1)).alias("tiles"), F.min("x").alias("x"), F.min("y").alias("y"))


# A triangle a parcel; a tile is touched unless all of its corners lie beyond one of the edges.
@query("slanting_tiles", "S19", "parcel", """
    with z as (select unnest([14, 16]) as z), p as (select npn, z, pow(2, z) as n, lng - 0.04 as x1, lat - 0.03 as y1, lng + 0.05 as x2, lat - 0.01 as y2, lng - 0.01 as x3, lat + 0.04 as y3 from parcel, z),
    b as (select *, cast(floor((x1 + 180) / 360 * n) as bigint) as c0, cast(floor((x2 + 180) / 360 * n) as bigint) as c1,
        cast(floor((1 - ln(tan(radians(y3)) + 1 / cos(radians(y3))) / pi()) / 2 * n) as bigint) as r0, cast(floor((1 - ln(tan(radians(y1)) + 1 / cos(radians(y1))) / pi()) / 2 * n) as bigint) as r1 from p),
    t as (select *, unnest(range(c0, c1 + 1)) as x from b), u as (select *, unnest(range(r0, r1 + 1)) as y from t),
    k as (select *, x / n * 360 - 180 as w, (x + 1) / n * 360 - 180 as e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))) as s, degrees(atan(sinh(pi() * (1 - 2 * y / n)))) as o from u)
    select npn, z, count(*) as tiles, cast(sum(x) as bigint) as x, cast(sum(y) as bigint) as y from k where """ + " and ".join(
        f"greatest({', '.join(f'({q[0]} - {p[0]}) * ({y} - {p[1]}) - ({q[1]} - {p[1]}) * ({x} - {p[0]})' for x in 'we' for y in 'so')}) >= 0"
        for p, q in ((("x1", "y1"), ("x2", "y2")), (("x2", "y2"), ("x3", "y3")), (("x3", "y3"), ("x1", "y1")))) + " group by 1, 2")
def _(t):
    corner = lambda dx, dy: F.struct((F.col("lng") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    ring = F.array(corner(-0.04, -0.03), corner(0.05, -0.01), corner(-0.01, 0.04), corner(-0.04, -0.03))
    out = tiles.assign_tiles(t.parcel.select("npn", F.array(ring).alias("rings")), "parcel", "npn", "rings", [12, 14, 16])
    return out.groupBy("npn", "z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@query("tile_boxes", "S20 G16", "", """
    with t as (select p_partkey, p_partkey % 24 as z, p_size * 7 as x, p_partkey % 60 as y, pow(2, p_partkey % 24) as n from part)
    select p_partkey, z between 0 and 22 and x < n and y < n as valid, round(x / n * 360 - 180, 8) as xmin, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))), 8) as ymin, case when z <= 7 then 6 when z <= 9 then 7 when z <= 12 then 8 else 9 end as level from t""")
def _(t):
    from landgrid.functions.hexgrid import level_for_zoom
    z, x, y = (F.col("p_partkey") % 24).cast("int"), F.col("p_size") * 7, F.col("p_partkey") % 60
    b = geo.tile_box(z, x, y)
    return t.part.select("p_partkey", geo.valid_tile(z, x, y).alias("valid"), F.round(b["xmin"], 8).alias("xmin"), F.round(b["ymin"], 8).alias("ymin"), level_for_zoom(z).alias("level"))


def landed(t, df):
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


@query("landed_records", "S3 S9", "", "select o_orderkey, o_totalprice, o_orderpriority from orders")
def _(t):
    path = landed(t, t.orders.select(F.to_json(F.struct("o_orderkey", "o_totalprice", "o_orderpriority")).alias("value")))
    return readers.read_records(t.spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("landed_features", "S4 S15", "parcel", "select npn, round(4 * half * half * 1000000, 4) as size, economic_use from parcel")
def _(t):
    lines = writers.feature_lines(t.outlined, "rings", ["npn", "economic_use"], ["cadastre"])
    wrapped = lines.select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("value"))
    path = landed(t, wrapped)
    # One collection per line here; real collections are one per file.
    files = t.spark.read.schema(readers.FEATURES).json(path).select(F.explode("features").alias("f"))
    rings = readers.polygon_from(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return files.select(F.col("f.properties")["npn"].alias("npn"), F.round(geo.area(rings) * 1e6, 4).alias("size"), F.col("f.properties")["economic_use"].alias("economic_use"))


@query("extract_csv", "S5 S14", "", "select o_orderkey, coalesce(case when o_orderkey % 13 <> 0 then o_orderpriority end, 'NO_DISPONIBLE') as use_text from orders")
def _(t):
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/extract-{uuid.uuid4().hex}"
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("use_text"))
    writers.export_rows(df).write.option("header", "true").option("sep", ";").csv(path)
    return readers.read_extract(t.spark, path, "csv", separator=";").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_lines", "S14", "", """
    select cast(p_partkey as varchar) || ';' || case when p_partkey % 3 = 0 then chr(34) || 'a;' || chr(34) || chr(34) || p_name || chr(34) || chr(34) || chr(34) else p_name end || ';' || case when p_partkey % 5 = 0 then 'NO_DISPONIBLE' else p_type end as value from part""")
def _(t):
    k = F.col("p_partkey")
    odd = F.when(k % 3 == 0, F.concat(F.lit('a;"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    return writers.csv_lines(t.part.select("p_partkey", odd.alias("n"), F.when(k % 5 != 0, F.col("p_type")).alias("t")))


@query("license_split", "S16", "", "select p_partkey, p_name, p_brand from part")
def _(t):
    own, rest = writers.split_by_license(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name"], "p_partkey")
    return own.join(rest, "p_partkey")


@query("license_groups", "S17", "", """
    with d as (select distinct p_brand as dataset_id, right(p_brand, 1) = '7' as share_alike from part) select p_type as table_name, bool_or(share_alike) as share_alike from part join d on dataset_id = p_brand group by 1""")
def _(t):
    d = t.part.select(F.col("p_brand").alias("dataset_id"), F.col("p_brand").endswith("7").alias("share_alike")).distinct()
    return writers.license_groups(t.part.select(F.col("p_type").alias("table_name"), F.col("p_brand").alias("dataset_id")), d)


@query("staged_cuts", "S8", "parcel", "select snapshot_id, count(*) as n, case when snapshot_id = 1999 then 'second' else 'first' end as load from parcel group by 1")
def _(t):
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    p = t.parcel.select("npn", "snapshot_id")
    writers.stage(p.withColumn("load", F.lit("first")), path)
    writers.stage(p.where("snapshot_id = 1999").withColumn("load", F.lit("second")), path)
    out = t.spark.read.schema("npn string, load string, snapshot_id long").parquet(path)
    return out.groupBy("snapshot_id", "load").agg(F.count(F.lit(1)).alias("n"))


@query("column_catalogue", "S9", "", "select unnest(['a', 'b', 'c', 'd']) as field, count(*) as n, unnest(['integer', 'number', 'text', 'timestamp']) as type from orders")
def _(t):
    payload = F.create_map(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("b"), F.col("o_totalprice").cast("string"), F.lit("c"), F.col("o_orderpriority"), F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return readers.column_catalogue(t.orders.select(payload.alias("payload"))).select("field", "n", "type")


@query("grouped_rings", "S7", "", """
    select s_suppkey, unnest([0, 1, 2]) as ring_no, unnest([0, 0, 2]) as shell_no, unnest([false, true, false]) as is_hole from supplier""")
def _(t):
    k = F.col("s_suppkey").cast("double")
    square = lambda x, y, h, left: geo.rectangle(x - h, y - h, x + h, y + h)[0] if left else F.reverse(geo.rectangle(x - h, y - h, x + h, y + h)[0])
    rings = F.array(square(k, k, 0.4, False), square(k, k, 0.2, True), square(k + 5, k, 0.3, True))
    return readers.group_rings(t.supplier.select("s_suppkey", F.posexplode(rings).alias("ring_no", "ring")), ["s_suppkey"]).drop("ring")
