"""Differences of cuts, alerts and indicators."""

from pyspark.sql import functions as F

from landgrid.functions.geo import rectangle
from landgrid.operators import changes as ops
from landgrid.operators import indicators, ranking
from landgrid.operators.snapshots import last_two_cuts
from landgrid.registry.base import query

DIFF_SQL = """
    ch as (select coalesce(a.npn, b.npn) as npn, case when a.npn is null then 'created' when b.npn is null then 'removed' else 'attrs_changed' end as change_type
      from cut_a a full outer join cut_b b on a.npn = b.npn
      where a.npn is null or b.npn is null or a.area_reported_m2 is distinct from b.area_reported_m2
        or a.built_area_m2 is distinct from b.built_area_m2 or a.economic_use is distinct from b.economic_use)"""


@query("parcel_changes", "C4 J6 J7 D2", "cut_a cut_b", f"with {DIFF_SQL} select npn, change_type from ch")
def _(t):
    return ops.parcel_changes(t.cut_a, t.cut_b).select("npn", "change_type")


@query("change_details", "F43 J7", "cut_a cut_b", """
    select a.npn, case when a.area_reported_m2 is distinct from b.area_reported_m2 then b.area_reported_m2 - a.area_reported_m2 end as area_step,
      case when a.built_area_m2 is distinct from b.built_area_m2 then a.built_area_m2 end as built_from, a.built_area_m2 is distinct from b.built_area_m2 as built_changed
    from cut_a a join cut_b b using (npn) where a.area_reported_m2 is distinct from b.area_reported_m2 or a.built_area_m2 is distinct from b.built_area_m2""")
def _(t):
    ch = ops.parcel_changes(t.cut_a, t.cut_b).where("change_type = 'attrs_changed'")
    num = lambda path: F.get_json_object("detail", path).cast("double")
    return ch.select(
        "npn", (num("$.area_reported_m2.to") - num("$.area_reported_m2.from")).alias("area_step"),
        num("$.built_area_m2.from").cast("bigint").alias("built_from"),
        F.get_json_object("detail", "$.built_area_m2").isNotNull().alias("built_changed"),
    )


def _rectangles(t, shift):
    from landgrid.registry.base import lat, lng
    box = t.part.select(
        F.col("p_partkey").alias("npn"), F.expr(lng("p_partkey")).alias("x"), F.expr(lat("p_partkey")).alias("y"),
        (F.col("p_size") / 1000).alias("h"), (F.col("p_partkey") % 3 * shift).alias("s"),
    )
    return box.select("npn", rectangle(F.col("x") - F.col("h") + F.col("s"), F.col("y") - F.col("h"), F.col("x") + F.col("h") + F.col("s"), F.col("y") + F.col("h")).alias("rings"))


@query("geometry_changes", "G5 G6 C4", "", """
    with d as (select p_partkey as npn, p_size / 1000 as h, p_partkey % 3 * cast(0.0007 as double) as s from part),
    o as (select npn, h, s, greatest(2 * h - s, 0) * 2 * h as shared, 4 * h * h as a from d where s <> 0)
    select npn, round(shared / (2 * a - shared), 5) as iou, round((2 * a - 2 * shared) * 1000000, 2) as changed from o where shared / (2 * a - shared) < 0.98""")
def _(t):
    from landgrid.functions.geo import area
    from landgrid.functions.kernels import overlap_area
    from landgrid.operators.skew import shuffled
    from landgrid.operators.spatial import iou, symmetric_difference_area
    ch = ops.parcel_changes(_rectangles(t, 0.0), _rectangles(t, 0.0007), compared=[]).where("change_type = 'geometry_changed'").select("npn")
    a = _rectangles(t, 0.0).withColumnRenamed("rings", "a")
    b = _rectangles(t, 0.0007).withColumnRenamed("rings", "b")
    pairs = ch.join(shuffled(a), "npn").join(shuffled(b), "npn").withColumn("shared", overlap_area("a", "b"))
    sizes = (F.col("shared"), area(F.col("a")), area(F.col("b")))
    return pairs.select("npn", iou(*sizes).alias("iou"), F.round(symmetric_difference_area(*sizes) * 1e6, 2).alias("changed"))


@query("buildings_added", "J6 C4", "building", """
    with o as (select * from building where snapshot_id = 1999), n as (select * from building where snapshot_id = 2000)
    select parcel_key, building_ref, floors from n where not exists (
      select 1 from o where o.parcel_key = n.parcel_key and o.building_ref is not distinct from n.building_ref)""")
def _(t):
    b = t.building
    out = ops.building_changes(b.where("snapshot_id = 1999"), b.where("snapshot_id = 2000"))
    return out.select("parcel_key", "building_ref", "floors")


@query("buildings_both_ways", "D2", "building", """
    with o as (select * from building where snapshot_id = 1999), n as (select * from building where snapshot_id = 2000)
    select change_type, count(*) as n from (
      select 'building_added' as change_type from n where (parcel_key, building_ref) not in (select (parcel_key, building_ref) from o)
      union all select 'building_removed' from o where (parcel_key, building_ref) not in (select (parcel_key, building_ref) from n)) group by 1""")
def _(t):
    b = t.building
    out = ops.building_changes(b.where("snapshot_id = 1999"), b.where("snapshot_id = 2000"), removed=True)
    return out.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("change_summary", "A15", "cut_a cut_b", f"""with {DIFF_SQL}
    select count(*) filter (where change_type = 'created') as created, count(*) filter (where change_type = 'removed') as removed,
      count(*) filter (where change_type = 'attrs_changed') as attrs_changed, 0 as geometry_changed, 0 as building_added from ch""")
def _(t):
    return ops.change_summary(ops.parcel_changes(t.cut_a, t.cut_b))


def _coded(t):
    """Changes with a municipality, the pair of cuts and a place."""
    from landgrid.registry.base import lat, lng, pad
    ch = ops.parcel_changes(t.cut_a, t.cut_b).select("npn", "change_type")
    return ch.select(
        "npn", "change_type", F.expr(pad("npn % 5 + 1", 2) + " || " + pad("npn % 25 + 1", 3)).alias("muni_code"),
        F.lit(1).alias("from_snapshot"), F.lit(2).alias("to_snapshot"),
        F.expr(f"case when npn % 9 <> 0 then {lng('npn')} end").alias("lng"), F.expr(f"case when npn % 9 <> 0 then {lat('npn')} end").alias("lat"),
    )


@query("municipality_dynamics", "A16", "cut_a cut_b", f"""with {DIFF_SQL}
    select lpad(cast(npn % 5 + 1 as varchar), 2, '0') || lpad(cast(npn % 25 + 1 as varchar), 3, '0') as muni_code, 1 as from_snapshot, 2 as to_snapshot,
      count(*) filter (where change_type = 'created') as created, count(*) filter (where change_type = 'removed') as removed,
      count(*) filter (where change_type = 'attrs_changed') as attrs_changed, 0 as geometry_changed, 0 as building_added from ch group by 1""")
def _(t):
    new = ops.municipality_dynamics(_coded(t))
    return ops.merge_dynamics(new.withColumn("created", F.lit(-1).cast("bigint")), new)


@query("changes_in_areas", "C5", "cut_a cut_b municipality", f"""with {DIFF_SQL}
    , p as (select npn, change_type, case when npn % 9 <> 0 then cast(-79 as double) + cast((npn * 7919) % 12000 as double) / cast(1000 as double) end as lng,
       case when npn % 9 <> 0 then cast(-4 as double) + cast((npn * 10473) % 16000 as double) / cast(1000 as double) end as lat from ch where change_type <> 'attrs_changed')
    select m.muni_code as scope_id, npn, change_type from p join municipality m on lng >= xmin and lng < xmax and lat >= ymin and lat < ymax
    union all select null, npn, change_type from p where lng is null""")
def _(t):
    scopes = t.municipality.select(F.col("muni_code").alias("scope_id"), rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("scope_rings"))
    out = ops.changes_in_areas(_coded(t), scopes, "npn", ["created", "removed"])
    return out.select("scope_id", "npn", "change_type")


@query("parcel_history", "C5 W7", "cut_a cut_b snapshot", f"""with {DIFF_SQL}
    select npn, change_type, case when npn % 2 = 0 then '1999-01-01' else '1998-01-01' end as from_cut, case when npn % 3 = 0 then '2000-01-01' else '2001-01-01' end as to_cut from ch""")
def _(t):
    ch = _coded(t).withColumns({
        "from_snapshot": F.when(F.col("npn") % 2 == 0, 1999).otherwise(1998), "to_snapshot": F.when(F.col("npn") % 3 == 0, 2000).otherwise(2001),
    })
    return ops.parcel_history(ch, t.snapshot).select("npn", "change_type", F.col("from_cut").cast("string").alias("from_cut"), F.col("to_cut").cast("string").alias("to_cut"))


@query("area_series", "W7", "parcel snapshot", """
    with c as (select substr(npn, 1, 5) || economic_use as series, cast(cut_date as varchar) as cut_date, round(sum(area_m2), 2) as area_m2
      from parcel join snapshot using (snapshot_id) where status in ('published', 'superseded') and economic_use is not null group by 1, 2)
    select *, round(area_m2 - lag(area_m2) over (partition by series order by cut_date, area_m2), 2) as area_delta_m2 from c""")
def _(t):
    p = t.parcel.where("economic_use is not null").groupBy(F.concat(F.substring("npn", 1, 5), "economic_use").alias("series"), "snapshot_id").agg(F.round(F.sum("area_m2"), 2).alias("area_m2"))
    return ops.parcel_series(p, t.snapshot, "series").withColumn("cut_date", F.col("cut_date").cast("string"))


@query("alerts", "C6", "cut_a cut_b snapshot", f"""with {DIFF_SQL}
    , c as (select npn, change_type, lpad(cast(npn % 5 + 1 as varchar), 2, '0') || lpad(cast(npn % 25 + 1 as varchar), 3, '0') as muni_code from ch),
    a as (select c_custkey as alert_id, case c_custkey % 3 when 0 then 'parcel_change' when 1 then 'area_change' else 'new_cut' end as kind,
      lpad(cast(c_custkey % 5 + 1 as varchar), 2, '0') || lpad(cast(c_custkey % 25 + 1 as varchar), 3, '0') as muni_code, c_custkey as npn, case when c_custkey % 2 = 0 then 'cadastre_a' else 'none' end as dataset_id from customer)
    select alert_id, kind, count(*) as n from a join c on (kind = 'parcel_change' and a.npn = c.npn) or (kind = 'area_change' and a.muni_code = c.muni_code) group by 1, 2
    union all select alert_id, kind, 1 from a where kind = 'new_cut' and dataset_id = 'cadastre_a'""")
def _(t):
    from landgrid.registry.base import pad
    k = F.col("c_custkey")
    alerts = t.customer.select(
        k.alias("alert_id"), F.when(k % 3 == 0, "parcel_change").when(k % 3 == 1, "area_change").otherwise("new_cut").alias("kind"),
        F.expr(pad("c_custkey % 5 + 1", 2) + " || " + pad("c_custkey % 25 + 1", 3)).alias("muni_code"), k.alias("npn"),
        F.when(k % 2 == 0, "cadastre_a").otherwise("none").alias("dataset_id"),
    )
    return ops.evaluate_alerts(alerts, _coded(t), last_two_cuts(t.snapshot))


BETTER = "(indicator <> 'education_dropout_rate')"


@query("indicator_ranks", "W1 W2 D6", "indicator", f"""
    select muni_code, indicator, period, value, case when value is null then null when {BETTER} then rank() over (partition by indicator, period, value is null order by value desc)
        else rank() over (partition by indicator, period, value is null order by value) end as national_rank,
      case when value is null then null when {BETTER} then round(percent_rank() over (partition by indicator, period, value is null order by value) * 100, 2)
        else round(percent_rank() over (partition by indicator, period, value is null order by value desc) * 100, 2) end as national_pct,
      count(value) over (partition by indicator, period) as n_ranked from indicator""")
def _(t):
    return indicators.ranked(t.indicator).select("muni_code", "indicator", "period", "value", "national_rank", "national_pct", "n_ranked")


@query("indicator_top", "L2", "indicator", "select * from indicator order by value desc nulls last, muni_code, indicator, period limit 20")
def _(t):
    return indicators.top_ranked(t.indicator, 20)


@query("indicator_cards", "C22", "indicator", """
    with l as (select muni_code, indicator, max(period) as period from indicator where value is not null group by 1, 2)
    select i.muni_code, i.indicator, l.period, v.value, s.n as points, s.first_value from (select distinct muni_code, indicator from indicator) i
    left join l using (muni_code, indicator) left join indicator v on v.muni_code = l.muni_code and v.indicator = l.indicator and v.period = l.period
    join (select muni_code, indicator, count(*) as n, arg_min(value, period) as first_value from indicator group by 1, 2) s on s.muni_code = i.muni_code and s.indicator = i.indicator""")
def _(t):
    cards = indicators.indicator_cards(indicators.ranked(t.indicator))
    return cards.select("muni_code", "indicator", "period", "value", F.size("series").alias("points"), F.col("series")[0]["value"].alias("first_value"))


@query("education_load", "C7 F35", "municipality", """
    with w as (select o_custkey % 30 + 1 as m, cast(year(o_orderdate) as varchar) as period, o_orderpriority as g, round(avg(o_totalprice) / 1000, 3) as v from orders group by 1, 2, 3),
    s as (select lpad(cast(((m - 1) % 5 + 1) * 1000 + m as varchar), 5, '0') as muni_code, period, max(case when g = '1-URGENT' then v end) as a, max(case when g = '2-HIGH' then v end) as b from w group by 1, 2),
    l as (select muni_code, 'education_net_coverage' as indicator, period, a as value from s union all select muni_code, 'education_dropout_rate', period, b from s where cast(period as int) % 2 = 0)
    select muni_code, indicator, period, value from l where value is not null and muni_code in (select muni_code from municipality)""")
def _(t):
    w = t.orders.groupBy((F.col("o_custkey") % 30 + 1).alias("m"), F.year("o_orderdate").alias("anio")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.round(F.avg("o_totalprice") / 1000, 3))
    text = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    sheet = w.select(
        (((F.col("m") - 1) % 5 + 1) * 1000 + F.col("m")).cast("string").alias("muni"), "anio",
        text("1-URGENT").alias("cobertura_neta"), F.when(F.col("anio") % 2 == 0, text("2-HIGH")).otherwise("ND").alias("desercion"),
    )
    return indicators.load_education(sheet, t.municipality).select("muni_code", "indicator", "period", "value")


@query("score_percentile", "F23 D6", "", """
    select p_partkey, round((select count(*) from customer where c_acctbal < p_retailprice) * 1.0 / (select count(*) from customer) * 100
      + (select count(*) from customer where c_acctbal = p_retailprice) / 2.0 / (select count(*) from customer) * 100, 2) as percentile_score from part""")
def _(t):
    return ranking.midrank_percentile(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", t.customer, "c_acctbal").select("p_partkey", "percentile_score")


@query("grouped_percentiles", "A2 F36", "parcel", """
    select muni_code, round(quantile_cont(area_m2, 0.25), 4) as p25, round(quantile_cont(area_m2, 0.5), 4) as p50, round(quantile_cont(area_m2, 0.75), 4) as p75 from parcel group by muni_code""")
def _(t):
    out = ranking.grouped_percentiles(t.parcel, ["muni_code"], "area_m2", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.select("muni_code", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query("global_row_numbers", "W3", "", """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as place from lineitem""")
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranking.number_rows(li, order, "place").drop("l_suppkey")
