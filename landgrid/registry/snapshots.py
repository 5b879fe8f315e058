"""Queries over dated cuts."""

from pyspark.sql import functions as F

from landgrid.operators import snapshots as ops
from landgrid.registry.base import query

DATASETS = """
    select 'cadastre_a' as dataset_id, 'mensual' as frequency, 'core.parcel' as target_table
    union all select 'cadastre_b', 'anual', 'core.parcel'"""


def datasets(t):
    """One dataset per order status and priority, some without any cut."""
    return t.orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "cadastre_a")
        .when(F.col("o_orderpriority") == "2-HIGH", "cadastre_b")
        .otherwise(F.concat(F.lit("demo-"), F.lower("o_orderpriority"))).alias("dataset_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "mensual").otherwise("anual").alias("frequency"),
    ).distinct()


DATASET_SQL = """
    select distinct case o_orderpriority when '1-URGENT' then 'cadastre_a' when '2-HIGH' then 'cadastre_b'
             else 'demo-' || lower(o_orderpriority) end as dataset_id,
           case o_orderpriority when '1-URGENT' then 'mensual' else 'anual' end as frequency
    from orders"""


@query("active_rows", "S1", "parcel snapshot", """
    select parcel_key, npn, muni_code, snapshot_id from parcel
    where snapshot_id in (select snapshot_id from snapshot where is_active)""")
def _(t):
    return ops.active_rows(t.parcel, t.snapshot).select("parcel_key", "npn", "muni_code", "snapshot_id")


@query("rows_at_date", "S2", "parcel snapshot", """
    select parcel_key, snapshot_id, area_m2 from parcel where snapshot_id in (
      select max(snapshot_id) from snapshot
      where status in ('published', 'superseded') and cut_date <= date '1999-06-30' group by dataset_id)""")
def _(t):
    cut = ops.rows_at(t.parcel, t.snapshot, F.lit("1999-06-30").cast("date"))
    return cut.select("parcel_key", "snapshot_id", "area_m2")


@query("latest_cut_per_dataset", "J14 W4", "snapshot", f"""
    with d as ({DATASET_SQL}), s as (select *, row_number() over (partition by dataset_id order by cut_date desc, snapshot_id desc) as rn from snapshot)
    select d.dataset_id, s.snapshot_id, s.row_count, cast(s.cut_date as varchar) as cut_date
    from d left join s on s.dataset_id = d.dataset_id and s.rn = 1""")
def _(t):
    out = ops.latest_cut_per_dataset(datasets(t).select("dataset_id"), t.snapshot)
    return out.select("dataset_id", "snapshot_id", "row_count", F.col("cut_date").cast("string").alias("cut_date"))


@query("last_two_cuts", "W8 J15", "snapshot", """
    with r as (select *, dense_rank() over (partition by dataset_id order by cut_date desc) as k from snapshot)
    select dataset_id, max(case when k = 2 then snapshot_id end) as from_id, max(case when k = 1 then snapshot_id end) as to_id
    from r where k <= 2 group by dataset_id""")
def _(t):
    return ops.last_two_cuts(t.snapshot)


@query("row_count_delta", "W6 Q2", "snapshot", """
    with p as (select snapshot_id, dataset_id, row_count, lag(row_count) over (partition by dataset_id order by cut_date, snapshot_id) as previous from snapshot)
    select snapshot_id, dataset_id, row_count, previous,
           case when previous > 0 then round((row_count - previous) / previous * 100, 4) end as delta_pct,
           coalesce(abs((row_count - previous) / previous * 100) <= 10, true) as passed
    from p""")
def _(t):
    return ops.row_count_delta(t.snapshot).select(
        "snapshot_id", "dataset_id", "row_count", "previous", "delta_pct", "passed"
    )


@query("merge_snapshots", "S11", "snapshot", """
    with n as (select dataset_id, cut_date, case when snapshot_id % 2 = 0 then null else row_count + 10 end as row_count, 'transformed' as status
               from snapshot where snapshot_id >= 1998
               union all select 'cadastre_c', date '2002-01-01', 5, 'transformed')
    select coalesce(n.dataset_id, s.dataset_id) as dataset_id, cast(coalesce(n.cut_date, s.cut_date) as varchar) as cut_date,
           coalesce(n.row_count, s.row_count) as row_count, coalesce(n.status, s.status) as status, s.snapshot_id
    from n full outer join snapshot s on n.dataset_id = s.dataset_id and n.cut_date = s.cut_date""")
def _(t):
    new = t.snapshot.where("snapshot_id >= 1998").select(
        "dataset_id", "cut_date",
        F.when(F.col("snapshot_id") % 2 == 0, None).otherwise(F.col("row_count") + 10).alias("row_count"),
        F.lit("transformed").alias("status"),
    )
    extra = t.spark.sql("select 'cadastre_c' as dataset_id, date '2002-01-01' as cut_date, bigint(5) as row_count, 'transformed' as status")
    out = ops.merge_snapshots(t.snapshot, new.unionByName(extra))
    return out.select("dataset_id", F.col("cut_date").cast("string").alias("cut_date"), "row_count", "status", "snapshot_id")


@query("upsert_datasets", "S12", "", f"""
    with o as ({DATASET_SQL}), n as (select dataset_id, 'diaria' as frequency from o where dataset_id < 'd')
    select * from n union all select * from o where dataset_id not in (select dataset_id from n)""")
def _(t):
    old = datasets(t)
    return ops.upsert_datasets(old, old.where("dataset_id < 'd'").withColumn("frequency", F.lit("diaria")))


VALIDATION_SQL = """
    select snapshot_id, 'error' as severity, (snapshot_id <> 1999) as passed from snapshot
    union all select snapshot_id, 'warning', false from snapshot"""


@query("publish_cuts", "S13", "snapshot", f"""
    with v as ({VALIDATION_SQL}),
    state as (
      select s.*, case when snapshot_id not in (1995, 1996, 1998, 1999) then null
        when snapshot_id in (select snapshot_id from v where severity = 'error' and not passed) then 'failed_validation'
        when is_synthetic and exists (select 1 from snapshot r where r.dataset_id = s.dataset_id and r.status = 'published' and not r.is_synthetic) then 'synthetic_over_real'
        else 'accepted' end as publish_result from snapshot s),
    w as (select dataset_id, max(snapshot_id) as win from state where publish_result = 'accepted' group by dataset_id)
    select s.snapshot_id, s.dataset_id, s.publish_result,
      case when s.snapshot_id = w.win then 'published' when w.win is not null and s.is_active then 'superseded' else s.status end as status,
      case when s.snapshot_id = w.win then true when w.win is not null then false else s.is_active end as is_active
    from state s left join w using (dataset_id)""")
def _(t):
    s = t.snapshot
    checks = s.select("snapshot_id", F.lit("error").alias("severity"), (F.col("snapshot_id") != 1999).alias("passed"))
    checks = checks.unionByName(s.select("snapshot_id", F.lit("warning").alias("severity"), F.lit(False).alias("passed")))
    asked = s.where(F.col("snapshot_id").isin(1995, 1996, 1998, 1999)).select("snapshot_id")
    return ops.publish(s, checks, asked).select("snapshot_id", "dataset_id", "publish_result", "status", "is_active")


@query("freshness_report", "C17 F41", "snapshot", f"""
    with d as ({DATASET_SQL}), a as (select dataset_id, max(cut_date) as cut_date from snapshot where is_active group by dataset_id),
    j as (select d.dataset_id, d.frequency, date_diff('day', a.cut_date, date '2001-02-20') as age_days from d left join a using (dataset_id) where d.dataset_id not like 'demo-%')
    select dataset_id, frequency, age_days, case when age_days is null then 'sin-corte'
       when age_days > round((case frequency when 'mensual' then 35 else 400 end) * 1.5) then 'vencido'
       when age_days > (case frequency when 'mensual' then 35 else 400 end) then 'revisar' else 'al-dia' end as state from j""")
def _(t):
    out = ops.freshness(datasets(t), t.snapshot, F.lit("2001-02-20").cast("date"))
    return out.select("dataset_id", "frequency", "age_days", "state")


@query("covered_synthetic_cuts", "U5", "parcel", """
    with k as (select distinct snapshot_id, (snapshot_id = 2001) as is_synthetic from parcel where snapshot_id >= 2000),
    p as (select distinct parcel.snapshot_id, muni_code, is_synthetic from parcel join k using (snapshot_id))
    select snapshot_id from p where is_synthetic group by snapshot_id
    having count(*) = (select count(*) from p a where a.is_synthetic and a.muni_code in (select muni_code from p b where not b.is_synthetic))""")
def _(t):
    cuts = t.parcel.select("snapshot_id").distinct().select(
        "snapshot_id", (F.col("snapshot_id") >= 2000).alias("is_active"), (F.col("snapshot_id") == 2001).alias("is_synthetic")
    )
    return ops.covered_synthetic(t.parcel, cuts)


@query("cut_dates", "A32", "snapshot", """
    select cast(cut_date as varchar) as cut_date, max(snapshot_id) as snapshot_id from snapshot
    where status in ('published', 'superseded') group by cut_date""")
def _(t):
    return ops.cut_dates(t.snapshot).select(F.col("cut_date").cast("string").alias("cut_date"), "snapshot_id")


@query("lineage_sources", "J22 S18", "parcel snapshot", """
    select distinct dataset_id, snapshot_id, cast(cut_date as varchar) as cut_date
    from snapshot s where is_active and snapshot_id = (select max(x.snapshot_id) from snapshot x where x.is_active and x.dataset_id = s.dataset_id)
      and exists (select 1 from parcel)""")
def _(t):
    lineage = ops.lineage_map(t.snapshot)
    rows = t.parcel.select("parcel_key").withColumn("source_snapshots", lineage.scalar())
    out = ops.sources_of(rows, datasets(t), t.snapshot)
    return out.select("dataset_id", "snapshot_id", F.col("cut_date").cast("string").alias("cut_date"))
