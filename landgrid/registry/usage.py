"""Search, addresses, codes, ledger, quotas and streams."""

from pyspark.sql import functions as F

from landgrid.functions import address, geo, text
from landgrid.operators import search, usage
from landgrid.registry.base import pad, query
from landgrid.session import ensure_checkpoint_dir
from landgrid.streaming import additions
from landgrid.streaming import usage as streams


@query("trigram_similarity", "F12", "", """
    with w as (select p_partkey, p_name, unnest(string_split(p_name, ' ')) as w from part), g as (
      select distinct p_partkey, substr('  ' || w || ' ', i, 3) as g from w, range(1, 30) r(i) where i <= length(w) + 1)
    select p_partkey, count(*) as trigrams from g group by 1""")
def _(t):
    return t.part.select("p_partkey", F.size(text.trigrams(F.col("p_name"))).cast("bigint").alias("trigrams"))


def index_sources(t):
    names = t.part.select(F.lit("place").alias("kind"), F.col("p_name").alias("ref"), F.col("p_name").alias("label"), F.lit("part").alias("context"), F.lit(2).alias("rank"))
    munis = t.municipality.select(F.lit("municipality").alias("kind"), F.col("muni_code").alias("ref"), F.col("muni_name").alias("label"), F.col("dept_code").alias("context"), F.lit(1).alias("rank"))
    again = t.part.select(F.lit("place").alias("kind"), F.col("p_name").alias("ref"), F.concat("p_name", F.lit(" again")).alias("label"), F.lit("late").alias("context"), F.lit(3).alias("rank"))
    return [munis, names, again]


INDEX_SQL = """ix as (select 'municipality' as kind, muni_code as ref, muni_name as label, 1 as rank from municipality
      union all select distinct 'place', p_name, p_name, 2 from part)"""


NINE_SQL = """select 'department' as kind, dept_code as ref, dept_name as label, 'Departamento' as context, 10 as rank, null as muni_code, dept_code as dept_code from department
    union all select 'municipality', muni_code, muni_name, dept_name, 20, muni_code, dept_code from m
    union all select 'neighborhood', m.muni_code || ':' || npn, 'B ' || cast(o_orderkey as varchar), muni_name || ', ' || dept_name, 40, m.muni_code, m.dept_code from p join m on m.muni_code = p.muni_code where o_orderkey % 4 = 0 and o_orderkey % 12 <> 8 and o_orderkey % 5 <> 0
    union all select 'vereda', m.muni_code || ':' || npn, 'B ' || cast(o_orderkey as varchar), 'Vereda · ' || muni_name || ', ' || dept_name, 45, m.muni_code, m.dept_code from p join m on m.muni_code = p.muni_code where o_orderkey % 4 = 1 and o_orderkey % 12 <> 5 and o_orderkey % 5 <> 0
    union all select 'populated_place', cast(p_partkey as varchar), p_name, case p_partkey % 2 when 0 then 'Centro Poblado' else 'Caserio' end || ' · ' || muni_name, 50, x.muni_code, dept_code from x join m on m.muni_code = x.muni_code where p_partkey % 3 = 0
    union all select 'toponym', cast(p_partkey as varchar), p_name, case when p_partkey % 2 = 0 then p_brand else 'Nombre geográfico' end, 60, muni_code, null from x where p_partkey % 3 = 1
    union all select 'protected_area', cast(s_suppkey as varchar), s_name, case when s_suppkey % 2 = 0 then 'Parque' else 'Área protegida' end, 70, null, null from supplier
    union all select 'school', cast(c_custkey as varchar), c_name, 'Establecimiento educativo · ' || coalesce(muni_name, 'municipio no determinado'), 80, y.muni_code, null from y left join m on m.muni_code = y.muni_code where c_custkey % 5 <> 0
    union all select 'health_facility', cast(health_id as varchar), name, 'Prestador de salud · ' || coalesce(muni_name, 'municipio no determinado'), 85, health.muni_code, null from health left join m on m.muni_code = health.muni_code where f_lng is not null"""
CODE = pad("{0} % 5 + 1", 2) + " || " + pad("{0} % 30 + 1", 3)


@query("search_index", "U3 C13", "department municipality parcel health", f"""
    with m as (select muni_code, muni_name, dept_code, dept_name from municipality join department using (dept_code)),
    p as (select parcel_key as o_orderkey, npn, {CODE.format('parcel_key')} as muni_code from parcel), x as (select *, {CODE.format('p_partkey')} as muni_code from part), y as (select *, {CODE.format('c_custkey')} as muni_code from customer)
    select *, upper(strip_accents(label)) as label_fold from ({NINE_SQL})""")
def _(t):
    named = lambda df, name: df.withColumn("name", F.col(name))
    here = F.struct(F.lit(-74.0).alias("x"), F.lit(5.0).alias("y"))
    munis, departments = named(t.municipality, "muni_name").withColumn("place", here), named(t.department, "dept_name").withColumn("place", here)
    k = F.col("parcel_key")
    label = F.when(k % 5 != 0, F.concat(F.lit("B "), k.cast("string")))
    areas = t.parcel.withColumns({"muni_code": F.expr(CODE.format("parcel_key")), "code": F.col("npn"), "name": label})
    # Some have no place, some no name, a third of the codes no municipality.
    placed = lambda rest, none: areas.where(k % 4 == rest).withColumn("place", F.when(k % 12 != none, geo.point(F.col("lng"), F.col("lat"))))
    part = t.part.withColumns({"muni_code": F.expr(CODE.format("p_partkey")), "id": F.col("p_partkey"), "name": F.col("p_name"), "place": here,
                               "kind": F.when(F.col("p_partkey") % 2 == 0, "centro_poblado").otherwise("caserio"), "category": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))})
    areas_kept = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Parque").alias("category"), here.alias("place"))
    schools = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr(CODE.format("c_custkey")).alias("muni_code"), F.when(F.col("c_custkey") % 5 != 0, here).alias("place"))
    health = t.health.select(F.col("health_id").alias("id"), "name", "muni_code", F.when(F.col("f_lng").isNotNull(), geo.point(F.col("f_lng"), F.col("f_lat"))).alias("place"))
    of = lambda rest: part.where(F.col("p_partkey") % 3 == rest)
    sources = search.place_sources(departments, munis, placed(0, 8), placed(1, 5), of(0), of(1), areas_kept, schools, health)
    # A second load of the same places changes nothing.
    return search.build_index([*sources, *[s.withColumn("label", F.concat(F.lit("0"), F.col("label"))) for s in sources[:3]]]).drop("place")


GRAMS = """(select distinct {key}, substr('  ' || w || ' ', i, 3) as g from (select {key}, unnest(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' ')) as w from {table}) x, range(1, 60) r(i) where w <> '' and i <= length(w) + 1)"""


@query("text_search", "C13 L4 F12", "municipality", f"""
    with {INDEX_SQL}, q as (select s_suppkey as query_id, case when s_suppkey % 3 = 0 then 'nation ' || cast(s_nationkey as varchar) when s_suppkey % 3 = 1 then left(p_name, 6) else replace(p_name, 'e', 'a') end as text
      from supplier join part on p_partkey = s_suppkey * 7 % (select count(*) from part)),
    qg as {GRAMS.format(key='query_id', text='text', table='q')}, dg as {GRAMS.format(key="kind || ':' || ref as doc", text='label', table='ix').replace("select distinct kind || ':' || ref as doc", "select distinct doc")},
    nq as (select query_id, count(*) as n from qg group by 1), nd as (select doc, count(*) as n from dg group by 1),
    s as (select query_id, doc, count(*) as c from qg join dg using (g) group by 1, 2),
    p as (select q.query_id, ix.*, coalesce(s.c / (nq.n + nd.n - s.c), 0) as similarity, starts_with(upper(ix.label), upper(q.text)) as is_prefix
      from q join ix on true left join s on s.query_id = q.query_id and s.doc = ix.kind || ':' || ix.ref left join nq on nq.query_id = q.query_id left join nd on nd.doc = ix.kind || ':' || ix.ref),
    r as (select *, row_number() over (partition by query_id order by is_prefix desc, similarity desc, rank, label, kind, ref) as place from (
      select *  from p where is_prefix or similarity >= 0.25))
    select query_id, place, kind, ref, round(case when similarity >= 0.25 then similarity else 0 end, 6) as similarity, is_prefix from r where place <= 10""")
def _(t):
    n = t.part.agg(F.count(F.lit(1))).scalar()
    q = t.supplier.withColumn("p_partkey", F.col("s_suppkey") * 7 % n).join(t.part.select("p_partkey", "p_name"), "p_partkey")
    k = F.col("s_suppkey")
    words = F.when(k % 3 == 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).when(k % 3 == 1, F.substring("p_name", 1, 6)).otherwise(F.replace("p_name", F.lit("e"), F.lit("a")))
    out = search.search_text(q.select(k.alias("query_id"), words.alias("text")), search.build_index(index_sources(t)))
    return out.select("query_id", "place", "kind", "ref", F.round("similarity", 6).alias("similarity"), "is_prefix")


WAYS = [("Cra.", "CARRERA"), ("Cll", "CALLE"), ("AV", "AVENIDA"), ("diag", "DIAGONAL"), ("Tv", "TRANSVERSAL")]


def raw_address(t, table="orders", key="o_orderkey"):
    k = F.col(key)
    way = F.element_at(F.array(*[F.lit(w) for w, _ in WAYS]), (k % 5 + 1).cast("int"))
    tail = F.when(k % 3 == 0, " sur").when(k % 3 == 1, " Apto 201").otherwise("")
    return F.concat(way, F.lit(" "), (k % 170 + 1).cast("string"), F.when(k % 2 == 0, " A").otherwise(""), F.lit(" No. "), (k % 90 + 1).cast("string"), F.lit(" - "), (k % 60 + 1).cast("string"), tail)


WAY_SQL = "case o_orderkey % 5 " + " ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(WAYS)) + " end"
NUM_SQL = "cast(o_orderkey % 170 + 1 as varchar) || case when o_orderkey % 2 = 0 then 'A' else '' end"
CANON_SQL = f"{WAY_SQL} || ' ' || {NUM_SQL} || ' # ' || cast(o_orderkey % 90 + 1 as varchar) || '-' || cast(o_orderkey % 60 + 1 as varchar)"


@query("address_parts", "F3 F4 F5 C24", "", f"""
    select o_orderkey, {CANON_SQL} || case o_orderkey % 3 when 0 then ' SUR' when 1 then ' APTO 201' else '' end as canonical, {WAY_SQL} as way_type, {NUM_SQL} as way_number, cast(o_orderkey % 90 + 1 as varchar) as cross_number,
      cast(o_orderkey % 60 + 1 as varchar) as plate, case when o_orderkey % 3 = 0 then 'SUR' end as quadrant, case when o_orderkey % 3 = 1 then 'APTO 201' end as complement from orders""")
def _(t):
    return search.standardize(t.orders.select("o_orderkey", raw_address(t).alias("raw")), "raw").drop("raw")


@query("address_variants", "F6 F7", "", f"""
    with n as (select o_orderkey, {CANON_SQL} || case o_orderkey % 3 when 0 then ' SUR' when 1 then ' APTO 201' else '' end as c, {WAY_SQL} as w, {NUM_SQL} || ' ' || cast(o_orderkey % 90 + 1 as varchar) || ' ' || cast(o_orderkey % 60 + 1 as varchar) as s from orders)
    select o_orderkey, c || '|' || w || ' ' || s || '|' || case w when 'CARRERA' then 'CR' when 'CALLE' then 'CL' when 'AVENIDA' then 'AV' when 'DIAGONAL' then 'DG' else 'TV' end || ' ' || s || '|' || s as variants, true as is_address, o_orderkey % 3 = 1 as complement from n""")
def _(t):
    raw = t.orders.select("o_orderkey", raw_address(t).alias("raw"))
    std = search.standardize(raw, "raw")
    p = F.struct("way_type", "way_number", "cross_number", "plate")
    return std.select("o_orderkey", F.array_join(address.search_variants(F.col("canonical"), p), "|").alias("variants"), address.looks_like_address(F.col("canonical")).alias("is_address"), address.has_complement(F.col("raw")).alias("complement"))


@query("address_matches", "C24 J21 U2", "parcel", """
    with c as (select parcel_key as address_id, muni_code, parcel_key % 170 as way, npn, 'carrera ' || cast(parcel_key % 170 + 1 as varchar) || ' ' || cast(parcel_key % 90 + 1 as varchar) || ' ' || cast(parcel_key % 60 + 1 as varchar) as text from parcel),
    g as """ + GRAMS.format(key="address_id", text="text", table="c") + """, s as (select address_id, string_agg(g, '|' order by g) as grams from g group by 1)
    select a.address_id, 'parcel' as source, min(b.npn) as ref, cast(1 as double) as similarity from c a join s sa using (address_id) join c b on a.muni_code = b.muni_code and a.way = b.way join s sb on sb.address_id = b.address_id and sa.grams = sb.grams group by 1""")
def _(t):
    p = t.parcel
    asked = p.select(F.col("parcel_key").alias("address_id"), "muni_code", F.col("address").alias("raw"))
    points = p.where("false").select(F.col("npn").alias("ref"), "muni_code", F.col("address").alias("label"))
    out = search.match_addresses(asked, points, p.select(F.col("npn").alias("ref"), "muni_code", F.col("address").alias("label")), limit=1)
    return out.drop("place")


@query("resolved_codes", "C25 D8 D9 F8", "parcel", """
    select parcel_key, case parcel_key % 4 when 1 then 'old_format' when 2 then 'department_00' when 3 then 'not_30_digits' end as reason, case parcel_key % 4 when 0 then 'new' when 1 then 'old' end as matched_by,
      case when parcel_key % 4 < 2 then npn end as npn from parcel""")
def _(t):
    k = F.col("parcel_key")
    code = F.when(k % 4 == 0, F.regexp_replace("npn", "^(.{5})(.{10})", "$1-$2.")).when(k % 4 == 1, F.col("npn_old")).when(k % 4 == 2, F.concat(F.lit("00"), F.substring("npn", 3, 28))).otherwise(F.substring("npn", 1, 17))
    asked = t.parcel.select("parcel_key", code.alias("code"))
    return search.resolve_codes(asked, t.parcel).select("parcel_key", "reason", "matched_by", "npn")


@query("query_classes", "F13 F14", "parcel", f"""
    select parcel_key, case parcel_key % 6 when 0 then 'parcel_code' when 1 then 'old_code' when 2 then 'coordinates' when 3 then 'division_code' when 4 then 'address' else 'text' end as kind,
      cast(case parcel_key % 6 when 3 then 0.95 when 4 then 0.8 when 5 then 0.5 else 1 end as double) as score, case when parcel_key % 6 = 2 then lng end as x from parcel""")
def _(t):
    k = F.col("parcel_key")
    q = F.when(k % 6 == 0, F.col("npn")).when(k % 6 == 1, F.col("npn_old")).when(k % 6 == 2, F.concat_ws(", ", F.when(k % 4 == 0, F.col("lat")).otherwise(F.col("lng")), F.when(k % 4 == 0, F.col("lng")).otherwise(F.col("lat")))).when(k % 6 == 3, F.col("muni_code")).when(k % 6 == 4, F.col("address")).otherwise("palma")
    out = search.classify_queries(t.parcel.select("parcel_key", "npn", q.alias("text")))
    return out.select("parcel_key", "kind", "score", search.parse_coordinates(F.col("text"))["lng"].alias("x"))


LEDGER_SUMS = ", ".join(f"cast(coalesce(sum(amount) filter (where kind = '{k}'), 0) as bigint) as {n}" for k, n in usage.ENTRY_KINDS.items())


@query("credit_balances", "A25", "ledger", f"select owner_id, cast(sum(amount) as bigint) as balance, {LEDGER_SUMS}, count(*) as entry_count from ledger group by 1")
def _(t):
    return usage.balances(t.ledger, ["owner_id"])


@query("period_balances", "A25 F42", "ledger", f"""
    select owner_id, strftime(ts - interval 5 hour, '%Y-%m') as period, cast(sum(amount) as bigint) as balance, {LEDGER_SUMS}, count(*) as entry_count from ledger group by 1, 2""")
def _(t):
    return usage.period_balances(t.ledger)


@query("ledger_append", "U6", "ledger", "select owner_id, cast(sum(amount) as bigint) as balance, count(*) as n from ledger group by 1")
def _(t):
    old = t.ledger.where("owner_id < 30")
    new = t.ledger.unionByName(t.ledger.where("kind = 'refund'"))
    return usage.append_entries(old, new).groupBy("owner_id").agg(F.sum("amount").alias("balance"), F.count(F.lit(1)).alias("n"))


def limits(t):
    return t.usage.groupBy("metric").agg(F.ceil(F.avg("amount") * 12).alias("quota"))


DAILY_SQL = """with l as (select metric, cast(ceil(avg(amount) * 12) as bigint) as quota from usage group by 1),
    u as (select org_id, metric, cast(date_trunc('{p}', ts) as date) as d, cast(sum(amount) as bigint) as used from usage group by 1, 2, 3)"""


@query("quota_days", "T1", "usage", DAILY_SQL.format(p="day") + " select org_id, metric, cast(d as varchar) as period, used, quota, used > quota as over_limit from u join l using (metric)")
def _(t):
    return usage.quota_usage(t.usage, limits(t)).withColumn("period", F.col("period").cast("string"))


@query("quota_months", "T1", "usage", DAILY_SQL.format(p="month") + " select org_id, metric, cast(d as varchar) as period, used, quota, used > quota as over_limit from u join l using (metric)")
def _(t):
    return usage.quota_usage(t.usage, limits(t), "month").withColumn("period", F.col("period").cast("string"))


@query("charges_once", "T2", "usage", "select event_id, org_id, amount from usage")
def _(t):
    return usage.charge_once(t.usage.unionByName(t.usage.where("event_id % 20 = 0"))).select("event_id", "org_id", "amount")


@query("active_users", "T4 A24", "usage", """
    select count(distinct user_id) as active_users, count(*) as calls from usage where ts > timestamp '2024-01-20 00:00:00' - interval 7 day and ts <= timestamp '2024-01-20 00:00:00'""")
def _(t):
    return usage.active_users(t.usage, F.lit("2024-01-20").cast("timestamp"), 7)


@query("business_metrics", "A24", "usage", """
    with p as (select user_id, count(*) filter (where metric = 'purchase') as b, count(*) filter (where metric = 'view') as v, sum(case metric when 'purchase' then 49.5 when 'signup' then 0.25 else 0 end) as r from usage group by 1)
    select count(*) as users, count(*) filter (where b > 0) as paying, cast(round(sum(r), 2) as double) as revenue, round(count(*) filter (where b > 0) / count(*) * 100, 4) as conversion_pct, round(sum(v) / count(*), 4) as reports_per_user from p""")
def _(t):
    return usage.business_metrics(t.usage, t.spark.sql("select * from values ('purchase', 49.5D), ('signup', 0.25D) as p(metric, price)"))


def stream_of(t, df):
    """A file stream over a copy of a table in the checkpoint folder, and a folder for its output."""
    import uuid
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/in")
    return t.spark.readStream.schema(df.schema).parquet(f"{root}/in"), root


def in_three(t, df):
    """The table as a stream of three batches that each hold events of all days, and a folder for its output."""
    _, root = stream_of(t, df.repartition(3, "event_id"))
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root


@query("streamed_quota_days", "T1", "usage", DAILY_SQL.format(p="day") + """
    select org_id, metric, cast(d as varchar) as period, used, cast(d as timestamp) + interval 2 day <= (select max(ts) from usage) as closed from u""")
def _(t):
    stream, root = in_three(t, t.usage)
    additions.add_days(stream, f"{root}/days", f"{root}/log").awaitTermination()
    additions.compact(t.spark, f"{root}/days", additions.DAY)
    return additions.read_days(t.spark, f"{root}/days").select("org_id", "metric", F.col("period").cast("string").alias("period"), "used", "closed")


@query("streamed_charges", "T2", "usage", "select event_id, org_id, amount from usage")
def _(t):
    stream, root = stream_of(t, t.usage.unionByName(t.usage.where("event_id % 20 = 0")))
    streams.run_to_table(streams.charge_once(stream).select("event_id", "org_id", "amount"), f"{root}/out", f"{root}/log")
    return t.spark.read.schema("event_id long, org_id long, amount long").parquet(f"{root}/out")


@query("streamed_months", "T1", "usage", "select org_id, metric, strftime(ts, '%Y-%m') as period, cast(sum(amount) as bigint) as used from usage group by 1, 2, 3")
def _(t):
    stream, root = stream_of(t, t.usage)
    streams.monthly_usage(stream, f"{root}/out", f"{root}/log").awaitTermination()
    return streams.read_monthly_usage(t.spark.read.parquet(f"{root}/out").drop("batch"))


@query("streamed_alerts", "T3 C6", "cut_a cut_b", """
    with ch as (select coalesce(a.npn, b.npn) as npn from cut_a a full outer join cut_b b on a.npn = b.npn where a.npn is null or b.npn is null or a.area_reported_m2 is distinct from b.area_reported_m2 or a.built_area_m2 is distinct from b.built_area_m2)
    select c_custkey as alert_id, 'parcel_change' as kind, count(*) as n from customer join ch on npn = c_custkey group by 1""")
def _(t):
    from landgrid.operators.changes import parcel_changes
    rows = parcel_changes(t.cut_a, t.cut_b).select("npn", F.expr(pad("npn % 25 + 1", 5)).alias("muni_code"), "change_type")
    stream, root = stream_of(t, rows)
    alerts = t.customer.select(F.col("c_custkey").alias("alert_id"), F.lit("parcel_change").alias("kind"), F.lit("").alias("muni_code"), F.col("c_custkey").alias("npn"), F.lit("").alias("dataset_id"))
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    streams.watch_changes(stream, alerts, keep, f"{root}/log").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").drop("batch").groupBy("alert_id", "kind").agg(F.sum("n").alias("n"))


@query("streamed_cut_alerts", "T3 C6", "snapshot", """
    select c_custkey as alert_id, dataset_id, cast(cut_date as varchar) as cut_date from customer join snapshot on dataset_id = case c_custkey % 3 when 0 then 'cadastre_a' when 1 then 'cadastre_b' else 'none' end""")
def _(t):
    cuts = t.snapshot.select("dataset_id", "cut_date")
    _, root = stream_of(t, cuts.unionByName(cuts).repartition(3))
    k = F.col("c_custkey")
    alerts = t.customer.select(k.alias("alert_id"), F.lit("new_cut").alias("kind"), F.when(k % 3 == 0, "cadastre_a").when(k % 3 == 1, "cadastre_b").otherwise("none").alias("dataset_id"))
    once = t.spark.readStream.schema(cuts.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streams.watch_cuts(once, alerts, f"{root}/sent", f"{root}/log").awaitTermination()
    sent = t.spark.read.parquet(f"{root}/sent")
    return sent.select("alert_id", "dataset_id", F.col("cut_date").cast("string").alias("cut_date"))


@query("streamed_actives", "T4", "usage", """
    select cast(date '1970-01-01' + cast(floor(datediff('day', date '1970-01-01', cast(ts as date)) / 7) * 7 as integer) as varchar) as period,
        count(distinct user_id) as active_users, count(*) as calls from usage group by 1""")
def _(t):
    stream, root = in_three(t, t.usage)
    additions.add_actives(stream, f"{root}/users", f"{root}/log").awaitTermination()
    additions.compact(t.spark, f"{root}/users", additions.USER_DAY)
    return additions.read_actives(t.spark, f"{root}/users", days=7).withColumn("period", F.col("period").cast("string"))
