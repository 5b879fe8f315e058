"""Normalisers, suitability, templates and zones."""

from pyspark.sql import functions as F

from landgrid.functions import catalogue as cat
from landgrid.functions import hexgrid, normalize, text
from landgrid.operators import scoring, zones
from landgrid.registry.base import query


def key_sql(value):
    return f"regexp_replace(regexp_replace(lower(translate({value}, '{text.ACCENTED}', '{text.PLAIN}')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def score_sql(value, rule):
    """The catalogue rule as SQL text."""
    kind, *args = rule
    clamp = lambda e: f"case when ({e}) is not null then floor(least(greatest({e}, 0), 100) * 100 + 0.5) / 100 end"
    if kind in ("linear", "linear_inverse"):
        low, high = args
        forward = clamp(f"({value} - cast({low} as double)) / cast({high - low} as double) * 100")
        return forward if kind == "linear" else clamp(f"100 - {forward}")
    if kind == "stepped":
        steps = " ".join(f"when {value} <= {end} then {score}" for end, score in args[0])
        return f"cast(case when {value} is null then null {steps} else 0 end as double)"
    if kind == "band":
        a, b, c, d = args
        return clamp(f"case when {value} between {b} and {c} then cast(100 as double) when {value} <= {a} or {value} >= {d} then 0 when {value} < {b} then ({value} - {a}) / cast({b - a} as double) * 100 when {value} > {c} then ({d} - {value}) / cast({d - c} as double) * 100 end")
    if kind == "categorical":
        hits = " ".join(f"when '{k}' then {v}" for k, v in args[0].items())
        fallback = args[1] if len(args) > 1 else "null"
        return f"cast(case when {value} is null then null else case {key_sql(value)} {hits} else {fallback} end end as double)"
    return f"cast(case when {value} then {args[0]} when not {value} then {args[1]} end as double)"


def flag_sql(value, rule):
    kind, *args = rule
    if kind == "above":
        caution, blocker = args
        block = f"when {value} > {blocker} then 'blocker'" if blocker is not None else ""
        return f"case when {value} is null then 'unknown' {block} when {value} > {caution} then 'caution' else 'ok' end"
    if kind == "below":
        return f"case when {value} is null then 'unknown' when {value} < {args[0]} then 'caution' else 'ok' end"
    if kind == "band":
        (c1, c2), (b1, b2) = args
        return f"case when {value} is null then 'unknown' when {value} < {b1} or {value} > {b2} then 'blocker' when {value} < {c1} or {value} > {c2} then 'caution' else 'ok' end"
    if kind == "category":
        hits = " ".join(f"when '{k}' then '{v}'" for k, v in args[0].items())
        return f"case when {value} is null then 'unknown' else case {key_sql(value)} {hits} else '{args[1]}' end end"
    if kind == "boolean":
        return f"case when {value} then '{args[0]}' when not {value} then '{args[1]}' else 'unknown' end"
    return f"case when {value} is null then 'unknown' else 'ok' end"


ABSENT = {"hazard_seismic_level": "varchar", "solar_irradiance_kwh_m2_day": "double", "mining_title_present": "boolean",
          "competitor_density_per_km2": "double", "built_area_m2": "double", "land_cadastral_value_per_m2": "double"}
WIDE = "u as (select *, " + ", ".join(f"cast(null as {t}) as {c}" for c, t in ABSENT.items()) + " from unit)"

PROTECTED_SQL = f"case when protected_area_overlap_pct is null then null when protected_area_overlap_pct <= 10 then false when protected_area_category is null then true else {key_sql('protected_area_category')} in ({', '.join(repr(c) for c in cat.RESTRICTIVE_CATEGORIES)}) end"
FRONTIER_SQL = "not inside_agricultural_frontier"


def composite_sql(weights, own):
    """Known weight, weighted sum and declared weight of a profile, added in the same order as the Columns."""
    parts = []
    for i, w in weights.items():
        rule = (own.get(i) or (None, None))[0] or cat.INDICATORS[i][2]
        parts.append((i, score_sql(i, rule), w))
    known = " + ".join(["cast(0 as double)"] + [f"case when {s} is not null then cast({w!r} as double) else 0 end" for _, s, w in parts])
    total = " + ".join(["cast(0 as double)"] + [f"coalesce({s} * cast({w!r} as double), 0)" for _, s, w in parts])
    return known, total, repr(sum(weights.values())), parts


def use_sql(use):
    base, rules, own = cat.USE_PROFILES[use]
    weights, _ = scoring.apply_overrides(base, None)
    known, total, declared, _ = composite_sql(weights, own)
    flags = {i: flag_sql(i, (own.get(i) or (None, None))[1] or cat.INDICATORS[i][3]) for i in weights}
    fires = {cat.PROTECTED: PROTECTED_SQL, "agricultural_frontier": FRONTIER_SQL}
    hit = {r: f"coalesce({fires[r]}, false)" for r in rules}
    blockers = " + ".join([f"cast({hit[r]} as int)" for r in rules] + [f"cast({f} = 'blocker' as int)" for f in flags.values()])
    cautions = []
    for i, f in flags.items():
        covering = [hit[r] for r in rules if i in scoring.BLOCKER_RULES[r][1]]
        cautions.append(f"cast({f} = 'caution' and not ({' or '.join(covering) or 'false'}) as int)")
    unsure = " + ".join(f"cast(({fires[r]}) is null as int)" for r in rules)
    required = [i for i, spec in cat.INDICATORS.items() if use in spec[4]]
    lacking = " or ".join(f"{score_sql(i, (own.get(i) or (None, None))[0] or cat.INDICATORS[i][2])} is null" if i in weights else "true" for i in required) or "false"
    return f"""select unit_key, '{use}' as use, {known} as k, {total} as w, {declared} as d, {blockers} as blockers, {' + '.join(cautions)} as cautions, {unsure} as undetermined, ({lacking}) as lacking from u"""


SUITABILITY_SQL = "with " + WIDE + ", r as (" + " union all ".join(use_sql(u) for u in cat.USE_PROFILES) + """),
    s as (select *, case when not lacking and k > 0 and k / d >= 0.5 then floor(w / k * 10 + 0.5) / 10 end as score, floor(k / d * 1000 + 0.5) / 1000 as confidence from r)
    select unit_key, use, score, confidence, blockers, cautions, undetermined, case when blockers > 0 then 'desfavorable' when score is null then 'sin_datos'
      when score >= 70 and cautions + undetermined = 0 then 'favorable' when score >= 45 then 'condicionado' else 'desfavorable' end as verdict from s"""


@query("suitability", "F26 F27 F28 F30 F32 P16 F29", "unit", SUITABILITY_SQL)
def _(t):
    out = scoring.suitability(t.unit, ["unit_key"])
    return out.select("unit_key", "use", "score", "confidence", F.size("blockers").alias("blockers"), F.size("cautions").alias("cautions"),
                      F.size("undetermined").alias("undetermined"), "verdict")


FILTER_SQL = {
    cat.PROTECTED: PROTECTED_SQL, cat.ETHNIC: "ethnic_territory_overlap_pct > 10", cat.POT_PROTECTION: f"{key_sql('pot_classification')} = 'suelo_de_proteccion'",
    cat.FLOOD: f"{key_sql('hazard_flood_level')} in ('alta', 'muy_alta')", cat.URBAN_ONLY: "not inside_urban_perimeter",
}


def filter_sql(rule):
    if isinstance(rule, str):
        return FILTER_SQL[rule]
    name, limit = rule
    return {"max_slope": f"slope_mean_pct > {limit}", "min_large_parcels": f"large_parcels_count < {limit}"}[name]


def template_sql(name):
    _, base, filters, own = cat.TEMPLATES[name]
    weights, _ = scoring.apply_overrides(base, None)
    known, total, declared, parts = composite_sql(weights, own)
    drops = " + ".join(f"cast(coalesce({filter_sql(r)}, false) as int)" for r in filters)
    missing = " + ".join(f"cast({s} is null as int)" for _, s, _ in parts)
    return f"select unit_key, '{name}' as template, {known} as k, {total} as w, {declared} as d, {drops} + cast(coalesce(distance_school_m > 3000, false) as int) as drops, {missing} as missing from u"


TEMPLATES_SQL = "with " + WIDE + ", r as (" + " union all ".join(template_sql(n) for n in cat.TEMPLATES) + """),
    s as (select unit_key, template, drops, missing, case when k > 0 and k / d >= 0.5 then floor(w / k * 10 + 0.5) / 10 end as score, floor(k / d * 1000 + 0.5) / 1000 as confidence from r),
    n as (select *, row_number() over (partition by template order by drops > 0, score desc nulls last, unit_key) as place from s)"""


def scored(t):
    return scoring.score_cells(t.unit, ["unit_key"], thresholds={"distance_school_m": {"lte": 3000.0}})


@query("template_scores", "C9 F28 F29 F30 P14 P15 W3", "unit", TEMPLATES_SQL + """
    select unit_key, template, score, confidence, drops as exclusions, missing, case when drops = 0 and score is not null then place end as rank from n""")
def _(t):
    out = scoring.rank_cells(scored(t), "unit_key", ["template"])
    return out.select("unit_key", "template", "score", "confidence", F.size("exclusions").alias("exclusions"), F.size("missing").alias("missing"), "rank")


@query("always_missing", "A27", "", """
    select unnest(['retail_barrio', 'supermercado', 'farmacia', 'restaurante', 'gimnasio', 'hotel']) as template, 'competitor_density_per_km2' as indicator
    union all select unnest(['supermercado', 'clinica_ips', 'bodega_logistica', 'gimnasio', 'vivienda_vis']), 'land_cadastral_value_per_m2'""")
def _(t):
    return scoring.always_missing(scored(t))


def _driver_sql(name):
    _, base, filters, own = cat.TEMPLATES[name]
    weights, _ = scoring.apply_overrides(base, None)
    _, _, _, parts = composite_sql(weights, own)
    return " union all ".join(
        f"select n.template, '{i}' as indicator, cast({w!r} as double) as weight, n.place, {s} as score from n join u using (unit_key) where n.template = '{name}' and drops = 0 and n.score is not null"
        for i, s, w in parts)


@query("ranking_drivers", "A26", "unit", TEMPLATES_SQL + ", f as (" + " union all ".join(_driver_sql(n) for n in cat.TEMPLATES) + """),
    c as (select template, greatest(1, least(20, ceil(max(place) * 0.1))) as top from n where drops = 0 and score is not null group by template),
    m as (select f.template, indicator, weight, avg(case when place <= top then score end) as t, avg(score) as a from f join c using (template) group by 1, 2, 3)
    select template, indicator, floor(t * 10 + 0.5) / 10 as top_mean, floor(a * 10 + 0.5) / 10 as overall_mean, floor((t - a) * weight * 100 + 0.5) / 100 as influence from m where t is not null""")
def _(t):
    return scoring.ranking_drivers(scoring.rank_cells(scored(t), "unit_key", ["template"], most=scoring.BEST_CELLS))


@query("factor_contributions", "F31", "unit", "with " + WIDE + ", r as (" + " union all ".join(
    f"select unit_key, '{i}' as indicator, {s} * cast({w!r} as double) as sw, {composite_sql(cat.TEMPLATES['hotel'][1], {})[0]} as k from u"
    for i, s, w in composite_sql(cat.TEMPLATES["hotel"][1], {})[3]) + """)
    select unit_key, indicator, floor(sw / k * 10 + 0.5) / 10 as contribution from r""")
def _(t):
    weights = cat.TEMPLATES["hotel"][1]
    units, scores = scoring.with_scores(t.unit, weights)
    parts = scoring.contributions(scores, weights)
    return units.select("unit_key", F.explode(parts).alias("p")).select("unit_key", "p.*")


RULES = {
    "lin": ("linear", -500, 9000), "inv": ("linear_inverse", -500, 9000), "step": ("stepped", [(-100, 10), (0, 20), (2500, 55), (7000, 90)]),
    "banded": ("band", -900, 100, 3000, 8000),
}


@query("numeric_scores", "F20 F21 F22", "", "select c_custkey, " + ", ".join(f"{score_sql('c_acctbal', r)} as {n}" for n, r in RULES.items()) + " from customer")
def _(t):
    return t.customer.select("c_custkey", *[normalize.score_column(F.col("c_acctbal"), r).alias(n) for n, r in RULES.items()])


SEGMENTS = ("categorical", {"machinery": 90, "building": 55, "household": 12.5}, 30)


@query("category_scores", "F24 F25", "", f"""
    select c_custkey, {score_sql("c_mktsegment", SEGMENTS)} as category, cast(case c_custkey % 4 when 0 then 80 when 1 then 15 when 2 then 80 end as double) as truth from customer""")
def _(t):
    k = F.col("c_custkey")
    word = F.when(k % 4 == 0, "Sí").when(k % 4 == 1, "FALSO").when(k % 4 == 2, "true").otherwise("quizás")
    return t.customer.select("c_custkey", normalize.score_column(F.col("c_mktsegment"), SEGMENTS).alias("category"), normalize.boolean(word, 80, 15).alias("truth"))


@query("road_scores", "F33 D5 F34", "", """
    select p_partkey, case when p_partkey % 9 = 0 then round(100 - cast(4900 as double) / 49, 6) else round(least(greatest(100 - (p_retailprice * 3 - 100) / 49, 0), 100), 6) end as cell_score,
      case when p_partkey % 9 = 0 then null else round(least(greatest(100 - (p_retailprice * 3 - 100) / 49, 0), 100)) end as area_score,
      cast(round(p_size + p_size * 2 + p_partkey % 5 * 0.4) as bigint) as school_age from part""")
def _(t):
    d = F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") * 3)
    bands = F.create_map(F.lit("5_9"), F.col("p_size"), F.lit("10_14"), F.col("p_size") * 2, F.lit("15_19"), (F.col("p_partkey") % 5).cast("int"))
    return t.part.select("p_partkey", F.round(normalize.road_access(d, missing_as=5000), 6).alias("cell_score"), normalize.road_access(d, whole=True).alias("area_score"), normalize.school_age(bands).alias("school_age"))


@query("dominant_keys", "P20", "", """
    select p_partkey, case when p_size >= p_partkey % 50 then 'a' else 'b' end as key from part""")
def _(t):
    mix = F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), (F.col("p_partkey") % 50).cast("double"))
    return t.part.select("p_partkey", scoring.dominant_key(mix).alias("key"))


@query("frontier_state", "P23", "", """
    with o as (select l_orderkey, l_quantity * 2 as pct, case l_returnflag when 'A' then 'Frontera agrícola nacional' when 'N' then 'Exclusiones legales' end as category from lineitem),
    b as (select l_orderkey, arg_max(coalesce(category, '-'), (pct, coalesce(category, ''))) as c, max(pct) as p from o group by 1)
    select l_orderkey, case when p <= 50 then false when c = '-' then null else c = 'Frontera agrícola nacional' end as inside_agricultural_frontier from b""")
def _(t):
    cat_ = F.when(F.col("l_returnflag") == "A", "Frontera agrícola nacional").when(F.col("l_returnflag") == "N", "Exclusiones legales")
    o = t.lineitem.select("l_orderkey", (F.col("l_quantity") * 2).alias("overlap_pct"), cat_.alias("category"))
    # A category of NULL must be able to win, so it is carried as an empty text.
    return scoring.agricultural_frontier(o, ["l_orderkey"])


@query("dominant_overlaps", "P19", "overlay", """
    with p as (select parcel_id as parcel_key, kind, code, pct from (select l_orderkey as parcel_id, case l_linestatus when 'F' then 'soil' else 'zone' end as kind, 'c' || cast(l_suppkey as varchar) as code, l_quantity as pct from lineitem))
    select parcel_key, max(case when kind = 'soil' then s end) as soil, max(case when kind = 'zone' then s end) as zone from (
      select parcel_key, kind, arg_max(code, (pct, code)) as s from p group by 1, 2) group by 1""")
def _(t):
    o = t.lineitem.select(F.col("l_orderkey").alias("parcel_key"), F.when(F.col("l_linestatus") == "F", "soil").otherwise("zone").alias("kind"),
                          F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("code"), F.col("l_quantity").alias("overlap_pct"))
    return scoring.dominant_overlap(o, ["parcel_key"], {"soil": "soil", "zone": "zone"})


@query("guarded_densities", "P22", "", """
    select p_partkey, case when p_size % 5 > 0 then round(p_retailprice / (p_size % 5), 2) end as density, case when p_size % 3 > 0 then round(p_partkey / (p_size % 3) * 100, 1) end as seats from part""")
def _(t):
    return t.part.select("p_partkey", scoring.density(F.col("p_retailprice"), F.col("p_size") % 5).alias("density"), scoring.seats_per_100(F.col("p_partkey"), F.col("p_size") % 3).alias("seats"))


# Cells of a compact hexagonal block: one per order, scored by its price.
HEX_SQL = "select o_orderkey, cast(floor(o_orderkey / 120) as bigint) - 60 as q, o_orderkey % 120 - 60 as r, round(o_totalprice / 5000, 1) as score from orders"


def hex_cells(t):
    base = t.spark.sql(HEX_SQL.replace("from orders", "from {orders}"), orders=t.raw("orders"))
    return base.select(hexgrid.pack(8, F.col("q") + 7000, F.col("r") + 4000).alias("cell"), F.lit("grid").alias("template"), F.col("score"),
                       F.lit(False).alias("excluded"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))


@query("hex_neighbours", "G11", "", f"""
    with h as ({HEX_SQL}), d as (select unnest([1, 1, 0, -1, -1, 0]) as dq, unnest([0, -1, -1, 0, 1, 1]) as dr)
    select a.o_orderkey as a, count(*) as around from h a join d on true join h b on b.q = a.q + d.dq and b.r = a.r + d.dr group by 1""")
def _(t):
    cells = hex_cells(t).withColumn("k", hexgrid.axial(F.col("cell"))[0] - 7000 + 60).withColumn("o", F.col("k") * 120 + hexgrid.axial(F.col("cell"))[1] - 4000 + 60)
    edges = zones.hex_edges(hex_cells(t), ["template"])
    return edges.groupBy("a").agg(F.count(F.lit(1)).alias("around")).join(cells.select(F.col("cell").alias("a"), "o"), "a").select(F.col("o").alias("a"), "around")


@query("top_zones", "C10 A28 L6 F36", "", f"""
    with recursive h as ({HEX_SQL}), c as (select * from h where score >= (select quantile_cont(score, 0.75) from h)),
    d as (select unnest([1, 1, 0, -1, -1, 0]) as dq, unnest([0, -1, -1, 0, 1, 1]) as dr),
    e as (select a.o_orderkey as a, b.o_orderkey as b from c a join d on true join c b on b.q = a.q + d.dq and b.r = a.r + d.dr),
    w as (select o_orderkey as a, o_orderkey as root from c union select e.b, w.root from w join e on e.a = w.a),
    l as (select a, min(root) as component from w group by a),
    z as (select component, count(*) as cell_count, round(count(*) * 0.7373, 3) as area_km2, round(avg(score), 1) as score_mean, max(score) as score_max, min(score) as score_min
      from l join c on c.o_orderkey = l.a group by component having count(*) >= 2),
    r as (select *, row_number() over (order by score_mean desc, component) as rank from z)
    select cell_count, area_km2, score_mean, score_max, score_min, rank from r where rank <= 10""")
def _(t):
    return zones.top_zones(hex_cells(t), 8).select("cell_count", "area_km2", "score_mean", "score_max", "score_min", "rank")
