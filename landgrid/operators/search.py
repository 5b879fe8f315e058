"""Fuzzy search by trigrams, address matching and parcel-code resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import address, codes
from landgrid.functions.geo import in_envelope
from landgrid.functions.text import fold, trigrams
from landgrid.operators.skew import salted_join
from landgrid.session import cut_lineage

TEXT_SIMILARITY = 0.25
ADDRESS_SIMILARITY = 0.30


#: What every row of the index has; a source may leave out the places.
INDEX = ["kind", "ref", "label", "context", "rank"]
PLACED = {"muni_code": "string", "dept_code": "string", "place": "struct<x: double, y: double>"}


def build_index(sources: list[DataFrame]) -> DataFrame:
    """One search index of ``kind, ref, label, context, rank, muni_code, dept_code, place``; the first source of a (kind, ref) wins.

    Sources come in order of preference; within one source the least label wins, then the least
    context. A row without a label cannot be found and is left out.
    """
    tagged = [
        s.select(*INDEX, *[(F.col(c) if c in s.columns else F.lit(None)).cast(kind).alias(c) for c, kind in PLACED.items()], F.lit(i).alias("_source"))
        for i, s in enumerate(sources)
    ]
    union = reduce(lambda a, b: a.unionByName(b), tagged).where("label is not null")
    row = F.struct("label", "context", "rank", *PLACED)
    picked = union.groupBy("kind", "ref").agg(F.min_by(row, F.struct("_source", "label", "context")).alias("r"))
    return picked.select("kind", "ref", "r.*").withColumn("label_fold", fold(F.col("label")))


def _source(rows: DataFrame, kind: str, ref: Column, label: str, context: Column, **placed: Column) -> DataFrame:
    rank = F.lit(RANKS[kind])
    return rows.select(F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), F.col(label).alias("label"), context.alias("context"), rank.alias("rank"),
                       *[column.alias(name) for name, column in placed.items()])


# The order of the kinds among equally similar names, and what the context says of them.
RANKS = {"department": 10, "municipality": 20, "neighborhood": 40, "vereda": 45, "populated_place": 50, "toponym": 60, "protected_area": 70, "school": 80, "health_facility": 85}
DEPARTMENT, TOPONYM, PROTECTED, UNKNOWN = "Departamento", "Nombre geográfico", "Área protegida", "municipio no determinado"
PREFIXES = {"neighborhood": "", "vereda": "Vereda · ", "school": "Establecimiento educativo · ", "health_facility": "Prestador de salud · "}


def place_sources(
    departments: DataFrame, municipalities: DataFrame, neighborhoods: DataFrame, veredas: DataFrame, populated_places: DataFrame,
    toponyms: DataFrame, protected_areas: DataFrame, schools: DataFrame, health_facilities: DataFrame,
) -> list[DataFrame]:
    """The nine sources of the index, shaped from the rows of the active cuts.

    All have ``name`` and ``place``; departments ``dept_code``; municipalities ``muni_code, dept_code``;
    neighbourhoods and veredas ``muni_code, code``; the others ``id`` and, but for protected areas,
    ``muni_code``; populated places ``kind``, toponyms and protected areas ``category``.

    A neighbourhood, vereda or facility needs a place, a neighbourhood, vereda or populated place a
    known municipality; a facility of an unknown one says so. Names of municipalities come by a
    join whose right side has one row each.
    """
    of_dept = departments.select("dept_code", F.col("name").alias("_dept"))
    of_muni = municipalities.join(of_dept, "dept_code").select("muni_code", "dept_code", F.col("name").alias("_muni"), "_dept")
    both = F.concat_ws(", ", "_muni", "_dept")
    place = F.col("place")
    at = {"muni_code": F.col("muni_code"), "dept_code": F.col("dept_code"), "place": place}
    out = [
        _source(departments, "department", F.col("dept_code"), "name", F.lit(DEPARTMENT), dept_code=F.col("dept_code"), place=place),
        _source(municipalities.join(of_dept, "dept_code"), "municipality", F.col("muni_code"), "name", F.col("_dept"), **at),
    ]
    for kind, rows in (("neighborhood", neighborhoods), ("vereda", veredas)):
        known = rows.where("place is not null").select("muni_code", "code", "name", "place").join(of_muni, "muni_code")
        out.append(_source(known, kind, F.concat_ws(":", "muni_code", "code"), "name", F.concat(F.lit(PREFIXES[kind]), both), **at))
    settled = populated_places.select("id", "kind", "name", "muni_code", "place").join(of_muni, "muni_code")
    out.append(_source(settled, "populated_place", F.col("id"), "name", F.concat_ws(" · ", F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), "_muni"), **at))
    out.append(_source(toponyms, "toponym", F.col("id"), "name", F.coalesce("category", F.lit(TOPONYM)), muni_code=F.col("muni_code"), place=place))
    out.append(_source(protected_areas, "protected_area", F.col("id"), "name", F.coalesce("category", F.lit(PROTECTED)), place=place))
    for kind, rows in (("school", schools), ("health_facility", health_facilities)):
        placed = rows.where("place is not null").select("id", "name", "muni_code", "place").join(of_muni.select("muni_code", "_muni"), "muni_code", "left")
        context = F.concat(F.lit(PREFIXES[kind]), F.coalesce("_muni", F.lit(UNKNOWN)))
        out.append(_source(placed, kind, F.col("id"), "name", context, muni_code=F.col("muni_code"), place=place))
    return out


def _rarest(texts: DataFrame, counts: DataFrame, same: list[str], text: str, grams: str, threshold: float) -> DataFrame:
    """One row per text and probe trigram: the rarest ``n - ceil(t n) + 1`` of its ``n`` trigrams.

    Ordered by how often the index holds a trigram, ties by the trigram itself.
    """
    each = texts.select(*same, text, F.explode(grams).alias("_g")).join(counts, "_g", "left")
    # A text has a handful of trigrams, so its list is short.
    ordered = each.groupBy(*same, text).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), F.col("_g").alias("g")))).alias("_r")
    )
    size = F.size("_r")
    keep = F.least(size - F.ceil(size * F.lit(threshold)).cast("int") + 1, size)
    listed = ordered.select(*same, text, size.alias("_n"), F.posexplode(F.slice("_r", F.lit(1), keep)).alias("_pos", "_p"))
    return listed.select(*same, text, F.col("_p.g").alias("_g"), F.struct("_n", "_pos").alias(f"{text}s"))


def text_pairs(
    queries: DataFrame, index: DataFrame, query_text: str, index_text: str, threshold: float, block: list[str] | None = None,
) -> DataFrame:
    """Pairs of a distinct query text ``_qt`` and a distinct index text ``_dt`` at or above the threshold, with ``similarity``.

    Two texts that share the wanted part of their trigrams also share one of
    the rarest ``n - ceil(t n) + 1`` of each, under one order for both; only
    those are looked up, which spares the common trigrams and loses no pair.
    ``block`` names columns that must agree on both sides.
    """
    same = block or []
    q = queries.select(*same, F.col(query_text).alias("_qt")).distinct().withColumn("_qg", trigrams(F.col("_qt")))
    d = index.select(*same, F.col(index_text).alias("_dt")).distinct().withColumn("_dg", trigrams(F.col("_dt")))
    # Both are read three times below.
    q, d = cut_lineage(q.where(F.size("_qg") > 0)), cut_lineage(d.where(F.size("_dg") > 0))
    counts = d.select(F.explode("_dg").alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    posted = _rarest(d, counts, same, "_dt", "_dg", threshold)
    probes = _rarest(q, counts, same, "_qt", "_qg", threshold)
    # Sizes and the places of a first common trigram must allow the similarity.
    a, b, t = "_qts", "_dts", f"{float(threshold)!r}D"
    fits = (
        f"{a}._n >= {t} * {b}._n and {b}._n >= {t} * {a}._n and "
        f"1 + least({a}._n - {a}._pos - 1, {b}._n - {b}._pos - 1) >= {t} / (1 + {t}) * ({a}._n + {b}._n) - 1e-9"
    )
    met = salted_join(posted, probes, [*same, "_g"], spread=["_dt"]).where(fits).select(*same, "_qt", "_dt").distinct()
    both = met.join(q, [*same, "_qt"]).join(d, [*same, "_dt"])
    shared = F.size(F.array_intersect("_qg", "_dg"))
    scored = both.select(*same, "_qt", "_dt", F.size("_qg").alias("_nq"), F.size("_dg").alias("_nd"), shared.alias("_n"))
    similarity = F.col("_n") / (F.col("_nq") + F.col("_nd") - F.col("_n"))
    return scored.select(*same, "_qt", "_dt", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def trigram_pairs(
    queries: DataFrame, index: DataFrame, query_id: str, index_id: str, query_text: str, index_text: str,
    threshold: float, block: list[str] | None = None,
) -> DataFrame:
    """Pairs of a query and an index row with their trigram similarity at or above the threshold.

    Both sides are reduced to distinct texts, so copies of a text cost nothing until
    every pair of rows is listed; see ``text_pairs``.
    """
    same = block or []
    scored = text_pairs(queries, index, query_text, index_text, threshold, block)
    back_q = queries.select(query_id, *same, F.col(query_text).alias("_qt"))
    back_d = index.select(index_id, *same, F.col(index_text).alias("_dt"))
    return scored.join(back_q, [*same, "_qt"]).join(back_d, [*same, "_dt"]).drop("_qt", "_dt")


def prefix_pairs(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, query_text: str, index_text: str) -> DataFrame:
    """Pairs where the index text starts with the query text.

    Distinct index texts are listed under those of their beginnings that are as
    long as some query and met on the whole query text, so only true pairs ever
    come together.
    """
    q = queries.select(query_id, F.col(query_text).alias("_head")).where(F.length("_head") > 0)
    d = index.select(F.col(index_text).alias("_dt")).where(F.length(index_text) > 0).distinct()
    # As many numbers as the longest query has characters, at most.
    asked = [r[0] for r in q.select(F.length("_head")).distinct().collect()]
    if not asked:
        return q.join(index.select(index_id), F.lit(False)).select(query_id, index_id)
    lengths = F.explode(F.filter(F.array(*map(F.lit, asked)), lambda n: n <= F.length("_dt")))
    heads = d.withColumn("_n", lengths).select("_dt", F.expr("substring(_dt, 1, _n)").alias("_head"))
    met = salted_join(heads, q, ["_head"], spread=["_dt"])
    back = index.select(index_id, F.col(index_text).alias("_dt"))
    return met.join(back, "_dt").select(query_id, index_id)


def search_text(queries: DataFrame, index: DataFrame, query_id: str = "query_id", text: str = "text", limit: int = 10, muni: str | None = None) -> DataFrame:
    """Best index rows per query: prefix matches, then similarity, rank and label.

    ``index`` comes from ``build_index`` and is keyed by ``kind, ref``. ``muni`` names the column of
    ``queries`` with the municipality to search in; NULL there searches everywhere.
    """
    if limit < 1:
        raise ValueError("bad limit")
    q = queries.select(query_id, fold(F.col(text)).alias("_needle"))
    keyed = index.withColumn("_key", F.struct("kind", "ref"))
    fuzzy = trigram_pairs(q, keyed, query_id, "_key", "_needle", "label_fold", TEXT_SIMILARITY).select(query_id, "_key", "similarity")
    prefix = prefix_pairs(q, keyed, query_id, "_key", "_needle", "label_fold").withColumn("_prefix", F.lit(True))
    pairs = fuzzy.join(prefix, [query_id, "_key"], "full_outer")
    found = pairs.join(keyed, "_key")
    if muni is not None:
        asked = queries.select(query_id, F.col(muni).alias("_within"))
        found = found.join(asked, query_id).where("_within is null or muni_code = _within").drop("_within")
    found = found.withColumn("is_prefix", F.coalesce("_prefix", F.lit(False)))
    found = found.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    order = Window.partitionBy(query_id).orderBy(
        F.col("is_prefix").desc(), F.col("similarity").desc(), "rank", "label", "kind", "ref"
    )
    return (
        found.withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= limit)
        .select(query_id, F.col("_nth").alias("place"), "kind", "ref", "label", "context", "similarity", "is_prefix")
    )


def standardize(df: DataFrame, raw: str) -> DataFrame:
    """Canonical address and its parts next to the raw text."""
    out = df.withColumn("canonical", address.canonical(F.col(raw)))
    return out.withColumn("_p", address.parts_of(F.col("canonical"))).select(*df.columns, "canonical", "_p.*")


def match_addresses(asked: DataFrame, points: DataFrame, parcels: DataFrame, limit: int = 5) -> DataFrame:
    """Best address points and parcels per asked address of the same municipality and way number.

    ``asked`` has ``address_id, muni_code, raw``; points and parcels have ``ref,
    muni_code, label``. Texts are ranked before rows: a text brings its first ``limit``
    rows, an asked text keeps its best ``limit``, and only those meet the asked rows.
    """
    q = cut_lineage(standardize(asked, "raw")).where("way_number is not null")
    both = points.select(F.lit("address_point").alias("source"), "ref", "muni_code", "label").unionByName(
        parcels.select(F.lit("parcel").alias("source"), "ref", "muni_code", "label")
    )
    d = cut_lineage(standardize(both, "label")).where("way_number is not null")
    block = ["muni_code", "way_number"]
    q = q.select("address_id", *block, F.col("canonical").alias("_qt"))
    d = d.select("source", "ref", *block, F.col("canonical").alias("_dt"))

    def first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
        # A filter on row_number keeps only ``limit`` rows per group before the shuffle.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("place", place).where(F.col("place") <= limit)

    own = first(d, [*block, "_dt"], "source", "ref").drop("place")
    ranked = [F.col("similarity").desc(), "source", "ref"]
    pairs = text_pairs(q, d, "_qt", "_dt", ADDRESS_SIMILARITY, block).join(own, [*block, "_dt"])
    best = first(pairs, [*block, "_qt"], *ranked).select(*block, "_qt", "source", "ref", "similarity")
    flat = q.join(best, [*block, "_qt"]).select("address_id", "source", "ref", "similarity")
    return first(flat, ["address_id"], *ranked)


def resolve_codes(asked: DataFrame, parcels: DataFrame, text: str = "code") -> DataFrame:
    """Decoded codes with their parcel, found by new or by old code, or the reason there is none."""
    digits = codes.digits(F.col(text))
    decoded = asked.withColumns(
        {"reason": codes.reason_invalid(F.col(text)), "zone_kind": codes.zone_kind(F.col(text)), "_digits": digits}
    )
    new = parcels.select(F.col("npn").alias("_digits"), F.col("npn").alias("by_new"))
    old = parcels.groupBy(F.col("npn_old").alias("_digits")).agg(F.min("npn").alias("by_old"))
    joined = decoded.join(new, "_digits", "left").join(old, "_digits", "left")
    match = F.when(F.col("by_new").isNotNull(), "new").when(F.col("by_old").isNotNull(), "old")
    return joined.withColumn("matched_by", match).withColumn("npn", F.coalesce("by_new", "by_old")).drop("_digits", "by_new", "by_old")


PAIR = "^\\s*(-?[0-9]{1,3}(?:[.][0-9]+)?)\\s*[,; ]\\s*(-?[0-9]{1,3}(?:[.][0-9]+)?)\\s*$"


def parse_coordinates(text: Column) -> Column:
    """Struct ``lng, lat`` from two numbers in either order, told apart by the national ranges."""
    first = F.regexp_extract(text, PAIR, 1).try_cast("double")
    second = F.regexp_extract(text, PAIR, 2).try_cast("double")
    pair = lambda lng, lat: F.struct(lng.alias("lng"), lat.alias("lat"))
    return F.when(in_envelope(second, first), pair(second, first)).when(
        in_envelope(first, second), pair(first, second)
    )


# Score of each kind of answer.
CLASS_SCORES = {"parcel_code": 1.0, "old_code": 1.0, "coordinates": 1.0, "division_code": 0.95, "address": 0.8, "text": 0.5}


def classify_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """What a search text is: a code, coordinates, a division code, an address or plain text."""
    t = F.col(text)
    kind = (
        F.when(codes.is_code(t), "parcel_code")
        .when(codes.is_old_code(t), "old_code")
        .when(parse_coordinates(t).isNotNull(), "coordinates")
        .when(F.trim(t).rlike("^([0-9]{2}|[0-9]{5})$"), "division_code")
        .when(address.looks_like_address(address.canonical(t)), "address")
        .otherwise("text")
    )
    scores = F.create_map(*[F.lit(v) for kv in CLASS_SCORES.items() for v in kv])
    return queries.withColumn("kind", kind).withColumn("score", F.try_element_at(scores, F.col("kind")))
