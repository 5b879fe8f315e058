"""What is at, near and inside places: points, parcels and user-drawn areas, many at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import cells, spatial
from landgrid.operators.ranking import grouped_percentiles
from landgrid.session import cut_lineage

TOP_USES = 20
OTHER_USES = "OTROS"
NEAREST_MUNICIPALITY_M = 80_000.0


def scopes_from(spec: DataFrame, municipalities: DataFrame) -> DataFrame:
    """``scope_id, position, scope_rings, warning`` of polygon, radius, municipality and travel scopes.

    ``spec`` has ``scope_id, position, kind, rings, lng, lat, radius_m, minutes,
    mode, muni_code``. A travel time becomes a circle, and says so.
    """
    outlines = municipalities.select("muni_code", F.col("rings").alias("_outline"))
    joined = spec.join(outlines, "muni_code", "left")
    circle = lambda r: geo.radius_polygon(F.col("lng"), F.col("lat"), r)
    travel = geo.travel_radius_m(F.col("mode"), F.col("minutes"))
    rings = (
        F.when(F.col("kind") == "polygon", geo.clean_polygon(F.col("rings")))
        .when(F.col("kind") == "radius", circle(F.col("radius_m")))
        .when(F.col("kind") == "municipality", F.col("_outline"))
        .when(F.col("kind") == "isochrone", circle(travel))
    )
    # The warning asks for the shape again, so it reads the column and not the whole formula.
    shaped = joined.select("scope_id", "position", "kind", rings.alias("scope_rings"))
    warning = F.when(F.col("kind") == "isochrone", "circle_for_travel_time").when(F.col("scope_rings").isNull(), "no_outline")
    return shaped.select("scope_id", "position", "scope_rings", warning.alias("warning"))


def municipality_of(points: DataFrame, municipalities: DataFrame, point_id: str, limit_m: float | None = NEAREST_MUNICIPALITY_M) -> DataFrame:
    """Municipality of each point and how it was matched.

    The smallest outline that holds the point wins; points outside every
    outline take the nearest seat within the limit, or any without a limit.
    """
    m = municipalities.select("muni_code", F.col("rings").alias("m_rings"), geo.area(F.col("rings")).alias("m_area"))
    held = spatial.smallest_holder(
        points.select(point_id, "lng", "lat"), m, point_id, "muni_code", "m_area", rings="m_rings"
    ).withColumn("match", F.lit("polygon"))
    held = cut_lineage(held)
    rest = points.select(point_id, "lng", "lat").join(held, point_id, "left_anti")
    seats = municipalities.select("muni_code", F.col("seat_lng").alias("s_lng"), F.col("seat_lat").alias("s_lat"))
    names = {"left_xy": ("lng", "lat"), "right_xy": ("s_lng", "s_lat")}
    if limit_m is None:
        near = spatial.nearest_anywhere(rest, seats, point_id, "muni_code", **names)
    else:
        near = spatial.nearest(rest, seats, [limit_m / 4, limit_m], point_id, "muni_code", **names)
    return held.unionByName(near.select(point_id, "muni_code", F.lit("nearest").alias("match")))


def resolve_points(points: DataFrame, municipalities: DataFrame, parcels: DataFrame, coverage: DataFrame, point_id: str) -> DataFrame:
    """Municipality, smallest parcel and coverage at each point."""
    muni = municipality_of(points, municipalities, point_id)
    own = parcels.select("npn", F.col("rings").alias("p_rings"), F.col("area_m2").alias("p_area"))
    parcel = spatial.smallest_holder(points.select(point_id, "lng", "lat"), own, point_id, "npn", "p_area", rings="p_rings")
    known = coverage.select("muni_code", "coverage_status", "n_parcels")
    return points.select(point_id).join(muni, point_id, "left").join(parcel, point_id, "left").join(known, "muni_code", "left")


def parcels_in(parcels: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pairs of scopes and the parcels that share surface with them."""
    return spatial.polygon_overlaps(parcels, scopes.select("scope_id", "scope_rings"), "parcel_key", "rings", "scope_rings")


def parcel_stats(parcels: DataFrame, buildings: DataFrame, scopes: DataFrame, top_uses: int = TOP_USES) -> DataFrame:
    """Totals, median and uses of the parcels in each scope.

    The map of uses names the ``top_uses`` most frequent ones and sums up the others.

    ``buildings`` has ``building_id, parcel_key, footprint_m2, b_rings``.
    """
    # The pairs feed the sums, the median and the uses.
    hits = cut_lineage(parcels_in(parcels, scopes).drop("rings", "scope_rings"))
    sums = hits.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.count_if(F.col("zone") == "01").alias("n_urban"),
        F.count_if(F.col("zone") == "02").alias("n_rural"),
        F.sum("area_m2").alias("area_sum_m2"),
        F.sum("built_area_m2").alias("built_area_sum_m2"),
    )
    median = grouped_percentiles(hits, ["scope_id"], "area_m2", {"area_median_m2": 0.5})
    uses = hits.groupBy("scope_id", F.coalesce("economic_use", F.lit(cells.NO_USE)).alias("use")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("scope_id").orderBy(F.col("n").desc(), "use")
    # The most frequent uses by name, all others as one entry, so that the map adds up.
    named = F.when(F.row_number().over(order) <= top_uses, F.col("use")).otherwise(OTHER_USES)
    top = uses.withColumn("use", named).groupBy("scope_id", "use").agg(F.sum("n").alias("n"))
    use_map = top.groupBy("scope_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("use", "n")))).alias("use_counts")
    )
    built = spatial.polygon_overlaps(buildings, scopes.select("scope_id", "scope_rings"), "building_id", "b_rings", "scope_rings")
    # Buildings per parcel first, so the distinct parcels are a plain count.
    per_parcel = built.groupBy("scope_id", "parcel_key").agg(F.count(F.lit(1)).alias("n"), F.sum("footprint_m2").alias("f"))
    cons = per_parcel.groupBy("scope_id").agg(
        F.sum("n").alias("n_buildings"), F.count(F.lit(1)).alias("n_with_building"), F.sum("f").alias("built_footprint_sum_m2")
    )
    out = scopes.select("scope_id").join(sums, "scope_id", "left").join(median, "scope_id", "left")
    out = out.join(use_map, "scope_id", "left").join(cons, "scope_id", "left")
    out = out.fillna(0, ["n_parcels", "n_urban", "n_rural", "n_buildings", "n_with_building"])
    return out.withColumn("large_lots", F.col("n_parcels") - F.col("n_with_building"))


def population_in(blocks: DataFrame, scopes: DataFrame) -> DataFrame:
    """People inside each scope with a map of age bands, by share of the block."""
    b = blocks.withColumn("block_area", geo.area(F.col("block_rings")))
    pairs = spatial.polygon_overlaps(b, scopes.select("scope_id", "scope_rings"), "block_id", "block_rings", "scope_rings")
    share = spatial.overlap_pct(F.col("overlap"), F.col("block_area")) / 100
    pairs = cut_lineage(pairs.withColumn("_share", share).drop("block_rings", "scope_rings"))
    whole = lambda c: F.round(F.sum(F.col(c) * F.col("_share"))).cast("bigint")
    totals = pairs.groupBy("scope_id").agg(
        whole("pop_total").alias("pop_total"), whole("households").alias("households"),
        whole("dwellings").alias("dwellings"), F.count(F.lit(1)).alias("n_blocks"),
    )
    bands = (
        pairs.select("scope_id", "_share", F.explode("age_bands").alias("band", "people"))
        .groupBy("scope_id", "band")
        .agg(F.round(F.sum(F.col("people") * F.col("_share"))).cast("bigint").alias("n"))
    )
    band_map = bands.groupBy("scope_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "n")))).alias("age_bands")
    )
    return totals.join(band_map, "scope_id", "left")


def facilities_in(schools: DataFrame, health: DataFrame, pois: DataFrame, municipalities: DataFrame, scopes: DataFrame) -> DataFrame:
    """Facilities inside each scope; providers without a place count by touched municipality."""
    s = scopes.select("scope_id", "scope_rings")
    inside = lambda df, key: spatial.points_in_polygons(df, s, key, rings="scope_rings").drop("scope_rings")
    schools_n = inside(schools, "school_id").groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n_schools"), F.sum("enrollment").alias("school_enrollment")
    )
    health_n = inside(health, "health_id").groupBy("scope_id").agg(F.count(F.lit(1)).alias("n_health"))
    poi_map = cells.count_map(inside(pois, "poi_id"), ["scope_id"], F.col("category"), "poi_counts")
    m = municipalities.select("muni_code", F.col("rings").alias("m_rings"))
    touched = spatial.polygon_overlaps(m, s, "muni_code", "m_rings", "scope_rings").select("scope_id", "muni_code")
    unplaced = health.where("lng is null").groupBy("muni_code").agg(F.count(F.lit(1)).alias("n"))
    unlocated = touched.join(unplaced, "muni_code").groupBy("scope_id").agg(F.sum("n").alias("n_health_unlocated"))
    out = reduce(lambda a, b: a.join(b, "scope_id", "left"), [schools_n, health_n, poi_map, unlocated], scopes.select("scope_id"))
    return out.fillna(0, ["n_schools", "n_health", "n_health_unlocated"])


def health_count(n_health: Column, n_unlocated: Column) -> Column:
    """Unknown, not zero, when only providers without a place are around."""
    return F.when((n_health == 0) & (n_unlocated > 0), None).otherwise(n_health)


def overlaps_of(subjects: DataFrame, layers: DataFrame, key: str, rings: str) -> DataFrame:
    """Share of each subject under every layer feature, of every kind in one table.

    ``layers`` has ``kind, code, label, l_rings`` as built by ``union_layers``.
    """
    s = subjects.select(key, rings).withColumn("_area", geo.area(F.col(rings)))
    pairs = spatial.polygon_overlaps(s, layers, key, rings, "l_rings")
    pct = spatial.overlap_pct(F.col("overlap"), F.col("_area"))
    return pairs.select(key, "kind", "code", "label", pct.alias("overlap_pct"))


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """One table of ``kind, code, label, l_rings`` from layers of the same three columns."""
    parts = [df.select(F.lit(kind).alias("kind"), "code", "label", "l_rings") for kind, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def inside_urban(subjects: DataFrame, perimeters: DataFrame, key: str, rings: str) -> DataFrame:
    """TRUE over half inside the perimeters of the subject's municipality, NULL without any.

    Perimeter pieces of one municipality do not overlap, so their shares add up.
    """
    s = subjects.select(key, "muni_code", rings).withColumn("_area", geo.area(F.col(rings)))
    p = perimeters.select(F.col("muni_code").alias("u_muni"), F.col("rings").alias("u_rings"))
    hits = spatial.polygon_overlaps(s, p, key, rings, "u_rings").where("muni_code = u_muni")
    share = hits.groupBy(key).agg(spatial.overlap_pct(F.sum("overlap"), F.first("_area")).alias("pct"))
    known = perimeters.select("muni_code").distinct().withColumn("_known", F.lit(True))
    joined = subjects.select(key, "muni_code").join(known, "muni_code", "left").join(share, key, "left")
    inside = F.coalesce("pct", F.lit(0.0)) > 50
    return joined.select(key, F.when(F.col("_known"), inside).alias("inside_urban_perimeter"))


# Road classes of the two distances that name them.
MAIN_ROADS = ["motorway", "trunk", "primary"]
SIDE_ROADS = ["secondary", "tertiary"]


def road_access(points: DataFrame, roads: DataFrame, point_id: str, reach_m: float = 10_000.0) -> DataFrame:
    """Least distance to primary, secondary, paved and any road, for points with any road within reach.

    All roads are looked at close by; farther out a point only meets roads of the kinds it still
    lacks, so it never lists all roads within reach.
    """
    kinds = {
        "dist_primary_m": F.col("class").isin(MAIN_ROADS), "dist_secondary_m": F.col("class").isin(SIDE_ROADS),
        "dist_paved_m": F.coalesce("is_paved", F.lit(False)), "dist_any_m": F.lit(True),
    }
    return spatial.least_distances(points, roads, [reach_m / 8, reach_m], point_id, kinds, left_xy=("lng", "lat"), right_segment="segment")


def nearest_facilities(points: DataFrame, layers: dict[str, DataFrame], point_id: str, reach_m: float = 20_000.0) -> DataFrame:
    """Distance to the nearest feature of each layer; layers have ``id, f_lng, f_lat``."""
    out = points.select(point_id)
    for name, layer in layers.items():
        near = spatial.nearest(
            points, layer, [reach_m / 8, reach_m], point_id, "id", left_xy=("lng", "lat"), right_xy=("f_lng", "f_lat")
        )
        out = out.join(near.select(point_id, F.col("distance_m").alias(f"dist_{name}_m")), point_id, "left")
    return out


def area_discrepancy(measured: Column, registered: Column) -> Column:
    """TRUE when the outline and the register differ by more than a tenth, NULL without both."""
    return F.when(registered > 0, F.abs(measured - registered) / registered * 100 > 10)


# Kinds of layers in the sections of an area report that show overlaps.
LAYER_SECTIONS = {
    "soils": ["land_capability", "land_vocation", "soil_unit", "land_use", "agricultural_frontier"],
    "hazards": ["hazard"],
    "protected": ["protected_area", "ethnic_territory"],
    "pot": ["pot_zone"],
}
FACILITY_SECTIONS = ["education", "health", "commerce"]
SECTIONS = ["parcels", "population", *FACILITY_SECTIONS, *LAYER_SECTIONS, "relief", "accessibility"]
# Why a section is missing. The frontier alone is no soil survey.
REASONS = {
    "parcels": "no_parcels_loaded",
    "population": "no_census_blocks",
    "soils": "no_soil_survey",
    "hazards": "no_hazard_layer",
    "pot": "no_zoning_plan",
    "relief": "no_elevation_model",
}


def layer_sections(scopes: DataFrame, layers: DataFrame, wanted: list[str]) -> DataFrame:
    """One array column per wanted overlap section: percent, kind, code and label, largest first."""
    kinds = [k for name in wanted for k in LAYER_SECTIONS[name]]
    pairs = overlaps_of(scopes.select("scope_id", "scope_rings"), layers.where(F.col("kind").isin(kinds)), "scope_id", "scope_rings")
    # Pieces of one code add up first, so a scope keeps one entry per code.
    codes = pairs.groupBy("scope_id", "kind", "code").agg(
        F.least(F.round(F.sum("overlap_pct"), 3), F.lit(100.0)).alias("overlap_pct"), F.min("label").alias("label")
    )
    entry = F.struct((-F.col("overlap_pct")).alias("order"), "kind", "code", "overlap_pct", "label")

    def of(name: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("kind").isin(LAYER_SECTIONS[name]), entry)))
        return F.transform(listed, lambda e: F.struct(e["kind"].alias("kind"), e["code"].alias("code"), e["label"].alias("label"), e["overlap_pct"].alias("overlap_pct"))).alias(name)

    return codes.groupBy("scope_id").agg(*[of(name) for name in wanted])


def missing_sections(wanted: list[str]) -> Column:
    """Array of ``section, reason`` for the wanted sections without data.

    Facilities, protected areas and access are never missing: none there is an answer.
    """
    soil_kinds = [k for k in LAYER_SECTIONS["soils"] if k != "agricultural_frontier"]

    def none_of(name: str, kinds: list[str]) -> Column:
        return F.coalesce(F.size(F.filter(F.col(name), lambda e: e["kind"].isin(kinds))), F.lit(0)) <= 0

    empty = {
        "parcels": lambda: F.coalesce(F.col("n_parcels"), F.lit(0)) == 0,
        "population": lambda: F.coalesce(F.col("n_blocks"), F.lit(0)) == 0,
        "soils": lambda: none_of("soils", soil_kinds),
        "hazards": lambda: none_of("hazards", LAYER_SECTIONS["hazards"]),
        "pot": lambda: none_of("pot", LAYER_SECTIONS["pot"]),
        "relief": lambda: F.coalesce(F.col("slope_mean_pct"), F.lit(0.0)) == 0,
    }
    entries = []
    for name in wanted:
        if name in empty:
            reason = F.lit(REASONS[name])
            if name == "parcels":
                reason = F.when(F.col("coverage_status") == "none", "other_manager").otherwise(reason)
            entries.append(F.when(empty[name](), F.struct(F.lit(name).alias("section"), reason.alias("reason"))))
    none = F.expr("cast(array() as array<struct<section:string,reason:string>>)")
    return F.array_compact(F.array(*entries)) if entries else none


def analyze_areas(
    scopes: DataFrame,
    sources: dict[str, DataFrame],
    sections: list[str] | None = None,
    level: int = 8,
) -> DataFrame:
    """One row per scope with the wanted sections, all eleven by default, and the list of missing ones.

    ``sources`` by name: parcels, buildings, blocks, schools, health, pois, municipalities, layers
    (from ``union_layers``), elevation (cells of ``level``), roads, and coverage (``muni_code,
    coverage_status``), which tells, for scopes with a ``muni_code``, why parcels are absent.
    Only the sources of the wanted sections are read. ``warning`` says how many sections lack data.
    """
    wanted = [name for name in SECTIONS if not sections or name in sections]
    area = F.round(geo.area_m2(F.col("scope_rings")) / 1e6, 4)
    kept = ["scope_id", "position", *[c for c in ("muni_code",) if c in scopes.columns]]
    out = scopes.select(*kept, area.alias("area_km2")).withColumn("area_ha", F.round(F.col("area_km2") * 100, 2))
    if "muni_code" in scopes.columns and "coverage" in sources:
        out = out.join(sources["coverage"].select("muni_code", "coverage_status"), "muni_code", "left")
    else:
        out = out.withColumn("coverage_status", F.lit(None).cast("string"))
    per_km2 = lambda n: F.when(F.col("area_km2") > 0, F.round(F.col(n) / F.col("area_km2"), 1))
    if "parcels" in wanted:
        out = out.join(parcel_stats(sources["parcels"], sources["buildings"], scopes), "scope_id", "left").withColumns({
            "n_without_building": F.greatest(F.col("n_parcels") - F.col("n_with_building"), F.lit(0)),
            "parcels_per_km2": per_km2("n_parcels"),
        })
    if "population" in wanted:
        out = out.join(population_in(sources["blocks"], scopes), "scope_id", "left").withColumn("pop_per_km2", per_km2("pop_total"))
    if any(name in wanted for name in FACILITY_SECTIONS):
        found = facilities_in(sources["schools"], sources["health"], sources["pois"], sources["municipalities"], scopes)
        columns = {"education": ["n_schools", "school_enrollment"], "health": ["n_health"], "commerce": ["poi_counts"]}
        found = found.withColumn("n_health", health_count(F.col("n_health"), F.col("n_health_unlocated")))
        out = out.join(found.select("scope_id", *[c for name in FACILITY_SECTIONS if name in wanted for c in columns[name]]), "scope_id", "left")
    overlapping = [name for name in LAYER_SECTIONS if name in wanted]
    if overlapping:
        out = out.join(layer_sections(scopes, sources["layers"], overlapping), "scope_id", "left")
    if "relief" in wanted:
        out = out.join(cells.relief(scopes, sources["elevation"], "scope_id", "scope_rings", level), "scope_id", "left")
    if "accessibility" in wanted:
        centre = geo.point_on_surface(F.col("scope_rings"))
        places = scopes.select("scope_id", centre.alias("_p")).select("scope_id", F.col("_p.x").alias("lng"), F.col("_p.y").alias("lat"))
        out = out.join(road_access(places, sources["roads"], "scope_id"), "scope_id", "left")
    n = F.size("missing")
    text = F.concat(F.lit("no data for "), n, F.lit(f" of {len(wanted)} sections"))
    return out.withColumn("missing", missing_sections(wanted)).withColumn("warning", F.when(n > 0, text))


def compare_areas(analysis: DataFrame) -> DataFrame:
    """Two to four analysed areas in the order they were asked for."""
    return analysis.orderBy("position")
