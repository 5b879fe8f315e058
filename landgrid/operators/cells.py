"""Aggregates per hexagonal cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import geo, hexgrid
from landgrid.functions.normalize import road_access
from landgrid.operators import overlays as overlays_of
from landgrid.operators import spatial
from landgrid.operators.ranking import grouped_percentiles
from landgrid.operators.skew import shuffled
from landgrid.session import cut_lineage

LARGE_LOT_M2 = 1000.0
ROAD_REACH_M = [1_000.0, 4_000.0, 15_000.0]
NO_USE = "NO_DISPONIBLE"


def seed_cells(municipalities: DataFrame, parcels: DataFrame, level: int) -> DataFrame:
    """Cells of every municipality: those of its outline and of its parcels.

    Municipalities without an outline take the hull of their parcels. A cell of
    two municipalities goes to the higher code. ``municipalities`` has
    ``muni_code, rings``; ``parcels`` has ``muni_code, cell, lng, lat``.
    """
    shaped = municipalities.where(F.col("rings").isNotNull()).select("muni_code", "rings")
    covered = spatial.polygon_cells(shaped, "rings", level).select("muni_code", "cell")
    from_parcels = parcels.join(municipalities.select("muni_code"), "muni_code", "left_semi")
    bare = municipalities.where(F.col("rings").isNull()).select("muni_code")
    hulls = spatial.convex_hulls(parcels.join(bare, "muni_code", "left_semi"), ["muni_code"], "lng", "lat")
    hull_cells = spatial.polygon_cells(hulls, "rings", level).select("muni_code", "cell")
    seeds = covered.unionByName(from_parcels.where("cell is not null").select("muni_code", "cell")).unionByName(hull_cells)
    return seeds.groupBy("cell").agg(F.max("muni_code").alias("muni_code"))


def cadastre_stats(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums, large lots and the spread of areas per cell."""
    lot = (F.col("area_m2") > LARGE_LOT_M2) & (F.coalesce("built_area_m2", F.lit(0.0)) == 0)
    sums = parcels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.sum("area_m2").alias("parcel_area_sum_m2"),
        F.sum("built_area_m2").alias("built_area_sum_m2"),
        F.count_if(lot).alias("n_large_lots"),
        F.min("area_m2").alias("area_min"),
        F.max("area_m2").alias("area_max"),
    )
    middle = grouped_percentiles(
        parcels, keys, "area_m2", {"area_p25": 0.25, "area_median": 0.5, "area_p75": 0.75}
    )
    return sums.join(middle, keys, "left")


def count_map(df: DataFrame, keys: list[str], category: Column, name: str) -> DataFrame:
    """Map of category to rows per key; categories are counted before they are put together."""
    counted = df.groupBy(*keys, category.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct("_c", "_n")))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def use_counts(parcels: DataFrame, keys: list[str]) -> DataFrame:
    return count_map(parcels, keys, F.coalesce("economic_use", F.lit(NO_USE)), "use_counts")


def school_age_of(block: str = "age_bands") -> Column:
    band = lambda k: F.coalesce(F.try_element_at(F.col(block), F.lit(k)).cast("double"), F.lit(0.0))
    return band("5_9") + band("10_14") + band("15_19") * 0.4


def population(shapes: DataFrame, blocks: DataFrame, key: str, rings: str) -> DataFrame:
    """People of census blocks shared out by the part of the block inside each shape.

    ``blocks`` has ``block_id, pop_total, households, dwellings, school_age,
    block_rings``. Blocks and shapes must use the same plane.
    """
    b = blocks.withColumn("block_area", geo.area(F.col("block_rings")))
    pairs = spatial.polygon_overlaps(b, shapes.select(key, rings), "block_id", "block_rings", rings)
    share = spatial.overlap_pct(F.col("overlap"), F.col("block_area")) / 100
    whole = lambda c: F.round(F.sum(F.col(c) * share)).cast("bigint")
    return pairs.groupBy(key).agg(
        whole("pop_total").alias("pop"), whole("households").alias("households"),
        whole("dwellings").alias("dwellings"), whole("school_age").alias("pop_school_age"),
        F.count(F.lit(1)).alias("n_blocks"),
    )


def facilities(schools: DataFrame, health: DataFrame, pois: DataFrame) -> DataFrame:
    """Counts per cell of points that already carry their cell."""
    s = schools.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_schools"), F.sum("enrollment").alias("school_enrollment")
    )
    h = health.groupBy("cell").agg(F.count(F.lit(1)).alias("n_health"))
    p = count_map(pois, ["cell"], F.col("category"), "poi_counts")
    return s.join(h, "cell", "full_outer").join(p, "cell", "full_outer")


def hazard_order() -> Column:
    """What the worst level is greatest by; unranked levels come last."""
    return F.struct(F.coalesce("level_rank", F.lit(0)), "level")


def overlay_shares(shapes: DataFrame, overlays: DataFrame, key: str, rings: str, strongest: bool = False) -> DataFrame:
    """Share of each shape under each overlay source: ``layer, layer_key, source_id, pct``.

    Large shapes are cut into pieces; pieces of one source are added up and capped at one hundred. ``overlays``
    has ``piece_id, source_id, layer, layer_key, level, level_rank, o_rings``. For a reader of the worst levels alone,
    ``strongest`` leaves out sources that others of their layer and key make needless, and shares: pairs may repeat.
    """
    s = shapes.select(key, rings).withColumn("_area", geo.area(F.col(rings)))
    ids = ["layer", "layer_key", "source_id", "level", "level_rank"]
    o = overlays.select(*ids, "o_rings")
    if strongest:
        pairs = overlays_of.strongest_pieces(s, o, rings, "o_rings", ["layer", "layer_key"], hazard_order())
        return pairs.select(key, *ids)
    many_s, many_o = (cut_lineage(overlays_of.in_many_rows(df, k, r)) for df, k, r in ((s, [key], rings), (o, ids, "o_rings")))

    def parted(df: DataFrame, many: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """Rows whose key has only them, and the others, if any."""
        if many.isEmpty():
            return df, None
        listed = many.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")

    (s_one, s_more), (o_one, o_more) = parted(s, many_s, [key]), parted(o, many_o, ids)
    pairs = lambda a, b: overlays_of.piece_overlaps(a, b, rings, "o_rings").select(key, *ids, "overlap", "_area")
    # A shape and a source of one row each have their share at once; there is nothing to add up.
    shares = pairs(s_one, o_one)
    rest = [pairs(a, b) for a, b in ((s_more, o), (s_one, o_more)) if a is not None and b is not None]
    if rest:
        grouped = reduce(lambda a, b: a.unionByName(b), rest).groupBy(key, *ids)
        shares = shares.unionByName(grouped.agg(F.sum("overlap").alias("overlap"), F.first("_area").alias("_area")))
    return shares.select(key, *ids, spatial.overlap_pct(F.col("overlap"), F.col("_area")).alias("pct"))


def layer_maxima(shares: DataFrame, key: str, layers: dict[str, str]) -> DataFrame:
    """Largest share per layer, one column each; NULL where nothing overlaps."""
    return shares.where(F.col("layer").isin(list(layers))).groupBy(key).agg(
        *[F.max(F.when(F.col("layer") == layer, F.col("pct"))).alias(name) for layer, name in layers.items()]
    )


def worst_hazards(shares: DataFrame, key: str) -> DataFrame:
    """Map of hazard kind to the level of highest rank; unranked levels come last."""
    hazards = shares.where("layer = 'hazard'")
    worst = hazards.groupBy(key, "layer_key").agg(
        F.max_by("level", hazard_order()).alias("level")
    )
    entries = F.sort_array(F.collect_list(F.struct("layer_key", "level")))
    return worst.groupBy(key).agg(F.map_from_entries(entries).alias("hazard_flags"))


def category_mix(shares: DataFrame, key: str, layer: str, name: str) -> DataFrame:
    """Map of an overlay's key to its share of the shape."""
    summed = shares.where((F.col("layer") == layer) & F.col("layer_key").isNotNull()).groupBy(key, "layer_key")
    pct = F.round(F.least(F.sum("pct"), F.lit(100.0)), 2)
    entries = F.sort_array(F.collect_list(F.struct("layer_key", "_pct")))
    return summed.agg(pct.alias("_pct")).groupBy(key).agg(F.map_from_entries(entries).alias(name))


def road_distances(points: DataFrame, roads: DataFrame, key: str, xy: tuple[str, str]) -> DataFrame:
    """Metres to the nearest primary and the nearest paved road within fifteen kilometres.

    ``roads`` has one straight piece per row: ``road_id, class, is_paved, segment``.
    """
    kinds = {
        "dist_primary_road_m": F.col("class").isin("motorway", "trunk", "primary"),
        "dist_paved_road_m": F.col("is_paved"),
    }
    near = spatial.least_distances(points, roads, ROAD_REACH_M, key, kinds, left_xy=xy, right_segment="segment")
    return points.select(key).join(near, key, "left")


def relief(shapes: DataFrame, elevation: DataFrame, key: str, rings: str, level: int) -> DataFrame:
    """Mean height, mean slope and steepest slope of the cells a shape covers."""
    wanted = spatial.polygon_cells(shapes.select(key, rings), rings, level).select(key, "cell")
    return shuffled(wanted).join(elevation, "cell").groupBy(key).agg(
        F.avg("elevation_mean_m").alias("elevation_mean_m"),
        F.avg("slope_mean_pct").alias("slope_mean_pct"),
        F.max("slope_max_pct").alias("slope_max_pct"),
    )


def seat_distances(points: DataFrame, municipalities: DataFrame, key: str) -> DataFrame:
    """Metres from a point to the seat of its own municipality."""
    seats = municipalities.select("muni_code", "seat_lng", "seat_lat")
    metres = geo.haversine_m(F.col("lng"), F.col("lat"), F.col("seat_lng"), F.col("seat_lat"))
    return points.join(seats, "muni_code").select(key, metres.alias("dist_muni_seat_m"))


def rebuild_cells(
    municipalities: DataFrame,
    parcels: DataFrame,
    blocks: DataFrame,
    schools: DataFrame,
    health: DataFrame,
    pois: DataFrame,
    overlays: DataFrame,
    elevation: DataFrame,
    roads: DataFrame,
    level: int,
) -> DataFrame:
    """All cells of all municipalities at one level with every aggregate.

    Point tables have ``lng, lat``; polygon tables have rings in degrees. Every
    aggregate is keyed by cell and joined once.
    """
    at = hexgrid.point_to_cell(F.col("lng"), F.col("lat"), level)
    # Five aggregates read the placed parcels; their cells are computed once.
    kept = ["muni_code", "area_m2", "built_area_m2", "economic_use", "lng", "lat"]
    placed = cut_lineage(parcels.select(*kept).withColumn("cell", at))
    cells = seed_cells(municipalities, placed, level)
    cells = cells.withColumn("_p", hexgrid.center(F.col("cell"), level)).select(
        "cell", "muni_code", F.col("_p.x").alias("lng"), F.col("_p.y").alias("lat")
    )
    # Every aggregate below starts from the cells, and four of them from the shares.
    cells = cut_lineage(cells)
    shapes = cells.select("cell", hexgrid.boundary(F.col("cell"), level).alias("cell_rings"))
    shares = cut_lineage(overlay_shares(shapes, overlays, "cell", "cell_rings"))
    put = lambda df: df.withColumn("cell", at)
    parts = [
        cadastre_stats(placed, ["cell"]),
        use_counts(placed, ["cell"]),
        population(shapes, blocks, "cell", "cell_rings"),
        facilities(put(schools), put(health), put(pois)),
        layer_maxima(shares, "cell", {"protected_area": "protected_pct", "ethnic_territory": "ethnic_pct", "urban_perimeter": "urban_pct"}),
        worst_hazards(shares, "cell"),
        category_mix(shares, "cell", "land_capability", "capability_mix"),
        category_mix(shares, "cell", "land_vocation", "vocation_mix"),
        elevation,
        road_distances(cells, roads, "cell", ("lng", "lat")),
        seat_distances(cells, municipalities, "cell"),
    ]
    out = cells
    for part in parts:
        out = out.join(part, "cell", "left")
    out = out.withColumn("road_access_score", road_access(F.col("dist_paved_road_m"), missing_as=5000))
    return out.fillna(0, ["n_schools", "n_health"])
