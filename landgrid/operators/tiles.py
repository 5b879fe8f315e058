"""Which map tile shows which feature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import geo, hexgrid
from landgrid.session import cut_lineage

# Published columns and first zoom of every layer.
LAYERS = {
    "parcel": (14, ["npn", "muni_code", "zone", "area_m2", "built_area_m2", "economic_use"]),
    "building": (15, ["parcel_key", "floors", "built_area_m2", "building_use"]),
    "block": (12, ["muni_code", "code"]),
    "sector": (10, ["muni_code", "code", "name", "zone"]),
    "municipality": (4, ["muni_code", "muni_name", "dept_code", "population"]),
    "department": (0, ["dept_code", "dept_name"]),
    "hex": (0, ["cell", "muni_code", "n_parcels", "pop", "road_access_score"]),
}
LAST_ZOOM = 22
#: Runs of tiles that one task lists and sorts, which bounds its memory.
RUNS_A_TASK = 1_000_000


def assign_tiles(features: DataFrame, layer: str, feature_id: str, rings: str, zooms: list[int]) -> DataFrame:
    """One row per zoom, tile and feature whose shape touches the tile.

    Zooms before the layer's first show nothing. Rows stay one per feature, so
    a crowded tile is never put together in one place. A box of at most two tiles
    in line settles which ones; wider shapes are followed edge by edge, see
    ``covering_runs``, so a slanting feature is only in the tiles it passes.
    """
    first, columns = LAYERS[layer]
    shown = [z for z in zooms if first <= z <= LAST_ZOOM]
    if not shown:
        shown = [-1]
    kept = [feature_id, *[c for c in columns if c in features.columns and c != feature_id]]
    df = features.select(*kept, F.col(rings).alias("_rings"), geo.box(F.col(rings)).alias("_b"))
    df = df.where(F.col("_b").isNotNull()).withColumn("z", F.explode(F.array(*[F.lit(z) for z in shown]))).where("z >= 0")
    low = geo.tile_of(F.col("_b.xmin"), F.col("_b.ymax"), F.col("z"))
    high = geo.tile_of(F.col("_b.xmax"), F.col("_b.ymin"), F.col("z"))
    df = df.withColumns({"_lo": low, "_hi": high})
    plain = F.expr("_hi.x - _lo.x + _hi.y - _lo.y <= 1")
    near = df.where(plain).withColumn("x", F.explode(F.sequence("_lo.x", "_hi.x"))).withColumn("y", F.explode(F.sequence("_lo.y", "_hi.y")))
    # About the runs of a shape: one an edge and a few in every row of tiles.
    about = F.expr("cast(size(flatten(_rings)) + 3 * (_hi.y - _lo.y + 1) as bigint)")
    wide = cut_lineage(df.where(~plain).select(*kept, "z", "_rings", about.alias("_runs")).withColumn("_row", F.monotonically_increasing_id()))
    runs = _spread_runs(wide).join(wide.drop("_rings", "z", "_runs"), "_row")
    far = runs.withColumn("x", F.explode(F.sequence("low", "high")))
    return near.select(*kept, "z", "x", "y").unionByName(far.select(*kept, "z", "x", "y"))


def _spread_runs(wide: DataFrame) -> DataFrame:
    """``covering_runs`` of rows ``_row, z, _rings`` with about ``_runs`` runs each.

    Shapes are shuffled once, before their edges are listed, to so many tasks that none lists more
    than ``RUNS_A_TASK`` or so; their runs stay there. Only those of very large shapes go to tasks by row of tiles.
    """
    large = F.col("_runs") > RUNS_A_TASK / 10
    total, most = wide.agg(F.sum(F.when(~large, F.col("_runs"))), F.max("_runs")).first()
    tasks = max(1, math.ceil((total or 0) / RUNS_A_TASK))
    runs = covering_runs(wide.where(~large).select("_row", "z", "_rings").repartition(tasks, "_row"), "_row", "_rings")
    if (most or 0) <= RUNS_A_TASK / 10:
        return runs
    return runs.unionByName(covering_runs(wide.where(large), "_row", "_rings"))


def covering_runs(shapes: DataFrame, shape_id: str, rings: str) -> DataFrame:
    """Runs of tiles ``z, y, low, high`` that a shape touches, each tile in one run.

    ``shapes`` has one row per id, with its zoom ``z``. Every edge is cut at the borders of the
    rows of tiles that it passes and gives the run it covers in each. What lies between the runs
    of a row is untouched by edges, so it is inside as a whole or not at all, which the edges
    left of it that cross the middle of the row tell. Rows grow with the tiles along the outline;
    a run of inner tiles is one row, however wide.
    """
    points = lambda ring: F.when(F.size(ring) == 1, F.concat(ring, ring)).otherwise(ring)
    ends = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    edges = F.flatten(F.transform(F.transform(F.col(rings), points), lambda r: F.zip_with(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), ends)))
    df = shapes.select(F.col(shape_id).alias("_id"), "z", F.explode(edges).alias("e")).select("_id", "z", "e.*")
    rows = [geo.tile_of(F.col("x1"), pick("y1", "y2"), F.col("z"))["y"] for pick in (F.greatest, F.least)]
    df = df.withColumn("y", F.explode(F.sequence(*rows)))
    band = geo.tile_box(F.col("z"), F.lit(0), F.col("y"))
    df = df.withColumns({"_south": band["ymin"], "_north": band["ymax"]})
    df = df.withColumn("_middle", (F.col("_south") + F.col("_north")) / 2)

    def at(lat: Column) -> Column:
        """Where the edge is at a latitude; never beyond its ends."""
        x = F.col("x1") + (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1"))
        return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x))

    level = F.col("y1") == F.col("y2")
    cut = lambda x, y: F.when(level, F.col(x)).otherwise(at(F.least(F.greatest(F.col(y), F.col("_south")), F.col("_north"))))
    column = lambda x: F.expr(f"cast(greatest(0, least(_n - 1, floor(({x} + 180) / 360 * _n))) as bigint)")
    crosses = ((F.col("y1") > F.col("_middle")) != (F.col("y2") > F.col("_middle"))).cast("int")
    df = df.select("_id", "z", "y", cut("x1", "y1").alias("_a"), cut("x2", "y2").alias("_b"), F.pow(F.lit(2.0), "z").alias("_n"), crosses.alias("cross"))
    runs = df.select("_id", "z", "y", "cross", column("least(_a, _b)").alias("low"), column("greatest(_a, _b)").alias("high"))
    runs = runs.groupBy("_id", "z", "y", "low").agg(F.max("high").alias("high"), F.sum("cross").alias("cross"))
    row = Window.partitionBy("_id", "z", "y").orderBy("low")
    reach = F.max("high").over(row.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("high").over(row.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("cross").over(row.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.select("_id", "z", "y", "low", "high", reach.alias("_reach"), before.alias("_before"), left.alias("_left"), F.lead("low").over(row).alias("_next"))
    own = F.struct(F.greatest(F.col("low"), F.coalesce(F.col("_before") + 1, F.col("low"))).alias("low"), F.col("high").alias("high"))
    gap = F.struct((F.col("_reach") + 1).alias("low"), F.when(F.col("_left") % 2 == 1, F.col("_next") - 1).alias("high"))
    runs = runs.select(F.col("_id").alias(shape_id), "z", "y", F.explode(F.array(own, gap)).alias("r"))
    return runs.select(shape_id, "z", "y", "r.*").where("low <= high")


def cells_for_zoom(cells: DataFrame, z: int) -> DataFrame:
    """The cells of the level that a zoom shows."""
    wanted = hexgrid.level_for_zoom(F.lit(z))
    return cells.where(hexgrid.level_of(F.col("cell")) == wanted)
