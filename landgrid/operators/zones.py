"""Contiguous zones of high-scoring cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import hexgrid
from landgrid.operators.ranking import grouped_percentiles
from landgrid.operators.skew import hot_keys, salted_join
from landgrid.session import cut_lineage


def hex_edges(cells: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """Pairs of neighbouring cells that are both in the table; at most six per cell."""
    around = cells.select(*keys, F.col(cell).alias("a"), F.explode(hexgrid.neighbours(F.col(cell))).alias("b"))
    present = cells.select(*keys, F.col(cell).alias("b"))
    return around.join(present, [*keys, "b"])


def connected_components(cells: DataFrame, edges: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """Adds ``component``, the least cell id each cell is connected to.

    Every round takes the least label around a cell and then the label of that
    label, so paths halve. A round is written to the checkpoint folder; only
    the count of changed cells reaches the driver.
    """
    edges = cut_lineage(edges.select(*keys, "a", "b"))
    labels = cut_lineage(cells.select(*keys, F.col(cell).alias("a"), F.col(cell).alias("component")))
    while True:
        seen = labels.select(*keys, F.col("a").alias("b"), F.col("component").alias("_near"))
        near = edges.join(seen, [*keys, "b"]).groupBy(*keys, "a").agg(F.min("_near").alias("_near"))
        lower = labels.join(near, [*keys, "a"], "left").select(
            *keys, "a", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        heads = lower.select(*keys, F.col("a").alias("_new"), F.col("_new").alias("_head"))
        # A large zone makes its label a hot key; the labels of the last round tell which.
        hot = hot_keys(labels.select(*keys, F.col("component").alias("_new")), [*keys, "_new"], 1.0)
        jumped = salted_join(lower, heads, [*keys, "_new"], spread=["a"], hot=hot)
        step = cut_lineage(jumped.select(*keys, "a", "_old", F.least("_new", "_head").alias("component")))
        changed = step.where("_old <> component").count()
        labels = step.drop("_old")
        if changed == 0:
            return labels.withColumnRenamed("a", cell)


def top_zones(
    ranked: DataFrame,
    level: int,
    keys: list[str] | None = None,
    percentile: float = 0.75,
    min_cells: int = 2,
    limit: int = 10,
    min_score: float | None = None,
) -> DataFrame:
    """The best contiguous zones per key: cells at or above the cutoff, grown by neighbourhood."""
    keys = keys if keys is not None else ["template"]
    good = ranked.where("not excluded and score is not null")
    if min_score is None:
        cut = grouped_percentiles(good, keys, "score", {"_cutoff": percentile})
        chosen = good.join(cut, keys).where("score >= _cutoff").drop("_cutoff")
    else:
        chosen = good.where(F.col("score") >= min_score)
    chosen = cut_lineage(chosen)
    parts = connected_components(chosen, hex_edges(chosen, keys), keys)
    cells = chosen.join(parts, [*keys, "cell"])
    cells = cells.withColumn("_c", hexgrid.center(F.col("cell"), level))
    zones = cells.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.round(F.count(F.lit(1)) * hexgrid.area_km2(level), 3).alias("area_km2"),
        F.round(F.avg("_c.x"), 6).alias("center_lng"),
        F.round(F.avg("_c.y"), 6).alias("center_lat"),
        F.round(F.avg("score"), 1).alias("score_mean"),
        F.max("score").alias("score_max"),
        F.min("score").alias("score_min"),
        F.round(F.avg("confidence"), 3).alias("confidence_mean"),
    )
    order = Window.partitionBy(*keys).orderBy(F.col("score_mean").desc(), "component")
    return (
        zones.where(F.col("cell_count") >= min_cells)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def zone_members(ranked: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.join(parts, [*keys, "cell"])


def zone_factors(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score and number of cells with data for every factor of a zone."""
    f = members.select(*keys, "component", F.explode("factors").alias("f"))
    return f.groupBy(*keys, "component", F.col("f.indicator").alias("indicator")).agg(
        F.round(F.avg("f.score"), 1).alias("mean_score"), F.count("f.score").alias("cells_with_data")
    )
