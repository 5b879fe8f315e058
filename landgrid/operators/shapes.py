"""Whole shapes from many rows: the parts of a code in one shape, the outline of adjoining polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators.skew import salted_join
from landgrid.session import cut_lineage

#: Points that one row's shape may hold, some 16 bytes each; a larger shape takes several rows.
MOST_POINTS = 200_000


def points_of(rings: Column) -> Column:
    return F.coalesce(F.aggregate(rings, F.lit(0).cast("bigint"), lambda n, ring: n + F.size(ring)), F.lit(0).cast("bigint"))


def with_pieces(parts: DataFrame, keys: list[str], rings: str = "rings", most_points: int = MOST_POINTS) -> DataFrame:
    """Adds ``piece`` and ``pieces``: in how many rows the shape of a part's key comes, and in which of them the part is.

    A key whose parts have at most ``most_points`` points in all has one row. The parts of any other
    are spread by their row over as many as hold half of that on average, so that no row grows with
    the key, whatever number of parts, equal ones included, it has.
    """
    sized = cut_lineage(parts.withColumns({"_points": points_of(F.col(rings)), "_row": F.monotonically_increasing_id()}))
    large = sized.groupBy(*keys).agg(F.sum("_points").alias("_all")).where(F.col("_all") > most_points)
    known = salted_join(sized, large.withColumn("pieces", F.ceil(2 * F.col("_all") / most_points)).drop("_all"), keys, ["_row"], "left")
    known = known.withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("bigint")))
    return known.withColumn("piece", F.pmod(F.xxhash64("_row"), F.col("pieces"))).drop("_points", "_row")


def gathered_rings(rings: str, size: Column, when: Column | None = None) -> Column:
    """Aggregate: the rings of a group's parts in one shape, largest part first, ties by their points."""
    part = F.struct((-size).alias("order"), F.col(rings).alias("rings"))
    return F.flatten(F.transform(F.array_sort(F.collect_list(part if when is None else F.when(when, part))), lambda p: p["rings"]))


def multipart(parts: DataFrame, keys: list[str], rings: str = "rings", most_points: int = MOST_POINTS) -> DataFrame:
    """``keys, piece, pieces, rings``: one shape of many parts per key, in several rows only where it is very large.

    Sums over the rows of a key (area, points, parts) do not depend on how many there are.
    """
    spread = with_pieces(parts.where(F.size(rings) > 0), keys, rings, most_points)
    return spread.groupBy(*keys, "piece", "pieces").agg(gathered_rings(rings, geo.area(F.col(rings))).alias("rings"))


def outline_edges(df: DataFrame, keys: list[str], rings: str) -> DataFrame:
    """``keys, x1, y1, x2, y2``: the directed edges around the union of adjoining polygons, the inside on their left.

    Edges lie on lines, and along a line every edge counts up where it begins and down where it
    ends, one way or the other. Where the count is zero two neighbours meet, whether vertex to vertex
    or with a vertex of one within an edge of the other; the rest is the outline. A line is known by
    its own coordinate if it runs along an axis, else by direction and distance to ten digits.
    Equal polygons count once.
    """
    edges = (
        df.select(*keys, F.col(rings).alias("_rings")).distinct().select(*keys, F.explode("_rings").alias("_ring"))
        .select(*keys, F.explode(geo.segments(F.col("_ring"))).alias("e")).select(*keys, "e.*")
        .where("x1 <> x2 or y1 <> y2")
    )
    forward = "x1 < x2 or (x1 = x2 and y1 < y2)"
    ordered = edges.select(*keys, F.expr(f"if({forward}, 1, -1)").alias("turn"),
                           *[F.expr(f"if({forward}, {a}, {b})").alias(a) for a, b in (("x1", "x2"), ("y1", "y2"))],
                           *[F.expr(f"if({forward}, {b}, {a})").alias(b) for a, b in (("x1", "x2"), ("y1", "y2"))])
    # Equal edges first: most of a mosaic is gone before lines are formed.
    left = ordered.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.sum("turn").alias("turn")).where("turn <> 0")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    long = F.sqrt(dx * dx + dy * dy)
    away = (dx * F.col("y1") - dy * F.col("x1")) / long
    line = (
        F.when(dx == 0, F.struct(F.lit(0.0).alias("u"), F.lit(1.0).alias("v"), F.col("x1").alias("w")))
        .when(dy == 0, F.struct(F.lit(1.0).alias("u"), F.lit(0.0).alias("v"), F.col("y1").alias("w")))
        .otherwise(F.struct(F.round(dx / long, 10).alias("u"), F.round(dy / long, 10).alias("v"), F.round(away, 10).alias("w")))
    )
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("turn").alias("step")),
                             F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), (-F.col("turn")).alias("step"))))
    steps = left.select(*keys, line.alias("_line"), ends.alias("p")).groupBy(*keys, "_line", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.sum("p.step").alias("step"))
    along = Window.partitionBy(*keys, "_line").orderBy("x", "y")
    runs = steps.select(*keys, "x", "y", F.sum("step").over(along).alias("turn"), F.lead(F.struct("x", "y")).over(along).alias("to")).where("turn <> 0")
    there = F.col("turn") > 0
    return runs.select(
        *keys, F.when(there, F.col("x")).otherwise(F.col("to.x")).alias("x1"), F.when(there, F.col("y")).otherwise(F.col("to.y")).alias("y1"),
        F.when(there, F.col("to.x")).otherwise(F.col("x")).alias("x2"), F.when(there, F.col("to.y")).otherwise(F.col("y")).alias("y2"),
        F.explode(F.sequence(F.lit(1), F.abs("turn").cast("int"))).alias("_copy"),
    ).drop("_copy")


def _followers(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``id, to``: the edge that goes on where each one ends.

    Where outlines touch in a point an edge goes on with the one that bounds the same inside, the
    next one clockwise, so rings touch there and do not cross.
    """
    out = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(False).alias("ends"), F.atan2(F.expr("y2 - y1"), F.expr("x2 - x1")).alias("angle"))
    back = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(True).alias("ends"), F.atan2(F.expr("y1 - y2"), F.expr("x1 - x2")).alias("angle"))
    met = edges.select(*keys, "id", F.explode(F.array(out, back)).alias("e")).groupBy(*keys, F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("e.angle", "e.ends", "id")))).alias("around")  # the edges of one vertex
    )
    ends, begins = F.filter("around", lambda e: e["ends"]), F.filter("around", lambda e: ~e["ends"])
    shift = F.when(F.col("around")[0]["ends"], 0).otherwise(1)
    pairs = met.select(ends.alias("ends"), begins.alias("begins"), shift.alias("shift")).select(F.posexplode("ends").alias("k", "e"), "begins", "shift")
    follower = F.expr("element_at(begins, int((k + shift) % size(begins)) + 1)")
    return pairs.select(F.col("e.id").alias("id"), follower["id"].alias("to"))


def _ring_places(followers: DataFrame) -> DataFrame:
    """``id, low, dist``: the least edge of each edge's ring and the steps to it.

    Every round an edge takes over what the edge it knows furthest ahead knows, so the stretch
    doubles; joins are one to one. A round is written to the shared folder, only the number of
    changed edges reaches the driver.
    """
    state = cut_lineage(followers.select("id", "to", F.col("id").alias("low"), F.lit(0).cast("bigint").alias("dist")))
    reach = 1
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("dist").alias("_dist"))
        lower = F.col("_low") < F.col("low")
        state = cut_lineage(state.join(ahead, "to").select(
            "id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"),
            F.when(lower, F.col("_dist") + reach).otherwise(F.col("dist")).alias("dist"), lower.alias("changed"),
        ))
        if state.where("changed").isEmpty():
            return state.select("id", "low", "dist")
        reach *= 2


def outlines(df: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """One closed ring a row around the union of adjoining polygons by key: ``keys, ring, points``.

    Shells run counter-clockwise, holes clockwise. Polygons of a key may touch but not overlap,
    vertices need not meet; rows without a shape add nothing. ``ring`` names the least edge. The
    rings are put together over all tasks, in as many rounds as the longest has binary digits.
    """
    edges = cut_lineage(outline_edges(df, keys, rings).withColumn("id", F.monotonically_increasing_id()))
    places = _ring_places(_followers(edges, keys))
    # The head has distance 0, the edge behind it the greatest one.
    order = F.struct(F.when(F.col("dist") == 0, F.lit(None)).otherwise(-F.col("dist")).alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    found = edges.join(places, "id").groupBy(*keys, F.col("low").alias("ring")).agg(F.array_sort(F.collect_list(order)).alias("p"))
    # Nulls come last in array_sort: the head closes the ring.
    corners = F.transform("p", lambda p: geo.point(p["x"], p["y"]))
    closed = F.concat(F.array(F.element_at(corners, -1)), corners)
    return found.select(*keys, "ring", closed.alias("points"))


def dissolve(df: DataFrame, keys: list[str], rings: str = "rings", most_points: int = MOST_POINTS) -> DataFrame:
    """``keys, piece, pieces, rings``: the union of adjoining polygons by key, as ``multipart`` shapes of its outline."""
    single = outlines(df, keys, rings).select(*keys, F.array("points").alias("rings"))
    return multipart(single, keys, "rings", most_points)
