"""Spatial joins as bucketed equi joins.

Points and boxes are put into square buckets of several sizes. A box uses the
smallest size that is at least half as wide as the box, so it never covers more
than three buckets a side. Candidates meet on the bucket, then boxes are
compared, then the exact test runs. A pair meets in one bucket only, so no
``distinct`` follows. Joins go through ``salted_join``, which splits buckets
that hold too many rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import geo, hexgrid
from landgrid.functions.kernels import REST, halve, hull, hull_batches, overlap_area
from landgrid.operators.skew import MOST_HOT, SAMPLE, hot_keys, salted_join
from landgrid.session import cut_lineage

# Bucket sides in degrees; each is four times the one before.
SIDES = [0.01 * 4**k for k in range(7)]
LAST = len(SIDES) - 1
#: Points at which a search for the nearest counts features, and how many a point are a crowd.
PROBES = 1000
CROWD = 2
#: Rectangles of a group that a bucket may have without being cut.
FEW = 8
#: What is within a radius is looked for a little farther out, which rounding may need.
REACH = 1.001
HULL_PARTS = 32


BOX = ["xmin", "ymin", "xmax", "ymax"]
BUCKET = ["_level", "_ix", "_iy"]
SIDE_SQL = "element_at(array(" + ", ".join(f"{s!r}D" for s in SIDES) + "), _level + 1)"


def _boxed(df: DataFrame, rings: str, name: str) -> DataFrame:
    """Rows with a shape, and its box as a struct that is never NULL.

    A box that could be NULL would be tested again below the scan for every
    comparison a join makes with it.
    """
    points = F.flatten(F.col(rings))
    side = lambda pick, axis: F.coalesce(pick(points.getField(axis)), F.lit(0.0))
    box = F.struct(
        side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"),
        side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"),
    )
    return df.where(F.size(points) > 0).withColumn(name, box)


def _with_level(df: DataFrame, box: str) -> DataFrame:
    """Adds ``_native``, the finest level whose buckets are at least half as wide as the box."""
    extent = f"greatest({box}.xmax - {box}.xmin, {box}.ymax - {box}.ymin)"
    steps = " ".join(f"when {extent} <= {2 * side!r}D then {k}" for k, side in enumerate(SIDES[:-1]))
    return df.withColumn("_native", F.expr(f"case {steps} else {LAST} end"))


def _with_buckets(df: DataFrame, box: str) -> DataFrame:
    """One row per bucket the box touches on the row's ``_level``."""
    def run(axis: str) -> Column:
        low, high = f"{box}.{axis}min", f"{box}.{axis}max"
        return F.expr(f"explode(sequence(floor({low} / {SIDE_SQL}), floor({high} / {SIDE_SQL})))")

    return df.withColumn("_ix", run("x")).withColumn("_iy", run("y"))


def _among(levels: list[int]) -> str:
    return f"array({', '.join(map(str, levels))})" if levels else "cast(array() as array<int>)"


def _point_buckets(df: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """One row per level with the bucket of the point."""
    levels = df.withColumn("_level", F.expr(f"explode({_among(levels)})"))
    return levels.withColumns(
        {"_ix": F.expr(f"floor({x} / {SIDE_SQL})"), "_iy": F.expr(f"floor({y} / {SIDE_SQL})")}
    )


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    point_id: str,
    x: str = "lng",
    y: str = "lat",
    rings: str = "rings",
    how: str = "inner",
) -> DataFrame:
    """Every (point, polygon) pair where the polygon holds the point.

    With ``how`` left_semi or left_anti, the points inside any or no polygon.
    The two sides must not share column names.
    """
    left = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    right = _boxed(polygons, rings, "_box")
    if how != "inner":
        hits = _holding(left.select(point_id, x, y), right.select(rings, "_box"), point_id, x, y, rings)
        return points.join(hits.select(point_id).distinct(), point_id, how)
    return _holding(left, right, point_id, x, y, rings)


def _holding(left: DataFrame, right: DataFrame, point_id: str, x: str, y: str, rings: str) -> DataFrame:
    """Pairs of points and shapes with a ``_box`` that hold them. A shape without rings is its box."""
    # Points only go to the levels that shapes have.
    levels, flat = _levels_and_rectangles(right.select("_box", F.col(rings).isNull().alias("_flat")), "_box", "_flat")
    # Plain numbers, as in ``touching_overlaps``.
    sides = {f"_{name}": F.col("_box")[name] for name in BOX}
    right = _with_buckets(_with_level(right, "_box").withColumnRenamed("_native", "_level"), "_box").withColumns(sides).drop("_box")
    hot = hot_keys(_point_buckets(left.select(x, y).sample(SAMPLE, seed=7), x, y, levels), BUCKET)
    # Like ``contains_point``, a box holds its lower and left edge.
    inside = (F.col(x) < F.col("_xmax")) & (F.col(y) < F.col("_ymax"))
    if not flat:
        inside = F.when(F.col(rings).isNull(), inside).otherwise(geo.contains_point(F.col(rings), F.col(x), F.col(y)))
    near = F.col(x).between(F.col("_xmin"), F.col("_xmax")) & F.col(y).between(F.col("_ymin"), F.col("_ymax"))
    joined = salted_join(_point_buckets(left, x, y, levels), right, BUCKET, [point_id], hot=hot, sorted_merge=True)
    return joined.where(near & inside).drop(*sides, *BUCKET)


def smallest_holder(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, area: str,
    x: str = "lng", y: str = "lat", rings: str = "rings",
) -> DataFrame:
    """Per point, the holding polygon of least area; ties go to the lower id.

    Polygons are numbered by area and id and written once, and a point's least number wins. Tasks
    keep a number a point instead of sorting the pairs, which grow with the polygons
    around a point, and rectangles meet points as boxes, without their rings.
    """
    # A shape that is exploded is made once a row; else its formula is repeated for every corner that is read.
    own = _boxed(polygons.select(polygon_id, area, F.explode(F.array(rings)).alias(rings)), rings, "_box")
    own = own.withColumn(rings, F.when(~geo.is_rectangle(F.col(rings)), F.col(rings)))
    # The number never falls from one range to the next, nor within a range.
    ranged = own.repartitionByRange(area, polygon_id).sortWithinPartitions(area, polygon_id)
    numbered = cut_lineage(ranged.withColumn("_number", F.monotonically_increasing_id()))
    placed = points.select(point_id, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = _holding(placed, numbered.select("_number", rings, "_box"), point_id, x, y, rings)
    best = pairs.groupBy(point_id).agg(F.min("_number").alias("_number"))
    return best.join(numbered.select("_number", polygon_id), "_number").select(point_id, polygon_id)


def _levels_and_rectangles(df: DataFrame, box: str, flat: str) -> tuple[list[int], bool]:
    """The bucket levels that occur, seven at most, and whether every row is a rectangle."""
    found = _with_level(df.select(box, flat), box).groupBy("_native").agg(F.bool_and(flat).alias("flat")).collect()
    return sorted(r["_native"] for r in found), all(r["flat"] for r in found)


def touching_overlaps(left: DataFrame, right: DataFrame, spread: list[str], kernel: Callable[[Column], Column]) -> DataFrame:
    """Pairs of rows whose ``_abox`` and ``_bbox`` touch, each pair once, with their common area as ``overlap``.

    A pair meets at the coarser of its two levels. Class 1 joins left rows on
    their own level with right rows of that level or finer; class 2 joins right
    rows on their own level with finer left rows. Rows only go to the coarser
    levels that the other side has. Two rectangles, told by ``_aflat`` and
    ``_bflat``, share a box; ``kernel`` gives the area of the other pairs, from
    a condition that tells which. Nothing is shuffled by pair.
    """
    left_levels, left_flat = _levels_and_rectangles(left, "_abox", "_aflat")
    right_levels, right_flat = _levels_and_rectangles(right, "_bbox", "_bflat")

    def buckets(df: DataFrame, box: str, others: list[int], classes: str) -> DataFrame:
        wanted = f"array_union(array(_native), filter({_among(others)}, x -> x > _native))"
        levels = _with_level(df, box).withColumn("_level", F.expr(f"explode({wanted})"))
        put = _with_buckets(levels.withColumn("_class", F.expr(classes)), box).drop("_native")
        # Whether the box begins in this column and this row of buckets.
        begins = {f"{box}_{axis}": F.expr(f"floor({box}.{axis}min / {SIDE_SQL}) = _i{axis}") for axis in "xy"}
        # Plain numbers: a pair's condition would build a struct anew for each field it reads.
        sides = {f"{box}_{name}": F.col(box)[name] for name in BOX}
        return put.withColumns(begins | sides).drop(box)

    of_left = lambda df: buckets(df, "_abox", right_levels, "if(_level = _native, 1, 2)")
    of_right = buckets(right, "_bbox", left_levels, "explode(if(_level = _native, array(1, 2), array(1)))")
    keys = ["_class", *BUCKET]
    hot = hot_keys(of_left(left.select("_abox").sample(SAMPLE, seed=7)), keys)
    joined = salted_join(of_left(left), of_right, keys, [*spread, "_abox_xmin", "_abox_ymin"], hot=hot, sorted_merge=True)
    # The common part of two boxes begins where one of them does.
    owner = F.expr("(_abox_x or _bbox_x) and (_abox_y or _bbox_y)")
    a, b = ({name: F.col(f"_{side}box_{name}") for name in BOX} for side in "ab")
    met = joined.where(geo.boxes_touch(a, b) & owner)
    return _with_overlap(met, left_flat and right_flat, kernel).drop(*keys, *[f"_{side}box_{axis}" for side in "ab" for axis in "xy"])


def _with_overlap(met: DataFrame, all_flat: bool, kernel: Callable[[Column], Column]) -> DataFrame:
    """Pairs with the plain sides of both boxes that have a common area, as ``overlap``, without those sides."""
    a, b = ({name: F.col(f"_{side}box_{name}") for name in BOX} for side in "ab")
    overlap = geo.shared_box_area(a, b, REST)
    if not all_flat:
        met = met.withColumns({f"_{side}box": F.struct(*[c.alias(name) for name, c in box.items()]) for side, box in (("a", a), ("b", b))})
        flat = F.col("_aflat") & F.col("_bflat")
        overlap = F.when(flat, overlap).otherwise(kernel(~flat))
    return met.withColumn("overlap", overlap).where("overlap > 0").drop(
        *[f"_{side}{name}" for side in "ab" for name in ("box", "flat", *[f"box_{c}" for c in BOX])]
    )


def strongest_overlaps(
    left: DataFrame, rectangles: DataFrame, spread: list[str], kernel: Callable[[Column], Column], group: list[str], order: Column
) -> DataFrame:
    """Pairs as in ``touching_overlaps`` with rectangles, enough to know a left row's greatest ``order`` in each group.

    In a bucket that a rectangle covers, those of its group that are not above it add nothing: whatever
    they share with a left row there, it shares too. So buckets are listed from the coarsest on, keep what is above
    the best that covers them and one that covers them, and only those with more than ``FEW`` of a group
    are cut into sixteen, down to the size of the left rows. A pair may come once a bucket.
    """
    own, flat = _levels_and_rectangles(left, "_abox", "_aflat")
    sizes, _ = _levels_and_rectangles(rectangles, "_bbox", "_bflat")
    ends = [f"{pick}(_abox.{axis}{pick})" for axis in "xy" for pick in ("min", "max")]
    extent = left.agg(*[F.expr(e).alias(n) for e, n in zip(ends, ("xmin", "xmax", "ymin", "ymax"), strict=True)]).first()
    none = [F.lit(0.0).alias("overlap")]
    if not own or not sizes:
        plain = [c for c in left.columns if c not in ("_abox", "_aflat")] + [c for c in rectangles.columns if c not in ("_bbox", "_bflat")]
        return left.crossJoin(rectangles.limit(0)).select(*plain, *none)
    # What lies beyond all left rows is cut off, so buckets at the rim can be covered.
    sides = {f"_bbox_{name}": F.col("_bbox")[name] for name in BOX}
    cut = {f"_c{name}": (F.greatest if "min" in name else F.least)(F.col("_bbox")[name], F.lit(float(extent[name]))) for name in BOX}
    listed = rectangles.withColumns(sides | cut | {"_order": order, "_number": F.monotonically_increasing_id()})
    waiting = cut_lineage(listed.where("_cxmin <= _cxmax and _cymin <= _cymax").drop("_bbox", "_bflat"))
    lists, settled, within = {}, {}, Window.partitionBy("_ix", "_iy", *group)
    for level in range(max(*own, *sizes), min(own) - 1, -1):
        side = SIDES[level]
        for axis in "xy":
            low, high = f"floor(_c{axis}min / {side!r}D)", f"floor(_c{axis}max / {side!r}D)"
            if f"_i{axis}" in waiting.columns:
                low, high = f"greatest({low}, 4 * _i{axis})", f"least({high}, 4 * _i{axis} + 3)"
            waiting = waiting.withColumn(f"_n{axis}", F.expr(f"explode(if({low} <= {high}, sequence({low}, {high}), cast(array() as array<bigint>)))"))
            waiting = waiting.drop(f"_i{axis}").withColumnRenamed(f"_n{axis}", f"_i{axis}")
        covers = reduce(lambda a, b: a & b, [
            (F.col(f"_c{axis}min") <= F.greatest(F.col(f"_i{axis}") * side, F.lit(float(extent[f"{axis}min"]))))
            & (F.col(f"_c{axis}max") >= F.least((F.col(f"_i{axis}") + 1) * side, F.lit(float(extent[f"{axis}max"]))))
            for axis in "xy"
        ])
        rows = waiting.withColumn("_covers", covers).withColumn("_most", F.max(F.when(F.col("_covers"), F.col("_order"))).over(within))
        one = F.min(F.when(F.col("_covers") & (F.col("_order") == F.col("_most")), F.col("_number"))).over(within)
        rows = rows.withColumn("_one", one).where("_most is null or _order > _most or _number = _one")
        rows = cut_lineage(rows.withColumn("_few", F.count(F.lit(1)).over(within) <= FEW).drop("_covers", "_most", "_one"))
        lists[level], settled[level] = rows, rows.where("_few")
        waiting = rows.where("not _few").drop("_few")
    out = None
    for size in own:
        # Rows of this size meet the buckets that were settled before and all of their own size.
        parts = {level: lists[level] if level == size else settled[level] for level in lists if level >= size}
        parts = {level: df for level, df in parts.items() if not df.isEmpty()} or {size: lists[size]}
        levels = _with_level(left, "_abox").where(F.col("_native") == size).drop("_native").withColumn("_level", F.expr(f"explode({_among([*parts])})"))
        placed = _with_buckets(levels, "_abox").withColumns({f"_abox_{name}": F.col("_abox")[name] for name in BOX}).drop("_abox")
        right = reduce(lambda a, b: a.unionByName(b), [df.withColumn("_level", F.lit(level)) for level, df in parts.items()])
        right = right.drop("_few", "_order", "_number", *cut).withColumn("_bflat", F.lit(True))
        listed = cut_lineage(right.select(*BUCKET).distinct().limit(MOST_HOT + 1))
        if listed.count() <= MOST_HOT:
            # Left rows are not shuffled for buckets that list nothing.
            placed = placed.join(F.broadcast(listed), BUCKET, "left_semi")
        met = salted_join(placed, right, BUCKET, [*spread, "_abox_xmin", "_abox_ymin"], sorted_merge=True)
        a, b = ({name: F.col(f"_{mark}box_{name}") for name in BOX} for mark in "ab")
        found = _with_overlap(met.where(geo.boxes_touch(a, b)), flat, kernel).drop(*BUCKET)
        out = found if out is None else out.unionByName(found)
    return out


def polygon_overlaps(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    left_rings: str,
    right_rings: str,
) -> DataFrame:
    """Pairs of polygons with a common surface, with ``overlap`` in ring units squared.

    The two sides must not share column names. Touching borders do not count.
    """
    a = _boxed(left, left_rings, "_abox").withColumn("_aflat", geo.is_rectangle(F.col(left_rings)))
    b = _boxed(right, right_rings, "_bbox").withColumn("_bflat", geo.is_rectangle(F.col(right_rings)))
    shapes = lambda some: [F.when(some, F.col(c)) for c in (left_rings, right_rings)]
    return touching_overlaps(a, b, [left_id], lambda some: overlap_area(*shapes(some)))


def overlap_pct(overlap: Column, subject_area: Column, digits: int = 3) -> Column:
    """Share of the subject in percent, between 0 and 100."""
    share = F.round(overlap / subject_area * 100, digits)
    clamped = F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))
    return F.when((subject_area > 0) & overlap.isNotNull(), clamped)


def iou(overlap: Column, area_a: Column, area_b: Column) -> Column:
    joint = area_a + area_b - overlap
    return F.round(F.when(joint > 0, overlap / joint), 5)


def symmetric_difference_area(overlap: Column, area_a: Column, area_b: Column) -> Column:
    return area_a + area_b - 2 * overlap


def within_distance(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    left_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str] | None = None,
    right_segment: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Pairs of a left point and a right point or segment at most ``radius_m`` apart.

    Adds ``distance_m``. The right side gives either two point columns or one
    ``x1, y1, x2, y2`` struct. Left points keep one bucket; right features are
    repeated over the buckets within reach, so a pair meets once. A segment is followed
    column by column, so a long one is not in all buckets of its box. ``few`` left points
    are broadcast, and the features stay where they are.
    """
    a, b, distance = _in_reach(left, right, radius_m, left_xy, right_xy, right_segment)
    keys = ["_ix", "_iy"]
    joined = b.join(F.broadcast(a), keys) if few else salted_join(a, b, keys, [left_id], sorted_merge=True)
    return joined.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m).drop("_ix", "_iy", "_kx", "_dx")


def _in_reach(
    left: DataFrame, right: DataFrame, radius_m: float, left_xy: tuple[str, str],
    right_xy: tuple[str, str] | None = None, right_segment: str | None = None,
) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of ``within_distance`` with their buckets, and the metres between two rows that met."""
    lx, ly = left_xy
    # One bucket is twice the radius, so a point feature reaches at most two a side.
    step_y = 2 * radius_m / geo.METRES_PER_DEGREE
    step_x = step_y / math.cos(math.radians(20))
    if right_segment is not None:
        s = F.col(right_segment)
        low_x, high_x = F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])
        low_y, high_y = F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])
        distance = geo.point_segment_m(F.col(lx), F.col(ly), s, F.col("_kx"))
        known = s.isNotNull()
    else:
        rx, ry = right_xy
        low_x = high_x = F.col(rx)
        low_y = high_y = F.col(ry)
        distance = geo.haversine_m(F.col(lx), F.col(ly), F.col(rx), F.col(ry))
        known = F.col(rx).isNotNull() & F.col(ry).isNotNull()
    dy = radius_m * REACH / geo.METRES_PER_DEGREE
    farthest = F.greatest(F.abs(low_y), F.abs(high_y)) + dy
    dx = dy / F.cos(F.radians(F.least(farthest, F.lit(89.0))))
    b = right.where(known).withColumn("_ix", F.explode(F.sequence(F.floor((low_x - dx) / step_x), F.floor((high_x + dx) / step_x))))
    if right_segment is not None:
        # The part of the segment that a point of this column can be near to.
        def height(x: Column) -> Column:
            y = s["y1"] + (s["y2"] - s["y1"]) * ((x - s["x1"]) / (s["x2"] - s["x1"]))
            return F.greatest(low_y, F.least(high_y, y))

        ends = [height(F.col("_ix") * step_x - dx), height((F.col("_ix") + 1) * step_x + dx)]
        slanting = s["x1"] != s["x2"]
        low_y, high_y = (F.when(slanting, pick(*ends)).otherwise(edge) for pick, edge in ((F.least, low_y), (F.greatest, high_y)))
    b = b.withColumns({"_iy": F.explode(F.sequence(F.floor((low_y - dy) / step_y), F.floor((high_y + dy) / step_y))), "_dx": dx})
    a = left.where(F.col(lx).isNotNull() & F.col(ly).isNotNull())
    place = {"_ix": F.floor(F.col(lx) / step_x), "_iy": F.floor(F.col(ly) / step_y)}
    # What a distance needs of the point alone is not computed again for every pair.
    return a.withColumns(place | {"_kx": geo.metres_per_degree_lng(F.col(ly))}), b, distance


def near(left: DataFrame, right: DataFrame, radius_m: float, left_id: str, invert: bool = False, **names) -> DataFrame:
    """Left rows with (or, inverted, without) any right feature within the radius.

    Close features are looked for first; only points without one look farther,
    so crowded places do not list all their pairs.
    """
    x, y = names["left_xy"]
    shape = [names["right_segment"]] if names.get("right_segment") else list(names["right_xy"])
    waiting, features, found = left.select(left_id, x, y), right.select(*shape), None
    for reach in _widening(radius_m):
        hits = within_distance(waiting, features, reach, left_id, **names).select(left_id).distinct()
        if reach < radius_m:
            hits = cut_lineage(hits)
            waiting = waiting.join(hits, left_id, "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return left.join(found, left_id, "left_anti" if invert else "left_semi")


def _widening(radius_m: float) -> list[float]:
    return [radius_m / 16, radius_m]


def _crowded_radii(points: DataFrame, features: DataFrame, radius_m: float, left_id: str, **names) -> list[float]:
    """Radii below ``radius_m`` to begin with, where a point has many features within it.

    Counted at ``PROBES`` sampled points at most. A wrong guess costs time, never a result: a
    radius only settles the points that found something within it.
    """
    smaller = [radius_m / 4**k for k in (1, 2, 3, 4)]
    probes = points.sample(SAMPLE, seed=7).limit(PROBES)
    met = within_distance(probes, features, radius_m, left_id, few=True, **names)
    found = met.agg(*[F.count_if(F.col("distance_m") <= r).alias(f"n{k}") for k, r in enumerate(smaller)]).first()
    return [r for k, r in enumerate(smaller) if found[k] >= CROWD * PROBES][::-1]


def nearest(
    left: DataFrame,
    right: DataFrame,
    radii_m: list[float],
    left_id: str,
    right_id: str | None,
    **names,
) -> DataFrame:
    """Per left point, the nearest right feature within the last radius.

    Returns ``left_id, right_id, distance_m``; ties go to the lower id. Without ``right_id`` only
    distances are kept, and tasks keep a number a point instead of sorting the pairs. In
    crowded places smaller radii come first, see ``_crowded_radii``. Each
    radius only looks at the points that found nothing within the ones before,
    which is exact, and keeps the candidates of crowded places few. What a
    radius found is written to the checkpoint folder, because both the result
    and the next radius need it.
    """
    x, y = names["left_xy"]
    shape = [names["right_segment"]] if names.get("right_segment") else list(names["right_xy"])
    waiting = left.select(left_id, x, y)
    features = right.select(*([] if right_id is None else [right_id]), *shape)
    radii_m = [*_crowded_radii(waiting, features, radii_m[0], left_id, **names), *radii_m]
    found = None
    for k, radius in enumerate(radii_m):
        last = k + 1 == len(radii_m)
        pairs = within_distance(waiting, features, radius, left_id, **names).groupBy(left_id)
        if right_id is None:
            hits = pairs.agg(F.min("distance_m").alias("distance_m"))
        else:
            hits = pairs.agg(F.min(F.struct("distance_m", right_id)).alias("_best"))
            hits = hits.select(left_id, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.distance_m").alias("distance_m"))
        hits = hits if last else cut_lineage(hits)
        found = hits if found is None else found.unionByName(hits)
        if not last:
            waiting = waiting.join(hits.select(left_id), left_id, "left_anti")
            if len(radii_m) > 2:
                waiting = cut_lineage(waiting)
                if waiting.isEmpty():
                    break
    return found


def least_distances(
    left: DataFrame, right: DataFrame, radii_m: list[float], left_id: str, kinds: dict[str, Column],
    left_xy: tuple[str, str], right_segment: str,
) -> DataFrame:
    """Per left id, the metres to the nearest segment of every kind within the last radius, or NULL.

    ``kinds`` names conditions on ``right``, which may overlap. As in ``nearest``, each radius only looks
    at points that still lack a kind, for the kinds they lack, and crowded places begin with smaller radii.
    All candidates of a point meet it in one bucket, so its least distances are taken where they meet:
    pairs are neither sorted nor shuffled, and points are shuffled once a radius and once at the end.
    Ids that none of the kinds is near to are left out.
    """
    x, y = left_xy
    flags = {name: f"_is_{name}" for name in kinds}
    marked = right.select(right_segment, *[F.coalesce(cond, F.lit(False)).alias(flags[name]) for name, cond in kinds.items()])
    marked = marked.where(reduce(lambda a, b: a | b, map(F.col, flags.values())))
    waiting = left.select(left_id, x, y)
    names = {"left_xy": left_xy, "right_segment": right_segment}
    radii_m = [*_crowded_radii(waiting, marked, radii_m[0], left_id, **names), *radii_m]
    waiting = waiting.withColumns({name: F.lit(None).cast("double") for name in kinds})
    lacking = " or ".join(f"{name} is null" for name in kinds)
    found = None
    for k, radius in enumerate(radii_m):
        a, b, metres = _in_reach(waiting, marked, radius, **names)
        s, px, py, dy = F.col(right_segment), F.col(x), F.col(y), F.lit(radius * REACH / geo.METRES_PER_DEGREE)
        # The box of what is within reach is a shorter test than the distance.
        close = (
            (py >= F.least(s["y1"], s["y2"]) - dy) & (py <= F.greatest(s["y1"], s["y2"]) + dy)
            & (px >= F.least(s["x1"], s["x2"]) - F.col("_dx")) & (px <= F.greatest(s["x1"], s["x2"]) + F.col("_dx"))
        )
        a = a.withColumns({f"_to_{name}": F.col(name) for name in kinds}).drop(*kinds)
        # Most candidates are of other kinds or too far, and stop at the join.
        wanted = reduce(lambda a, b: a | b, [F.col(f"_to_{name}").isNull() & F.col(flag) for name, flag in flags.items()])
        joined = salted_join(
            a, b, ["_ix", "_iy"], [left_id, x, y], how="left", sorted_merge=True, keep_salt=True, condition=wanted & close
        ).withColumn("_m", metres)
        joined = joined.withColumn("_m", F.when(F.col("_m") <= radius, F.col("_m")))
        own = [left_id, x, y, *[f"_to_{name}" for name in kinds]]
        least = joined.groupBy("_ix", "_iy", "_salt", *own).agg(*[F.min(F.when(F.col(flag), F.col("_m"))).alias(flag) for flag in flags.values()])
        step = least.select(left_id, x, y, *[F.coalesce(f"_to_{name}", flag).alias(name) for name, flag in flags.items()])
        last = k + 1 == len(radii_m)
        step = step if last else cut_lineage(step)
        done = (step if last else step.where(f"not ({lacking})")).drop(x, y)
        found = done if found is None else found.unionByName(done)
        waiting = step.where(lacking)
        if not last and waiting.isEmpty():
            break
    best = found.groupBy(left_id).agg(*[F.min(name).alias(name) for name in kinds])
    return best.where(" or ".join(f"{name} is not null" for name in kinds))


def nearest_anywhere(left: DataFrame, right: DataFrame, left_id: str, right_id: str, first_m: float = 20_000, **names):
    """Nearest right feature without a distance limit.

    Radii grow fourfold up to some twelve hundred kilometres. Points without a
    feature that near are compared with the features of the cells that can hold
    the nearest one: two degrees wide, so the globe has 16 200 cells, and cells
    are compared with cells before any point is.
    """
    radii, reach = [], first_m
    while reach < math.pi * geo.EARTH_RADIUS_M / 8:
        radii.append(reach)
        reach *= 4
    x, y = names["left_xy"]
    placed = left.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    close = cut_lineage(nearest(placed, right, radii, left_id, right_id, **names))
    far = cut_lineage(placed.select(left_id, x, y).join(close.select(left_id), left_id, "left_anti"))
    if far.isEmpty():
        return close
    return close.unionByName(_nearest_far(far, right, left_id, right_id, **names))


def _nearest_far(far: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str],
                 right_xy: tuple[str, str] | None = None, right_segment: str | None = None) -> DataFrame:
    side = 2.0
    lx, ly = left_xy
    if right_segment is not None:
        s = F.col(right_segment)
        fx, fy, known = s["x1"], s["y1"], s.isNotNull()
        size = geo.haversine_m(s["x1"], s["y1"], s["x2"], s["y2"])
        distance, shape = geo.point_segment_m(F.col(lx), F.col(ly), s), [right_segment]
    else:
        fx, fy = F.col(right_xy[0]), F.col(right_xy[1])
        known, size = fx.isNotNull() & fy.isNotNull(), F.lit(0.0)
        distance, shape = geo.haversine_m(F.col(lx), F.col(ly), fx, fy), list(right_xy)

    def cell(x: Column, y: Column) -> Column:
        return (F.floor(x / side) * 1000 + F.floor(y / side)).cast("bigint")

    def middle(c: Column) -> list[Column]:
        row = F.pmod(c + 500, F.lit(1000)) - 500
        return [((c - row) / 1000 + 0.5) * side, (row + 0.5) * side]

    features = right.where(known).select(right_id, *shape, cell(fx, fy).alias("_b"), size.alias("_size"))
    points = far.withColumn("_a", cell(F.col(lx), F.col(ly)))
    own = points.select("_a").distinct()
    held = features.groupBy("_b").agg(F.max("_size").alias("_size"))
    # Cells of the globe against cells of the globe: bounded, whatever the tables hold.
    apart = geo.haversine_m(*middle(F.col("_a")), *middle(F.col("_b")))
    slack = 2 * side * geo.METRES_PER_DEGREE
    pairs = own.withColumn("_one", F.lit(1)).join(F.broadcast(held.withColumn("_one", F.lit(1))), "_one")
    pairs = pairs.select("_a", "_b", (apart - slack - F.col("_size")).alias("_least"), (apart + slack).alias("_most"))
    bound = F.min("_most").over(Window.partitionBy("_a"))
    pairs = pairs.withColumn("_bound", bound).where("_least <= _bound").select("_a", "_b")
    met = salted_join(salted_join(points, pairs, ["_a"], [left_id]), features.drop("_size"), ["_b"], [left_id], sorted_merge=True)
    best = F.min(F.struct(distance.alias("distance_m"), F.col(right_id).alias(right_id)))
    return met.groupBy(left_id).agg(best.alias("_best")).select(
        left_id, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.distance_m").alias("distance_m")
    )


def top_k_near(
    left: DataFrame, layers: dict[str, DataFrame], radius_m: float, k: int, left_id: str, left_xy: tuple[str, str]
) -> DataFrame:
    """The k nearest features of every layer around every left point.

    Each layer has ``id, name, category`` and either ``lng, lat`` or one
    ``segment`` struct per row; a feature of several segments counts once.
    """
    out = None
    for layer, df in layers.items():
        shape = {"right_segment": "segment"} if "segment" in df.columns else {"right_xy": ("f_lng", "f_lat")}
        if "segment" not in df.columns:
            df = df.withColumnRenamed("lng", "f_lng").withColumnRenamed("lat", "f_lat")
        waiting = left.select(left_id, *left_xy)
        for reach in _widening(radius_m):
            hits = within_distance(waiting, df, reach, left_id, left_xy=left_xy, **shape)
            if "segment" in df.columns:
                hits = hits.groupBy(left_id, "id", "name", "category").agg(F.min("distance_m").alias("distance_m"))
            hits = hits.select(left_id, F.lit(layer).alias("layer"), "id", "name", "category", "distance_m")
            if reach < radius_m:
                # All features this near are known, so points with k of them are done.
                hits = cut_lineage(hits)
                done = hits.groupBy(left_id).count().where(F.col("count") >= k).select(left_id)
                hits = hits.join(done, left_id, "left_semi")
                waiting = waiting.join(done, left_id, "left_anti")
            out = hits if out is None else out.unionByName(hits)
    order = Window.partitionBy(left_id, "layer").orderBy("distance_m", "id")
    # A filter on row_number keeps only k rows per group before the shuffle.
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def polygon_cells(df: DataFrame, rings: str, level: int, cell: str = "cell") -> DataFrame:
    """One row per hexagon whose centre falls in the polygon."""
    plane = df.withColumn("_plane", geo.project_rings(F.col(rings)))
    listed = plane.withColumn(cell, F.explode(hexgrid.box_cells(geo.box(F.col("_plane")), level)))
    c = hexgrid.plane_center(F.col(cell), level)
    return listed.where(geo.contains_point(F.col("_plane"), c["x"], c["y"])).drop("_plane")


def line_segments(df: DataFrame, line: str, longest_deg: float = 0.05, name: str = "segment") -> DataFrame:
    """One row per straight piece of a line, none longer than ``longest_deg`` a side."""
    parts = df.withColumn("_s", F.explode(geo.segments(F.col(line)))).drop(line)
    s = F.col("_s")
    n = F.greatest(
        F.ceil(F.greatest(F.abs(s["x2"] - s["x1"]), F.abs(s["y2"] - s["y1"])) / longest_deg), F.lit(1)
    ).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (s["x1"] + (s["x2"] - s["x1"]) * i / n).alias("x1"),
            (s["y1"] + (s["y2"] - s["y1"]) * i / n).alias("y1"),
            (s["x1"] + (s["x2"] - s["x1"]) * (i + 1) / n).alias("x2"),
            (s["y1"] + (s["y2"] - s["y1"]) * (i + 1) / n).alias("y2"),
        ),
    )
    return parts.withColumn(name, F.explode(pieces)).drop("_s")


def subdivide(df: DataFrame, rings: str, limit: int = 128) -> DataFrame:
    """Polygons cut into pieces of at most ``limit`` points; adds ``piece``.

    Points stay in arrays: a batch is cut shape by shape, and its other columns are taken by
    row number. Rows without rings have no pieces.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("piece", T.IntegerType())])
    at = df.columns.index(rings)

    def cut(batches):
        for batch in batches:
            polygons = batch.column(at)
            inner = polygons.flatten()
            first_ring = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(polygons), 0))]).astype(int)
            first_point = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(inner), 0))]).astype(int)
            xy = np.stack([c.to_numpy(zero_copy_only=False) for c in inner.flatten().flatten()], axis=1)
            rows, numbers, rings_in, points = [], [], [], [np.zeros((0, 2))]
            for row in range(batch.num_rows):
                own = range(first_ring[row], first_ring[row + 1])
                shape = [xy[first_point[r] : first_point[r + 1]] for r in own if first_point[r + 1] - first_point[r] >= 4]
                for number, piece in enumerate(halve(shape, limit) if shape else []):
                    rows.append(row)
                    numbers.append(number)
                    rings_in.append(len(piece))
                    points += piece
            points_in = [len(p) for p in points[1:]]
            flat = np.concatenate(points)
            corners = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
            closed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(points_in)]).astype(np.int32)), corners)
            shapes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rings_in)]).astype(np.int32)), closed)
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [shapes if k == at else c for k, c in enumerate(taken.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32())], names=schema.names)

    return df.mapInArrow(cut, schema)


def convex_hulls(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Convex hull of each group's points as ``rings``.

    Every task first reduces its points to hull points; the hulls of a group's
    tasks are then merged in a few dozen parts and those parts in one, so no
    step sees more than hull points.
    """
    points = df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    local = points.mapInPandas(hull_batches(keys), points.schema)
    parts = local.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(HULL_PARTS)))

    def merge(group):
        ring = hull(group[["x", "y"]].to_numpy())[:-1]
        out = pd.DataFrame({"x": ring[:, 0], "y": ring[:, 1]})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "x", "y"]]

    def close(group):
        ring = hull(group[["x", "y"]].to_numpy())
        shape = [[{"x": float(px), "y": float(py)} for px, py in ring]]
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "rings": shape}])

    merged = parts.groupBy(*keys, "_part").applyInPandas(merge, points.schema)
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    rings = T.StructField("rings", T.ArrayType(T.ArrayType(point)))
    schema = T.StructType([*[df.schema[k] for k in keys], rings])
    return merged.groupBy(*keys).applyInPandas(close, schema)
