"""Overlay of polygons on subdivided pieces, where only border pairs reach the area kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import geo
from landgrid.functions.kernels import settled_area
from landgrid.operators import spatial
from landgrid.session import cut_lineage

#: Points up to which a shape stays one piece.
PIECE_POINTS = 128


def point_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + F.coalesce(F.size(ring), F.lit(0)))


def pieces(shapes: DataFrame, rings: str, limit: int = PIECE_POINTS) -> DataFrame:
    """``shapes`` with those of more than ``limit`` points cut into pieces; all other columns repeat."""
    points = point_count(F.col(rings))
    small = shapes.where(points.isNull() | (points <= limit))
    # The cuts are read by several joins.
    return small.unionByName(cut_lineage(spatial.subdivide(shapes.where(points > limit), rings, limit).drop("piece")))


def _boxes(shapes: DataFrame, rings: str, side: str, limit: int) -> DataFrame:
    """Pieces with their box, their area and whether they are rectangles."""
    cut = spatial._boxed(pieces(shapes, rings, limit), rings, f"_{side}box")
    return cut.withColumns({f"_{side}area": geo.area(F.col(rings)), f"_{side}flat": geo.is_rectangle(F.col(rings))})


def piece_overlaps(left: DataFrame, right: DataFrame, left_rings: str, right_rings: str, limit: int = PIECE_POINTS) -> DataFrame:
    """A row per pair of pieces with common surface: the columns of both sides without rings, and ``overlap``.

    Areas of pieces add up to those of the whole shapes, so callers sum ``overlap`` by the ids
    they need. Large shapes of either side are cut first, so a piece and its copies in the buckets
    stay small; pairs are settled where they meet and never shuffled. A pair is inside or
    outside if no edge of the right piece comes near the left one's box, which settles its
    area; only the others, at the border, are intersected. The sides must not share column
    names. Rows without rings overlap nothing.
    """
    a, b = _boxes(left, left_rings, "a", limit), _boxes(right, right_rings, "b", limit)
    plain = [f.name for f in left.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    area = lambda some: settled_area(F.when(some, F.col(left_rings)), F.col("_aarea"), F.col("_abox"), F.when(some, F.col(right_rings)))
    pairs = spatial.touching_overlaps(a, b, plain, area)
    return pairs.drop(left_rings, right_rings, "_aarea", "_barea")


def strongest_pieces(left: DataFrame, right: DataFrame, left_rings: str, right_rings: str, group: list[str], order: Column, limit: int = PIECE_POINTS) -> DataFrame:
    """Pairs as in ``piece_overlaps``, enough to know a left row's greatest ``order`` in each group of right rows.

    Rectangles that others make needless are left out where they meet; other shapes meet as before.
    """
    a, b = _boxes(left, left_rings, "a", limit), _boxes(right, right_rings, "b", limit)
    plain = [f.name for f in left.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    area = lambda some: settled_area(F.when(some, F.col(left_rings)), F.col("_aarea"), F.col("_abox"), F.when(some, F.col(right_rings)))
    pairs = spatial.strongest_overlaps(a, b.where("_bflat"), plain, area, group, order)
    other = b.where("not _bflat")
    if not other.isEmpty():
        pairs = pairs.unionByName(spatial.touching_overlaps(a, other, plain, area))
    return pairs.drop(left_rings, right_rings, "_aarea", "_barea")


def in_many_rows(shapes: DataFrame, keys: list[str], rings: str, limit: int = PIECE_POINTS) -> DataFrame:
    """The keys, NULLs included, that have several rows or a shape that ``pieces`` cuts."""
    points = F.max(F.coalesce(point_count(F.col(rings)), F.lit(0)))
    counted = shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), points.alias("_points"))
    return counted.where((F.col("_n") > 1) | (F.col("_points") > limit)).select(*keys)
