"""Hexagonal cells on the measure projection, as Column expressions.

A cell id packs the level and the axial coordinates ``q, r`` into one LONG.
Levels have the published mean cell areas; they do not nest exactly, so a
parent is the coarser cell that holds the centre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgrid.functions.geo import let, point, project, unproject

# Mean cell area in square kilometres by level.
CELL_AREA_KM2 = {5: 252.9, 6: 36.13, 7: 5.161, 8: 0.7373, 9: 0.1053, 10: 0.01504}
OFFSET = 1 << 28
SHIFT = 29
NEIGHBOURS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
ROOT3 = math.sqrt(3.0)


def edge_m(level: int) -> float:
    return math.sqrt(2 * CELL_AREA_KM2[level] * 1e6 / (3 * ROOT3))


def pack(level: int | Column, q: Column, r: Column) -> Column:
    tag = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(tag.cast("bigint"), 2 * SHIFT) + F.shiftleft(q.cast("bigint") + OFFSET, SHIFT) + (
        r.cast("bigint") + OFFSET
    )


def level_of(cell: Column) -> Column:
    return F.shiftright(cell, 2 * SHIFT).cast("int")


def axial(cell: Column) -> tuple[Column, Column]:
    mask = (1 << SHIFT) - 1
    q = F.shiftright(cell, SHIFT).bitwiseAND(F.lit(mask)) - OFFSET
    return q, cell.bitwiseAND(F.lit(mask)) - OFFSET


def plane_to_cell(x: Column, y: Column, level: int) -> Column:
    """Cell of a projected point, by rounding cube coordinates."""
    s = edge_m(level)

    def nearest(f):
        ft = -f["q"] - f["r"]
        parts = F.struct(
            f["q"].alias("fq"), f["r"].alias("fr"), ft.alias("ft"),
            F.floor(f["q"] + 0.5).alias("q"), F.floor(f["r"] + 0.5).alias("r"),
            F.floor(ft + 0.5).alias("t"),
        )
        return let(parts, mended)

    def mended(p):
        dq, dr, dt = F.abs(p["q"] - p["fq"]), F.abs(p["r"] - p["fr"]), F.abs(p["t"] - p["ft"])
        worst_q = (dq > dr) & (dq > dt)
        q = F.when(worst_q, -p["r"] - p["t"]).otherwise(p["q"])
        r = F.when(worst_q, p["r"]).when(dr > dt, -p["q"] - p["t"]).otherwise(p["r"])
        return pack(level, q, r)

    fractions = F.struct(
        ((x * (ROOT3 / 3) - y / 3) / s).alias("q"), ((y * (2.0 / 3)) / s).alias("r")
    )
    return let(fractions, nearest)


def point_to_cell(lng: Column, lat: Column, level: int) -> Column:
    cell = let(project(lng, lat), lambda p: plane_to_cell(p["x"], p["y"], level))
    return F.when(lng.isNotNull() & lat.isNotNull(), cell)


def plane_center(cell: Column, level: int) -> Column:
    q, r = axial(cell)
    s = edge_m(level)
    return point(s * ROOT3 * (q + r / 2), s * 1.5 * r)


def center(cell: Column, level: int) -> Column:
    return let(plane_center(cell, level), lambda c: unproject(c["x"], c["y"]))


def plane_boundary(cell: Column, level: int) -> Column:
    """Closed counter-clockwise hexagon in metres."""
    s = edge_m(level)
    turns = [math.radians(60 * i - 30) for i in [0, 1, 2, 3, 4, 5, 0]]
    return let(
        plane_center(cell, level),
        lambda c: F.array(
            F.array(*[point(c["x"] + s * math.cos(t), c["y"] + s * math.sin(t)) for t in turns])
        ),
    )


def boundary(cell: Column, level: int) -> Column:
    """Closed hexagon in degrees."""
    return F.transform(
        plane_boundary(cell, level),
        lambda ring: F.transform(ring, lambda p: unproject(p["x"], p["y"])),
    )


def area_km2(level: int) -> float:
    return CELL_AREA_KM2[level]


def parent(cell: Column, level: int, coarser: int) -> Column:
    return let(plane_center(cell, level), lambda c: plane_to_cell(c["x"], c["y"], coarser))


def neighbours(cell: Column) -> Column:
    """Array of the six cells around a cell."""
    q, r = axial(cell)
    return F.array(*[pack(level_of(cell), q + dq, r + dr) for dq, dr in NEIGHBOURS])


def disk(cell: Column, k: int) -> Column:
    """Array of the cells within ``k`` steps, the cell itself included."""
    q, r = axial(cell)
    steps = [
        (dq, dr)
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    ]
    return F.array(*[pack(level_of(cell), q + dq, r + dr) for dq, dr in steps])


def box_cells(b: Column, level: int) -> Column:
    """Array of cells whose centres may fall in a projected box (one ring of margin)."""
    s = edge_m(level)
    r_low = F.floor(b["ymin"] / (1.5 * s)) - 1
    r_high = F.ceil(b["ymax"] / (1.5 * s)) + 1

    def row(r):
        q_low = F.floor(b["xmin"] / (s * ROOT3) - r / 2) - 1
        q_high = F.ceil(b["xmax"] / (s * ROOT3) - r / 2) + 1
        return F.transform(F.sequence(q_low, q_high), lambda q: pack(level, q, r))

    return F.flatten(F.transform(F.sequence(r_low, r_high), row))


# Cell level shown up to each map zoom, then the finest.
ZOOM_LEVELS = [(7, 6), (9, 7), (12, 8)]
FINEST_SHOWN = 9


def level_for_zoom(z: Column) -> Column:
    (first, level), *rest = ZOOM_LEVELS
    chain = F.when(z <= first, level)
    for last, shown in rest:
        chain = chain.when(z <= last, shown)
    return chain.otherwise(FINEST_SHOWN)
