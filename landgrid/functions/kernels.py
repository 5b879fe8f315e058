"""Polygon kernels that need more than Column expressions, over Arrow batches.

Each function works on the rows of one batch; Spark decides which rows those
are. Polygons follow the convention of ``functions.geo``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

PAIR_BUDGET = 2_000_000
REST = 1e-11


def _edges(polygons: pa.Array):
    """Edge arrays ``row, x1, y1, x2, y2`` of all rings of a column of polygons."""
    rows = polygons.flatten()
    row_of_ring = np.asarray(polygons.value_parent_indices())
    points = rows.flatten()
    ring_of_point = np.asarray(rows.value_parent_indices())
    x, y = (c.to_numpy(zero_copy_only=False) for c in points.flatten())
    same = ring_of_point[1:] == ring_of_point[:-1]
    row = row_of_ring[ring_of_point[:-1][same]] if len(x) else np.empty(0, int)
    return row, x[:-1][same], y[:-1][same], x[1:][same], y[1:][same]


def _starts(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _below_both(a, b, i, j, y0) -> np.ndarray:
    """Signed area below both edges of every pair ``(i, j)``."""
    ax1, ay1, ax2, ay2 = (v[i] for v in a)
    bx1, by1, bx2, by2 = (v[j] for v in b)
    lo = np.maximum(np.minimum(ax1, ax2), np.minimum(bx1, bx2))
    hi = np.minimum(np.maximum(ax1, ax2), np.maximum(bx1, bx2))
    slope_a, slope_b = (ay2 - ay1) / (ax2 - ax1), (by2 - by1) / (bx2 - bx1)
    fa_lo = ay1 - y0 + slope_a * (lo - ax1)
    fa_hi = ay1 - y0 + slope_a * (hi - ax1)
    fb_lo = by1 - y0 + slope_b * (lo - bx1)
    fb_hi = by1 - y0 + slope_b * (hi - bx1)
    d_lo, d_hi = fa_lo - fb_lo, fa_hi - fb_hi
    size = np.abs(d_lo) + np.abs(d_hi)
    crossing = d_lo * d_hi < 0
    gap = np.where(crossing, (d_lo**2 + d_hi**2) / np.where(size > 0, 2 * size, 1.0), size / 2)
    under = (hi - lo) * ((fa_lo + fa_hi + fb_lo + fb_hi) / 4 - gap / 2)
    return np.where(hi > lo, np.sign(ax1 - ax2) * np.sign(bx1 - bx2) * under, 0.0)


def _row_extreme(values: np.ndarray, starts: np.ndarray, best) -> np.ndarray:
    """Smallest or largest value per row; zero for rows without edges."""
    out = np.zeros(len(starts) - 1)
    filled = starts[1:] > starts[:-1]
    if filled.any():
        out[filled] = best.reduceat(values, starts[:-1][filled])
    return out


def _meetings(left, right, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right edge of one row whose x ranges meet, each once, in blocks.

    A side is (row, lowest x, highest x) of its edges. The range that both sides of a row
    cover is cut into strips about as wide as its mean edge, so an edge lies in few strips,
    and edges meet where they share one: the pairs follow the edges and what they cross, not
    the product of the two shapes. A pair counts in the strip where its common part begins.
    """
    sides = (left, right)
    starts = [_starts(row, n) for row, _, _ in sides]
    low = np.maximum(*[_row_extreme(lo, at, np.minimum) for (_, lo, _), at in zip(sides, starts, strict=True)])
    high = np.minimum(*[_row_extreme(hi, at, np.maximum) for (_, _, hi), at in zip(sides, starts, strict=True)])
    kept = [np.flatnonzero((hi >= low[row]) & (lo <= high[row])) for row, lo, hi in sides]
    many = sum(np.bincount(row[k], minlength=n) for (row, _, _), k in zip(sides, kept, strict=True))
    extent = sum(
        np.bincount(row[k], np.minimum(hi[k], high[row[k]]) - np.maximum(lo[k], low[row[k]]), minlength=n)
        for (row, lo, hi), k in zip(sides, kept, strict=True)
    )
    span = np.maximum(high - low, 0.0)
    strips = np.where(extent > 0, span * many / np.where(extent > 0, extent, 1.0), 1.0)
    strips = np.clip(np.floor(np.minimum(strips, many / 8)), 1, None).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(strips)])
    scale = np.where(span > 0, strips / np.where(span > 0, span, 1.0), 0.0)

    def strip(row: np.ndarray, x: np.ndarray) -> np.ndarray:
        return base[row] + np.clip((x - low[row]) * scale[row], 0, strips[row] - 1).astype(np.int64)

    spread = []
    for (row, lo, hi), k in zip(sides, kept, strict=True):
        first, last = strip(row[k], lo[k]), strip(row[k], hi[k])
        count = last - first + 1
        edge = np.repeat(k, count)
        key = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(edge))
        order = np.argsort(key, kind="stable")
        spread.append((key[order], edge[order]))
    (key, edge), (other_key, other) = spread
    begin = np.searchsorted(other_key, key)
    ends = np.concatenate([[0], np.cumsum(np.searchsorted(other_key, key, side="right") - begin)])
    for start in range(0, int(ends[-1]), PAIR_BUDGET):
        place = np.arange(start, min(start + PAIR_BUDGET, int(ends[-1])))
        at = np.searchsorted(ends, place, side="right") - 1
        i, j = edge[at], other[begin[at] + place - ends[at]]
        common = np.maximum(left[1][i], right[1][j])
        meets = (common <= np.minimum(left[2][i], right[2][j])) & (strip(left[0][i], common) == key[at])
        yield i[meets], j[meets]


def shared_areas(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Plane area common to the two polygons of every row.

    The area of a polygon is the signed sum of the strips below its edges, so
    the common area of two is the signed sum, over pairs of edges, of what lies
    below both. That holds for holes, many parts and concave shapes alike.
    """
    n = len(left)
    sides, ranges = [], []
    for column in (left, right):
        row, *xy = _edges(column)
        slanted = xy[0] != xy[2]
        row, xy = row[slanted], [v[slanted] for v in xy]
        sides.append((xy, _starts(row, n)))
        ranges.append((row, np.minimum(xy[0], xy[2]), np.maximum(xy[0], xy[2])))
    (a, sa), (b, sb) = sides
    floor = np.minimum(_row_extreme(a[1], sa, np.minimum), _row_extreme(b[1], sb, np.minimum))
    spread = np.minimum(
        *[
            (_row_extreme(e[0], s, np.maximum) - _row_extreme(e[0], s, np.minimum))
            * (_row_extreme(e[1], s, np.maximum) - _row_extreme(e[1], s, np.minimum))
            for e, s in sides
        ]
    )
    out = np.zeros(n)
    for i, j in _meetings(*ranges, n):
        row = ranges[0][0][i]
        out += np.bincount(row, _below_both(a, b, i, j, floor[row]), minlength=n)
    # Polygons that only touch leave a rounding rest of the summed strips.
    out[out < REST * spread] = 0.0
    return out


@F.arrow_udf(T.DoubleType())
def overlap_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Plane area common to two polygons; NULL when either is NULL."""
    missing = np.asarray(left.is_null()) | np.asarray(right.is_null())
    return pa.array(shared_areas(left, right), mask=missing)


def border_pairs(boxes: np.ndarray, polygons: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether an edge of the polygon comes into the box, and whether the box's corner is inside.

    Without such an edge the whole box is on the corner's side. Boxes are xmin, ymin, xmax, ymax.
    """
    n = len(polygons)
    row, x1, y1, x2, y2 = _edges(polygons)
    xmin, ymin, xmax, ymax = (boxes[row, k] for k in range(4))
    enters = (np.minimum(x1, x2) <= xmax) & (np.maximum(x1, x2) >= xmin) & (np.minimum(y1, y2) <= ymax) & (np.maximum(y1, y2) >= ymin)
    border = np.bincount(row[enters], minlength=n) > 0
    above = ((y1 > ymin) != (y2 > ymin)) & ~border[row]
    k = np.flatnonzero(above)
    right = xmin[k] < x1[k] + (ymin[k] - y1[k]) / (y2[k] - y1[k]) * (x2[k] - x1[k])
    return border, np.bincount(row[k[right]], minlength=n) % 2 == 1


@F.arrow_udf(T.DoubleType())
def settled_area(left: pa.Array, left_area: pa.Array, left_box: pa.Array, right: pa.Array) -> pa.Array:
    """Common area of two polygons: the left one's own where it lies inside, and intersected only at a border."""
    boxes = np.stack([side.to_numpy(zero_copy_only=False) for side in left_box.flatten()], axis=1)
    border, inside = border_pairs(boxes, right)
    out = np.where(inside, left_area.to_numpy(zero_copy_only=False), 0.0)
    some = np.flatnonzero(border)
    if len(some):
        out[some] = shared_areas(left.take(pa.array(some)), right.take(pa.array(some)))
    return pa.array(out)


def crossing_rows(row: np.ndarray, x1, y1, x2, y2, n: int) -> np.ndarray:
    """For each of ``n`` rows whether two of its edges cross each other inside."""

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    edges = row, np.minimum(x1, x2), np.maximum(x1, x2)
    found = np.zeros(n, bool)
    for p, q in _meetings(edges, edges, n):
        some = (p < q) & ~found[row[p]]
        p, q = p[some], q[some]
        near = (np.minimum(y1[p], y2[p]) <= np.maximum(y1[q], y2[q])) & (np.minimum(y1[q], y2[q]) <= np.maximum(y1[p], y2[p]))
        p, q = p[near], q[near]
        a = side(x1[p], y1[p], x2[p], y2[p], x1[q], y1[q]) * side(x1[p], y1[p], x2[p], y2[p], x2[q], y2[q])
        b = side(x1[q], y1[q], x2[q], y2[q], x1[p], y1[p]) * side(x1[q], y1[q], x2[q], y2[q], x2[p], y2[p])
        found[row[p[(a < 0) & (b < 0)]]] = True
    return found


@F.arrow_udf(T.BooleanType())
def self_crossing(polygons: pa.Array) -> pa.Array:
    """TRUE when any two edges of a polygon cross; NULL for NULL."""
    found = crossing_rows(*_edges(polygons), len(polygons))
    return pa.array(found, pa.bool_(), mask=np.asarray(polygons.is_null()))


def _clip_half(ring: np.ndarray, axis: int, at: float, keep_low: bool) -> np.ndarray:
    """Part of a closed ring on one side of an axis-parallel line."""
    sign = 1.0 if keep_low else -1.0
    depth = sign * (at - ring[:, axis])
    here, there = ring[:-1], ring[1:]
    d1, d2 = depth[:-1], depth[1:]
    cut = (d1 < 0) != (d2 < 0)
    t = np.divide(d1, d1 - d2, out=np.zeros_like(d1), where=cut)
    crossing = here + t[:, None] * (there - here)
    crossing[:, axis] = np.where(cut, at, crossing[:, axis])
    order = np.concatenate([np.arange(len(here)) * 2, np.nonzero(cut)[0] * 2 + 1])
    points = np.concatenate([here, crossing[cut]])
    kept = np.concatenate([d1 >= 0, np.ones(int(cut.sum()), bool)])
    ring_out = points[np.argsort(order, kind="stable")][kept[np.argsort(order, kind="stable")]]
    if len(ring_out) < 3:
        return np.empty((0, 2))
    return np.vstack([ring_out, ring_out[:1]])


def halve(rings: list[np.ndarray], limit: int) -> Iterator[list[np.ndarray]]:
    """Cut a polygon along its longer side until no piece has more than ``limit`` points.

    A cut in the middle that leaves all points on one side is tried at the median, then along
    the other side. A piece that no cut makes smaller, which only more than ``limit`` points in
    one place can be, is an error.
    """
    waiting = [rings]
    while waiting:
        piece = waiting.pop()
        total = sum(len(r) for r in piece)
        if total <= limit:
            yield piece
            continue
        points = np.concatenate(piece)
        low, high = points.min(axis=0), points.max(axis=0)
        longer = int(np.argmax(high - low))
        for axis, at in [
            (axis, at) for axis in (longer, 1 - longer)
            for at in ((low[axis] + high[axis]) / 2, float(np.median(points[:, axis])))
        ]:
            halves = [
                [c for c in (_clip_half(r, axis, at, keep_low) for r in piece) if len(c)] for keep_low in (True, False)
            ]
            if all(sum(len(r) for r in half) < total for half in halves):
                waiting += [half for half in halves if half]
                break
        else:
            raise ValueError(f"{total} points of a shape cannot be cut apart")


def hull(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise convex hull by sorting and two chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return np.vstack([points, points[:1]])

    def chain(ordered):
        kept: list[np.ndarray] = []
        for p in ordered:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], p - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(points), chain(points[::-1])
    return np.array(lower[:-1] + upper[:-1] + lower[:1])


def hull_batches(keys: list[str], most_points: int = 500_000):
    """Hull points of each group over all batches of a task.

    What is kept is handed on early when many groups together pass
    ``most_points``, which bounds the memory of a task.
    """
    def frame(key, ring: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"x": ring[:, 0], "y": ring[:, 1]})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "x", "y"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, np.ndarray] = {}
        size = 0
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                points = group[["x", "y"]].to_numpy()
                old = kept.get(key)
                if old is not None:
                    points = np.vstack([old, points])
                    size -= len(old)
                kept[key] = hull(points)[:-1]
                size += len(kept[key])
            if size > most_points:
                yield pd.concat([frame(k, r) for k, r in kept.items()], ignore_index=True)
                kept, size = {}, 0
        if kept:
            yield pd.concat([frame(k, r) for k, r in kept.items()], ignore_index=True)
    return run
