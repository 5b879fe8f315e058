"""Shapes of many parts and outlines of adjoining polygons."""

import random

import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import cadastre, shapes


def ring(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


SCHEMA = "k string, rings array<array<struct<x: double, y: double>>>"


def signed(points):
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(points, points[1:])) / 2


def groups(cells, corners):
    """Number of groups of unit squares that meet along edges, and at corners too if wanted."""
    left, count = set(cells), 0
    while left:
        todo, count = [left.pop()], count + 1
        while todo:
            x, y = todo.pop()
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    near = (x + dx, y + dy)
                    if near in left and (corners or dx * dy == 0):
                        left.remove(near)
                        todo.append(near)
    return count


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_outlines_of_random_squares(spark, seed):
    draw = random.Random(seed)
    cells = {(x, y) for x in range(12) for y in range(12) if draw.random() < 0.6}
    df = spark.createDataFrame([("a", [ring(x, y, x + 1, y + 1)]) for x, y in cells] + [("none", [])], SCHEMA)
    found = [r.points for r in shapes.outlines(df, ["k"]).collect()]
    assert all(p[0] == p[-1] and len(p) >= 5 for p in found)
    assert sum(map(signed, found)) == len(cells)
    outside = {(x, y) for x in range(-1, 13) for y in range(-1, 13)} - cells
    assert sum(signed(p) > 0 for p in found) == groups(cells, corners=False)
    assert sum(signed(p) < 0 for p in found) == groups(outside, corners=True) - 1
    edges = {(p["x"], p["y"], q["x"], q["y"]) for points in found for p, q in zip(points, points[1:])}
    assert len(edges) == sum(len(p) - 1 for p in found)


def test_vertices_within_edges_and_long_rings(spark):
    # One wide rectangle under two narrow ones, a slanted border met halfway, and a comb of 500 teeth.
    wide = [("t", [ring(0, 0, 4, 1)]), ("t", [ring(0, 1, 1, 2)]), ("t", [ring(1, 1, 4, 2)])]
    slant = [
        ("s", [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0))]]),
        ("s", [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 2.0), (0.0, 4.0), (0.0, 0.0))]]),
        ("s", [[{"x": x, "y": y} for x, y in ((2.0, 2.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0))]]),
    ]
    comb = [("c", [ring(0, 0, 1000, 1)])] + [("c", [ring(2 * k, 1, 2 * k + 1, 2)]) for k in range(500)]
    rows = {r.k: r.rings for r in shapes.dissolve(spark.createDataFrame(wide + slant + comb, SCHEMA), ["k"]).collect()}
    assert {k: len(r) for k, r in rows.items()} == {"t": 1, "s": 1, "c": 1}
    assert {k: signed(r[0]) for k, r in rows.items()} == {"t": 8.0, "s": 16.0, "c": 1500.0}
    assert len(rows["c"][0]) > 2000


def test_empty_and_equal(spark):
    assert shapes.dissolve(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0
    twice = spark.createDataFrame([("a", [ring(0, 0, 1, 1)])] * 2, SCHEMA)
    assert [signed(r.points) for r in shapes.outlines(twice, ["k"]).collect()] == [1.0]


def test_large_code_takes_several_rows(spark):
    raw = [("05001" + "0" * 25, [ring(-75 + k * 0.01, 5, -75 + k * 0.01 + 0.005, 5.005), ring(-75 + k * 0.01 + 0.001, 5.001, -75 + k * 0.01 + 0.002, 5.002)]) for k in range(300)]
    raw += [("05002" + "0" * 25, [ring(-75, 5, -74.9, 5.1)])] * 2 + [("05003" + "0" * 25, []), ("05004" + "0" * 25, None)]
    df = spark.createDataFrame(raw, "codigo string, rings array<array<struct<x: double, y: double>>>").withColumns(
        {"codigo_anterior": F.lit(None).cast("string"), "numero_subterraneos": F.lit(1)})
    rows = {r.npn[:5]: r for r in cadastre.parcels(df, "01", "2024-01-01", most_points=400).collect()}
    assert set(rows) == {"05001", "05002"} and rows["05001"].parts == 300
    assert rows["05001"].rings is None and rows["05001"].shape_rows == 15
    assert len(rows["05002"].rings) == 2 and rows["05002"].shape_rows == 1
    parts = cadastre.parcel_parts(df)
    found = shapes.multipart(parts, ["npn"], most_points=400).where("npn like '05001%'")
    sizes = [r[0] for r in found.select(shapes.points_of(F.col("rings"))).collect()]
    assert sum(sizes) == 3000 and 10 <= len(sizes) <= 15 and max(sizes) <= 400
    area = found.agg(F.sum(geo.area(F.col("rings")))).collect()[0][0]
    assert abs(area - 300 * (0.005**2 - 0.001**2)) < 1e-9
    report = cadastre.parcel_load_report(df).collect()[0]
    assert (report.source_rows, report.no_geometry, report.parcels) == (304, 2, 2)
