import math
import random

from landgrid.operators import tiles

SCHEMA = "npn long, muni_code string, rings array<array<struct<x:double,y:double>>>"


def star(x, y, r, n, rng, turn=1):
    points = []
    for k in range(n):
        far, a = r * rng.uniform(0.3, 1), turn * 2 * math.pi * k / n
        points.append((x + far * math.cos(a), y + far * math.sin(a)))
    return [*points, points[0]]


def spot(x, y, z):
    n, phi = 2**z, math.radians(y)
    return math.floor((x + 180) / 360 * n), math.floor((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)


def tile(z, x, y):
    n = 2**z
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def meets(p, q, b):
    """Part of an edge lies in a box."""
    low, high = 0.0, 1.0
    for start, move, least, most in ((p[0], q[0] - p[0], b[0], b[2]), (p[1], q[1] - p[1], b[1], b[3])):
        if move == 0:
            if not least <= start <= most:
                return False
            continue
        one, two = sorted(((least - start) / move, (most - start) / move))
        low, high = max(low, one), min(high, two)
    return low <= high


def touched(rings, z):
    """Every tile of the box against every edge, then against the inside."""
    points = [p for r in rings for p in r]
    (x0, y1), (x1, y0) = spot(min(p[0] for p in points), min(p[1] for p in points), z), spot(max(p[0] for p in points), max(p[1] for p in points), z)
    edges = [e for r in rings for e in zip(r, r[1:] or r, strict=False)]
    out = set()
    for x in range(x0, x1 + 1):
        for y in range(y0, y1 + 1):
            b = tile(z, x, y)
            cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            odd = sum((p[1] > cy) != (q[1] > cy) and cx < (q[0] - p[0]) * (cy - p[1]) / (q[1] - p[1]) + p[0] for p, q in edges) % 2
            if odd or any(meets(p, q, b) for p, q in edges):
                out.add((x, y))
    return out


def test_shapes_are_in_the_tiles_they_touch(spark):
    rng = random.Random(6)
    shapes = {k: [star(rng.uniform(-77, -70), rng.uniform(-4, 12), rng.choice([0.001, 0.03, 0.2]), rng.randrange(3, 12), rng)] for k in range(20)}
    ring = star(-74, 5, 0.5, 40, random.Random(1))
    shapes[100] = [ring, [(-74 + (x + 74) * 0.7, 5 + (y - 5) * 0.7) for x, y in ring][::-1]]  # a band around a hole
    shapes[101] = [star(-75, 4, 0.1, 6, rng), star(-74.5, 4.01, 0.1, 6, rng)]  # two parts in the same rows
    shapes[102] = [[(-75.3, 3.1), (-75.0, 3.3), (-75.3, 3.1)]]  # no area: a slanting line there and back
    shapes[103] = [[(-75.3, 3.1)]]
    rows = [(k, "05001", v) for k, v in shapes.items()] + [(100, "05001", shapes[100]), (7, None, None), (8, "x", [])]
    found = tiles.assign_tiles(spark.createDataFrame(rows, SCHEMA), "parcel", "npn", "rings", [3, 14]).collect()
    want = sorted((k, "05001", 14, *t) for k, v in [*shapes.items(), (100, shapes[100])] for t in touched(v, 14))
    assert sorted((r.npn, r.muni_code, r.z, r.x, r.y) for r in found) == want
    box = lambda side: max(t[side] for t in touched(shapes[102], 14)) - min(t[side] for t in touched(shapes[102], 14)) + 1
    assert sum(w[0] == 102 for w in want) < box(0) * box(1) / 3


def test_inner_tiles_come_as_runs(spark):
    """Rows of a wide square grow with its outline, not with its tiles."""
    square = [[(-76.0, 2.0), (-72.0, 2.0), (-72.0, 6.0), (-76.0, 6.0), (-76.0, 2.0)]]
    df = spark.createDataFrame([(1, 15, square)], "id long, z int, rings array<array<struct<x:double,y:double>>>")
    runs = tiles.covering_runs(df, "id", "rings").collect()
    (x0, y1), (x1, y0) = spot(-76, 2, 15), spot(-72, 6, 15)
    assert sum(r.high - r.low + 1 for r in runs) == (x1 - x0 + 1) * (y1 - y0 + 1)
    assert len(runs) <= 3 * (y1 - y0 + 1)


def test_zooms_before_the_first(spark):
    assert tiles.assign_tiles(spark.createDataFrame([(1, "a", [[(-75.3, 3.1)]])], SCHEMA), "parcel", "npn", "rings", [2]).collect() == []
