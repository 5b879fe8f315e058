import math
import random

from landgrid.sources import readers

SCHEMA = "feature long, ring_no int, ring array<struct<x:double,y:double>>"


def circle(x, y, r, n, shell):
    turn = [2 * math.pi * k / n + 0.1 for k in range(n)]
    points = [(x + r * math.cos(a), y + r * math.sin(a)) for a in (turn[::-1] if shell else turn)]
    return [*points, points[0]]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def inside(ring, x, y):
    hits = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        hits += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hits % 2 == 1


def owners(rows):
    """Every hole against every shell of its feature."""
    out = {}
    for key, no, ring in rows:
        best = None
        if area(ring) > 0:
            for other, at, shell in rows:
                size = -area(shell)
                if other == key and size > area(ring) and inside(shell, *ring[0]) and (best is None or (size, at) < best):
                    best = (size, at)
        out[key, no] = (best[1], True) if best else (no, False)
    return out


def test_rings_of_random_features(spark):
    rng = random.Random(2)
    rows = []
    for key in (1, 2, None):
        for no in range(60):
            x, y, r = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.01, 1, 5, 40])
            rows.append((key, no, circle(x, y, r, rng.randrange(3, 9), rng.random() < 0.5)))
        rows.append((key, 100, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]))  # no area: left out
        rows += [(key, 101, circle(500, 500, 3, 4, True)), (key, 102, circle(500, 500, 3, 4, True)), (key, 103, circle(500, 500, 1, 4, False))]
    found = readers.group_rings(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("feature", "_id"), ["_id"]).collect()
    real = [r for r in rows if r[1] != 100]
    want = owners([r for r in real if r[0] is not None]) | {(None, r[1]): (r[1], False) for r in real if r[0] is None}
    assert {(r._id, r.ring_no): (r.shell_no, r.is_hole) for r in found} == want
    assert len(found) == len(real) and sum(v[1] for v in want.values()) > 10
    assert want[1, 103] == (101, True)


def test_a_feature_of_many_shells_and_holes(spark, monkeypatch):
    """A wide shell of many points around a grid of shells, each with a hole."""
    side = 50
    rows = [(1, 0, circle(side, side, 4 * side, 20_000, True))]
    for k in range(side * side):
        x, y = 2.0 * (k // side), 2.0 * (k % side)
        rows += [(1, 1 + 2 * k, circle(x, y, 0.9, 12, True)), (1, 2 + 2 * k, circle(x, y, 0.3, 5, False))]
    made = []
    whole = readers._ring_pairs
    monkeypatch.setattr(readers, "_ring_pairs", lambda slim, keys: made.append(whole(slim, keys)) or made[0])
    found = {r.ring_no: r.shell_no for r in readers.group_rings(spark.createDataFrame(rows, SCHEMA), ["feature"]).select("ring_no", "shell_no").collect()}
    assert found == {0: 0, **{1 + 2 * k: 1 + 2 * k for k in range(side * side)}, **{2 + 2 * k: 1 + 2 * k for k in range(side * side)}}
    assert made[0].count() == 2 * side * side


def test_no_rings(spark):
    assert readers.group_rings(spark.createDataFrame([], SCHEMA), ["feature"]).collect() == []
