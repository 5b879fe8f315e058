"""Plain Python versions of the spatial rules, for small fixtures."""

import math
import random

RADIUS = 6371008.8


def haversine(lng1, lat1, lng2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def clip_half(ring, a, b):
    """Part of an open ring to the left of the line from a to b."""
    def side(p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    out = []
    for p, q in zip(ring, ring[1:] + ring[:1]):
        sp, sq = side(p), side(q)
        if sp >= 0:
            out.append(p)
        if (sp < 0) != (sq < 0):
            t = sp / (sp - sq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def shoelace(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def convex_overlap(subject, clip):
    """Common area of an open ring and a convex counter-clockwise open ring."""
    ring = subject
    for a, b in zip(clip, clip[1:] + clip[:1]):
        ring = clip_half(ring, a, b)
        if len(ring) < 3:
            return 0.0
    return abs(shoelace(ring))


def inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def regular(cx, cy, r, n, turn=0.0):
    return [(cx + r * math.cos(turn + 2 * math.pi * k / n), cy + r * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]


def star(rng, cx, cy, r, n):
    """A simple, usually concave ring."""
    return [
        (cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n))
        for k, d in enumerate(r * rng.uniform(0.3, 1.0) for _ in range(n))
    ]


def rings(*open_rings):
    """Spark value of a polygon from open rings."""
    return [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in open_rings]


def seeded(n=7):
    return random.Random(n)
