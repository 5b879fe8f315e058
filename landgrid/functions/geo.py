"""Distances, projection, rings, boxes and map tiles as Column expressions.

A polygon is ``ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>``: closed rings, shells
counter-clockwise and holes clockwise, so signed ring areas simply add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"
POLYGON_TYPE = f"array<{RING_TYPE}>"

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

# The national measure projection (transverse Mercator on GRS80).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
ORIGIN_LAT = 4.0
ORIGIN_LNG = -73.0
SCALE = 0.9992
FALSE_EASTING = 5_000_000.0
FALSE_NORTHING = 2_000_000.0

# National envelopes (xmin, ymin, xmax, ymax) of the different checks.
ENVELOPE = (-81.85, -4.3, -66.8, 13.6)
ENVELOPE_CADASTRE = (-82.0, -4.5, -66.5, 13.6)
ENVELOPE_SEA = (-85.0, -4.5, -66.5, 16.0)

E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
M_COEF = (
    1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
    3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024,
    15 * E2**2 / 256 + 45 * E2**3 / 1024,
    35 * E2**3 / 3072,
)


def meridian_arc(lat_rad: float) -> float:
    m0, m2, m4, m6 = M_COEF
    return SEMI_MAJOR * (
        m0 * lat_rad
        - m2 * math.sin(2 * lat_rad)
        + m4 * math.sin(4 * lat_rad)
        - m6 * math.sin(6 * lat_rad)
    )


ORIGIN_ARC = meridian_arc(math.radians(ORIGIN_LAT))


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres on the mean sphere."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    metres = 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    # least() skips NULL, so unknown places are left out here.
    known = lng1.isNotNull() & lat1.isNotNull() & lng2.isNotNull() & lat2.isNotNull()
    return F.when(known, metres)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Long formulas that use a step several times would otherwise repeat that
    step's whole expression in the plan.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def project(lng: Column, lat: Column) -> Column:
    """Struct ``x, y`` in metres of the measure projection."""
    m0, m2, m4, m6 = M_COEF

    def plane(s):
        phi, a, t, c, n = s["phi"], s["a"], s["t"], s["c"], s["n"]
        arc = SEMI_MAJOR * (
            m0 * phi - m2 * F.sin(2 * phi) + m4 * F.sin(4 * phi) - m6 * F.sin(6 * phi)
        )
        x = FALSE_EASTING + SCALE * n * (
            a
            + (1 - t + c) * F.pow(a, 3) / 6
            + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120
        )
        y = FALSE_NORTHING + SCALE * (
            arc
            - ORIGIN_ARC
            + n * F.tan(phi) * (
                a * a / 2
                + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
                + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720
            )
        )
        return F.struct(x.alias("x"), y.alias("y"))

    phi = F.radians(lat)
    steps = F.struct(
        phi.alias("phi"),
        (F.radians(lng - ORIGIN_LNG) * F.cos(phi)).alias("a"),
        F.pow(F.tan(phi), 2).alias("t"),
        (EP2 * F.pow(F.cos(phi), 2)).alias("c"),
        (SEMI_MAJOR / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))).alias("n"),
    )
    return let(steps, plane)


def unproject(x: Column, y: Column) -> Column:
    """Struct ``x, y`` in degrees for a point of the measure projection."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))

    def footpoint(m):
        mu = m["mu"]
        phi = (
            mu
            + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
            + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
            + (151 * e1**3 / 96) * F.sin(6 * mu)
        )
        return let(F.struct(phi.alias("phi"), m["x"].alias("x")), radii)

    def radii(f):
        phi = f["phi"]
        w = 1 - E2 * F.pow(F.sin(phi), 2)
        steps = F.struct(
            phi.alias("phi"),
            (EP2 * F.pow(F.cos(phi), 2)).alias("c"),
            F.pow(F.tan(phi), 2).alias("t"),
            (SEMI_MAJOR / F.sqrt(w) * F.tan(phi) / (SEMI_MAJOR * (1 - E2) / F.pow(w, 1.5))).alias("k"),
            ((f["x"] - FALSE_EASTING) / (SEMI_MAJOR / F.sqrt(w) * SCALE)).alias("d"),
        )
        return let(steps, degrees)

    def degrees(s):
        phi, c, t, d = s["phi"], s["c"], s["t"], s["d"]
        lat = phi - s["k"] * (
            d * d / 2
            - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720
        )
        lng = (
            d
            - (1 + 2 * t + c) * F.pow(d, 3) / 6
            + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120
        ) / F.cos(phi)
        return F.struct((ORIGIN_LNG + F.degrees(lng)).alias("x"), F.degrees(lat).alias("y"))

    mu = (ORIGIN_ARC + (y - FALSE_NORTHING) / SCALE) / (SEMI_MAJOR * M_COEF[0])
    return let(F.struct(mu.alias("mu"), x.alias("x")), footpoint)


def project_rings(polygon: Column) -> Column:
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: project(p["x"], p["y"])))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Polygon of a box, counter-clockwise and closed."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(F.array(*[point(x, y) for x, y in corners]))


def is_rectangle(polygon: Column) -> Column:
    """TRUE for one closed ring along the axes with four corners, counter-clockwise; such a polygon is its box."""
    p = [F.get(F.get(polygon, F.lit(0)), F.lit(k)) for k in range(5)]
    x, y = [q["x"] for q in p], [q["y"] for q in p]
    level = (y[0] == y[1]) & (x[1] == x[2]) & (y[2] == y[3]) & (x[3] == x[0])
    upright = (x[0] == x[1]) & (y[1] == y[2]) & (x[2] == x[3]) & (y[3] == y[0])
    turn = (x[1] - x[0]) * (y[2] - y[1]) - (y[1] - y[0]) * (x[2] - x[1])
    closed = (x[4] == x[0]) & (y[4] == y[0])
    # NaN is above every number here, and no area.
    shaped = (F.size(polygon) == 1) & (F.size(F.get(polygon, F.lit(0))) == 5) & (turn > 0) & (turn < float("inf"))
    return F.coalesce(shaped & closed & (level | upright), F.lit(False))


def shared_box_area(a, b, rest: float) -> Column:
    """Area common to two boxes, columns by the names of their sides; nothing below ``rest`` of the smaller one, which rounding leaves of boxes that touch."""
    over = lambda axis: F.least(a[f"{axis}max"], b[f"{axis}max"]) - F.greatest(a[f"{axis}min"], b[f"{axis}min"])
    size = lambda c: (c["xmax"] - c["xmin"]) * (c["ymax"] - c["ymin"])
    common = F.greatest(over("x"), F.lit(0.0)) * F.greatest(over("y"), F.lit(0.0))
    return F.when(common >= rest * F.least(size(a), size(b)), common).otherwise(0.0)


def _edges(ring: Column, value) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), value)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_signed_area(ring: Column) -> Column:
    """Positive for counter-clockwise rings; shifted to the first point to keep digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = _edges(
        ring,
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return _total(cross) / 2


def area(polygon: Column) -> Column:
    """Plane area of normalised rings."""
    return _total(F.transform(polygon, ring_signed_area))


def area_m2(polygon: Column) -> Column:
    """Square metres in the measure projection, two decimals."""
    return F.round(area(project_rings(polygon)), 2)


def box(polygon: Column) -> Column:
    """Struct ``xmin, ymin, xmax, ymax``; NULL for an empty polygon."""
    points = F.flatten(polygon)
    xs, ys = points.getField("x"), points.getField("y")
    corners = F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )
    return F.when(F.size(points) > 0, corners)


def boxes_touch(a: Column, b: Column) -> Column:
    return (
        (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    )


def clamp_box(b: Column, envelope=ENVELOPE) -> Column:
    """Intersection of a box with the envelope; NULL when they do not meet."""
    xmin, ymin, xmax, ymax = [F.lit(float(v)) for v in envelope]
    meets = (b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin)
    cut = F.struct(
        F.greatest(b["xmin"], xmin).alias("xmin"),
        F.greatest(b["ymin"], ymin).alias("ymin"),
        F.least(b["xmax"], xmax).alias("xmax"),
        F.least(b["ymax"], ymax).alias("ymax"),
    )
    return F.when(meets, cut)


def in_envelope(lng: Column, lat: Column, envelope=ENVELOPE) -> Column:
    xmin, ymin, xmax, ymax = [float(v) for v in envelope]
    return lng.between(xmin, xmax) & lat.between(ymin, ymax)


def contains_point(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings; points on a lower or left edge count as inside."""
    def crossings(ring):
        hits = _edges(
            ring,
            lambda p, q: F.when(
                ((p["y"] > y) != (q["y"] > y))
                & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]),
                F.lit(1),
            ).otherwise(F.lit(0)),
        )
        return F.aggregate(hits, F.lit(0), lambda acc, v: acc + v)

    count = F.aggregate(F.transform(polygon, crossings), F.lit(0), lambda acc, v: acc + v)
    return (count % 2) == 1


def centroid(polygon: Column) -> Column:
    """Area centroid; mean of the points when the area is zero."""
    x0, y0 = polygon[0][0]["x"], polygon[0][0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def moments(ring):
        return _edges(
            ring,
            lambda p, q: F.struct(
                ((p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)).alias("a"),
                (p["x"] + q["x"] - 2 * x0).alias("x"),
                (p["y"] + q["y"] - 2 * y0).alias("y"),
            ),
        )

    total = F.aggregate(
        F.flatten(F.transform(polygon, moments)),
        zero,
        lambda acc, t: F.struct(
            (acc["a"] + t["a"]).alias("a"),
            (acc["x"] + t["a"] * t["x"]).alias("x"),
            (acc["y"] + t["a"] * t["y"]).alias("y"),
        ),
    )
    n = F.size(F.flatten(polygon))
    mean = point(
        _total(F.transform(F.flatten(polygon), lambda p: p["x"])) / n,
        _total(F.transform(F.flatten(polygon), lambda p: p["y"])) / n,
    )
    by_area = let(
        total,
        lambda t: F.when(t["a"] != 0, point(x0 + t["x"] / (3 * t["a"]), y0 + t["y"] / (3 * t["a"]))),
    )
    return F.when(n > 0, F.coalesce(by_area, mean))


def widest_point(polygon: Column) -> Column:
    """Middle of the widest inner span at half the height of a polygon."""
    ys = F.flatten(polygon).getField("y")
    height = (F.array_min(ys) + F.array_max(ys)) / 2

    def span_at(y):
        def crossings(ring):
            return _edges(
                ring,
                lambda p, q: F.when(
                    (p["y"] > y) != (q["y"] > y),
                    (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"],
                ),
            )

        xs = F.array_sort(F.array_compact(F.flatten(F.transform(polygon, crossings))))
        return let(F.struct(xs.alias("xs"), y.alias("y")), widest)

    def widest(s):
        pairs = F.sequence(F.lit(0), F.floor(F.size(s["xs"]) / 2).cast("int") - 1)
        spans = F.transform(
            pairs,
            lambda i: F.struct(
                (F.get(s["xs"], i * 2 + 1) - F.get(s["xs"], i * 2)).alias("width"),
                ((F.get(s["xs"], i * 2) + F.get(s["xs"], i * 2 + 1)) / 2).alias("x"),
            ),
        )
        return F.when(F.size(s["xs"]) >= 2, point(F.array_max(spans)["x"], s["y"]))

    return let(height, span_at)


def point_on_surface(polygon: Column) -> Column:
    """A point inside the polygon: its centroid, or the widest point where that lies outside."""
    return let(
        centroid(polygon),
        lambda c: F.when(contains_point(polygon, c["x"], c["y"]), c).otherwise(
            F.coalesce(widest_point(polygon), c)
        ),
    )


def clean_polygon(polygon: Column) -> Column:
    """Close rings, drop those without area, shells counter-clockwise and holes clockwise.

    A ring inside an even number of other rings is a shell, inside an odd number a hole, so
    shapes of many parts keep all their surface; NULL when no surface is left.
    """
    def closed(ring):
        last = F.element_at(ring, -1)
        open_ring = (ring[0]["x"] != last["x"]) | (ring[0]["y"] != last["y"])
        return F.when(open_ring, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)

    filled = F.filter(polygon, lambda r: F.size(r) >= 3)
    rings = F.filter(
        F.transform(filled, closed), lambda r: (F.size(r) >= 4) & (ring_signed_area(r) != 0)
    )

    def turned(all_rings):
        def one(r):
            shell = F.size(F.filter(all_rings, lambda other: _ring_within(r, other))) % 2 == 0
            return F.when((ring_signed_area(r) > 0) == shell, r).otherwise(F.reverse(r))

        return F.transform(all_rings, one)

    return let(rings, lambda found: F.when(F.size(found) > 0, turned(found)))


def _ring_within(ring: Column, other: Column) -> Column:
    """TRUE when a ring lies inside a larger one that it does not cross."""
    larger = F.abs(ring_signed_area(other)) > F.abs(ring_signed_area(ring))
    inner = let(point_on_surface(F.array(ring)), lambda p: contains_point(F.array(other), p["x"], p["y"]))
    return larger & inner


def parts(polygon: Column) -> Column:
    """The parts of a clean polygon, each its shell and then the shell's holes."""
    shells = F.filter(polygon, lambda r: ring_signed_area(r) > 0)
    holes = F.filter(polygon, lambda r: ring_signed_area(r) < 0)

    def owner(hole, found):
        around = F.filter(found, lambda s: _ring_within(hole, s))
        sizes = F.transform(around, lambda s: F.struct(ring_signed_area(s).alias("size"), s.alias("ring")))
        return F.array_min(sizes)["ring"]

    def put_together(found):
        placed = F.transform(holes, lambda h: F.struct(owner(h, found).alias("shell"), h.alias("hole")))
        return let(placed, lambda rows: F.transform(found, lambda s: F.concat(
            F.array(s), F.transform(F.filter(rows, lambda r: r["shell"] == s), lambda r: r["hole"]))))

    return let(shells, put_together)


def segments(line: Column) -> Column:
    """Array of ``x1, y1, x2, y2`` structs of a line's points."""
    return _edges(
        line,
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def metres_per_degree_lng(y: Column) -> Column:
    return METRES_PER_DEGREE * F.cos(F.radians(y))


def point_segment_m(x: Column, y: Column, seg: Column, kx: Column | None = None) -> Column:
    """Metres from a point to a segment on the plane tangent at the point.

    Plain arithmetic, so it is compiled with the join it is used in. ``kx``, if the
    caller has it, is ``metres_per_degree_lng`` of the point.
    """
    kx, ky = metres_per_degree_lng(y) if kx is None else kx, METRES_PER_DEGREE
    ax, ay = (seg["x1"] - x) * kx, (seg["y1"] - y) * ky
    dx, dy = (seg["x2"] - seg["x1"]) * kx, (seg["y2"] - seg["y1"]) * ky
    length2, along = dx * dx + dy * dy, -(ax * dx + ay * dy)
    t = F.when(length2 > 0, F.least(F.greatest(along / length2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def line_length_m(line: Column) -> Column:
    return _total(_edges(line, lambda p, q: haversine_m(p["x"], p["y"], q["x"], q["y"])))


def line_midpoint(line: Column) -> Column:
    """Point at half of the plane length of a line."""
    lengths = _edges(
        line, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
    )
    half = _total(lengths) / 2
    start = F.struct(
        F.lit(0.0).alias("run"), line[0]["x"].alias("x"), line[0]["y"].alias("y"),
        F.lit(False).alias("done"),
    )
    legs = F.zip_with(segments(line), lengths, lambda s, d: F.struct(s.alias("s"), d.alias("d")))

    def step(acc, leg):
        s, d = leg["s"], leg["d"]
        reached = (acc["run"] + d >= half) & (d > 0)
        k = (half - acc["run"]) / F.when(d > 0, d).otherwise(F.lit(1.0))
        return F.struct(
            (acc["run"] + d).alias("run"),
            F.when(acc["done"], acc["x"]).when(reached, s["x1"] + k * (s["x2"] - s["x1"])).otherwise(acc["x"]).alias("x"),
            F.when(acc["done"], acc["y"]).when(reached, s["y1"] + k * (s["y2"] - s["y1"])).otherwise(acc["y"]).alias("y"),
            (acc["done"] | reached).alias("done"),
        )

    end = F.aggregate(legs, start, step, lambda acc: point(acc["x"], acc["y"]))
    return F.when(F.size(line) > 0, end)


def radius_polygon(lng: Column, lat: Column, radius_m: Column, steps: int = 64) -> Column:
    """Closed circle of ``steps`` points at a great-circle distance."""
    delta = radius_m / EARTH_RADIUS_M
    phi = F.radians(lat)

    # Of literals only, so Spark folds it; the last point is the first again.
    bearings = [F.lit(-(i % steps)) * F.lit(2 * math.pi / steps) for i in range(steps + 1)]
    turns = F.array(*[F.struct(F.sin(b).alias("sin"), F.cos(b).alias("cos")) for b in bearings])
    known = F.struct(
        F.sin(phi).alias("sin_phi"), F.cos(phi).alias("cos_phi"), F.sin(delta).alias("sin_delta"), F.cos(delta).alias("cos_delta"),
        lng.alias("lng"),
    )

    def ring(k):
        def vertex(turn):
            lat2 = F.asin(k["sin_phi"] * k["cos_delta"] + k["cos_phi"] * k["sin_delta"] * turn["cos"])
            dlng = F.atan2(turn["sin"] * k["sin_delta"] * k["cos_phi"], k["cos_delta"] - k["sin_phi"] * F.sin(lat2))
            return point(k["lng"] + F.degrees(dlng), F.degrees(lat2))

        return F.transform(turns, vertex)

    return F.array(let(known, ring))


# Speeds of the circle that stands for a travel-time area.
TRAVEL_KMH = {"walk": 4.5, "drive": 25.0}


def travel_radius_m(mode: Column, minutes: Column) -> Column:
    speed = F.when(mode == "drive", TRAVEL_KMH["drive"]).otherwise(TRAVEL_KMH["walk"])
    return speed * 1000 / 60 * minutes


def densify_tolerance(area_km2: Column) -> Column:
    return F.when(area_km2 > 1000, 0.001).when(area_km2 > 100, 0.0005).when(area_km2 > 10, 0.0001).otherwise(0.0)


def coarse_coordinate(lng: Column, lat: Column) -> Column:
    """TRUE when both coordinates carry two decimals or fewer."""
    return (F.round(lng, 2) == lng) & (F.round(lat, 2) == lat)


def tile_of(lng: Column, lat: Column, z: Column) -> Column:
    """Struct ``x, y`` of the web-map tile a point falls in."""
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(lat)
    x = F.floor((lng + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)
    top = (n - 1).cast("bigint")
    tile = F.struct(
        F.least(F.greatest(x, F.lit(0)), top).alias("x"),
        F.least(F.greatest(y, F.lit(0)), top).alias("y"),
    )
    return F.when(lng.isNotNull() & lat.isNotNull(), tile)


def tile_box(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    edge = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return F.struct(
        (x / n * 360.0 - 180.0).alias("xmin"),
        edge(y + 1).alias("ymin"),
        ((x + 1) / n * 360.0 - 180.0).alias("xmax"),
        edge(y).alias("ymax"),
    )


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return z.between(0, 22) & (x >= 0) & (x < n) & (y >= 0) & (y < n)
