import pytest
from pyspark.sql import functions as F

from landgrid.functions import geo
from landgrid.operators import ranking, search, spatial, zones
from landgrid.operators.skew import hot_keys, salted_join
from tests import brute


def points(spark, n, seed, name, hot=0):
    rng = brute.seeded(seed)
    rows = [(i, rng.uniform(-76, -73), rng.uniform(3, 6)) for i in range(n)]
    # A third of all rows in one place.
    rows += [(n + i, -74.5, 4.5) for i in range(hot)]
    return rows, spark.createDataFrame(rows, f"{name}_id long, {name}_x double, {name}_y double")


def boxes(spark, n, seed, name, most):
    rng = brute.seeded(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.uniform(-76, -73), rng.uniform(3, 6), rng.uniform(0.001, most), rng.uniform(0.001, most)
        rows.append((i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    df = spark.createDataFrame([(i, brute.rings(r)) for i, r in rows], f"{name}_id long, {name}_rings {geo.POLYGON_TYPE}")
    return rows, df


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select((F.col("id") % 50).alias("k"), F.col("id").alias("r"))
    hot = hot_keys(left, ["k"], 1.0, 100)
    assert {r.k for r in hot.collect()} == {7}
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.where("k <> 3").join(right.where("k <> 5"), "k", how)
        salted = salted_join(left.where("k <> 3"), right.where("k <> 5"), ["k"], ["id"], how, hot=hot)
        cols = sorted(plain.columns)
        assert sorted(map(tuple, salted.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))
    parts = left.join(hot, "k").select(F.pmod(F.xxhash64("id"), F.col("_fan")).alias("s")).groupBy("s").count().collect()
    assert len(parts) > 5


def test_overlaps_of_mixed_sizes(spark):
    a_rows, a = boxes(spark, 150, 1, "a", 0.05)
    b_rows, b = boxes(spark, 150, 2, "b", 2.5)
    got = {(r.a_id, r.b_id): r.overlap for r in spatial.polygon_overlaps(a, b, "a_id", "a_rings", "b_rings").collect()}
    want = {}
    for i, p in a_rows:
        for j, q in b_rows:
            s = brute.convex_overlap(p, q)
            if s > 1e-12:
                want[i, j] = s
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    back = spatial.polygon_overlaps(b, a, "b_id", "b_rings", "a_rings").count()
    assert back == len(want)


def test_points_in_polygons_and_smallest_holder(spark):
    p_rows, p = points(spark, 300, 3, "p", hot=150)
    b_rows, b = boxes(spark, 80, 4, "b", 1.5)
    names = dict(x="p_x", y="p_y", rings="b_rings")
    got = {(r.p_id, r.b_id) for r in spatial.points_in_polygons(p, b, "p_id", **names).collect()}
    want = {(i, j) for i, x, y in p_rows for j, q in b_rows if brute.inside(q, x, y)}
    assert got == want
    anti = {r.p_id for r in spatial.points_in_polygons(p, b, "p_id", how="left_anti", **names).collect()}
    assert anti == {i for i, *_ in p_rows} - {i for i, _ in want}
    sized = b.withColumn("size", geo.area(F.col("b_rings")))
    size = {j: abs(brute.shoelace(q)) for j, q in b_rows}
    best = {r.p_id: r.b_id for r in spatial.smallest_holder(p, sized, "p_id", "b_id", "size", **names).collect()}
    assert best == {i: min((size[j], j) for k, j in want if k == i)[1] for i in {k for k, _ in want}}


def test_distance_joins(spark):
    a_rows, a = points(spark, 200, 5, "a", hot=100)
    b_rows, b = points(spark, 120, 6, "b")
    near = {(r.a_id, r.b_id) for r in spatial.within_distance(a, b, 30_000, "a_id", ("a_x", "a_y"), ("b_x", "b_y")).collect()}
    d = {(i, j): brute.haversine(x, y, u, v) for i, x, y in a_rows for j, u, v in b_rows}
    assert near == {k for k, m in d.items() if m <= 30_000}
    names = dict(left_xy=("a_x", "a_y"), right_xy=("b_x", "b_y"))
    first = {r.a_id: r.b_id for r in spatial.nearest(a, b, [5_000, 20_000, 60_000], "a_id", "b_id", **names).collect()}
    best = {i: min((d[i, j], j) for j, *_ in b_rows) for i, *_ in a_rows}
    assert first == {i: j for i, (m, j) in best.items() if m <= 60_000}
    anywhere = spatial.nearest_anywhere(a, b, "a_id", "b_id", first_m=2_000, **names)
    assert {r.a_id: r.b_id for r in anywhere.collect()} == {i: j for i, (_, j) in best.items()}


def test_results_do_not_depend_on_partitions_or_order(spark):
    _, a = boxes(spark, 100, 8, "a", 0.4)
    _, b = boxes(spark, 100, 9, "b", 1.0)
    def run(x, y):
        out = spatial.polygon_overlaps(x, y, "a_id", "a_rings", "b_rings").select("a_id", "b_id", F.round("overlap", 9))
        return sorted(map(tuple, out.collect()))
    assert run(a, b) == run(a.repartition(7).orderBy(F.col("a_id").desc()), b.repartition(3))


def test_road_distance_matches_a_dense_line(spark):
    from landgrid.operators.cells import road_distances
    line = [{"x": -74.0, "y": 4.0}, {"x": -73.7, "y": 4.2}, {"x": -73.7, "y": 4.6}]
    roads = spark.createDataFrame([(1, "primary", True, line), (2, "track", False, line)], f"road_id int, class string, is_paved boolean, line {geo.RING_TYPE}")
    p = spark.createDataFrame([(1, -73.9, 4.1), (2, -73.68, 4.5), (3, -70.0, 1.0)], "id int, lng double, lat double")
    got = {r.id: r for r in road_distances(p, spatial.line_segments(roads, "line"), "id", ("lng", "lat")).collect()}
    dense = [(-74 + 0.3 * k / 3000, 4 + 0.2 * k / 3000) for k in range(3001)] + [(-73.7, 4.2 + 0.4 * k / 3000) for k in range(3001)]
    for i, x, y in ((1, -73.9, 4.1), (2, -73.68, 4.5)):
        want = min(brute.haversine(x, y, u, v) for u, v in dense)
        assert got[i].dist_primary_road_m == pytest.approx(want, rel=2e-3, abs=8)
        assert got[i].dist_paved_road_m == got[i].dist_primary_road_m
    assert got[3].dist_primary_road_m is None


def test_percentiles_ranks_and_numbers(spark):
    rows = [(k % 3, (k * 37 % 101) / 7 - 5, k) for k in range(500)] + [(1, 2.5, 1000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, v double, id int")
    got = {r.g: (r.a, r.b) for r in ranking.grouped_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    want = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.9]).alias("p")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    ranks = ranking.rank_in_group(df, ["g"], "v", False).collect()
    for r in ranks[:50]:
        same = [v for g, v, _ in rows if g == r.g]
        assert r.national_rank == 1 + sum(v < r.v for v in same)
        assert r.national_pct == pytest.approx(sum(v > r.v for v in same) / (len(same) - 1) * 100, abs=0.006)
    numbered = ranking.number_rows(df, [F.col("v").desc(), F.col("id")], "n", ["g"]).collect()
    for g in range(3):
        order = [i for _, i in sorted((-v, i) for h, v, i in rows if h == g)]
        assert [r.id for r in sorted((r for r in numbered if r.g == g), key=lambda r: r.n)] == order


def test_missing_values_have_no_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "g string, v double")
    out = {(r.g, r.v): r for r in ranking.rank_in_group(df, ["g"], "v").collect()}
    assert out["a", None].national_rank is None and out["a", None].national_pct is None
    assert out["b", 3.0].national_rank == 1 and out["b", 3.0].national_pct == 0.0


def test_trigram_pairs_find_everything_at_the_threshold(spark):
    rng = brute.seeded(11)
    words = ["villa", "vila", "rosa", "rosal", "monte", "montes", "san", "santa", "pedro", "perdo", "rio", "alto"]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(120)]
    index = spark.createDataFrame(list(enumerate(names)), "i long, d string")
    asked = spark.createDataFrame(list(enumerate(names[:40] + ["vilal roza", "zzz"])), "q long, t string")

    def grams(s):
        return {f"  {w} "[k:k + 3] for w in s.split() for k in range(len(w) + 1)}

    for limit in (0.25, 0.3, 0.6):
        got = {(r.q, r.i): r.similarity for r in search.trigram_pairs(asked, index, "q", "i", "t", "d", limit).collect()}
        want = {}
        for q, t in enumerate(names[:40] + ["vilal roza", "zzz"]):
            for i, d in enumerate(names):
                s = len(grams(t) & grams(d)) / len(grams(t) | grams(d))
                if s >= limit:
                    want[q, i] = s
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_components_of_long_paths(spark):
    cells = spark.range(300).select(F.col("id").alias("cell"))
    edges = spark.range(299).where("id <> 150").selectExpr("id as a", "id + 1 as b")
    both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
    got = {r.cell: r.component for r in zones.connected_components(cells, both, []).collect()}
    assert all(got[c] == (0 if c <= 150 else 151) for c in range(300))
