"""Geometry against plain arithmetic, and positional joins against all pairs."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import healpix, sky
from skyloom.operators.crossmatch import cross_match, overlap_join


def far(a, b):
    (x1, y1, z1), (x2, y2, z2) = sky._vector(*a), sky._vector(*b)
    cross = (y1 * z2 - z1 * y2, z1 * x2 - x1 * z2, x1 * y2 - y1 * x2)
    return math.degrees(math.atan2(math.hypot(*cross), x1 * x2 + y1 * y2 + z1 * z2))


def awkward_points(radius):
    out = []
    for ra0, dec0 in ((0, 90), (0, -90), (0, 0), (359.9999, 10), (180, 45), (10, 89.5), (200, -89.9), (0.0001, -45)):
        out.append((float(ra0), float(dec0)))
        for k in (0.5, 0.999999, 1.5):
            for bearing in (0, 90, 180, 270, 45):
                d, b, a = math.radians(k * radius), math.radians(bearing), math.radians(dec0)
                dec = math.asin(max(-1, min(1, math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))))
                turn = math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(dec))
                out.append(((ra0 + math.degrees(turn)) % 360, math.degrees(dec)))
    return out


@pytest.mark.parametrize("radius", [1 / 3600, 60 / 3600, 1.0, 20.0])
def test_cross_match_equals_all_pairs(spark, radius):
    points = awkward_points(radius)
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(-1, None, None)], "k int, ra double, dec double")
    other = df.withColumnRenamed("k", "j")
    joined = cross_match(df, other, radius, ("ra", "dec"), ("ra", "dec"))
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    got = [(r.k, r.j) for r in joined.select("k", "j").collect()]
    expected = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if far(a, b) <= radius + 1e-8}
    assert len(got) == len(set(got)) and set(got) == expected
    alone = cross_match(df, other.filter("j % 7 = 0"), radius, ("ra", "dec"), ("ra", "dec"), "left_anti")
    near = {i for i, j in expected if j % 7 == 0}
    assert {r.k for r in alone.collect()} == {-1, *range(len(points))} - near


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(0, 359.9), st.floats(-90, 90), st.floats(0.01, 120))
def test_cones_equal_distances(spark, ra, dec, radius):
    points = [(float(a), float(d)) for a in range(0, 360, 20) for d in range(-90, 91, 15)]
    df = spark.createDataFrame(points, "ra double, dec double")
    got = {tuple(r) for r in df.filter(sky.in_cone(F.col("ra"), F.col("dec"), ra, dec, radius)).collect()}
    assert got == {p for p in points if far(p, (ra, dec)) <= radius + 5e-8} or all(abs(far(p, (ra, dec)) - radius) < 1e-6 for p in got ^ {p for p in points if far(p, (ra, dec)) <= radius})


def test_cone_bounds_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "ra double, dec double").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).filter(sky.in_cone(F.col("ra"), F.col("dec"), 10.0, 20.0, 1.0))
    assert "GreaterThanOrEqual(dec" in df._jdf.queryExecution().executedPlan().toString()


def test_polygons(spark):
    points = spark.createDataFrame([(5.0, 5.0), (0.0, 0.0), (10.0, 3.0), (11.0, 5.0), (5.0, 9.0), (5.0, 2.0), (185.0, -5.0)], "ra double, dec double")
    notched = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    got = {(r.ra, r.dec) for r in points.filter(sky.in_polygon(F.col("ra"), F.col("dec"), notched)).collect()}
    assert got == {(0.0, 0.0), (10.0, 3.0), (5.0, 2.0)}
    square = sky.polygon(0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0)
    kinds = points.select("ra", "dec", sky.contains(square, F.col("ra"), F.col("dec")).alias("inside")).collect()
    assert {(r.ra, r.dec) for r in kinds if r.inside} == {(5.0, 5.0), (0.0, 0.0), (10.0, 3.0), (5.0, 9.0), (5.0, 2.0)}
    with pytest.raises(ValueError):
        sky.in_box(F.col("ra"), F.col("dec"), 0, 89, 10, 6)


SQUARE = ("G", [0, 0, 10, 0, 10, 10, 0, 10])
PAIRS = [
    (("C", [0, 0, 1]), ("C", [1.9, 0, 1]), True), (("C", [0, 0, 1]), ("C", [2.1, 0, 1]), False), (("P", [5, 5]), SQUARE, True),
    (("C", [12, 5, 3]), SQUARE, True), (("C", [14, 5, 3]), SQUARE, False), (("G", [4, -5, 6, -5, 6, 15, 4, 15]), SQUARE, True),
    (("G", [20, 0, 30, 0, 25, 5]), SQUARE, False), (("C", [5, 5, 0.1]), SQUARE, True), (("P", [359.9, 0]), ("C", [0.05, 0, 0.2]), True),
]


def test_intersections(spark):
    floats = lambda r: (r[0], [float(x) for x in r[1]])
    df = spark.createDataFrame([(k, floats(a), floats(b)) for k, (a, b, _) in enumerate(PAIRS)], f"k int, a {sky.REGION}, b {sky.REGION}")
    rows = df.select("k", sky.intersects(F.col("a"), F.col("b")).alias("x"), sky.intersects(F.col("b"), F.col("a")).alias("y")).collect()
    assert {r.k: (r.x, r.y) for r in rows} == {k: (hit, hit) for k, (_, _, hit) in enumerate(PAIRS)}
    found = overlap_join(df.select(F.col("k").alias("i"), "a"), df.select(F.col("k").alias("j"), "b"), "a", "b").select("i", "j").collect()
    pairs = [(r.i, r.j) for r in found]
    assert len(pairs) == len(set(pairs)) and {i for i, j in pairs if i == j} == {k for k, (_, _, hit) in enumerate(PAIRS) if hit}


def test_areas_and_centroids(spark):
    octant = sky.polygon(0.0, 0.0, 90.0, 0.0, 0.0, 90.0)
    row = spark.range(1).select(sky.polygon_area(octant).alias("p"), sky.circle_area(180.0).alias("c"), sky.centroid(octant)["v"].alias("m"), sky.box_area(360.0, F.lit(-90.0), F.lit(90.0)).alias("b")).first()
    sphere = 4 * math.pi * (180 / math.pi) ** 2
    assert row.p == pytest.approx(sphere / 8) and row.c == pytest.approx(sphere) and row.b == pytest.approx(sphere)
    assert row.m == pytest.approx([45.0, math.degrees(math.asin(1 / math.sqrt(3)))])


def test_region_text(spark):
    texts = ["CIRCLE ICRS 10 20 1.5", "polygon 0 0 10 0 10 10", "POSITION 1 2", "CIRCLE 10 20 0", "CIRCLE 361 0 1", "POLYGON 0 0 1 1", "CIRCLE a b c", "BOX 1 2 3 4", "", None, "POLYGON ICRS 0 0 10 0 10 95"]
    got = [r.g and (r.g.kind, r.g.v) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(sky.parse_region(F.col("t")).alias("g")).collect()]
    assert got == [("C", [10, 20, 1.5]), ("G", [0, 0, 10, 0, 10, 10]), ("P", [1, 2]), *[None] * 8]
    flat = spark.range(1).select(sky.circle_vertices(30.0, 85.0, 10.0, 32).alias("v")).first().v
    assert len(flat) == 64 and all(far((flat[i], flat[i + 1]), (30, 85)) == pytest.approx(10) for i in range(0, 64, 2))


def test_healpix(spark):
    assert spark.range(1).select(healpix.healpix_index(1, 45.0, 80.0).alias("i")).first().i == 3
    for order in (0, 1, 5, 10, 20):
        cells = spark.range(0, 12 << (2 * order), max(1, (12 << (2 * order)) // 700))
        middle = cells.withColumn("m", healpix.healpix_center(order, F.col("id"))["v"])
        back = middle.withColumn("back", healpix.healpix_index(order, F.col("m")[0], F.col("m")[1]))
        assert back.filter("id <> back").count() == 0


def test_propagation(spark):
    star = spark.range(1).select(sky.propagate(269.452, 4.6934, 547.45, -801.551, 10362.394, -110.47, 2016.0, 2066.0).alias("s")).first().s
    assert star[1] - 4.6934 == pytest.approx(10362.394 * 50 / 3_600_000, rel=0.02) and star[2] > 547.45 and star[4] > 10362.394
    still = spark.range(1).select(sky.propagate(10.0, 20.0, None, None, None, None, 2000.0, 2050.0).alias("s")).first().s
    assert still[:2] == pytest.approx([10, 20]) and still[2] is None and still[5] is None
    back = spark.range(1).select(sky.propagate(star[0], star[1], star[2], star[3], star[4], star[5], 2066.0, 2016.0).alias("s")).first().s
    assert back == pytest.approx([269.452, 4.6934, 547.45, -801.551, 10362.394, -110.47], rel=1e-9)
