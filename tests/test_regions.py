"""Boxes, areas and rings of regions, cells of points, and positions at another epoch."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import healpix, scalar, sky
from skyloom.operators import relational
from skyloom.operators.crossmatch import overlap_join


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_boxes_meet_other_regions(spark):
    b = sky.box(10.0, 20.0, 4.0, 2.0)
    row = one(
        spark,
        inner=sky.intersects(b, sky.circle(10.0, 20.0, 0.1)), outer=sky.intersects(sky.circle(10.0, 20.0, 9.0), b), at=sky.intersects(b, sky.point(11.0, 20.5)),
        triangle=sky.intersects(b, sky.polygon(9.9, 19.9, 10.1, 19.9, 10.0, 20.1)), away=sky.intersects(b, sky.circle(20.0, 20.0, 1.0)),
        boxes=sky.intersects(b, sky.box(12.5, 20.0, 2.0, 2.0)), apart=sky.intersects(b, sky.box(15.0, 20.0, 2.0, 2.0)),
        pole=sky.intersects(sky.box(0.0, 89.5, 20.0, 4.0), sky.point(1.0, 89.9)), middle=sky.centroid(b)["v"], area=sky.area(b),
    )
    assert row.inner and row.outer and row.at and row.triangle and row.boxes and row.pole and not row.away and not row.apart
    assert row.middle == [10.0, 20.0]
    assert row.area == pytest.approx(math.radians(4) * (math.sin(math.radians(21)) - math.sin(math.radians(19))) * (180 / math.pi) ** 2)
    a = spark.range(1).select(F.lit(1).alias("i"), b.alias("a"))
    assert overlap_join(a, spark.range(1).select(sky.circle(8.5, 20.0, 0.1).alias("b")), "a", "b").count() == 1
    with pytest.raises(ValueError):
        sky.box(0.0, 0.0, 180.0, 1.0)


def test_box_search_ends_at_the_pole(spark):
    df = spark.createDataFrame([(0.0, 89.0), (0.0, 80.0), (90.0, 89.0)], "ra double, dec double")
    assert [tuple(r) for r in df.filter(sky.in_box(F.col("ra"), F.col("dec"), 0.0, 88.0, 20.0, 8.0, clamp=True)).collect()] == [(0.0, 89.0)]


def test_rings(spark):
    texts = {
        "POLYGON 0 0 10 0 10 10 0 10 0 0": [0, 0, 10, 0, 10, 10, 0, 10], "POLYGON 0 0 10 0 10 0 10 10": [0, 0, 10, 0, 10, 10],
        "POLYGON 0 0 10 0 1 1 0 10": None, "POLYGON 0 0 10 0 0 0": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "t string, v array<int>").select("v", sky.parse_region(F.col("t")).alias("g"), sky.parse_region(F.col("t"), convex=False).alias("any")).collect()
    assert all((r.g and r.g.v) == r.v for r in rows) and rows[2]["any"].v == [0, 0, 10, 0, 1, 1, 0, 10]
    eight = one(spark, g=sky.region_polygon(sky.parse_region(F.lit("POSITION 10 20"))), c=sky.region_polygon(sky.circle(1.0, 2.0, 3.0)))
    assert len(eight.g.v) == 16 and len(eight.c.v) == 64 and eight.g.v[1] - 20 == pytest.approx(0.05 / 3600)


def test_cells_of_points_and_positions(spark):
    row = one(spark, a=healpix.healpix_index_of(6, sky.point(10.0, 20.0)), b=healpix.healpix_index(6, 10.0, 20.0), p=sky.propagate_position(10.0, 20.0, 0.0, 3_600_000.0, 2000.0, 2001.0)["v"])
    assert row.a == row.b and row.p == pytest.approx([10.0, 20 + math.degrees(math.atan(math.radians(1)))])
    assert sky.named("area", F.lit(1))._jc.toString() and spark.range(1).select(sky.named("AREA", F.lit(1)), sky.named("x", F.lit(2))).columns == ["adql_area", "?column?"]


def test_scalars_at_large_numbers(spark):
    big = 9007199254740993
    row = one(spark, d=scalar.integer_divide(F.lit(big), F.lit(1)), up=scalar.ceiling(F.lit(1e19)), cut=scalar.truncate(F.lit(1e19), 1), down=scalar.floor(F.lit(-1e300)), t=scalar.truncate(F.lit(-1.29), 1))
    assert row.d == big and row.up == 1e19 and row.cut == 1e19 and row.down == -1e300 and row.t == -1.2


def test_not_in(spark):
    df, none = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([], "x int")
    found = lambda *x: sorted(str(r.k) for r in relational.not_in(df, "k", spark.createDataFrame([(i,) for i in x], "x int") if x else none, "x").collect())
    assert found(1) == ["2"] and found(1, None) == [] and found() == ["1", "2", "None"]
