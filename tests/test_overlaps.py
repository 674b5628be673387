"""Regions of very unequal sizes that overlap, against every pair."""

import random

from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators.crossmatch import overlap_join


def test_sizes_from_points_to_half_the_sky_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.uniform(-30, 400), rng.choice([-90.0, 90.0, rng.uniform(-90, 90), rng.uniform(80, 90)]), rng.choice([0.0, 0.3, 2.0, 2.1, 9.0, 40.0, 120.0, 180.0])) for k in range(90)]
    df = spark.createDataFrame([*rows, (90, None, 1.0, 1.0), (91, 3.0, 4.0, None)], "k int, ra double, dec double, r double")
    circles = df.select("k", F.when(F.col("r") == 0, sky.point(F.col("ra"), F.col("dec"))).otherwise(sky.circle(F.col("ra"), F.col("dec"), F.col("r"))).alias("g"))
    odd = spark.range(1).select(F.lit(100).alias("k"), sky.box(10.0, 88.0, 30.0, 6.0).alias("g")).union(spark.range(1).select(F.lit(101), sky.polygon(350, -10, 20, -10, 5, 25)))
    odd = odd.union(spark.range(1).select(F.lit(102), F.lit(None).cast(sky.REGION)))
    a = circles.union(odd).select(F.col("k").alias("i"), F.col("g").alias("a"))
    b = circles.union(odd).select(F.col("k").alias("j"), F.col("g").alias("b")).filter("j % 2 = 0 or j > 95")
    found = overlap_join(a, b, "a", "b")
    pairs = sorted(map(tuple, found.select("i", "j").collect()))
    # regions without a whole position and size, the last two circles, meet nothing
    expected = sorted(map(tuple, a.crossJoin(b).filter("i not in (90, 91) and j not in (90, 91)").filter(sky.intersects(F.col("a"), F.col("b"))).select("i", "j").collect()))
    assert pairs == expected and len(expected) > 500


def test_only_one_side_goes_to_many_cells(spark):
    small = lambda name: spark.range(50).select(F.col("id").alias(name), sky.circle(F.col("id").cast("double"), F.lit(89.0), F.lit(1.0)).alias(f"g{name}"))
    found = overlap_join(small("a"), small("b"), "ga", "gb", tolerance=0.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one row a region on the left, and no array of cells is carried along
    assert plan.count("Generate explode") == 1 and "array_intersect" not in plan
    assert found.count() == 2500
