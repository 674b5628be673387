"""Positional joins that stay equi-joins.

The sky is cut into zones of declination, each zone into cells of right ascension whose
number falls with the cosine, so that no cell is narrower than the radius. The left side has
one cell a row; the right side goes to every cell that its circle touches, nine or so. The
join is on (zone, cell), with the exact distance as the rest of its condition, so Spark can
shuffle, broadcast or split it as it would any other, and each pair is found once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sky import EPSILON, _column, _let, as_polygon, centroid, intersects, separation

#: Zones are not thinner than this many degrees.
THINNEST = 1 / 3600
#: Cosines that differ by more tell two angles apart, whatever their last digits.
SURE = 1e-9


def _zone(dec: Column, height: Column | float) -> Column:
    return F.floor((dec + 90) / _column(height)).cast("long")


def _cells(zone: Column, height: Column | float) -> Column:
    """Cells of a zone: as many as its narrower edge holds radii."""
    height = _column(height)
    south, north = F.abs(zone * height - 90), F.abs((zone + 1) * height - 90)
    return F.greatest(F.floor(F.lit(360.0) / height * F.cos(F.radians(F.least(F.greatest(south, north), F.lit(90.0))))), F.lit(1)).cast("long")


def _cell(ra: Column, cells: Column) -> Column:
    return F.floor(F.pmod(ra, F.lit(360.0)) / 360 * cells).cast("long")


def _touched(ra: Column, dec: Column, reach: float, height: float) -> Column:
    """All (zone, cell) that a circle touches."""
    zones = F.sequence(_zone(F.greatest(dec - reach, F.lit(-90.0)), height), _zone(F.least(dec + reach, F.lit(90.0)), height))
    far = F.abs(dec) + reach
    half = F.when(far >= 90, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(dec))))) + EPSILON
    )

    def of(zone: Column) -> Column:
        cells = _cells(zone, height)
        low = F.floor((ra - half) / 360 * cells).cast("long")
        high = F.floor((ra + half) / 360 * cells).cast("long")
        span = F.when(high - low + 1 >= cells, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(F.sequence(low, high))
        return F.transform(F.array_distinct(F.transform(span, lambda c: F.pmod(c, cells))), lambda c: F.struct(zone.alias("zone"), c.alias("cell")))

    return F.flatten(F.transform(zones, of))


def cross_match(
    left: DataFrame, right: DataFrame, radius: float, left_at: tuple[str, str], right_at: tuple[str, str], how: str = "inner", tolerance: float = EPSILON
) -> DataFrame:
    """All pairs of rows within ``radius`` degrees and ``tolerance``, of EPSILON at most, with their distance.

    ``left_at`` and ``right_at`` name the columns of ra and dec. Rows with a null position match
    nothing. Any join type will do that Spark has for an equi-join; of outer, semi and anti
    joins the left side's rows are the ones that stay, each once.
    """
    if not 0 <= radius < 90:
        raise ValueError(f"radius {radius} is not within 0 to 90")
    reach, height = radius + 2 * EPSILON, max(radius + 2 * EPSILON, THINNEST)
    a, b = left.alias("l"), right.alias("r")
    la, ld = (F.col(f"l.{c}") for c in left_at)
    ra, rd = (F.col(f"r.{c}") for c in right_at)
    zone = _zone(ld, height)
    a = a.withColumns({"zone_": zone, "cell_": _cell(la, _cells(zone, height))}).alias("l")
    b = b.select("r.*", F.explode(_touched(ra, rd, reach, height)).alias("at_")).alias("r")
    near = separation(la, ld, ra, rd)
    on = (F.col("l.zone_") == F.col("r.at_.zone")) & (F.col("l.cell_") == F.col("r.at_.cell")) & (near <= radius + tolerance)
    joined = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("zone_", "cell_")
    return joined.withColumn("distance", near).drop("zone_", "cell_", "at_")


def bounding_circle(region: Column) -> Column:
    """[ra, dec, radius] of a circle that holds a region."""

    def of(r: Column) -> Column:
        v = r["v"]

        def about(middle: Column) -> Column:
            ra, dec = F.get(middle, F.lit(0)), F.get(middle, F.lit(1))
            corners = F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1)
            far = F.array_max(F.transform(corners, lambda i: separation(ra, dec, F.get(v, 2 * i), F.get(v, 2 * i + 1))))
            radius = F.when(r["kind"] == "C", F.get(v, F.lit(2))).when(r["kind"] == "G", far).otherwise(F.lit(0.0))
            return F.array(ra, dec, radius)

        return _let(centroid(r)["v"], about)

    return _let(as_polygon(region), of)


def _ball(region: Column) -> Column:
    """Position and radius of a circle that holds a region, and whether the region is that circle or a point; its fields are null for a null region."""
    v, round_ = region["v"], region["kind"].isin("C", "P")
    # circles and points are told without the functions on arrays that polygons need
    plain = F.array(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.when(region["kind"] == "C", F.get(v, F.lit(2))).otherwise(F.lit(0.0)))
    ball = F.when(round_, plain).otherwise(bounding_circle(region))
    return F.struct(*[F.get(ball, F.lit(i)).alias(k) for i, k in enumerate(("ra", "dec", "radius"))], round_.alias("round"))


def overlap_join(left: DataFrame, right: DataFrame, left_region: str, right_region: str, cell_degrees: float = 2.0, tolerance: float = EPSILON) -> DataFrame:
    """Pairs of rows whose regions share a position, circles within ``tolerance``, of EPSILON at most.

    Left rows have one cell each, that of the middle of their bounding circle, in a grid for
    circles of up to its size: cells of ``cell_degrees``, and twice as large for each level of larger
    circles. Right rows go, in each grid that has left rows, to the cells that may hold the middle of
    a circle in reach, so each pair is found once. The cosine of their distance tells most pairs
    apart; the others are compared exactly.
    """
    height = max(cell_degrees, THINNEST)
    side = F.lit(height) * F.pow(F.lit(2.0), F.col("level_"))

    def placed(df: DataFrame, region: str) -> DataFrame:
        """With the bounding circle and the unit vector of its middle; rows without a position or size meet nothing."""
        rows = df.withColumn("ball_", _ball(F.col(region))).filter("ball_.ra is not null and ball_.dec is not null and ball_.radius is not null")
        a, d = F.radians("ball_.ra"), F.radians("ball_.dec")
        return rows.withColumns({"x_": F.cos(d) * F.cos(a), "y_": F.cos(d) * F.sin(a), "z_": F.sin(d)})

    level = F.greatest(F.ceil(F.log2(F.col("ball_.radius") / F.lit(height))).cast("int"), F.lit(0))
    a = placed(left, left_region).withColumn("level_", level)
    # one row for each grid in use, of eight or so
    grids = a.groupBy("level_").agg(F.max("ball_.radius").alias("most_"))
    zone = _zone(F.col("ball_.dec"), side)
    cells = _cells(zone, side)
    a = a.withColumn("at_", _number(zone, F.pmod(_cell(F.col("ball_.ra"), cells), cells))).alias("l")
    b = placed(right, right_region).crossJoin(F.broadcast(grids))
    reach = F.col("ball_.radius") + F.col("most_")
    b = b.withColumn("at_", F.explode(_touched_any(F.col("ball_.ra"), F.col("ball_.dec"), reach, side))).drop("most_")
    # a small side that is broadcast would leave the work to the few tasks that read the other
    b = b.hint("merge").alias("r")

    l, r = ([F.col(f"{t}.ball_.{k}") for k in ("ra", "dec", "radius", "round")] for t in "lr")
    cosine = F.col("l.x_") * F.col("r.x_") + F.col("l.y_") * F.col("r.y_") + F.col("l.z_") * F.col("r.z_")
    least = F.cos(F.radians(F.least(l[2] + r[2] + 2 * EPSILON, F.lit(180.0))))
    # near the limit, and for other regions, the exact test decides
    within = separation(l[0], l[1], r[0], r[1]) <= l[2] + r[2] + F.lit(float(tolerance))
    exact = F.when(l[3] & r[3], (cosine >= least + SURE) | within).otherwise(intersects(F.col(f"l.{left_region}"), F.col(f"r.{right_region}"), tolerance))
    pairs = a.join(b, (F.col("l.level_") == F.col("r.level_")) & (F.col("l.at_") == F.col("r.at_")) & (cosine >= least - SURE) & exact)
    return pairs.drop("at_", "level_", "ball_", "x_", "y_", "z_")


def _number(zone: Column, cell: Column) -> Column:
    """A zone and cell as one number."""
    return zone * F.lit(math.ceil(360 / THINNEST) + 1) + cell


def _touched_any(ra: Column, dec: Column, reach: Column, height: Column | float) -> Column:
    """All cells, as one number each, that a circle of any radius touches."""
    reach = reach + 2 * EPSILON
    low = _zone(F.greatest(dec - reach, F.lit(-90.0)), height)
    high = _zone(F.least(dec + reach, F.lit(90.0)), height)
    bounded = F.abs(dec) + reach < 90
    half = F.when(bounded, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(dec)))))).otherwise(F.lit(180.0))

    def of(zone: Column) -> Column:
        cells = _cells(zone, height)
        first = F.floor((ra - half) / 360 * cells).cast("long")
        last = F.floor((ra + half) / 360 * cells).cast("long")
        span = F.when(last - first + 1 >= cells, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(F.sequence(first, last))
        return F.transform(F.array_distinct(F.transform(span, lambda c: F.pmod(c, cells))), lambda c: _number(zone, c))

    return F.flatten(F.transform(F.sequence(low, high), of))
