"""Spherical geometry in degrees, as Columns.

Regions are structs of kind (P point, C circle, B box, G polygon) and v, their numbers:
[ra, dec], [ra, dec, r], [ra0, dec0, ra1, dec1] or [ra1, dec1, ra2, dec2, ...].
Boundaries belong to a region, within a tolerance of EPSILON; with a tolerance of 0 circles
are told by a plain comparison of distances, as SQL has it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees by which a point may lie outside a boundary that it is on.
EPSILON = math.degrees(1e-9)
REGION = "struct<kind:string,v:array<double>>"


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(None).cast("double") if x is None else F.lit(float(x))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance of two positions, exact at small and large angles."""
    ra1, dec1, ra2, dec2 = (F.radians(_column(x)) for x in (ra1, dec1, ra2, dec2))
    d = ra2 - ra1
    x = F.cos(dec2) * F.sin(d)
    y = F.cos(dec1) * F.sin(dec2) - F.sin(dec1) * F.cos(dec2) * F.cos(d)
    z = F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(d)
    return F.degrees(F.atan2(F.sqrt(x * x + y * y), z))


def in_cone(ra: Column, dec: Column, ra0: float, dec0: float, radius: float, tolerance: float = EPSILON) -> Column:
    """Whether a position lies in a fixed circle.

    The ranges of dec and ra that hold the circle come first; they are plain comparisons that
    reach the file scan. The exact test follows.
    """
    if not 0 <= radius <= 180:
        raise ValueError(f"radius {radius} is not within 0 to 180")
    exact = separation(ra, dec, ra0, dec0) <= radius + tolerance
    reach = radius + 2 * EPSILON
    if reach >= 90:
        return exact
    near = dec.between(max(-90.0, dec0 - reach), min(90.0, dec0 + reach))
    if abs(dec0) + reach < 90:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(dec0))))) + EPSILON
        near = near & in_range(ra, ra0 - half, ra0 + half)
    return near & exact


def in_range(ra: Column, low: float, high: float) -> Column:
    """Whether ra (0 to 360) is on the arc from low to high, which may pass 0."""
    if high - low >= 360:
        return F.lit(True)
    low, high = low % 360, high % 360
    return ra.between(low, high) if low <= high else (ra >= low) | (ra <= high)


def in_box(ra: Column, dec: Column, ra0: float, dec0: float, width: float, height: float, clamp: bool = False) -> Column:
    """Whether a position lies in a box about a centre, with edges of constant ra and dec; ``clamp`` ends it at a pole that it would pass."""
    if not clamp and abs(dec0) + height / 2 > 90:
        raise ValueError("the box passes a pole")
    e = EPSILON
    low, high = max(-90.0, dec0 - height / 2), min(90.0, dec0 + height / 2)
    return dec.between(low - e, high + e) & in_range(ra, ra0 - width / 2 - e, ra0 + width / 2 + e)


def _vector(ra: float, dec: float) -> tuple[float, float, float]:
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def in_polygon(ra: Column, dec: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a position lies in a simple polygon, convex or not, all within 90 degrees of its centroid.

    Positions and vertices are projected from the centroid on a plane, where great circles are
    straight; crossings of a ray with the edges are counted, and the edges themselves belong to
    the polygon.
    """
    if len(vertices) < 3:
        raise ValueError("a polygon needs three vertices")
    total = [sum(x) for x in zip(*[_vector(*v) for v in vertices], strict=True)]
    norm = math.hypot(*total)
    cx, cy, cz = (x / norm for x in total)
    ra0, dec0 = math.degrees(math.atan2(cy, cx)), math.degrees(math.asin(cz))
    a0, d0 = math.radians(ra0), math.radians(dec0)
    flat = []
    for r, d in vertices:
        a, d = math.radians(r) - a0, math.radians(d)
        c = math.sin(d0) * math.sin(d) + math.cos(d0) * math.cos(d) * math.cos(a)
        if c <= 0:
            raise ValueError("the polygon spans more than a hemisphere")
        flat.append((math.cos(d) * math.sin(a) / c, (math.cos(d0) * math.sin(d) - math.sin(d0) * math.cos(d) * math.cos(a)) / c))
    a, d = F.radians(ra) - a0, F.radians(dec)
    c = math.sin(d0) * F.sin(d) + math.cos(d0) * F.cos(d) * F.cos(a)
    x = F.cos(d) * F.sin(a) / c
    y = (math.cos(d0) * F.sin(d) - math.sin(d0) * F.cos(d) * F.cos(a)) / c
    odd, on = [], []
    for (x1, y1), (x2, y2) in zip(flat, flat[1:] + flat[:1], strict=True):
        if y1 != y2:
            crosses = ((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            odd.append(crosses.cast("int"))
        length = math.hypot(x2 - x1, y2 - y1)
        along = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length**2
        off = F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / length
        on.append((off <= 1e-9) & along.between(0.0, 1.0))
    inside = reduce(Column.__add__, odd) % 2 == 1
    reach = max(_angle(_vector(*v), (cx, cy, cz)) for v in vertices) + EPSILON
    return in_cone(ra, dec, ra0 % 360, dec0, min(90.0, reach)) & (c > 0) & (inside | reduce(Column.__or__, on))


def _angle(a: tuple, b: tuple) -> float:
    return math.degrees(math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True))))))


def point(ra, dec) -> Column:
    return F.struct(F.lit("P").alias("kind"), F.array(_column(ra), _column(dec)).alias("v"))


def circle(ra, dec, radius) -> Column:
    """A circle; a radius outside 0 to 180 is an error."""
    r = _column(radius)
    r = F.when((r < 0) | (r > 180), F.raise_error(F.lit("radius out of range")).cast("double")).otherwise(r)
    return F.struct(F.lit("C").alias("kind"), F.array(_column(ra), _column(dec), r).alias("v"))


def polygon(*numbers) -> Column:
    if len(numbers) < 6 or len(numbers) % 2:
        raise ValueError("a polygon needs three pairs of numbers at least")
    return F.struct(F.lit("G").alias("kind"), F.array(*map(_column, numbers)).alias("v"))


def box(ra: float, dec: float, width: float, height: float) -> Column:
    """A box about a centre; it ends at a pole that it would pass, and is less than 180 degrees wide."""
    if not (0 < width < 180 and height > 0):
        raise ValueError("a box is more than 0 and less than 180 degrees wide")
    corners = ra - width / 2, max(-90.0, dec - height / 2), ra + width / 2, min(90.0, dec + height / 2)
    return F.struct(F.lit("B").alias("kind"), F.array(*map(F.lit, map(float, corners))).alias("v"))


def as_polygon(region: Column) -> Column:
    """A box as the polygon of its corners, of three where it ends at a pole; other regions as they are."""

    def of(r: Column) -> Column:
        w, s, e, n = (F.get(r["v"], F.lit(i)) for i in range(4))
        south = F.when(s <= -90, F.array(w, s)).otherwise(F.array(w, s, e, s))
        north = F.when(n >= 90, F.array(w, n)).otherwise(F.array(e, n, w, n))
        whole = F.array(w, s, e, (s + n) / 2, w, n, w, (s + n) / 2)
        around = F.when((s <= -90) & (n >= 90), whole).when(s <= -90, F.concat(south, north)).otherwise(F.concat(south, north))
        return F.when(r["kind"] == "B", F.struct(F.lit("G").alias("kind"), around.alias("v"))).otherwise(r)

    return _let(region, of)


def coordinates(region: Column) -> Column:
    """The numbers of a region, as a result shows them."""
    return region["v"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(ra: Column, dec: Column) -> Column:
    a, d = F.radians(ra), F.radians(dec)
    return F.array(F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))


def _vertices(v: Column) -> Column:
    """Unit vectors of a polygon's vertices."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: _unit(F.get(v, 2 * i), F.get(v, 2 * i + 1)))


def _cross(a: Column, b: Column) -> Column:
    x = [F.get(a, F.lit(i)) for i in range(3)]
    y = [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def _dot(a: Column, b: Column) -> Column:
    return reduce(Column.__add__, [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(3)])


def _next(points: Column, i: Column) -> Column:
    return F.get(points, (i + 1) % F.size(points))


def _edges(points: Column) -> Column:
    """The polygon's edges: their ends and the normals of their great circles."""

    def edge(a: Column, i: Column) -> Column:
        return _let(_next(points, i), lambda b: _let(_cross(a, b), lambda n: F.struct(
            a.alias("a"), b.alias("b"), F.transform(n, lambda x: x / F.sqrt(_dot(n, n))).alias("n")
        )))

    return F.transform(points, edge)


def _polygon_holds(v: Column, p: Column) -> Column:
    """Whether a convex polygon holds a unit vector: it is on one side of all edges, and on the polygon's half of the sphere."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def held(points: Column) -> Column:
        middle = F.aggregate(points, zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        sides = F.transform(_edges(points), lambda e: _dot(e["n"], p))
        return _let(sides, lambda s: (F.forall(s, lambda x: x >= -1e-9) | F.forall(s, lambda x: x <= 1e-9))) & (_dot(p, middle) > 0)

    return _let(_vertices(v), held)


def contains(region: Column, ra: Column, dec: Column, tolerance: float = EPSILON) -> Column:
    """Whether a circle, box or convex polygon column holds a position; null for a null region, false for a point elsewhere. ``tolerance`` is that of circles and points."""

    def of(r: Column) -> Column:
        v = r["v"]
        n = [F.get(v, F.lit(i)) for i in range(4)]
        turn = F.pmod(_column(ra) - n[0], F.lit(360.0))
        in_the_box = _column(dec).between(n[1] - EPSILON, n[3] + EPSILON) & ((turn <= n[2] - n[0] + EPSILON) | (turn >= 360 - EPSILON))
        round_ = separation(ra, dec, n[0], n[1]) <= F.when(r["kind"] == "C", n[2]).otherwise(F.lit(0.0)) + F.lit(float(tolerance))
        return (
            F.when(r["kind"].isin("P", "C"), round_)
            .when(r["kind"] == "B", in_the_box)
            .when(r["kind"] == "G", _let(_unit(_column(ra), _column(dec)), lambda p: _polygon_holds(v, p)))
        )

    return _let(region, of)


def circles_intersect(ra1, dec1, r1, ra2, dec2, r2) -> Column:
    return separation(ra1, dec1, ra2, dec2) <= _column(r1) + _column(r2) + EPSILON


def _edge_distance(v: Column, ra: Column, dec: Column) -> Column:
    """Degrees from a position to the nearest place on the edges of a polygon."""

    def of(p: Column) -> Column:
        def far(e: Column) -> Column:
            n, a, b = e["n"], e["a"], e["b"]
            between = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0)
            to_end = F.acos(F.least(F.lit(1.0), F.greatest(_dot(a, p), _dot(b, p))))
            return F.when(between, F.asin(F.least(F.lit(1.0), F.abs(_dot(n, p))))).otherwise(to_end)

        return F.array_min(F.transform(_let(_vertices(v), _edges), far))

    return F.degrees(_let(_unit(ra, dec), of))


def _edges_cross(x: Column, y: Column) -> Column:
    """Whether any two edges of two polygons cross."""

    def crossed(e: Column, f: Column) -> Column:
        apart = (_dot(e["n"], f["a"]) * _dot(e["n"], f["b"]) < 0) & (_dot(f["n"], e["a"]) * _dot(f["n"], e["b"]) < 0)
        return apart & (_dot(e["n"], f["a"]) * _dot(f["n"], e["b"]) > 0)

    ys = _let(_vertices(y), _edges)
    return _let(ys, lambda t: F.exists(_let(_vertices(x), _edges), lambda e: F.exists(t, lambda f: crossed(e, f))))


def intersects(a: Column, b: Column, tolerance: float = EPSILON) -> Column:
    """Whether two regions share a position: points, circles, boxes (as polygons of their corners) and convex polygons, in any pairing.

    ``tolerance`` is that of circles and points with each other.
    """
    a, b = as_polygon(a), as_polygon(b)

    def ordered(pair: Column) -> Column:
        # the polygon, if there is one, is x; a point is y unless both are
        x, y = pair["x"], pair["y"]
        xv, yv = x["v"], y["v"]
        at = [F.get(yv, F.lit(i)) for i in range(3)]
        size = lambda r: F.when(r["kind"] == "C", F.get(r["v"], F.lit(2))).otherwise(F.lit(0.0))
        round_ = separation(F.get(xv, F.lit(0)), F.get(xv, F.lit(1)), at[0], at[1]) <= size(x) + size(y) + F.lit(float(tolerance))
        inside = lambda one, other: F.exists(_vertices(other["v"]), lambda p: _polygon_holds(one["v"], p))
        return (
            F.when(x["kind"] != "G", round_)
            .when(y["kind"] == "P", contains(x, at[0], at[1]))
            .when(y["kind"] == "C", contains(x, at[0], at[1]) | (_edge_distance(xv, at[0], at[1]) <= at[2] + EPSILON))
            .otherwise(inside(x, y) | inside(y, x) | _edges_cross(xv, yv))
        )

    def swapped(p: Column) -> Column:
        swap = (p["b"]["kind"] == "G") & (p["a"]["kind"] != "G")
        return _let(F.struct(F.when(swap, p["b"]).otherwise(p["a"]).alias("x"), F.when(swap, p["a"]).otherwise(p["b"]).alias("y")), ordered)

    return _let(F.struct(a.alias("a"), b.alias("b")), swapped)


def circle_area(radius) -> Column:
    """Square degrees of a circle."""
    return 2 * math.pi * (1 - F.cos(F.radians(_column(radius)))) * (180 / math.pi) ** 2


def box_area(width: float, low: Column, high: Column) -> Column:
    return F.radians(_column(width)) * (F.sin(F.radians(high)) - F.sin(F.radians(low))) * (180 / math.pi) ** 2


def polygon_area(region: Column) -> Column:
    """Square degrees of a simple polygon, as the spherical excess of its triangles from the first vertex."""

    def area(points: Column) -> Column:
        a = F.get(points, F.lit(0))

        def excess(i: Column) -> Column:
            b, c = F.get(points, i), F.get(points, i + 1)
            return 2 * F.atan2(_dot(a, _cross(b, c)), 1 + _dot(a, b) + _dot(b, c) + _dot(c, a))

        return F.abs(F.aggregate(F.sequence(F.lit(1), F.size(points) - 2), F.lit(0.0), lambda s, i: s + excess(i)))

    return _let(_vertices(region["v"]), area) * (180 / math.pi) ** 2


def area(region: Column) -> Column:
    """Square degrees of any region; 0 of a point."""

    def of(r: Column) -> Column:
        w, s, e, n = (F.get(r["v"], F.lit(i)) for i in range(4))
        box_ = F.radians(e - w) * (F.sin(F.radians(n)) - F.sin(F.radians(s))) * (180 / math.pi) ** 2
        return F.when(r["kind"] == "P", F.lit(0.0)).when(r["kind"] == "C", circle_area(e)).when(r["kind"] == "B", box_).when(r["kind"] == "G", polygon_area(r))

    return _let(region, of)


def centroid(region: Column) -> Column:
    """The centre of a circle, point or box; of a polygon, the direction of the sum of its vertices."""
    v = region["v"]
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def middle(s: Column) -> Column:
        x, y, z = (F.get(s, F.lit(i)) for i in range(3))
        return point(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))

    total = F.aggregate(_vertices(v), zero, lambda t, x: F.zip_with(t, x, lambda a, b: a + b))
    first, second = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    box_ = point(F.pmod((first + F.get(v, F.lit(2))) / 2, F.lit(360.0)), (second + F.get(v, F.lit(3))) / 2)
    return F.when(region["kind"] == "G", _let(total, middle)).when(region["kind"] == "B", box_).otherwise(point(first, second))


def _ring(v: Column) -> Column:
    """A polygon's numbers without its closing and repeated vertices."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.array(F.get(v, 2 * i), F.get(v, 2 * i + 1)))
    return F.flatten(F.array_distinct(pairs))


def is_convex(v: Column) -> Column:
    """Whether all vertices of a polygon lie on one side of each of its edges."""

    def of(points: Column) -> Column:
        def one_sided(e: Column) -> Column:
            return _let(F.transform(points, lambda p: _dot(e["n"], p)), lambda s: F.struct(F.forall(s, lambda x: x >= -1e-9).alias("l"), F.forall(s, lambda x: x <= 1e-9).alias("r")))

        return _let(F.transform(_edges(points), one_sided), lambda t: F.forall(t, lambda x: x["l"]) | F.forall(t, lambda x: x["r"]))

    return _let(_vertices(v), of)


def parse_region(text: Column, convex: bool = True) -> Column:
    """A region of ``CIRCLE``, ``POLYGON`` or ``POSITION`` text, with or without ICRS; null if it is malformed or out of range.

    Closing and repeated vertices are left out. A polygon that is not convex is null too,
    because ``contains`` and ``intersects`` need convex ones; ``convex`` False keeps it.
    """
    def of(parts: Column) -> Column:
        start = F.when(F.get(parts, F.lit(1)) == "ICRS", 3).otherwise(2)
        numbers = F.transform(F.slice(parts, start, F.greatest(F.size(parts), F.lit(1))), lambda x: x.try_cast("double"))
        return _let(numbers, lambda n: told(F.get(parts, F.lit(0)), n))

    def told(kind: Column, numbers: Column) -> Column:
        sane = F.forall(numbers, lambda x: x.isNotNull())
        pairs = F.when(kind == "CIRCLE", F.slice(numbers, 1, 2)).otherwise(numbers)
        ranged = F.forall(
            F.transform(pairs, lambda x, i: F.when(i % 2 == 0, x.between(0.0, 360.0)).otherwise(x.between(-90.0, 90.0))), lambda ok: ok
        )
        r = F.get(numbers, F.lit(2))
        named = (
            F.when((kind == "CIRCLE") & (F.size(numbers) == 3) & (r > 0) & (r <= 180), F.lit("C"))
            .when((kind == "POLYGON") & (F.size(numbers) >= 6) & (F.size(numbers) % 2 == 0), F.lit("G"))
            .when((kind == "POSITION") & (F.size(numbers) == 2), F.lit("P"))
        )
        shape = lambda k: F.struct(k.alias("kind"), F.when(k == "G", _ring(numbers)).otherwise(numbers).alias("v"))
        return _let(named, lambda k: F.when(sane & ranged & k.isNotNull(), shape(k)))

    def kept(r: Column) -> Column:
        held = is_convex(r["v"]) if convex else F.lit(True)
        return F.when(r["kind"] != "G", r).when(F.size(r["v"]) < 6, F.lit(None)).when(held, r)

    # text, parts and numbers are worked out once a row, however often they are looked at
    return _let(_let(F.split(F.upper(F.trim(text)), r"\s+"), of), kept)


#: Radius in degrees of the polygon that stands for a position.
POSITION_RADIUS = 0.05 / 3600


def region_polygon(region: Column) -> Column:
    """A region as a polygon: a circle has 32 vertices, a position 8 at 0.05 seconds of arc."""

    def of(r: Column) -> Column:
        ra, dec, radius = (F.get(r["v"], F.lit(i)) for i in range(3))
        v = F.when(r["kind"] == "C", circle_vertices(ra, dec, radius, 32)).when(r["kind"] == "P", circle_vertices(ra, dec, POSITION_RADIUS, 8))
        return F.when(r["kind"].isin("C", "P"), F.struct(F.lit("G").alias("kind"), v.alias("v"))).otherwise(as_polygon(r))

    return _let(region, of)


#: Names of result columns that a query gives no name.
OUTPUT_NAMES = {
    "POINT": "adql_point", "CIRCLE": "circle", "POLYGON": "adql_polygon", "BOX": "adql_polygon", "AREA": "adql_area", "DISTANCE": "distance", "CENTROID": "centroid",
    "COUNT": "count",
}


def named(function: str, value: Column) -> Column:
    """``value`` under the name that a result of this function has by default, ``?column?`` if it has none."""
    return value.alias(OUTPUT_NAMES.get(function.upper(), "?column?"))


def circle_vertices(ra, dec, radius, n: int = 32) -> Column:
    """A circle as a polygon of n vertices, by bearing from north."""
    a, d, r = (F.radians(_column(x)) for x in (ra, dec, radius))
    fixed = F.array(a, F.sin(d), F.cos(d), F.sin(r), F.cos(r))

    def of(known: Column) -> Column:
        a, sin_d, cos_d, sin_r, cos_r = (F.get(known, F.lit(i)) for i in range(5))

        def vertex(i: Column) -> Column:
            bearing = i * (2 * math.pi / n)
            turn = lambda z: F.atan2(F.sin(bearing) * sin_r * cos_d, cos_r - sin_d * F.sin(z))
            at = lambda z: F.array(F.pmod(F.degrees(a + turn(z)), F.lit(360.0)), F.degrees(z))
            return _let(F.asin(sin_d * cos_r + cos_d * sin_r * F.cos(bearing)), at)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), vertex))

    return _let(fixed, of)


def propagate(ra, dec, parallax, pm_ra, pm_dec, radial_velocity, epoch, to_epoch) -> Column:
    """[ra, dec, parallax, pm_ra, pm_dec, radial velocity] at another epoch, by rigorous uniform motion in space.

    Angles in degrees, parallax in mas, proper motions in mas a year (ra with cos dec),
    velocity in km/s, epochs in Julian years. A null parallax means a remote source, a null
    motion or velocity none; without a parallax, parallax and velocity come out null.
    """
    mas = math.pi / 180 / 3_600_000
    a, d = F.radians(_column(ra)), F.radians(_column(dec))
    plx = F.coalesce(_column(parallax), F.lit(0.0)) * mas
    ma, md = (F.coalesce(_column(x), F.lit(0.0)) * mas for x in (pm_ra, pm_dec))
    # km/s to astronomical units a Julian year
    mr = F.coalesce(_column(radial_velocity), F.lit(0.0)) / 4.740470446 * plx
    t = _column(to_epoch) - _column(epoch)
    p = [-F.sin(a), F.cos(a), F.lit(0.0)]
    q = [-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d)]
    r = [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]
    m = [p[i] * ma + q[i] * md for i in range(3)]
    m2 = ma * ma + md * md
    f2 = 1 / (1 + 2 * mr * t + (m2 + mr * mr) * t * t)
    f = F.sqrt(f2)
    u = [(r[i] * (1 + mr * t) + m[i] * t) * f for i in range(3)]
    w = [(m[i] * (1 + mr * t) - r[i] * m2 * t) * f2 * f for i in range(3)]
    flat = F.sqrt(u[0] * u[0] + u[1] * u[1])
    a1, d1 = F.atan2(u[1], u[0]), F.atan2(u[2], flat)
    p1 = [-F.sin(a1), F.cos(a1), F.lit(0.0)]
    q1 = [-F.sin(d1) * F.cos(a1), -F.sin(d1) * F.sin(a1), F.cos(d1)]
    near = _column(parallax).isNotNull()
    rv = (mr + (m2 + mr * mr) * t) * f2 / (plx * f) * 4.740470446
    return F.array(
        F.pmod(F.degrees(a1), F.lit(360.0)),
        F.degrees(d1),
        F.when(near, plx * f / mas),
        reduce(Column.__add__, [p1[i] * w[i] for i in range(3)]) / mas,
        reduce(Column.__add__, [q1[i] * w[i] for i in range(3)]) / mas,
        F.when(near & (plx > 0), rv),
    )


def propagate_position(ra, dec, pm_ra, pm_dec, epoch, to_epoch) -> Column:
    """A position at another epoch, as a point, where neither parallax nor velocity is known."""
    return _let(propagate(ra, dec, None, pm_ra, pm_dec, None, epoch, to_epoch), lambda s: point(F.get(s, F.lit(0)), F.get(s, F.lit(1))))
