"""HEALPix cells in NESTED order, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.sky import _column, _let, point

#: Row and column of the base cells' lowest corners.
ROWS = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
COLUMNS = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: Shifts and masks that spread the bits of a number.
MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _mixed(move, shift: int, mask: int):
    """A number and itself moved, under the mask."""
    return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(F.lit(mask))


def _spread(x: Column) -> Column:
    """The bits of x, 32 at most, at the even places."""
    for shift, mask in MASKS:
        x = _let(x, _mixed(F.shiftleft, shift, mask))
    return x


def _gather(x: Column) -> Column:
    """The bits of x at the even places, side by side."""
    x = x.bitwiseAND(F.lit(MASKS[-1][1]))
    for (shift, _), (_, mask) in zip(MASKS[::-1], [*MASKS[-2::-1], (32, 0xFFFFFFFF)], strict=True):
        x = _let(x, _mixed(F.shiftrightunsigned, shift, mask))
    return x


def _of(struct_of: dict[str, Column], body) -> Column:
    """``body`` of named values that are worked out once."""
    return _let(F.struct(*[v.alias(k) for k, v in struct_of.items()]), body)


def healpix_index(order: int, lon, lat) -> Column:
    """The cell of a position in degrees at a fixed order (0 to 29)."""
    side = 1 << order

    def placed(p: Column) -> Column:
        z, tt = p["z"], p["tt"]
        # belt about the equator
        up, shift = side * (0.5 + tt), side * z * 0.75
        # caps about the poles
        turn = F.least(F.floor(tt), F.lit(3)).cast("long")
        reach = side * F.sqrt(3 * (1 - F.abs(z)))
        return _of(
            {
                "belt": F.abs(z) <= 2 / 3, "north": z >= 0, "jp": F.floor(up - shift).cast("long"), "jm": F.floor(up + shift).cast("long"), "turn": turn,
                "kp": F.least(F.floor((tt - turn) * reach).cast("long"), F.lit(side - 1)), "km": F.least(F.floor((1 - tt + turn) * reach).cast("long"), F.lit(side - 1)),
            },
            cell,
        )

    def cell(c: Column) -> Column:
        fp, fm = F.floor(c["jp"] / F.lit(side)), F.floor(c["jm"] / F.lit(side))
        face_belt = F.when(fp == fm, (fp % 4) + 4).when(fp < fm, fp % 4).otherwise((fm % 4) + 8)
        face = F.when(c["belt"], face_belt).otherwise(F.when(c["north"], c["turn"]).otherwise(c["turn"] + 8)).cast("long")
        x = F.when(c["belt"], F.pmod(c["jm"], F.lit(side))).otherwise(F.when(c["north"], F.lit(side - 1) - c["km"]).otherwise(c["kp"]))
        y = F.when(c["belt"], F.lit(side - 1) - F.pmod(c["jp"], F.lit(side))).otherwise(F.when(c["north"], F.lit(side - 1) - c["kp"]).otherwise(c["km"]))
        return face * F.lit(side * side) + _spread(x.cast("long")) + 2 * _spread(y.cast("long"))

    return _of({"z": F.sin(F.radians(_column(lat))), "tt": F.pmod(_column(lon), F.lit(360.0)) / 90.0}, placed)


def healpix_index_of(order: int, region: Column) -> Column:
    """The cell of a point, or of a circle's centre."""
    return _let(region, lambda r: healpix_index(order, F.get(r["v"], F.lit(0)), F.get(r["v"], F.lit(1))))


def healpix_center(order: int, index) -> Column:
    """The centre of a cell, as a point."""
    side = 1 << order
    index = (index if isinstance(index, Column) else F.lit(int(index))).cast("long")

    def inner(i: Column) -> Column:
        face = F.shiftright(i, 2 * order).cast("int")
        rest = i.bitwiseAND(F.lit(side * side - 1))
        rows, cols = F.get(F.array(*map(F.lit, ROWS)), face), F.get(F.array(*map(F.lit, COLUMNS)), face)
        return _of({"x": _gather(rest), "y": _gather(F.shiftright(rest, 1)), "rows": rows, "cols": cols}, ringed)

    def ringed(p: Column) -> Column:
        return _of({"ring": p["rows"] * F.lit(side) - p["x"] - p["y"] - 1, "turn": p["x"] - p["y"] + 1, "cols": p["cols"]}, numbered)

    def numbered(p: Column) -> Column:
        ring = p["ring"]
        north, south = ring < side, ring > 3 * side
        n = F.when(north, ring).when(south, 4 * side - ring).otherwise(F.lit(side))
        odd = F.when(north | south, F.lit(0).cast("long")).otherwise(F.pmod(ring - side, F.lit(2)))
        return _of({"north": north, "south": south, "n": n, "odd": odd, "ring": ring, "turn": p["turn"], "cols": p["cols"]}, centred)

    def centred(p: Column) -> Column:
        n, odd, polar = p["n"], p["odd"], p["north"] | p["south"]
        cap = n * n / F.lit(3.0 * side * side)
        z = F.when(p["north"], 1 - cap).when(p["south"], cap - 1).otherwise((2 * side - p["ring"]) * (2.0 / (3 * side)))
        place = _let(
            F.floor((p["cols"] * n + p["turn"] + odd) / 2), lambda k: F.when(k > 4 * n, k - 4 * n).when(k < 1, k + 4 * n).otherwise(k)
        )
        lon = F.pmod((place - (odd + 1) * 0.5) * 90.0 / n, F.lit(360.0))
        return _of({"z": z, "cap": cap, "polar": polar, "lon": lon}, pointed)

    def pointed(p: Column) -> Column:
        rest = F.when(p["polar"], F.sqrt(p["cap"] * (2 - p["cap"]))).otherwise(F.sqrt(1 - p["z"] * p["z"]))
        return point(p["lon"], F.degrees(F.atan2(p["z"], rest)))

    return _let(index, inner)


def cell_width(order: int) -> float:
    """Degrees of a cell's side, about."""
    return math.degrees(math.sqrt(math.pi / 3) / (1 << order))
