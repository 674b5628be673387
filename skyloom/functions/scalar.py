"""Scalar functions with the result types and edge cases of a PostgreSQL-backed service, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(bad: Column, value: Column, message: str) -> Column:
    """``value``, or an error where ``bad``; null stays null."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def integer_divide(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero; division by zero is an error."""
    return guarded(b == 0, F.call_function("div", a, b), "division by zero")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def natural_log(x: Column) -> Column:
    return guarded(x <= 0, F.ln(x), "cannot take logarithm of a number that is not positive")


def common_log(x: Column) -> Column:
    return guarded(x <= 0, F.log10(x), "cannot take logarithm of a number that is not positive")


def square_root(x: Column) -> Column:
    return guarded(x < 0, F.sqrt(x), "cannot take square root of a negative number")


def arc_cosine(x: Column) -> Column:
    return guarded(F.abs(x) > 1, F.acos(x), "input is out of range")


def arc_sine(x: Column) -> Column:
    return guarded(F.abs(x) > 1, F.asin(x), "input is out of range")


def exponential(x: Column) -> Column:
    return guarded(x > math.log(1.7976931348623157e308), F.exp(x), "value out of range: overflow")


#: From here on every double is a whole number.
WHOLE = float(1 << 53)


def _unless_whole(x: Column, cut: Column) -> Column:
    return F.when(F.abs(x) >= WHOLE, x.cast("double")).otherwise(cut.cast("double"))


def ceiling(x: Column) -> Column:
    return _unless_whole(x, F.ceil(x))


def floor(x: Column) -> Column:
    return _unless_whole(x, F.floor(x))


def round_to(x: Column, digits: int) -> Column:
    """A decimal to a number of digits, which may be negative, ties away from zero."""
    return F.round(x, digits)


def round_even(x: Column) -> Column:
    """To the nearest whole double, ties to even."""
    return F.bround(x, 0)


def truncate(x: Column, digits: int = 0) -> Column:
    scale = F.lit(float(10**digits))
    cut = F.signum(x) * F.floor(F.abs(x) * scale).cast("double") / scale
    # beyond that, no digit is left to cut
    return F.when(F.abs(x) >= WHOLE / 10**digits, x.cast("double")).otherwise(cut)


def cotangent(x: Column) -> Column:
    return F.cot(x)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def to_integer(x: Column, kind: str = "int") -> Column:
    """A double as an integer, rounded to the nearest, ties to even."""
    return F.bround(x, 0).cast(kind)


def to_char(x: Column, n: int) -> Column:
    """Text of exactly n characters, cut or filled with blanks."""
    return F.rpad(F.substring(x.cast("string"), 1, n), n, " ")


def to_varchar(x: Column, n: int) -> Column:
    """Text of at most n characters."""
    return F.substring(x.cast("string"), 1, n)


def percent_encode(text: Column) -> Column:
    """Text with all but unreserved characters as %XX of their UTF-8 bytes; plain texts are passed as they are."""
    one = lambda c: F.when(c.rlike(r"^[A-Za-z0-9._~-]$"), c).otherwise(
        F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    )
    return F.when(text.rlike(r"^[A-Za-z0-9._~-]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def keyed_random(seed: Column, number: Column, salt: Column) -> Column:
    """A number of 0 to 1 that depends on seed, number and salt alone, by the first 31 bits of the MD5 of seed:number:salt."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in (seed, number, salt)]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31))
