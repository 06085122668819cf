"""Spreadsheet arithmetic as Column builders. Where a sheet shows an error, the value is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shift(digits: int) -> Column:
    return F.lit(float(10**abs(digits)))


def _scaled(x: Column, digits: int, how) -> Column:
    p = _shift(digits)
    return how(x * p) / p if digits >= 0 else how(x / p) * p


def toward_zero(x: Column, digits: int = 0) -> Column:
    """TRUNC and ROUNDDOWN."""
    return F.signum(x) * _scaled(F.abs(x), digits, F.floor)


def away_from_zero(x: Column, digits: int = 0) -> Column:
    """ROUNDUP."""
    return F.signum(x) * _scaled(F.abs(x), digits, F.ceil)


def ceiling(x: Column, step: float) -> Column:
    return F.ceil(x / F.lit(step)) * F.lit(step)


def floor(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step)) * F.lit(step)


def mround(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step) + F.lit(0.5)) * F.lit(step)


def even(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def odd(x: Column) -> Column:
    n = F.ceil((F.abs(x) - 1) / 2) * 2 + 1
    return F.when(x == 0, F.lit(1)).otherwise(F.signum(x) * F.greatest(n, F.lit(1)))


def mod(a: Column, b: Column) -> Column:
    """The sign of the divisor; null for zero."""
    return F.when(b != 0, a - b * F.floor(a / b))


def quotient(a: Column, b: Column) -> Column:
    return F.when(b != 0, toward_zero(a / b))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm on two non-negative whole numbers, at most 64 steps."""
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), F.try_mod(s.x, s.y).alias("y")))
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s.x)


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((a.cast("long") / gcd(a, b) * b.cast("long")).cast("long"))


def product_of(start: Column, end: Column) -> Column:
    """Product of the whole numbers from start to end; 1 if there are none."""
    numbers = F.when(start <= end, F.sequence(start.cast("int"), end.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, F.lit(1.0), lambda a, x: a * x)


def fact(n: Column) -> Column:
    return product_of(F.lit(2), n)


def permut(n: Column, k: Column) -> Column:
    return F.when(k <= n, product_of(n - k + 1, n))


def combin(n: Column, k: Column) -> Column:
    return permut(n, k) / fact(k)


def multinomial(*counts: Column) -> Column:
    """Ways to deal out the sum of the counts into groups of these sizes."""
    total, out = counts[0].cast("long"), F.lit(1.0)
    for c in counts[1:]:
        total = total + c
        out = out * combin(total, c)
    return out


def factdouble(n: Column) -> Column:
    """Product of every other number down from n."""
    steps = F.sequence(F.lit(0), F.floor(F.greatest(n, F.lit(1)) / 2).cast("int"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * F.greatest(n - 2 * i, F.lit(1)))


def munit(n: Column) -> Column:
    """The unit matrix, by rows."""
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(places, lambda j: (i == j).cast("int")))


def atan2_xy(x: Column, y: Column) -> Column:
    """Sheets take x first."""
    return F.atan2(y, x)


def to_base(n: Column, base: int, places: int | None = None) -> Column:
    out = F.conv(n.cast("string"), 10, base)
    return out if places is None else F.when(F.length(out) <= places, F.lpad(out, places, "0"))


def from_base(s: Column, base: int) -> Column:
    return F.conv(s, base, 10).cast("long")
