"""Complex numbers as pairs of double columns, and the scalar measures of S-parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Hertz of each display unit.
UNITS = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}
EPS = 1e-12

Pair = tuple[Column, Column]


def scale_of(unit: str) -> float:
    try:
        return UNITS[unit.lower()]
    except KeyError:
        raise ValueError(f"unknown frequency unit {unit!r}") from None


def mag(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def db(re: Column, im: Column, eps: float = 0.0) -> Column:
    """20 log10(|s| + eps); minus infinity at zero, where Spark's logarithm would be null."""
    size = mag(re, im) + eps if eps else mag(re, im)
    return F.when(size == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(size))


def deg(re: Column, im: Column) -> Column:
    """Wrapped phase in degrees."""
    return F.degrees(F.atan2(im, re))


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def turn(theta: Column) -> Pair:
    """e^(j theta)."""
    return F.cos(theta), F.sin(theta)


def div(a: Pair, b: Pair) -> Pair:
    """a / b; null where b is zero."""
    size = b[0] * b[0] + b[1] * b[1]
    re, im = mul(a, (b[0], -b[1]))
    return F.try_divide(re, size), F.try_divide(im, size)


def undo(value: Column, part: str) -> Column:
    """The amplitude or phase in radians that a ``mag``, ``db`` or ``deg`` value stands for."""
    return {"mag": value, "db": F.pow(F.lit(10.0), value / 20), "deg": F.radians(value)}.get(part, value)


def no_nan(value: Column) -> Column:
    """NaN as null, for aggregates that are to pass it over."""
    return F.when(~F.isnan(value), value)


def axial_ratio(c: Pair, d: Pair, in_db: bool = True) -> Column:
    """|tan(asin(2CD sin(A-B) / (C^2+D^2)) / 2)| of amplitudes C, D and phases A, B; NaN where both are zero."""
    size_c, size_d = mag(*c), mag(*d)
    # 2 C D sin(A - B) is twice the cross product of the two numbers.
    cross = 2 * (d[0] * c[1] - d[1] * c[0])
    ratio = F.try_divide(cross, size_c * size_c + size_d * size_d)
    value = F.abs(F.tan(F.asin(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0))) / 2))
    if in_db:
        value = F.when(value == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(value))
    return F.coalesce(value, F.lit(NAN))


def close(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= tol


TWO_PI = 2 * math.pi
