"""Arithmetic that keeps IEEE semantics (x/0, ln 0) and interpolation weights, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero: what queries return."""
    return F.round(c, 6) + F.lit(0.0)


def valid(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def known(c: Column | str) -> Column:
    """NaN becomes null, so that aggregates leave it out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(valid(c), c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b as in IEEE arithmetic: infinity or NaN where b is 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(b.isNotNull() & a.isNotNull(), F.lit(NAN))


def safe_ln(c: Column) -> Column:
    return F.when(F.isnan(c) | (c < 0), F.lit(NAN)).when(c == 0, F.lit(-INF)).otherwise(F.ln(c))


def clamp(c: Column, low: float, high: float) -> Column:
    """NaN stays NaN."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def horner(x: Column, *coefficients: float) -> Column:
    """Polynomial, highest power first."""
    out = F.lit(float(coefficients[0]))
    for k in coefficients[1:]:
        out = out * x + F.lit(float(k))
    return out


#: Coefficients (highest power first) of each tap's weight as a polynomial of the fraction f between two grid points.
#: Linear, Catmull-Rom and uniform cubic B-spline bases with their derivatives.
LINEAR = [(-1, 1), (1, 0)]
LINEAR_D = [(-1,), (1,)]
CATMULL_ROM = [(-0.5, 1, -0.5, 0), (1.5, -2.5, 0, 1), (-1.5, 2, 0.5, 0), (0.5, -0.5, 0, 0)]
CATMULL_ROM_D = [(-1.5, 2, -0.5), (4.5, -5, 0), (-4.5, 4, 0.5), (1.5, -1, 0)]
B_SPLINE = [(-1 / 6, 1 / 2, -1 / 2, 1 / 6), (1 / 2, -1, 0, 2 / 3), (-1 / 2, 1 / 2, 1 / 2, 1 / 6), (1 / 6, 0, 0, 0)]
B_SPLINE_D = [(-1 / 2, 1, -1 / 2), (3 / 2, -2, 0), (-3 / 2, 1, 1 / 2), (1 / 2, 0, 0)]
B_SPLINE_D2 = [(-1, 1), (3, -2), (-3, 1), (1, 0)]


def b_spline(x: Column) -> Column:
    """Cubic B-spline of a distance."""
    a = F.abs(x)
    return F.when(a < 1, 2 / 3 + (a / 2 - 1) * a * a).when(a < 2, -F.pow(a - 2, F.lit(3.0)) / 6).otherwise(F.lit(0.0))


def b_spline_slope(x: Column) -> Column:
    a, sign = F.abs(x), F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(a < 1, sign * (1.5 * a - 2) * a).when(a < 2, -sign * 0.5 * (2 - a) * (2 - a)).otherwise(F.lit(0.0))


def half_away(c: Column) -> Column:
    """Rounded to whole numbers, halves away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def truncated(c: Column, low: float, high: float) -> Column:
    """Clamped to an element type's range, then cut toward zero."""
    v = clamp(c, low, high)
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def whole(c: Column) -> Column:
    """Cut toward zero, whatever the size: NaN, infinities and null stay, as do values too large to have a fraction."""
    return F.when(F.abs(c) < 2.0**53, F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")).otherwise(c)
