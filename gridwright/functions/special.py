"""Functions missing from Spark SQL, as column expressions, and scalar tail probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations of erf and erfc (1969), by range, highest power first.
_ERF_P = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03)
_ERF_Q = (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_MID_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
    8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
)
_MID_Q = (
    1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
    4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
_FAR_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_FAR_Q = (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
# P. J. Acklam's approximation of the normal quantile (2003), centre and tails, highest power first.
_CENTRE_P = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_Q = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_P = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_Q = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _poly(x: Column, c: Sequence[float]) -> Column:
    return reduce(lambda a, b: a * x + F.lit(b), c[1:], F.lit(c[0]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-15 of its value; null stays null."""

    def body(x):
        y, square = F.abs(x), x * x
        centre = F.lit(1.0) - x * _poly(square, _ERF_P) / _poly(square, _ERF_Q)
        middle = F.exp(-square) * _poly(y, _MID_P) / _poly(y, _MID_Q)
        small = F.lit(1.0) / square
        far = F.exp(-square) / y * (F.lit(1 / math.sqrt(math.pi)) - small * _poly(small, _FAR_P) / _poly(small, _FAR_Q))
        tail = F.when(y <= 4.0, middle).when(y < 27.0, far).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
        return F.when(F.isnan(x), x).when(y <= 0.46875, centre).otherwise(_let(tail, lambda t: F.when(x < 0, F.lit(2.0) - t).otherwise(t)))

    return _let(x.cast("double"), body)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution, by a rational approximation and one Halley step; null outside (0, 1)."""

    def tail(q):
        """Of the lower half."""
        r = q - F.lit(0.5)
        t = F.sqrt(F.lit(-2.0) * F.log(q))
        return F.when(q < _TAIL, _poly(t, _TAIL_P) / _poly(t, _TAIL_Q)).otherwise(r * _poly(r * r, _CENTRE_P) / _poly(r * r, _CENTRE_Q))

    def better(x, q):
        step = (F.lit(0.5) * erfc(-x / F.lit(math.sqrt(2.0))) - q) * F.lit(math.sqrt(2.0 * math.pi)) * F.exp(x * x / 2.0)
        return _let(step, lambda u: x - u / (F.lit(1.0) + x * u / 2.0))

    def body(p):
        q = F.when(p > 0.5, F.lit(1.0) - p).otherwise(p)
        half = _let(q, lambda q: _let(tail(q), lambda x: better(x, q)))
        return F.when((p > 0) & (p < 1), half * F.when(p > 0.5, -1.0).otherwise(1.0))

    return _let(p.cast("double"), body)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic: Simpson integration of the density in angle form."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    theta = math.atan(abs(t) / math.sqrt(df))
    steps = 2000
    h = (math.pi / 2 - theta) / steps
    total = 0.0
    for i in range(steps + 1):
        w = 1 if i in (0, steps) else (4 if i % 2 else 2)
        total += w * math.cos(min(theta + i * h, math.pi / 2)) ** (df - 1)
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2.0 * const * total * h / 3.0)
