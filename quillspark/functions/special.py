"""Special functions as column expressions: logarithm of gamma, incomplete beta, p-values of correlations."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turns of the continued fraction, after which it has converged to 1e-15 for arguments of up to some millions; it stops earlier where it can.
TURNS, CLOSE, TINY = 400, 1e-15, 1e-300
#: Coefficients of Stirling's series for ln gamma, in 1/x, 1/x**3 and so on.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8


def ln_gamma(x: Column) -> Column:
    """ln gamma of positive numbers: Stirling's series at x + 8, and the eight factors between taken off."""
    y = x + _SHIFT
    series = F.lit(0.0)
    for i, c in enumerate(_STIRLING):
        series = series + F.lit(c) / F.pow(y, F.lit(2 * i + 1))
    between = F.lit(0.0)
    for i in range(_SHIFT):
        between = between + F.ln(x + i)
    return (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + series - between


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for positive a and b; 0 up to x = 0 and 1 from x = 1 on, null for a null.

    A continued fraction (evaluated from its front, numerator and denominator as ratios) of x, or of 1 - x with a and b changed, whichever converges fast.
    """
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    given = F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), z.cast("double").alias("z"), swap.alias("swap"))
    out = F.transform(F.array(given), lambda g: _fraction(g["p"], g["q"], g["z"], g["swap"]))  # each argument is worked out once
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.get(out, F.lit(0)))


def _fraction(p: Column, q: Column, z: Column, swap: Column) -> Column:
    safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    front = F.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * F.ln(z) + q * F.ln(1 - z)) / p

    def half(s: Column, coefficient: Column) -> Column:
        d = 1 / safe(1 + coefficient * s["d"])
        c = safe(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), (F.abs(d * c - 1) < CLOSE).alias("done"))

    def turn(s: Column, m: Column) -> Column:
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        both = F.get(F.transform(F.array(half(s, even)), lambda t: half(t, odd)), F.lit(0))
        return F.when(s["done"], s).otherwise(both)

    d = 1 / safe(1 - (p + q) * z / (p + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    value = front * F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), begin, turn, lambda s: s["h"])
    return F.when(swap, 1 - value).otherwise(value)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs, by the t distribution with n - 2 degrees of freedom; null for fewer than three pairs or an unknown r."""
    return F.when(n > 2, incomplete_beta((n - 2) / 2.0, F.lit(0.5), 1 - r * r))
