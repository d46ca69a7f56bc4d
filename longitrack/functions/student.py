"""Student's t distribution as column expressions, by the regularised incomplete beta function."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Terms of the series for the gamma ratio, which is good to 1e-13 from this argument on.
SERIES_FROM = 16
NEWTON_STEPS = 10
# Terms of the continued fraction: with one parameter of 1/2 it is exact to rounding after 50 at every number of degrees.
TERMS = 100
TINY = 1e-300


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma_ratio(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0: an asymptotic series, moved up by recurrence."""
    far = a + SERIES_FROM
    series = 0.5 * F.log(far) - 1 / (8 * far) + 1 / (192 * far * far * far) - 1 / (640 * F.pow(far, F.lit(5.0)))
    steps = F.sequence(F.lit(0), F.lit(SERIES_FROM - 1))
    return series + F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.log((a + i) / (a + i + 0.5)))


def _fraction(x: Column, p: Column, q: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's method, for x below (p + 1) / (p + q + 2)."""

    def kept(value: Column) -> Column:
        return F.when(F.abs(value) < TINY, F.lit(TINY)).otherwise(value)

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def stepped(old: Column, term: Column) -> Column:
        return _let(state(kept(1 + term / old["c"]), 1 / kept(1 + term * old["d"]), old["h"]),
                    lambda s: state(s["c"], s["d"], s["h"] * s["c"] * s["d"]))

    def both(old: Column, m: Column) -> Column:
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        return stepped(stepped(old, even), odd)

    first = 1 / kept(1 - (p + q) * x / (p + 1))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda m: m.cast("double")), state(F.lit(1.0), first, first), both)["h"]


def two_sided_p(t: Column, degrees: Column) -> Column:
    """Probability that Student's t with ``degrees`` of freedom lies farther from 0 than ``t``.

    It is the regularised incomplete beta function at d / (d + t^2) with parameters d / 2 and 1 / 2. An
    infinite ``t`` gives 0; null, and degrees below 1, give null.
    """
    d, square = degrees.cast("double"), t * t
    args = F.struct((d / (d + square)).alias("x"), (square / (d + square)).alias("y"), (d / 2).alias("a"))

    def beta(v: Column) -> Column:
        x, y, a = v["x"], v["y"], v["a"]
        half = F.lit(0.5)
        direct = x < (a + 1) / (a + 2.5)
        log_front = a * F.log1p(-y) + 0.5 * F.log(y) + log_gamma_ratio(a) - 0.5 * math.log(math.pi)
        picked = F.struct(F.when(direct, x).otherwise(y).alias("x"), F.when(direct, a).otherwise(half).alias("p"), F.when(direct, half).otherwise(a).alias("q"))
        part = _let(picked, lambda k: F.exp(log_front) * _fraction(k["x"], k["p"], k["q"]) / k["p"])
        return F.when(y <= 0, 1.0).when(x <= 0, 0.0).otherwise(_let(part, lambda i: F.when(direct, i).otherwise(1 - i)))

    infinite = F.abs(t) == float("inf")
    return F.when(infinite & (d >= 1), 0.0).when((d >= 1) & ~infinite, _let(args, beta))


def density(t: Column, degrees: Column) -> Column:
    """Density of Student's t."""
    d = degrees.cast("double")
    return F.exp(log_gamma_ratio(d / 2) - 0.5 * F.log(d * math.pi) - (d + 1) / 2 * F.log1p(t * t / d))


def critical_value(degrees: Column, alpha: float) -> Column:
    """The t with a two-sided probability of ``alpha``; null below one degree of freedom.

    Newton's method from the normal quantile, on the logarithm of the probability over that of t: heavy tails are
    straight lines there, and light ones close to the start.
    """
    start = NormalDist().inv_cdf(1 - alpha / 2)

    def step(t: Column, _: Column) -> Column:
        def moved(now: Column, p: Column) -> Column:
            return now * F.exp((F.log(p) - math.log(alpha)) * p / (2 * density(now, degrees) * now))

        return _let(t, lambda now: _let(two_sided_p(now, degrees), lambda p: moved(now, p)))

    return F.when(degrees >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(float(start)), step))
