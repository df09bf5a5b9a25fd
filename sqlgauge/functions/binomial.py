"""Binomial probabilities and quantiles as column expressions, at a cost that hardly depends on the number of trials.

The distribution function is a regularised incomplete beta function, by its continued fraction; next to the ends of a 95 %
interval that takes about 70 steps for a thousand trials and for 10^11. The quantile is found by bisection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions.text import with_value

#: Rounds of so many steps each; a fraction that has converged passes the rest untouched.
_ROUNDS = 256
_PRECISION = 1e-15
_HALVINGS = 64


def _stirling_error(x: Column) -> Column:
    """ln x! less Stirling's formula, for whole x from 1 on."""
    small = F.aggregate(F.sequence(F.lit(1), x.cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    small = small - (x + 0.5) * F.log(x) + x - F.lit(0.5 * math.log(2 * math.pi))
    square = x * x
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / square) / square) / square) / square) / x
    return F.when(x < 16, small).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without the loss of digits near the mean."""
    return with_value((x - mean) / mean, lambda r: mean * ((r + 1) * F.log1p(r) - r))


def probability(j: Column, n: Column, k: Column) -> Column:
    """Of exactly j hits in n trials with chance k / n, 0 < k < n. All are doubles of whole numbers."""
    log = (
        _stirling_error(n) - _stirling_error(j) - _stirling_error(n - j) - _deviance(j, k) - _deviance(n - j, n - k)
    )
    inside = F.sqrt(n / (j * (n - j) * (2 * math.pi))) * F.exp(log)
    return F.when(j == 0, F.exp(n * F.log1p(-k / n))).when(j == n, F.exp(n * F.log(k / n))).otherwise(inside)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function."""
    state = lambda m, c, d, h, done: F.struct(
        m.alias("m"), c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done")
    )
    one = F.lit(1.0)

    def step(s: Column, _: Column) -> Column:
        m, twice = s["m"], s["m"] * 2
        even = m * (b - m) * x / ((a - 1 + twice) * (a + twice))
        odd = -(a + m) * (a + b + m) * x / ((a + twice) * (a + 1 + twice))
        half = with_value(
            F.struct((one / (one + even * s["d"])).alias("d"), (one + even / s["c"]).alias("c")),
            lambda t: with_value(
                F.struct((one / (one + odd * t["d"])).alias("d"), (one + odd / t["c"]).alias("c"), (t["d"] * t["c"]).alias("before")),
                lambda v: state(
                    m + 1, v["c"], v["d"], s["h"] * v["before"] * v["d"] * v["c"], F.abs(v["d"] * v["c"] - 1) < F.lit(_PRECISION)
                ),
            ),
        )
        return F.when(s["done"], s).otherwise(half)

    steps = F.sequence(F.lit(1), F.lit(_ROUNDS))
    first = one / (one - (a + b) * x / (a + 1))
    start = state(one, one, first, first, F.lit(False))
    return F.aggregate(steps, start, lambda s, _: F.when(s["done"], s).otherwise(F.aggregate(steps, s, step)), lambda s: s["h"])


def at_most(j: Column, n: Column, k: Column) -> Column:
    """The chance of at most j hits, 0 <= j < n."""
    p, q = k / n, (n - k) / n
    lower = p * probability(j, n, k) * _fraction(n - j, j + 1, q)
    upper = F.lit(1.0) - q * probability(j + 1, n, k) * _fraction(j + 1, n - j, p)
    return F.when(q < (n - j + 1) / (n + 3), lower).otherwise(upper)


def quantile(u: Column, n: Column, k: Column) -> Column:
    """The smallest number of hits whose chance, with all below it, reaches u: in n trials with chance k / n."""
    n, k = n.cast("double"), k.cast("double")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("double")
        reached = with_value(middle, lambda j: F.struct(j.alias("j"), (at_most(j, n, k) >= u).alias("reached")))
        moved = with_value(
            reached,
            lambda r: F.struct(
                F.when(r["reached"], s["low"]).otherwise(r["j"]).alias("low"), F.when(r["reached"], r["j"]).otherwise(s["high"]).alias("high")
            ),
        )
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(moved)

    start = F.struct(F.lit(-1.0).alias("low"), n.alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), start, halve, lambda s: s["high"])
    return F.when((k == 0) | (k == n), k).otherwise(found)
