"""Logarithms of factorials and the hypergeometric tail as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_factorial(n: Column) -> Column:
    """ln(n!) of a whole number n >= 0."""
    x = n.cast("double")
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (x + i)
    t = x + 7.5
    return F.lit(0.9189385332046727) + (x + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(observed: Column, pool: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= observed) where drawn of pool are taken without replacement and marked of pool count.

    1 where observed <= 0, 0 where it can't be reached; drawn is at most pool. Terms are
    added from the one nearest to the mean outward, on the side that doesn't hold the
    mean, each from the one before. By Bernstein's bound those further away than nine
    standard deviations and 100 add less than 1e-17 in all, so no more are taken.
    """
    n = F.least(drawn, pool)
    lo, hi = F.greatest(observed, n + marked - pool, F.lit(0)), F.least(n, marked)
    share = marked / F.greatest(pool, F.lit(1))
    sd = F.sqrt(n * share * (1 - share))
    most = (F.ceil(9 * sd) + 100).cast("bigint")
    term = lambda i: F.exp(log_choose(marked, i) + log_choose(pool - marked, n - i) - log_choose(pool, n))
    up = lambda i: (marked - i) * (n - i).cast("double") / ((i + 1) * (pool - marked - n + i + 1).cast("double"))
    down = lambda i: i * (pool - marked - n + i).cast("double") / ((marked - i + 1) * (n - i + 1).cast("double"))

    def added(first, steps, ratio):
        start = F.struct(term(first).alias("t"), term(first).alias("s"))

        def step(a, i):
            t = a["t"] * ratio(i)
            return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

        return F.aggregate(steps, start, step)["s"]

    nothing = F.array().cast("array<bigint>")
    last = F.least(hi, lo + most) - 1
    upper = added(lo, F.when(last >= lo, F.sequence(lo.cast("bigint"), last.cast("bigint"))).otherwise(nothing), up)
    below, floor = lo - 1, F.greatest(n + marked - pool, F.lit(0))
    stop = F.greatest(floor, below - most) + 1
    lower = F.when(below < floor, 0.0).otherwise(added(below, F.when(below >= stop, F.sequence(below.cast("bigint"), stop.cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(nothing), down))
    tail = F.when(lo > n * share, upper).otherwise(1.0 - lower)
    return F.when(observed <= 0, 1.0).when(lo > hi, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
