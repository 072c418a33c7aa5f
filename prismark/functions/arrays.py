"""Expressions over ARRAY<DOUBLE> columns; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once per row, also if use refers to it inside a lambda over an array."""
    return F.get(F.transform(F.array(value), use), 0)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with inf and NaN where ANSI mode would raise."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    at_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(b != 0, a / b).otherwise(at_zero)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return ieee_div(total(x), F.size(x).cast("double"))


def spread(x: Column, centre: Column) -> Column:
    """Population standard deviation around a centre that is already bound."""
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre))
    return F.sqrt(ieee_div(squares, F.size(x).cast("double")))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def percentile(x: Column, percent: float) -> Column:
    """Linearly interpolated between the sorted values, as exact percentiles are."""

    def at(s: Column) -> Column:
        h = (F.size(s["v"]) - 1) * F.lit(percent / 100.0)
        low = F.floor(h).cast("int")
        a, b = F.get(s["v"], low), F.get(s["v"], F.ceil(h).cast("int"))
        return a + (b - a) * (h - low)

    return let(F.struct(F.array_sort(x).alias("v")), at)


def positions(x: Column) -> Column:
    """0 .. size - 1; empty for an empty array."""
    return F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))


def mapped(i: Column, n: Column, mode: str) -> Column:
    """The place inside 0 .. n - 1 that a place outside stands for; null for `constant`."""
    if mode in ("nearest", "grid-constant-nearest"):
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if mode in ("wrap", "grid-wrap"):
        return F.pmod(i, n)
    if mode in ("reflect", "grid-mirror"):
        k = F.pmod(i, 2 * n)
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    if mode == "mirror":
        k = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
        return F.when(k < n, k).otherwise(2 * n - 2 - k)
    if mode in ("constant", "grid-constant"):
        return F.when((i >= 0) & (i < n), i)
    raise ValueError(f"unknown mode {mode!r}")


def padded(x: Column, left: int, right: int, mode: str, value: float = 0.0) -> Column:
    """x with left and right more values at its ends, as the mode has them."""

    def build(s: Column) -> Column:
        n = F.size(s["x"])
        at = F.sequence(F.lit(-left), n - 1 + right)
        return F.transform(at, lambda i: F.coalesce(F.get(s["x"], mapped(i, n, mode)), F.lit(float(value))))

    return let(F.struct(x.alias("x")), build)


def windows(x: Column, left: int, right: int, mode: str, reduce: Callable[[Column], Column]) -> Column:
    """reduce(window) for the window i - left .. i + right around each place i."""
    full = padded(x, left, right, mode)

    def each(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(s["p"]) - left - right)
        return F.transform(places, lambda i: reduce(F.slice(s["p"], i, left + right + 1)))

    return let(F.struct(full.alias("p")), each)
