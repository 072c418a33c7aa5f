"""Random variation of spectra for training.

Draws are keyed by (random_state, row key, replicate), so an augmented table is the same on any partitioning. The row key
is a column (keyCol, by default id); replicateCol, if given, sets replicates of one spectrum apart.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions import linear, random_draws
from prismark.functions.arrays import let
from prismark.operators.base import SpectralTransformer, by_batch


class Augmenter(SpectralTransformer):
    params_ = {"random_state": 0, "keyCol": "id", "replicateCol": None}

    def key(self, *more: Column) -> list[Column]:
        replicate = self.value("replicateCol")
        return [F.lit(int(self.value("random_state"))), F.col(self.value("keyCol")), F.col(replicate) if replicate else F.lit(0), *more]

    def uniform(self, low: float, high: float) -> Column:
        """One draw per row."""
        return F.lit(low) + (random_draws.uniform(*self.key())) * F.lit(high - low)


def replicated(df: DataFrame, times: int, column: str = "replicate") -> DataFrame:
    """Each row `times` times, numbered from 0."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


class AddNoise(Augmenter):
    """x + N(0, scale), x + Poisson(x) * scale, or x + Exp(mean scale), drawn for each point."""

    params_ = {"distribution": "gaussian", "scale": 0.0}

    def column(self, x: Column) -> Column:
        kind, scale = self.value("distribution"), F.lit(float(self.value("scale")))
        if kind == "gaussian":
            return F.transform(x, lambda v, i: v + random_draws.gaussian(*self.key(i)) * scale)
        if kind == "exponential":
            return F.transform(x, lambda v, i: v + random_draws.exponential(*self.key(i)) * scale)
        if kind == "poisson":
            draws = F.transform(x, lambda v, i: random_draws.uniform(F.lit("u"), *self.key(i)))
            return by_batch(functools.partial(_poisson, scale=float(self.value("scale"))), x, draws)
        raise ValueError(f"distribution must be gaussian, poisson or exponential, not {kind!r}")


def _poisson(x: np.ndarray, draws: np.ndarray, scale: float) -> np.ndarray:
    return x + linear.poisson_quantile(draws, x) * scale


class BaselineShift(Augmenter):
    """x + U(0, scale), one draw per row."""

    params_ = {"scale": 0.0}

    def column(self, x: Column) -> Column:
        return let(F.struct(x.alias("x"), self.uniform(0.0, float(self.value("scale"))).alias("u")), lambda s: F.transform(s["x"], lambda v: v + s["u"]))


class SpectrumScale(Augmenter):
    """x * U(1 - scale, 1 + scale), one draw per row."""

    params_ = {"scale": 0.0}

    def column(self, x: Column) -> Column:
        scale = float(self.value("scale"))
        return let(F.struct(x.alias("x"), self.uniform(1 - scale, 1 + scale).alias("u")), lambda s: F.transform(s["x"], lambda v: v * s["u"]))


class IndexShift(Augmenter):
    """A whole number of places from -shift to shift; positive ones move to the right."""

    params_ = {"shift": 0, "padding_mode": "linear", "pad_value": 0.0}

    def drawn(self) -> Column:
        n = int(self.value("shift"))
        return F.floor(random_draws.uniform(*self.key()) * (2 * n + 1)).cast("int") - n

    def column(self, x: Column) -> Column:
        mode, pad = self.value("padding_mode"), F.lit(float(self.value("pad_value")))
        if mode not in ("wrap", "zeros", "constant", "extend", "mirror", "linear"):
            raise ValueError(f"unknown padding_mode {mode!r}")

        def moved(s: Column) -> Column:
            n, by, v = F.size(s["x"]), s["by"], s["x"]
            from_ = lambda i: F.get(v, i)
            if mode == "wrap":
                return F.transform(v, lambda _, i: from_(F.pmod(i - by, n)))
            inside = lambda i: (i - by >= 0) & (i - by < n)
            if mode == "zeros":
                return F.transform(v, lambda _, i: F.when(inside(i), from_(i - by)).otherwise(F.lit(0.0)))
            if mode == "constant":  # also where the spectrum itself is zero
                zero = lambda y: F.when(F.abs(y) < 1e-10, pad).otherwise(y)
                return F.transform(v, lambda _, i: F.when(inside(i), zero(from_(i - by))).otherwise(pad))
            if mode == "extend":
                return F.transform(v, lambda _, i: from_(F.greatest(F.lit(0), F.least(i - by, n - 1))))
            if mode == "mirror":  # on the left the edge is repeated, on the right it is not
                return F.transform(v, lambda _, i: F.when(inside(i), from_(i - by)).when(by > 0, from_(by - 1 - i)).otherwise(from_(2 * n - 2 - i + by)))
            # linear: regression over the |by| + 1 points at the edge
            k = F.abs(by) + 1
            edge = F.when(by > 0, F.slice(v, 1, k)).otherwise(F.slice(v, F.greatest(n - k + 1, F.lit(1)), k))

            def lined(t: Column) -> Column:
                m = F.size(t["e"]).cast("double")
                mean_i, mean_e = (m - 1) / 2, F.aggregate(t["e"], F.lit(0.0), lambda a, y: a + y) / m
                return F.struct(mean_i.alias("mi"), mean_e.alias("me"), t["e"].alias("e"), (m * (m * m - 1) / 12).alias("sii"))

            line = let(F.struct(edge.alias("e")), lambda t: let(lined(t), lambda u: F.struct(u["mi"].alias("mi"), u["me"].alias("me"), F.when(u["sii"] > 0, F.aggregate(F.transform(u["e"], lambda y, i: (i - u["mi"]) * (y - u["me"])), F.lit(0.0), lambda a, y: a + y) / u["sii"]).otherwise(F.lit(0.0)).alias("b"))))
            # Right of the end, places count on from the edge's first point.
            place = lambda i: F.when(by > 0, i - by).otherwise(i - by - n + k)
            return let(F.struct(v.alias("x"), line.alias("l")), lambda t: F.transform(t["x"], lambda _, i: F.when(inside(i), from_(i - by)).otherwise(t["l"]["me"] + t["l"]["b"] * (place(i) - t["l"]["mi"]))))

        return let(F.struct(x.alias("x"), self.drawn().alias("by")), moved)


class FractionalShift(Augmenter):
    """A shift from U(-shift, shift) by cubic spline; positive ones move to the left."""

    params_ = {"shift": 0.0, "padding_mode": "linear", "pad_value": 0.0}

    def column(self, x: Column) -> Column:
        mode, shift = self.value("padding_mode"), float(self.value("shift"))
        if mode not in ("zeros", "constant", "extend", "mirror", "linear"):
            raise ValueError(f"unknown padding_mode {mode!r}")
        return by_batch(functools.partial(fractional_shift, mode=mode, pad=float(self.value("pad_value"))), x, self.uniform(-shift, shift))


def fractional_shift(x: np.ndarray, shifts: np.ndarray, mode: str, pad: float) -> np.ndarray:
    """All rows at once: the spline through each row at its shifted places, then what is padded at the end that was moved in."""
    n = x.shape[1]
    moved = np.arange(n) + shifts[:, None]
    y = linear.unit_spline(x, moved)
    leftwards = (shifts < 0)[:, None]
    outside = np.where(leftwards, moved < 0, moved >= n - 1)
    if mode in ("zeros", "constant"):
        return np.where((moved < 0) | (moved >= n - 1), pad if mode == "constant" else 0.0, y)
    if mode == "linear":  # beyond the last place only; up to one place the spline goes on
        outside = np.where(leftwards, moved < 0, moved >= n)
    m = outside.sum(axis=1, keepdims=True)
    into = np.where(leftwards, np.arange(n) - m, np.arange(n) - (n - m))  # places before the first, or after those that stay
    if mode == "extend":
        padding = np.where(leftwards, x[:, :1], x[:, -1:])
    elif mode == "mirror":
        at = np.where(leftwards, -1 - into, n - 2 - into)
        padding = np.take_along_axis(x, np.clip(at, 0, n - 1), axis=1)
    else:
        k = min(5, n)
        edge = np.where(leftwards, x[:, :k], x[:, -k:])
        i = np.arange(k) - (k - 1) / 2
        slope = (edge @ i / max((i * i).sum(), 1e-300))[:, None]
        place = np.where(leftwards, into, k + into)
        padding = edge.mean(axis=1, keepdims=True) + slope * (place - (k - 1) / 2)
        outside &= k > 1
    return np.where(outside, padding, y)


class GaussianBroadening(Augmenter):
    """A Gaussian filter of width U(0, sigma), cut at `truncate` widths."""

    params_ = {"sigma": 1.0, "mode": "reflect", "pad_value": 0.0, "truncate": 4.0}

    def column(self, x: Column) -> Column:
        sigma = self.value("sigma")
        if isinstance(sigma, bool) or not isinstance(sigma, int | float) or sigma < 0:
            raise ValueError("sigma must be a number of 0 or more")
        if self.value("mode") not in linear.MODES:
            raise ValueError(f"unknown mode {self.value('mode')!r}")
        kernel = functools.partial(_broadened, mode=self.value("mode"), pad=float(self.value("pad_value")), truncate=float(self.value("truncate")))
        return by_batch(kernel, x, self.uniform(0.0, float(sigma)))


def _broadened(x: np.ndarray, widths: np.ndarray, mode: str, pad: float, truncate: float) -> np.ndarray:
    """One kernel per row; kernels of one radius are applied together."""
    out = np.empty_like(x)
    radii = (truncate * widths + 0.5).astype(int)
    for radius in np.unique(radii):
        rows = np.flatnonzero(radii == radius)
        places = np.arange(-radius, radius + 1)
        weights = np.exp(-0.5 * (places / widths[rows, None]) ** 2) if radius else np.ones((len(rows), 1))
        out[rows] = linear.correlate(x[rows], (weights / weights.sum(axis=1, keepdims=True)).T[:, :, None], radius, mode, pad)
    return out
