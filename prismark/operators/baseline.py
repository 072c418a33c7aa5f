"""Baseline correction of each spectrum."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions import linear
from prismark.functions.arrays import let, mean
from prismark.functions.linear import nearest_index
from prismark.operators.base import SpectralTransformer, by_batch


class ConstantBaselineCorrection(SpectralTransformer):
    """x less its mean over start to end, both included; with `wavenumbers` both are the nearest places."""

    params_ = {"start": 0, "end": 1, "wavenumbers": None}

    def bounds(self) -> tuple[int, int]:
        start, end, axis = self.value("start"), self.value("end"), self.value("wavenumbers")
        return (nearest_index(axis, start), nearest_index(axis, end)) if axis else (int(start), int(end))

    def kernel(self):
        return functools.partial(_less_level, bounds=self.bounds())

    def column(self, x: Column) -> Column:
        start, end = self.bounds()
        part = F.slice(x, start + 1, end - start + 1)
        return let(F.struct(x.alias("x"), mean(part).alias("m")), lambda s: F.transform(s["x"], lambda v: v - s["m"]))


def _less_level(x: np.ndarray, bounds: tuple[int, int]) -> np.ndarray:
    return x - x[:, bounds[0] : bounds[1] + 1].mean(axis=1, keepdims=True)


class LinearCorrection(SpectralTransformer):
    """x less the line through its first and last point."""

    def kernel(self):
        return _less_line

    def column(self, x: Column) -> Column:
        def line(s: Column) -> Column:
            first, last, n = F.get(s["x"], 0), F.element_at(s["x"], -1), F.size(s["x"])
            bound = F.struct(s["x"].alias("x"), first.alias("a"), F.when(n > 1, (last - first) / (n - 1)).otherwise(F.lit(0.0)).alias("b"))
            return let(bound, lambda t: F.transform(t["x"], lambda v, i: v - (t["a"] + t["b"] * i)))

        return F.when(F.size(x) > 0, let(F.struct(x.alias("x")), line)).otherwise(x)


def _less_line(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return x - (x[:, :1] + (x[:, -1:] - x[:, :1]) * (np.arange(n) / max(n - 1, 1)))


class NonNegative(SpectralTransformer):
    """Negative values become zero (`zero`) or positive (`abs`)."""

    params_ = {"mode": "zero"}

    def column(self, x: Column) -> Column:
        mode = self.value("mode")
        if mode not in ("zero", "abs"):
            raise ValueError(f"mode must be zero or abs, not {mode!r}")
        return F.transform(x, lambda v: F.abs(v) if mode == "abs" else F.greatest(v, F.lit(0.0)))


class SubtractReference(SpectralTransformer):
    """x - reference; x without one."""

    params_ = {"reference": None}

    def kernel(self):
        r = self.value("reference")
        return functools.partial(_less, reference=0.0 if r is None else np.ravel(np.array(r, float)))

    def column(self, x: Column) -> Column:
        r = self.value("reference")
        if r is None:
            return x
        r = np.ravel(np.array(r, float)).tolist()
        return F.zip_with(x, F.lit(r).cast("array<double>"), lambda a, b: a - b)


def _less(x: np.ndarray, reference: np.ndarray | float) -> np.ndarray:
    return x - reference


class PolynomialCorrection(SpectralTransformer):
    """x less the least-squares polynomial through x[indices] (all places without them)."""

    params_ = {"order": 1, "indices": None}

    def kernel(self):
        return functools.partial(_less_polynomial, order=int(self.value("order")), indices=tuple(self.value("indices") or ()))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


def _less_polynomial(x: np.ndarray, order: int, indices: tuple[int, ...]) -> np.ndarray:
    return x - x @ linear.polynomial_baseline(x.shape[1], order, indices)


class CubicSplineCorrection(SpectralTransformer):
    """x less the not-a-knot cubic spline through x[indices] (the ends without them), extrapolated to all places."""

    params_ = {"indices": None}

    def kernel(self):
        return functools.partial(_less_spline, indices=tuple(self.value("indices") or ()))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


def _less_spline(x: np.ndarray, indices: tuple[int, ...]) -> np.ndarray:
    return x - x @ linear.spline_baseline(x.shape[1], indices)


class AirPls(SpectralTransformer):
    """Adaptive iteratively reweighted penalised least squares; returns x less its baseline."""

    params_ = {"lam": 100, "polynomial_order": 1, "nr_iterations": 15}

    def column(self, x: Column) -> Column:
        n = int(self.value("nr_iterations"))
        if n < 2:
            raise ValueError("nr_iterations must be 2 or more")
        return by_batch(functools.partial(_air_pls, lam=float(self.value("lam")), order=int(self.value("polynomial_order")), iterations=n), x)


def _air_pls(x: np.ndarray, lam: float, order: int, iterations: int) -> np.ndarray:
    """All rows at once; a row leaves when it has converged."""
    penalty = lam * linear.differences(x.shape[1], order)[:, None, :]
    baseline, open_ = np.full_like(x, np.nan), np.arange(len(x))
    open_ = open_[np.abs(x).sum(axis=1) > 0]
    baseline[np.abs(x).sum(axis=1) == 0] = 0
    w = np.ones((len(open_), x.shape[1]))
    for i in range(1, iterations):
        if not len(open_):
            break
        y = x[open_]
        bands = np.repeat(penalty, len(open_), axis=1)
        bands[0] += w
        z = linear.solve_banded(bands, w * y)
        d = y - z
        below = np.where(d < 0, d, 0)
        size = np.abs(below.sum(axis=1))
        baseline[open_] = z
        go_on = (size >= 0.001 * np.abs(y).sum(axis=1)) & (i < iterations - 1)
        d, size, open_ = d[go_on], size[go_on][:, None], open_[go_on]
        w = np.where(d >= 0, 0, np.exp(i * np.abs(d) / size))
        nearest = np.where(d < 0, d, -np.inf).max(axis=1)
        w[:, 0] = w[:, -1] = np.exp(i * nearest / size[:, 0])
    return x - baseline


class ArPls(SpectralTransformer):
    """Asymmetrically reweighted penalised least squares; returns x less its baseline."""

    params_ = {"lam": 1e4, "ratio": 0.01, "nr_iterations": 100}

    def column(self, x: Column) -> Column:
        return by_batch(functools.partial(_ar_pls, lam=float(self.value("lam")), ratio=float(self.value("ratio")), iterations=int(self.value("nr_iterations"))), x)


def _ar_pls(x: np.ndarray, lam: float, ratio: float, iterations: int) -> np.ndarray:
    penalty = lam * linear.differences(x.shape[1], 2)[:, None, :]
    baseline, open_ = x.copy(), np.arange(len(x))
    w = np.ones_like(x)
    for _ in range(iterations):
        if not len(open_):
            break
        y = x[open_]
        bands = np.repeat(penalty, len(open_), axis=1)
        bands[0] += w
        z = linear.solve_banded(bands, w * y)
        baseline[open_] = z
        d = y - z
        below = d < 0
        n = below.sum(axis=1)
        m = np.where(below, d, 0).sum(axis=1) / n
        s = np.sqrt(np.where(below, (d - m[:, None]) ** 2, 0).sum(axis=1) / n)
        power = 2 * (d - (2 * s - m)[:, None]) / s[:, None]
        new = 1 / (1 + np.exp(np.clip(power, -709, 709)))
        change = np.sqrt(((w - new) ** 2).sum(axis=1)) / np.sqrt((w**2).sum(axis=1))
        go_on = (n > 0) & ~(change < ratio)
        w, open_ = new[go_on], open_[go_on]
    return x - baseline
