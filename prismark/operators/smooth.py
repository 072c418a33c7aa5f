"""Smoothing along the feature axis."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions import linear
from prismark.functions.arrays import windows
from prismark.operators.base import SpectralTransformer, by_batch


class MeanFilter(SpectralTransformer):
    """Moving mean; windows of even size reach one place further to the left."""

    params_ = {"window_size": 3, "mode": "nearest"}

    def kernel(self):
        w = int(self.value("window_size"))
        weights = np.full(w, 1.0 / w)
        return functools.partial(linear.correlate, weights=weights, left=w // 2, mode=_known(self.value("mode")))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


class MedianFilter(SpectralTransformer):
    """Moving median; of windows of even size the upper of the two middle values."""

    params_ = {"window_size": 3, "mode": "nearest"}

    def column(self, x: Column) -> Column:
        w = int(self.value("window_size"))
        return windows(x, w // 2, w - 1 - w // 2, self.value("mode"), lambda s: F.get(F.array_sort(s), w // 2))


class SavitzkyGolayFilter(SpectralTransformer):
    """Local least-squares polynomial at each place."""

    params_ = {"window_size": 3, "polynomial_order": 1, "mode": "nearest"}

    def kernel(self):
        mode = _known(self.value("mode"), "interp")
        return functools.partial(linear.savgol, window=int(self.value("window_size")), order=int(self.value("polynomial_order")), deriv=0, mode=mode)

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


class WhittakerSmooth(SpectralTransformer):
    """Solution of (I + lam D'D) z = x with D the differences of an order."""

    params_ = {"lam": 1e2, "differences": 1}

    def kernel(self):
        return functools.partial(linear.whittaker, lam=float(self.value("lam")), order=int(self.value("differences")))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


def _known(mode: str, *more: str) -> str:
    if mode not in (*linear.MODES, *more):
        raise ValueError(f"unknown mode {mode!r}")
    return mode
