"""Derivatives along the feature axis."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column

from prismark.functions import linear
from prismark.operators.base import SpectralTransformer, by_batch
from prismark.operators.smooth import _known


class SavitzkyGolay(SpectralTransformer):
    """Derivative of the local least-squares polynomial at each place."""

    params_ = {"window_size": 3, "polynomial_order": 1, "derivate_order": 1, "mode": "nearest"}

    def kernel(self):
        mode = _known(self.value("mode"), "interp")
        return functools.partial(linear.savgol, window=int(self.value("window_size")), order=int(self.value("polynomial_order")), deriv=int(self.value("derivate_order")), mode=mode)

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


class NorrisWilliams(SpectralTransformer):
    """Moving mean, then a difference over a gap, divided by gap_size once; each step pads its own input."""

    params_ = {"window_size": 5, "gap_size": 3, "derivative_order": 1, "mode": "nearest"}

    def kernel(self):
        order = self.value("derivative_order")
        if order not in (1, 2):
            raise ValueError("derivative_order must be 1 or 2")
        return functools.partial(_gap, window=int(self.value("window_size")), gap=int(self.value("gap_size")), order=order, mode=_known(self.value("mode")))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


def _gap(x: np.ndarray, window: int, gap: int, order: int, mode: str) -> np.ndarray:
    # A convolution: weights from the right end to the left.
    s = linear.correlate(x, np.full(window, 1.0 / window), (window - 1) // 2, mode)
    weights = np.zeros(gap)
    weights[gap - 1] += 1
    weights[0] += 1 if order == 2 else -1
    if order == 2:
        weights[gap - 1 - (gap - 1) // 2] -= 2
    return linear.correlate(s, weights / gap, (gap - 1) // 2, mode)
