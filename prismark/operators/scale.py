"""Scaling of each spectrum by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions.arrays import ieee_div, let, total
from prismark.functions.linear import nearest_index
from prismark.operators.base import SpectralTransformer


class MinMaxScaler(SpectralTransformer):
    """(x - min) / (max - min) per row; x / max without use_min. A constant row gives NaN."""

    params_ = {"use_min": True}

    def column(self, x: Column) -> Column:
        low = F.array_min(x) if self.value("use_min") else F.lit(0.0)
        return let(F.struct(x.alias("x"), low.alias("low"), (F.array_max(x) - low).alias("range")), lambda s: F.transform(s["x"], lambda v: ieee_div(v - s["low"], s["range"])))


class NormScaler(SpectralTransformer):
    """x / ||x|| for the vector norm of any order: p, +-inf, or 0 (non-zero values)."""

    params_ = {"l_norm": 2}

    def column(self, x: Column) -> Column:
        p = float(self.value("l_norm"))
        size = F.transform(x, lambda v: F.abs(v))
        if p == float("inf"):
            norm = F.array_max(size)
        elif p == float("-inf"):
            norm = F.array_min(size)
        elif p == 0:
            norm = F.size(F.filter(x, lambda v: v != 0)).cast("double")
        elif p == 2:
            norm = F.sqrt(total(F.transform(x, lambda v: v * v)))
        elif p == 1:
            norm = total(size)
        else:
            norm = F.pow(total(F.transform(size, lambda v: F.pow(v, F.lit(p)))), F.lit(1 / p))
        return let(F.struct(x.alias("x"), norm.alias("norm")), lambda s: F.transform(s["x"], lambda v: ieee_div(v, s["norm"])))


class PointScaler(SpectralTransformer):
    """x divided by its value at a place, or at the position of `wavenumbers` nearest to point."""

    params_ = {"point": 0, "wavenumbers": None}

    def column(self, x: Column) -> Column:
        axis, point = self.value("wavenumbers"), self.value("point")
        k = nearest_index(axis, point) if axis else int(point)
        at = F.element_at(x, k + 1 if k >= 0 else k)
        return let(F.struct(x.alias("x"), at.alias("at")), lambda s: F.transform(s["x"], lambda v: ieee_div(v, s["at"])))
