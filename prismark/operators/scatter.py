"""Scatter correction."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.arrays import dot, ieee_div, let, mean, percentile, spread
from prismark.functions.order_statistics import array_quantiles
from prismark.operators.base import FittedTransformer, SpectralEstimator, SpectralTransformer, by_batch
from prismark.operators.latent import Passes


class StandardNormalVariate(SpectralTransformer):
    """(x - mean) / population standard deviation, per row."""

    def column(self, x: Column) -> Column:
        centred = let(F.struct(x.alias("x"), mean(x).alias("m")), lambda s: F.struct(s["x"].alias("x"), s["m"].alias("m"), spread(s["x"], s["m"]).alias("sd")))
        return let(centred, lambda s: F.transform(s["x"], lambda v: ieee_div(v - s["m"], s["sd"])))


class RobustNormalVariate(SpectralTransformer):
    """(x - q) / population standard deviation of the values up to q, q the percentile."""

    params_ = {"percentile": 25}

    def column(self, x: Column) -> Column:
        bound = F.struct(x.alias("x"), percentile(x, float(self.value("percentile"))).alias("q"))

        def scaled(s: Column) -> Column:
            low = let(F.struct(F.filter(s["x"], lambda v: v <= s["q"]).alias("l")), lambda t: F.struct(t["l"].alias("l"), mean(t["l"]).alias("m")))
            sd = let(low, lambda t: spread(t["l"], t["m"]))
            return let(sd, lambda d: F.transform(s["x"], lambda v: ieee_div(v - s["q"], d)))

        return let(bound, scaled)


def column_centre(df: DataFrame, column: str, method: str) -> list[float]:
    """Mean or exact median of each feature over all rows; one number per feature comes to the driver."""
    if method not in ("mean", "median"):
        raise ValueError(f"method must be mean or median, not {method!r}")
    if method == "median":
        return [float("nan") if m is None else m[0] for m in array_quantiles(df, column, [0.5])]
    return [] if df.where(F.col(column).isNotNull()).isEmpty() else Passes(df, column).outline.mean.tolist()


def _reference(stage: SpectralEstimator, df: DataFrame) -> list[float]:
    column, given = stage.value("inputCol"), stage.value("reference")
    found = [float(v) for v in given] if given is not None else column_centre(df, column, stage.value("method"))
    first = df.select(F.size(column)).first()
    n = first[0] if first else len(found)
    if len(found) != n:
        raise ValueError(f"the reference has {len(found)} values, the spectra {n}")
    weights = stage.value("weights")
    if weights is not None and len(weights) != n:
        raise ValueError(f"there are {len(weights)} weights, the spectra have {n} values")
    return found


class MultiplicativeScatterCorrection(SpectralEstimator):
    """Least-squares line of each spectrum over a reference, taken out: (x - c) / m. Weights multiply both sides."""

    params_ = {"method": "mean", "reference": None, "weights": None}

    def _fit(self, df: DataFrame) -> MultiplicativeScatterModel:
        return MultiplicativeScatterModel(reference=_reference(self, df), weights=self.value("weights"), inputCol=self.value("inputCol"), outputCol=self.value("outputCol"))


class MultiplicativeScatterModel(FittedTransformer):
    params_ = {"reference": None, "weights": None}

    def column(self, x: Column) -> Column:
        r = np.array(self.value("reference"), float)
        w = self.value("weights")
        q = np.ones(len(r)) if w is None else np.array(w, float) ** 2
        centre = (q * r).sum() / q.sum()
        spread_r = (q * (r - centre) ** 2).sum()
        if not spread_r > 1e-14 * (q * r * r).sum():  # a constant reference: only the minimum-norm solution is defined
            inverse = np.linalg.pinv(np.stack([r, np.ones_like(r)], axis=1) * np.sqrt(q)[:, None]) * np.sqrt(q)
            return by_batch(functools.partial(_line_out, inverse=inverse), x)
        slope = F.lit((q * (r - centre) / spread_r).tolist()).cast("array<double>")
        level = F.lit((q / q.sum()).tolist()).cast("array<double>")
        fit = let(F.struct(x.alias("x"), dot(x, slope).alias("m"), dot(x, level).alias("a")), lambda s: F.struct(s["x"].alias("x"), s["m"].alias("m"), (s["a"] - s["m"] * F.lit(float(centre))).alias("c")))
        return let(fit, lambda s: F.transform(s["x"], lambda v: ieee_div(v - s["c"], s["m"])))


def _line_out(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    m, c = inverse @ x.T
    return (x - c[:, None]) / m[:, None]


class ExtendedMultiplicativeScatterCorrection(SpectralEstimator):
    """As the above with powers of the place up to `order` besides the reference; minimum-norm coefficients."""

    params_ = {"method": "mean", "order": 2, "reference": None, "weights": None}

    def _fit(self, df: DataFrame) -> ExtendedMultiplicativeScatterModel:
        return ExtendedMultiplicativeScatterModel(order=self.value("order"), reference=_reference(self, df), weights=self.value("weights"), inputCol=self.value("inputCol"), outputCol=self.value("outputCol"))


class ExtendedMultiplicativeScatterModel(FittedTransformer):
    params_ = {"order": 2, "reference": None, "weights": None}

    def column(self, x: Column) -> Column:
        r = np.array(self.value("reference"), float)
        design = np.column_stack([np.arange(len(r), dtype=float)[:, None] ** np.arange(self.value("order") + 1), r])
        w = np.ones(len(r)) if self.value("weights") is None else np.array(self.value("weights"), float)
        inverse = np.linalg.pinv(design * w[:, None]) * w
        return by_batch(functools.partial(_baseline_out, design=design, inverse=inverse), x)


def _baseline_out(x: np.ndarray, design: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    b = x @ inverse.T
    return (x - b[:, :-1] @ design[:, :-1].T) / b[:, -1:]
