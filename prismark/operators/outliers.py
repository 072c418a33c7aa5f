"""Outlier detection by what a latent-variable model leaves over and how far out scores lie.

A detector is fitted on training spectra with a fitted PCA or PLS model, or a PipelineModel that ends in one. Its model
adds two columns: the statistic, and -1 for outliers (statistic above the critical value) or 1.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions import linear
from prismark.functions.order_statistics import exact_quantiles
from prismark.operators.base import FittedTransformer, SpectralEstimator, by_batch
from prismark.operators.latent import LatentModel, Passes


def split_model(model: LatentModel | PipelineModel) -> tuple[list, LatentModel]:
    """(preprocessing stages, latent model)."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if not stages or not isinstance(stages[-1], LatentModel):
        raise ValueError("the model must be a fitted PCA or PLS, or a pipeline that ends in one")
    if stages[-1].value("rotations") is None:
        raise ValueError("the model is not fitted")
    return list(stages[:-1]), stages[-1]


def checked_confidence(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return float(confidence)


def _left_over(x: np.ndarray, mean, scale, rotations, loadings) -> np.ndarray:
    t = ((x - mean) / scale) @ rotations
    return x - (t @ loadings.T * scale + mean)


def _spe(x: np.ndarray, **m) -> np.ndarray:
    return (_left_over(x, **m) ** 2).sum(axis=1, keepdims=True)


def _t2(x: np.ndarray, mean, scale, rotations, variances) -> np.ndarray:
    return (((x - mean) / scale @ rotations) ** 2 / variances).sum(axis=1, keepdims=True)


def spe(x: Column, latent: LatentModel) -> Column:
    """Squared prediction error |x - x^|^2."""
    return F.get(by_batch(functools.partial(_spe, **{k: latent.matrix(k) for k in ("mean", "scale", "rotations", "loadings")}), x), 0)


def residual_spectra(x: Column, latent: LatentModel) -> Column:
    return by_batch(functools.partial(_left_over, **{k: latent.matrix(k) for k in ("mean", "scale", "rotations", "loadings")}), x)


def leverage(df: DataFrame, scores: str, a: int, output: str, gram: np.ndarray | None = None) -> DataFrame:
    """df with t (T'T)^-1 t' of its rows' scores; T'T over df itself unless given. a * a numbers come to the driver."""
    if gram is None:
        t = [F.get(scores, i) for i in range(a)]
        sums = df.agg(*[F.sum(t[i] * t[j]) for i in range(a) for j in range(a)]).first()
        gram = np.array([float(v or 0.0) for v in sums]).reshape(a, a)
    inverse = np.linalg.inv(gram)
    form = F.lit(0.0)
    for i in range(a):
        for j in range(a):
            form = form + F.get(scores, i) * F.get(scores, j) * F.lit(float(inverse[i, j]))
    return df.withColumn(output, form)


class _Detector(SpectralEstimator):
    params_ = {"confidence": 0.95}
    needs_targets = False

    def __init__(self, model: LatentModel | PipelineModel, *args, **kw):
        super().__init__(*args, **kw)
        self.before, self.latent = split_model(model)
        checked_confidence(self.value("confidence"))

    def prepared(self, df: DataFrame) -> DataFrame:
        for stage in self.before:
            df = stage.transform(df)
        return df

    def critical(self, scored: DataFrame, column: str) -> float:
        """The percentile of the training rows' statistic."""
        return exact_quantiles(scored, column, [self.value("confidence")]).get(0, [float("nan")])[0]

    def _fit(self, df: DataFrame) -> OutlierModel | PipelineModel:
        df = self.prepared(df)
        model = OutlierModel(kind=type(self).__name__, inputCol=self.latent.value("inputCol"), outputCol="residual", **{k: self.latent.value(k) for k in LatentModel.params_ if self.latent.value(k) is not None})
        model._set(critical=float(self.limit(df, model)))
        return PipelineModel([*self.before, model]) if self.before else model

    def limit(self, df: DataFrame, model: OutlierModel) -> float:
        return self.critical(model.scored(df), "residual")

    def fit_predict_residuals(self, df: DataFrame) -> DataFrame:
        """df, the training rows, with the statistic of each as `residual`."""
        return self.fit(df).transform(df).drop("outlier")


class OutlierModel(FittedTransformer):
    """Adds outputCol (the statistic) and outlierCol (-1 or 1). Leverage and studentized residuals are of the scored rows themselves."""

    params_ = {**LatentModel.params_, "kind": None, "critical": 0.0, "outlierCol": "outlier", "target": "y"}

    @property
    def latent(self) -> LatentModel:
        return LatentModel(**{k: self.value(k) for k in LatentModel.params_ if self.value(k) is not None}, inputCol=self.value("inputCol"), outputCol="_scores")

    def scored(self, df: DataFrame) -> DataFrame:
        latent, x, out, kind = self.latent, F.col(self.value("inputCol")), self.value("outputCol"), self.value("kind")
        p, a = len(self.value("mean")), latent.n_components
        if kind == "DModX":
            return df.withColumn(out, F.sqrt(spe(x, latent) / (p - a)))
        if kind == "HotellingT2":
            return df.withColumn(out, F.get(by_batch(functools.partial(_t2, **{k: latent.matrix(k) for k in ("mean", "scale", "rotations", "variances")}), x), 0))
        if kind == "QResiduals":
            return df.withColumn(out, spe(x, latent))
        if kind == "Leverage":
            return leverage(latent.transform(df), "_scores", a, out).drop("_scores")
        if kind == "StudentizedResiduals":
            e = F.col(self.value("target")) - F.get(latent.prediction(x), 0)
            df = leverage(latent.transform(df.withColumn("_e", e)), "_scores", a, "_h")
            total, n = df.agg(F.sum(F.col("_e") * F.col("_e")), F.count("_e")).first()
            s = math.sqrt((total or 0.0) / (n - a)) if n > a else float("nan")
            return df.withColumn(out, F.col("_e") / (F.lit(s) * F.sqrt(1 - F.col("_h")))).drop("_e", "_h", "_scores")
        raise ValueError(f"unknown statistic {kind!r}")

    def _transform(self, df: DataFrame) -> DataFrame:
        flag = F.when(F.col(self.value("outputCol")) > F.lit(self.value("critical")), F.lit(-1)).otherwise(F.lit(1))
        return self.scored(df).withColumn(self.value("outlierCol"), flag)


class DModX(_Detector):
    """sqrt(SPE / (p - A)) against the root of an F quantile."""

    def limit(self, df: DataFrame, model: OutlierModel) -> float:
        p, a = len(model.value("mean")), model.latent.n_components
        return math.sqrt(linear.f_quantile(self.value("confidence"), p - a, p - a - 1))


class HotellingT2(_Detector):
    """Sum of squared scores over their variances against a scaled F quantile."""

    def limit(self, df: DataFrame, model: OutlierModel) -> float:
        n, a = model.value("n_samples"), model.latent.n_components
        return linear.f_quantile(self.value("confidence"), a, n - a) * a * (n - 1) / (n - a)


class QResiduals(_Detector):
    """SPE against a percentile of the training rows', or a chi-square or Jackson-Mudholkar limit from the residuals' total variance."""

    params_ = {"method": "percentile"}

    def limit(self, df: DataFrame, model: OutlierModel) -> float:
        method, c = self.value("method"), self.value("confidence")
        if method == "percentile":
            return super().limit(df, model)
        if method not in ("chi-square", "jackson-mudholkar"):
            raise ValueError("method must be percentile, chi-square or jackson-mudholkar")
        left = df.select(residual_spectra(F.col(model.value("inputCol")), model.latent).alias("r"))
        o = Passes(left, "r").outline
        trace = float(o.squares.sum()) / (o.n - 1)
        if method == "chi-square":
            return trace * linear.chi2_two_quantile(c)
        return trace * (7 / 9 + math.sqrt(2 * linear.normal_quantile(c)) / 3) ** 3


class Leverage(_Detector):
    """Leverage within the scored rows against a percentile of the training rows'."""


class StudentizedResiduals(_Detector):
    """Residuals of a PLS model's target over their standard error; only large positive ones are outliers."""

    params_ = {"target": "y"}

    def _fit(self, df: DataFrame) -> OutlierModel:
        if self.latent.value("coefficients") is None:
            raise ValueError("studentized residuals need a model that predicts")
        return super()._fit(df)
