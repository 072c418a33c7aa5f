"""Operators as pyspark.ml stages over a column of spectra (ARRAY<DOUBLE>, one row per spectrum)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _WithParams(DefaultParamsReadable, DefaultParamsWritable):
    """Stages declare their parameters, in order and with defaults, in `params_`; all become pyspark.ml Params, so stages
    are saved and loaded as the library saves its own. Input and output column are parameters too; by default both are x.
    """

    params_: dict[str, object] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls._all = {**cls.__dict__.get("params_", {}), **getattr(cls, "_all", {}), "inputCol": "x", "outputCol": "x"}
        cls._all |= cls.__dict__.get("params_", {})
        for name in cls._all:
            if not isinstance(cls.__dict__.get(name), Param):
                setattr(cls, name, Param(Params._dummy(), name, name))

    def __init__(self, *args, **kw):
        super().__init__()
        self._setDefault(**{k: v for k, v in self._all.items() if v is not None})
        names = [n for n in self._all if n not in ("inputCol", "outputCol")]
        if len(args) > len(names):
            raise TypeError(f"{type(self).__name__} takes {len(names)} parameters")
        given = dict(zip(names, args, strict=False)) | kw
        if unknown := set(given) - set(self._all):
            raise TypeError(f"{type(self).__name__} has no parameter {sorted(unknown)}")
        self._set(**{k: _plain(v) for k, v in given.items() if v is not None})

    def value(self, name: str):
        """The parameter's value, or None where it is not set."""
        p = self.getParam(name)
        return self.getOrDefault(p) if self.isDefined(p) else None


def _plain(v):
    """Lists and numbers of Python, which a saved stage can hold."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        return v.item()
    return list(v) if isinstance(v, tuple | range) else v


class SpectralTransformer(_WithParams, Transformer):
    """Row by row: outputCol is column(inputCol)."""

    def column(self, x: Column) -> Column:
        raise NotImplementedError

    def kernel(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """The same for the rows of a matrix, where each result is a fixed weighted sum of the row's values, and perhaps a constant; else None."""
        return None

    def feature_names_out(self, names: list[str]) -> list[str]:
        """What the features are called that come of features with these names."""
        return list(names)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.value("outputCol"), self.column(F.col(self.value("inputCol"))))


class SpectralEstimator(_WithParams, Estimator):
    """Learns from all rows; _fit returns a SpectralTransformer."""


def feature_names_out(stages: list, names: list[str]) -> list[str]:
    """The names through several stages, as of a fitted pipeline."""
    for s in stages:
        names = s.feature_names_out(names)
    return names


class FittedTransformer(SpectralTransformer, Model):
    """What an estimator has learnt, as parameters."""


def by_batch(kernel: Callable[..., np.ndarray], *columns: Column) -> Column:
    """kernel(rows, ...) over Arrow batches: the first column's spectra as a matrix, one row each, the other columns as arrays, lists of the same length as matrices.

    Spectra of one length are worked on together; null spectra stay null. Spark fails to run a UDF whose argument
    holds a lambda within a lambda, so the argument must stay a column of its own: the UDF is declared not deterministic, which
    keeps inferred filters from copying it, and also takes the size, as a column used twice is not merged into its use.
    """

    def run(x: pa.Array, *more: pa.Array) -> pa.Array:
        lengths = np.asarray(x.value_lengths().fill_null(-1))
        others = [m if pa.types.is_list(m.type) else np.asarray(m) for m in more[:-1]]
        out: list = [None] * len(x)
        for n in np.unique(lengths):
            if n < 0:
                continue
            rows = np.flatnonzero(lengths == n)
            part = x if len(rows) == len(x) else x.take(pa.array(rows))
            matrix = np.asarray(part.flatten(), np.float64).reshape(len(rows), n)
            with np.errstate(all="ignore"):
                done = np.ascontiguousarray(kernel(matrix, *(_of_rows(m, rows, n) for m in others)), np.float64)
            if len(rows) == len(x):
                offsets = np.arange(0, done.size + 1, done.shape[1], dtype=np.int32) if done.shape[1] else np.zeros(len(x) + 1, np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(done.reshape(-1)))
            for r, y in zip(rows, done, strict=True):
                out[r] = y
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()(*columns, F.size(columns[0]))


def _of_rows(values: np.ndarray | pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    if isinstance(values, np.ndarray):
        return values[rows]
    return np.asarray(values.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), n)
