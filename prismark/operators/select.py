"""Selection of features by index or by position on an axis."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismark.functions.linear import nearest_index
from prismark.operators.base import SpectralTransformer


class IndexSelector(SpectralTransformer):
    """The features at the given places (or nearest to the given positions of `wavenumbers`), ascending and each once; all if none are given."""

    params_ = {"features": None, "wavenumbers": None}

    def places(self) -> list[int] | None:
        features, axis = self.value("features"), self.value("wavenumbers")
        if features is None:
            return None
        return sorted({nearest_index(axis, f) for f in features}) if axis else sorted({int(f) for f in features})

    def column(self, x: Column) -> Column:
        at = self.places()
        if at is None:
            return x
        if at and at[0] >= 0:
            return F.transform(F.array(*map(F.lit, at)), lambda i: F.element_at(x, i + 1))
        # Places from the end depend on the length.
        real = F.array_sort(F.array_distinct(F.array(*[F.lit(i) if i >= 0 else F.size(x) + i for i in at]).cast("array<int>")))
        return F.transform(real, lambda i: F.element_at(x, i + 1))

    def kernel(self):
        return functools.partial(_kept, stage=self.copy())

    def selected_wavenumbers(self) -> list[float] | None:
        axis, at = self.value("wavenumbers"), self.places()
        return axis if axis is None or at is None else [axis[i] for i in at]

    def feature_names_out(self, names: list[str]) -> list[str]:
        return [n for n, kept in zip(names, support(len(names), self), strict=True) if kept]


class RangeCut(SpectralTransformer):
    """Features start to end, the end excluded; with `wavenumbers` both are the places nearest to start and end."""

    params_ = {"start": 0, "end": -1, "wavenumbers": None}

    def bounds(self) -> tuple[int, int]:
        start, end, axis = self.value("start"), self.value("end"), self.value("wavenumbers")
        return (nearest_index(axis, start), nearest_index(axis, end)) if axis else (int(start), int(end))

    def column(self, x: Column) -> Column:
        n = F.size(x)
        start, end = (F.least(n, F.lit(b)) if b >= 0 else F.greatest(F.lit(0), n + b) for b in self.bounds())
        return F.slice(x, start + 1, F.greatest(F.lit(0), end - start))

    def kernel(self):
        return functools.partial(_kept, stage=self.copy())

    def selected_wavenumbers(self) -> list[float] | None:
        axis = self.value("wavenumbers")
        return axis and axis[slice(*self.bounds())]

    def feature_names_out(self, names: list[str]) -> list[str]:
        return list(names)[slice(*self.bounds())]


def support(n: int, stage: IndexSelector | RangeCut) -> list[bool]:
    """Which of n features a selector keeps."""
    if isinstance(stage, RangeCut):
        kept = set(range(n)[slice(*stage.bounds())])
    else:
        at = stage.places()
        kept = set(range(n)) if at is None else {i % n for i in at}
    return [i in kept for i in range(n)]


def _kept(x: np.ndarray, stage: IndexSelector | RangeCut) -> np.ndarray:
    return x[:, np.flatnonzero(support(x.shape[1], stage))]


def restored(x: Column, mask: list[bool]) -> Column:
    """The selected features at their old places and zeros elsewhere."""
    at, k = [], 0
    for m in mask:
        k += m
        at.append(k if m else 0)
    return F.transform(F.array(*map(F.lit, at)), lambda i: F.when(i > 0, F.try_element_at(x, i)).otherwise(F.lit(0.0)))
