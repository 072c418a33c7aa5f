"""Chains of fixed linear maps as one map.

Smoothing, derivatives, baselines by polynomials or lines, selection, centring and scores of a model are weighted sums of a
spectrum's values. Neighbours of these in a pipeline are composed before any row is read: filters stay narrow bands, and
whatever stands in front of a model goes into its loadings, so the chain costs one Arrow trip and one product.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import Column

from prismark.operators.base import FittedTransformer, SpectralTransformer, by_batch

#: Spectra that the map is read off at once, and the most weights that a composed map may have.
UNITS, WEIGHTS = 256, 1 << 24
Kernel = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class AffineMap:
    """Result j is offset[j] and the sum of weights[j] times the values from starts[j] on: a band for filters, all values for scores."""

    starts: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, kernel: Kernel, n: int) -> AffineMap | None:
        """Read off what an affine kernel does to spectra of n values; None if it has too many weights."""
        offset = kernel(np.zeros((1, n)))[0]
        lines, m = [], len(offset)
        first, last = np.full(m, n), np.full(m, -1)
        for i in range(0, n, UNITS):
            unit = np.zeros((min(UNITS, n - i), n))
            unit[np.arange(len(unit)), i + np.arange(len(unit))] = 1.0
            done = kernel(unit) - offset
            at, to = np.nonzero(done)
            np.minimum.at(first, to, i + at)
            np.maximum.at(last, to, i + at)
            lines.append((i + at, to, done[at, to]))
            if sum(len(x[0]) for x in lines) > WEIGHTS:
                return None
        width = max(1, int((last - first).max(initial=0)) + 1)
        starts = np.clip(np.where(last < 0, 0, first), 0, max(0, n - width))
        if m * width > WEIGHTS:
            return None
        weights = np.zeros((m, width))
        for at, to, w in lines:
            weights[to, at - starts[to]] = w
        return cls(starts, weights, offset)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m, width = self.weights.shape
        if width == x.shape[1] or m <= 16:
            dense = np.zeros((x.shape[1], m))
            dense[self.starts[:, None] + np.arange(width), np.arange(m)[:, None]] = self.weights
            return x @ dense + self.offset
        out = np.tile(self.offset, (len(x), 1))
        for k in range(width):
            out += x[:, self.starts + k] * self.weights[:, k]
        return out


def _chained(x: np.ndarray, kernels: list[Kernel]) -> np.ndarray:
    for k in kernels:
        x = k(x)
    return x


class LinearMap(FittedTransformer):
    """What several stages do, as one: see AffineMap. Spectra of another length than the map is for raise."""

    params_ = {"n": 0, "starts": None, "weights": None, "offset": None}

    def map(self) -> AffineMap:
        return AffineMap(np.array(self.value("starts"), np.int64), np.array(self.value("weights"), float), np.array(self.value("offset"), float))

    def kernel(self):
        return functools.partial(_mapped, of=self.map(), n=int(self.value("n")))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)


def _mapped(x: np.ndarray, of: AffineMap, n: int) -> np.ndarray:
    if x.shape[1] != n:
        raise ValueError(f"the map is for {n} values, not {x.shape[1]}")
    return of(x)


def fused(stages: list[Transformer] | PipelineModel, n: int) -> list[Transformer]:
    """The stages for spectra of n values, with every run of linear ones that feed each other as one LinearMap.

    A column that a run writes in between is no longer written: behind centring and a model, the input stays as it was.
    """
    stages = stages.stages if isinstance(stages, PipelineModel) else stages
    out: list[Transformer] = []
    run: list[SpectralTransformer] = []

    def close() -> None:
        nonlocal n
        found = AffineMap.of(functools.partial(_chained, kernels=[s.kernel() for s in run]), n) if len(run) > 1 else None
        if found is None:
            out.extend(run)
        else:
            out.append(LinearMap(n=n, starts=found.starts, weights=found.weights, offset=found.offset, inputCol=run[0].value("inputCol"), outputCol=run[-1].value("outputCol")))
        for s in run:
            n = s.kernel()(np.zeros((1, n))).shape[1]
        run.clear()

    for stage in stages:
        linear = isinstance(stage, SpectralTransformer) and stage.kernel() is not None
        if run and not (linear and stage.value("inputCol") == run[-1].value("outputCol")):
            close()
        if linear:
            run.append(stage)
        else:
            out.append(stage)
    close()
    return out
