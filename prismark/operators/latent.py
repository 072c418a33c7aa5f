"""Centring, PCA and PLS, fitted by distributed sums.

Spectra of up to GRAM_FEATURES values are summed up in one pass: the products of all pairs of features, pooled up a tree of
tasks. Longer ones take passes of vectors instead, and no matrix of features squared exists anywhere: PCA some passes of a block
Krylov method and one of a tree of QR factors, PLS one pass for each component.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.trees import added, few_tasks, levels, merged, of_tasks
from prismark.operators.base import FittedTransformer, SpectralEstimator, by_batch
from prismark.sources.scratch import written

#: Features (and targets) whose products are summed in one pass; the driver holds their square, 32 MB.
GRAM_FEATURES = 2048
#: Numbers that one row of partial sums holds, and bytes of all sums that the driver takes at once.
BLOCK, HELD_BYTES = 1 << 17, 64 << 20
#: Vectors beyond the wanted ones in a block of PCA's passes, passes at most, and relative residual that ends them.
BESIDE, PASSES, TOLERANCE = 8, 30, 1e-11


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and sums of products about the means of the features and, behind them, the targets."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def _with_targets(df: DataFrame, column: str, targets: tuple[str, ...]) -> Column:
    return F.concat(F.col(column), F.array(*[F.col(t).cast("double") for t in targets])) if targets else F.col(column)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows; null ones are left out."""
    lists = lists.drop_null()
    flat = np.asarray(lists.flatten(), np.float64)
    if len(lists) and len(flat) % len(lists):
        raise ValueError("spectra that are learnt from must have one length")
    return flat.reshape(len(lists), -1)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, rows less them), about the first row: columns that do not vary are exactly zero."""
    c = x - x[:1]
    m = c.mean(axis=0)
    return x[0] + m, c - m


def _mean_of(n: np.ndarray, means: np.ndarray) -> np.ndarray:
    return means[0] + n @ (means - means[0]) / n.sum()


def _pooled(parts: list[np.ndarray]) -> np.ndarray:
    """Of parts [rows, first line, length, means, some lines of the products about them] those of their rows together."""
    first, size = int(parts[0][1]), int(parts[0][2])
    n = np.array([x[0] for x in parts])
    means = np.stack([x[3 : 3 + size] for x in parts])
    mean = _mean_of(n, means)
    lines = np.sum([x[3 + size :] for x in parts], axis=0).reshape(-1, size)
    off = means - mean
    lines = lines + (off[:, first : first + len(lines)] * n[:, None]).T @ off
    return np.concatenate([[n.sum(), first, size], mean, lines.ravel()])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of a task's rows (z, g) for each g, in blocks of lines."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        g = np.asarray(batch.column(1).fill_null(-1))
        for k in np.unique(g).tolist():
            x = _matrix(batch.column(0).filter(pa.array(g == k)))
            if len(x):
                mean, c = _centred(x)
                part = np.concatenate([[len(x), 0, len(mean)], mean, (c.T @ c).ravel()])
                total[k] = _pooled([total[k], part]) if k in total else part
    for k, t in total.items():
        size = int(t[2])
        lines, step = t[3 + size :].reshape(size, size), max(1, BLOCK // size)
        starts = range(0, size, step)
        blocks = [np.concatenate([[t[0], i, size], t[3 : 3 + size], lines[i : i + step].ravel()]).tobytes() for i in starts]
        m = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int64()), pa.array(list(starts), pa.int64()), pa.array([TaskContext.get().partitionId()] * m, pa.int64()), pa.array(blocks, pa.binary())], ["g", "line", "part", "payload"])


def _assembled(rows: list) -> Moments:
    parts = [np.frombuffer(r["payload"], np.float64) for r in sorted(rows, key=lambda r: r["line"])]
    size = int(parts[0][2])
    return Moments(int(parts[0][0]), parts[0][3 : 3 + size], np.concatenate([x[3 + size :] for x in parts]).reshape(size, size))


class MomentsBy:
    """Moments of the rows of each value of a column; one at a time is read where all together are large."""

    def __init__(self, sums: DataFrame, size: int, groups: int):
        self._sums, self._held = sums, None
        if size * size * 8 * groups <= HELD_BYTES:
            self._held = {}
            for r in sums.collect():
                self._held.setdefault(r["g"], []).append(r)
            self.keys = sorted(self._held)
        else:
            self._sums = written(sums, "moments")
            self.keys = sorted(r["g"] for r in self._sums.select("g").distinct().collect())

    def __getitem__(self, k: int) -> Moments:
        return _assembled(self._held[k] if self._held is not None else self._sums.where(F.col("g") == k).collect())

    def but(self, keys: set[int]) -> Moments | None:
        """The moments of the rows of all other values."""
        total = None
        for k in self.keys:
            if k not in keys:
                total = self[k] if total is None else sum_of([total, self[k]])
        return total


def length_of(df: DataFrame, column: str) -> int:
    """Of the spectra; from one of them."""
    first = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    if first is None:
        raise ValueError("there are no spectra to learn from")
    return first[0]


def moments_by(df: DataFrame, column: str, targets: tuple[str, ...], by: str, groups: int, length: int | None = None) -> MomentsBy:
    """Moments of the rows of each value of `by` (whole numbers from 0, some `groups` of them): each task sums products about its own
    means, and tasks' sums are pooled up a tree, in blocks of lines. Groups may have spectra of lengths of their own; `length` is
    that of the longest, looked up if it isn't given.
    """
    rows = df.select(_with_targets(df, column, targets).alias("z"), F.col(by).cast("long").alias("g"))
    parts = few_tasks(rows).mapInArrow(_sums, "g long, line long, part long, payload binary")
    return MomentsBy(merged(parts, _pooled, by=("g", "line"), height=levels(rows)), (length or length_of(df, column)) + len(targets), groups)


def moments(df: DataFrame, column: str, targets: tuple[str, ...] = (), length: int | None = None) -> Moments:
    """Moments of all rows."""
    return moments_by(df.withColumn("_all", F.lit(0)), column, targets, "_all", 1, length)[0]


def sum_of(parts: list[Moments]) -> Moments:
    """The moments of the rows of several parts together."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    return Moments(n, mean, sum(m.products + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts))


# --- passes of vectors -------------------------------------------------------------------------------------------------
def _outlined(parts: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Of parts [rows, means, squares about them, products of features and targets] those of their rows together."""
    n = np.array([x[0] for x in parts])
    means = np.stack([x[1 : 1 + p + q] for x in parts])
    mean = _mean_of(n, means)
    off = means - mean
    both = np.sum([x[1 + p + q :] for x in parts], axis=0)
    both[: p + q] += n @ (off * off)
    both[p + q :] += ((off[:, :p] * n[:, None]).T @ off[:, p:]).ravel()
    return np.concatenate([[n.sum()], mean, both])


def _outline(batches: Iterator[pa.RecordBatch], p: int, q: int) -> np.ndarray | None:
    total = None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            mean, c = _centred(x)
            part = np.concatenate([[len(x)], mean, (c * c).sum(axis=0), (c[:, :p].T @ c[:, p:]).ravel()])
            total = part if total is None else _outlined([total, part], p, q)
    return total


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, spread: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    total = None
    for batch in batches:
        x = (_matrix(batch.column(0)) - mean) / spread
        part = x.T @ (x @ b)
        total = part if total is None else total + part
    return None if total is None else total.ravel()


def _factors(batches: Iterator[pa.RecordBatch], mean: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    r = None
    for batch in batches:
        t = (_matrix(batch.column(0)) - mean) @ b
        r = _triangle([t] if r is None else [r, t])
    return None if r is None else r.ravel()


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    """The square triangular factor of rows put one below the other."""
    k = parts[0].shape[1]
    r = np.linalg.qr(np.vstack([*parts, np.zeros((k, k))]), mode="r")
    return r[:k]


def _triangles(flat: list[np.ndarray]) -> np.ndarray:
    k = math.isqrt(len(flat[0]))
    return _triangle([x.reshape(k, k) for x in flat]).ravel()


@dataclass(frozen=True)
class Outline:
    """Rows, means, squares about them of features and targets, products of features (lines) and targets."""

    n: int
    mean: np.ndarray
    squares: np.ndarray
    cross: np.ndarray


class Passes:
    """Products of a table of spectra with vectors, each a pass over its rows."""

    def __init__(self, df: DataFrame, column: str, targets: tuple[str, ...] = (), length: int | None = None):
        self.rows = df.select(F.col(column).alias("x"))
        self.p, q = length or length_of(df, column), len(targets)
        z = df.select(_with_targets(df, column, targets).alias("z"))
        flat = of_tasks(z, functools.partial(_outline, p=self.p, q=q), functools.partial(_outlined, p=self.p, q=q))
        size = self.p + q
        self.outline = Outline(int(flat[0]), flat[1 : 1 + size], flat[1 + size : 1 + 2 * size], flat[1 + 2 * size :].reshape(self.p, q))
        self.mean, self.spread = self.outline.mean[: self.p], np.ones(self.p)

    def times(self, b: np.ndarray) -> np.ndarray:
        """X'(X b) for the centred and scaled spectra X and a vector or some columns b."""
        found = of_tasks(self.rows, functools.partial(_products, mean=self.mean, spread=self.spread, b=b), added)
        return found.reshape(b.shape)

    def triangle(self, b: np.ndarray) -> np.ndarray:
        """The triangular factor of X b for centred spectra X."""
        return of_tasks(self.rows, functools.partial(_factors, mean=self.mean, b=b), _triangles).reshape(b.shape[1], b.shape[1])


def principal(passes: Passes, a: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of squares along the first a principal directions, these as columns), by a block Krylov method.

    A block of vectors is multiplied in each pass, and what is new in it joins the basis; the best directions within the basis are
    taken until they are the table's own. A last pass factors the scores, so small variances keep their digits.
    """
    p, width = passes.p, min(passes.p, a + BESIDE)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(p, width)))[0]
    basis, images = np.zeros((p, 0)), np.zeros((p, 0))
    for _ in range(PASSES):
        image = passes.times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, y = np.linalg.eigh((inner + inner.T) / 2)
        values, y = values[::-1][:a], y[:, ::-1][:, :a]
        directions = basis @ y
        if np.linalg.norm(images @ y - directions * values) <= TOLERANCE * max(values[0], 0.0):
            break
        scale = np.linalg.norm(image)
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        u, s, _ = np.linalg.svd(image, full_matrices=False)
        block = u[:, (s > 1e-13 * scale)][:, : p - basis.shape[1]]
        if not block.shape[1]:
            break
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0]
    _, s, v = np.linalg.svd(passes.triangle(np.linalg.qr(directions)[0]))
    return s * s, np.linalg.qr(directions)[0] @ v.T


# --- partial least squares -----------------------------------------------------------------------------------------------
def deflated(xy: np.ndarray, times: Callable[[np.ndarray], np.ndarray], a: int) -> dict[str, np.ndarray]:
    """a components of partial least squares from the products of features and targets, X'Y, and r -> X'X r: weights, loadings, rotations, inner coefficients and sizes."""
    (p, q), xy = xy.shape, xy.copy()
    weights, loadings, rotations, inner, size = (np.zeros((k, a)) for k in (p, p, p, q, 1))
    for k in range(a):
        u, _, _ = np.linalg.svd(xy, full_matrices=False)
        w = u[:, 0] * np.sign(u[np.abs(u[:, 0]).argmax(), 0])
        r = w - rotations[:, :k] @ (loadings[:, :k].T @ w)
        image = times(r)
        tt = r @ image
        weights[:, k], rotations[:, k] = w, r
        loadings[:, k], inner[:, k], size[0, k] = image / tt, xy.T @ r / tt, tt
        xy -= tt * np.outer(loadings[:, k], inner[:, k])
    return {"weights": weights, "loadings": loadings, "rotations": rotations, "inner": inner, "size": size[0]}


def varying(spread: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Standard deviations, 1 for columns that vary by no more than rounding."""
    return np.where(spread <= 10 * np.finfo(float).eps * np.abs(mean), 1.0, spread)


def spreads(squares: np.ndarray, mean: np.ndarray, n: int, scale: bool) -> np.ndarray:
    """Sample standard deviations, 1 for columns that do not vary, or all 1."""
    return varying(np.sqrt(squares / max(n - 1, 1)), mean) if scale else np.ones(len(squares))


def checked_components(a: int, most: int) -> int:
    if not 0 < a <= most:
        raise ValueError(f"n_components must be 1 to {most}")
    return a


def pls(m: Moments, q: int, a: int, scale: bool) -> dict[str, np.ndarray]:
    """Partial least squares of the last q columns on the others, from products; see deflated(), and spread."""
    p = len(m.mean) - q
    checked_components(a, p)
    spread = spreads(np.diag(m.products), m.mean, m.n, scale)
    g = m.products / np.outer(spread, spread)
    return {"spread": spread} | deflated(g[:p, p:], lambda r: g[:p, :p] @ r, a)


def pls_by_passes(passes: Passes, a: int, scale: bool) -> dict[str, np.ndarray]:
    """The same by one pass for each component."""
    o, p = passes.outline, passes.p
    checked_components(a, p)
    spread = spreads(o.squares, o.mean, o.n, scale)
    passes.spread = spread[:p]
    return {"spread": spread} | deflated(o.cross / np.outer(spread[:p], spread[p:]), passes.times, a)


def pls_path(m: Moments, q: int, a: int, scale: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(coefficients with 1 .. a components, means of the features, means of the targets)."""
    f, p = pls(m, q, a, scale), len(m.mean) - q
    by = f["spread"][p:] / f["spread"][:p, None]
    return [f["rotations"][:, :k] @ f["inner"][:, :k].T * by for k in range(1, a + 1)], m.mean[:p], m.mean[p:]


class StandardScaler(SpectralEstimator):
    """Each feature less its mean over all rows, and divided by its population standard deviation unless with_std is false."""

    params_ = {"with_mean": True, "with_std": True}

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        column = self.value("inputCol")
        o = Passes(df, column).outline
        mean = o.mean if self.value("with_mean") else np.zeros(len(o.mean))
        scale = varying(np.sqrt(o.squares / o.n), o.mean) if self.value("with_std") else np.ones(len(o.mean))
        return StandardScalerModel(mean=mean, scale=scale, inputCol=column, outputCol=self.value("outputCol"))


class StandardScalerModel(FittedTransformer):
    params_ = {"mean": None, "scale": None}

    def column(self, x: Column) -> Column:
        mean, scale = (F.lit(self.value(k)).cast("array<double>") for k in ("mean", "scale"))
        return F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), scale, lambda v, s: v / s)

    def kernel(self):
        return functools.partial(_standardised, mean=np.array(self.value("mean"), float), scale=np.array(self.value("scale"), float))


def _standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x - mean) / scale


class LatentModel(FittedTransformer):
    """Scores of spectra: (x - mean) / scale @ rotations; outputCol is scores unless set otherwise."""

    params_ = {"mean": None, "scale": None, "rotations": None, "loadings": None, "variances": None, "n_samples": 0, "coefficients": None, "target_mean": None}

    @property
    def n_components(self) -> int:
        return len(self.value("rotations")[0])

    def matrix(self, name: str) -> np.ndarray:
        return np.array(self.value(name), float)

    def kernel(self):
        return functools.partial(_scores, mean=self.matrix("mean"), scale=self.matrix("scale"), rotations=self.matrix("rotations"))

    def column(self, x: Column) -> Column:
        return by_batch(self.kernel(), x)

    def feature_names_out(self, names: list[str]) -> list[str]:
        return [f"component{i}" for i in range(self.n_components)]

    def prediction(self, x: Column) -> Column:
        """Of each target, in order."""
        if self.value("coefficients") is None:
            raise ValueError("only PLS models predict")
        return by_batch(functools.partial(_predicted, mean=self.matrix("mean"), coefficients=self.matrix("coefficients"), level=self.matrix("target_mean")), x)


def _scores(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale) @ rotations


def _predicted(x: np.ndarray, mean: np.ndarray, coefficients: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (x - mean) @ coefficients + level


class PCA(SpectralEstimator):
    """Principal components of the centred spectra; variances are sample variances. Signs: the largest loading is positive."""

    params_ = {"n_components": 2}

    def _fit(self, df: DataFrame) -> LatentModel:
        column, a = self.value("inputCol"), int(self.value("n_components"))
        if (p := length_of(df, column)) <= GRAM_FEATURES:
            m = moments(df, column, length=p)
            n, mean = m.n, m.mean
            checked_components(a, min(n, len(mean)))
            values, vectors = np.linalg.eigh(m.products)
            values, vectors = values[::-1][:a], vectors[:, ::-1][:, :a]
        else:
            passes = Passes(df, column, length=p)
            n, mean = passes.outline.n, passes.mean
            checked_components(a, min(n, len(mean)))
            values, vectors = principal(passes, a)
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(a)])
        return LatentModel(mean=mean, scale=np.ones(len(mean)), rotations=vectors, loadings=vectors, variances=values / max(n - 1, 1), n_samples=n, inputCol=column, outputCol=_scores_col(self))


class PLSRegression(SpectralEstimator):
    """Partial least squares on one or more target columns (kernel algorithm); score variances are population variances."""

    params_ = {"n_components": 2, "scale": True, "targets": ["y"]}

    def _fit(self, df: DataFrame) -> LatentModel:
        targets, column, a = tuple(self.value("targets")), self.value("inputCol"), int(self.value("n_components"))
        scale, p = bool(self.value("scale")), length_of(df, column)
        if p + len(targets) <= GRAM_FEATURES:
            m = moments(df, column, targets, p)
            n, mean, f = m.n, m.mean, pls(m, len(targets), a, scale)
        else:
            passes = Passes(df, column, targets, p)
            n, mean, f = passes.outline.n, passes.outline.mean, pls_by_passes(passes, a, scale)
        coefficients = f["rotations"] @ f["inner"].T * f["spread"][p:] / f["spread"][:p, None]
        return LatentModel(
            mean=mean[:p], scale=f["spread"][:p], rotations=f["rotations"], loadings=f["loadings"], variances=f["size"] / n, n_samples=n,
            coefficients=coefficients, target_mean=mean[p:], inputCol=column, outputCol=_scores_col(self),
        )


def _scores_col(stage: SpectralEstimator) -> str:
    return stage.value("outputCol") if stage.isSet("outputCol") else "scores"
