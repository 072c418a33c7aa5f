"""Grid search over the parameters of any stage of a pipeline that ends in PLS.

The grid is a tree: a stage with other parameters, or behind a stage with other parameters, is another node, and what nodes
share is computed once, for all folds. The spectra at the leaves are summed up in one aggregate of products by leaf and fold;
models of all folds and numbers of components come from these sums and are judged in one more pass. So the number of
jobs does not grow with the grid. Only stages that learn are fitted fold by fold, once for each node.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.base import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.operators.base import by_batch
from prismark.operators.latent import Moments, PLSRegression, StandardScaler, moments_by, pls_path, varying
from prismark.plans.evaluation import folds_of
from prismark.sources.scratch import written

Params = dict[str, object]


@dataclass(frozen=True)
class GridSearch:
    """errors: (parameters, mean absolute error, mean of the folds') for each point of the grid, in its order; the point with the least error (of several the first), and the pipeline with it fitted on all rows."""

    errors: list[tuple[Params, float]]
    best: Params
    model: PipelineModel


def points(grid: dict[str, list]) -> list[Params]:
    """In order, the last parameter changing first."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def placed(stage: Estimator | Transformer, name: str, point: Params, **columns: str):
    """A copy of the stage with the point's parameters `name__parameter`."""
    new = stage.copy()
    for k, v in point.items():
        of, _, parameter = k.partition("__")
        if of == name:
            new._set(**{parameter: v})
    return new._set(**columns)


def _own(point: Params, names: list[str]) -> tuple:
    """What of a point belongs to some stages."""
    return tuple((k, v) for k, v in point.items() if k.partition("__")[0] in names)


class _Tree:
    """The nodes of the stages before PLS: each has a column of its own, made of its parent's."""

    def __init__(self, stages: dict[str, object], grid: dict[str, list], column: str):
        self.stages, self.column = stages, column
        names = list(stages)
        self.nodes: dict[tuple, tuple[str, object, str, str]] = {}  # (name, point) -> (column, stage, parent's column, name)
        self.leaves: dict[tuple, str] = {}
        for point in points({k: v for k, v in grid.items() if k.partition("__")[0] in names}):
            at = column
            for depth, name in enumerate(names):
                key = (depth, _own(point, names[: depth + 1]))
                if key not in self.nodes:
                    to = f"_node{len(self.nodes)}"
                    self.nodes[key] = (to, placed(stages[name], name, point, inputCol=at, outputCol=to), at, name)
                at = self.nodes[key][0]
            self.leaves[tuple(point.items())] = at

    def learns(self) -> bool:
        return any(isinstance(s, Estimator) for _, s, *_ in self.nodes.values())

    def made(self, df: DataFrame) -> DataFrame:
        """df with the columns of all nodes whose stages, and those before, learn nothing; once, in the order of the tree."""
        for _, stage, parent, _ in self.nodes.values():
            if parent in df.columns and isinstance(stage, Transformer):
                df = stage.transform(df)
        return df

    def fitted(self, df: DataFrame, train: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(df, train) with the columns of all nodes, each stage that learns fitted on train."""
        for column, stage, _, _ in self.nodes.values():
            if column not in df.columns:
                model = stage.fit(train) if isinstance(stage, Estimator) else stage
                df, train = model.transform(df), model.transform(train)
        return df, train


def _rows(df: DataFrame, leaves: list[str], targets: list[str], folds: int) -> DataFrame:
    """(g, x, targets): a row for each leaf; g is leaf * folds + fold."""
    each = F.explode(F.array(*[F.struct((F.lit(i * folds) + F.col("_fold")).cast("long").alias("g"), F.col(c).alias("x")) for i, c in enumerate(leaves)])).alias("e")
    return df.select(*targets, each).select(*targets, "e.g", "e.x")


def _scaled(m: Moments, q: int) -> tuple[Moments, np.ndarray]:
    """m as if the features had been divided by their population standard deviations, and these."""
    p = len(m.mean) - q
    by = np.r_[varying(np.sqrt(np.diag(m.products)[:p] / m.n), m.mean[:p]), np.ones(q)]
    return Moments(m.n, m.mean / by, m.products / np.outer(by, by)), by[:p]


def _models(m: Moments, q: int, most: int, scale: bool, divided: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients by number of components, means, targets' means) for spectra as they are; most: as many as the features allow."""
    by = np.ones(len(m.mean) - q)
    if divided:
        m, by = _scaled(m, q)
    coefficients, mean, level = pls_path(m, q, min(most, len(by)), scale)
    return np.stack([c / by[:, None] for c in coefficients]), mean * by, level


def _predicted(x: np.ndarray, g: np.ndarray, models: dict, most: int, q: int) -> np.ndarray:
    """For each row the predictions of each number of components, target by target; NaN where there are not so many."""
    out = np.full((len(x), most * q), np.nan)
    for k in np.unique(g):
        coefficients, mean, level = models[int(k)]
        some = g == k
        p = np.einsum("np,apq->naq", x[some] - mean, coefficients) + level
        out[np.ix_(some, range(p.shape[1] * q))] = p.reshape(len(p), -1)
    return out


def _errors(rows: DataFrame, models: dict, targets: list[str], most: int) -> dict[tuple[int, int], float]:
    """{(g, components): mean absolute error}."""
    p = by_batch(functools.partial(_predicted, models=models, most=most, q=len(targets)), F.col("x"), F.col("g"))
    long = rows.select("g", F.array(*targets).alias("y"), F.posexplode(p).alias("at", "p")).where("not isnan(p)")
    off = F.abs(F.get("y", F.col("at") % len(targets)) - F.col("p"))
    found = long.groupBy("g", F.floor(F.col("at") / len(targets)).cast("int").alias("a")).agg(F.avg(off).alias("e")).collect()
    return {(r["g"], r["a"] + 1): r["e"] for r in found if r["e"] is not None}


def grid_search(df: DataFrame, stages: dict[str, object], grid: dict[str, list], folds: int = 10, id_col: str = "id") -> GridSearch:
    """Cross-validation of every point of a grid.

    stages: by name, in order; the last is a PLSRegression. grid: values by `stage__parameter`, as in {"smooth__window_size": [5, 7],
    "pls__n_components": [1, 2, 3]}. Folds are runs of ids of even size; the error of a point is the mean over folds of the mean
    absolute error over rows and targets. Points that ask for more components than there are features have none, and are left out.
    """
    *names, last = stages
    pls = stages[last]
    if not isinstance(pls, PLSRegression):
        raise ValueError("the last stage must be a PLSRegression")
    for k in grid:
        of, _, parameter = k.partition("__")
        if of not in stages or not stages[of].hasParam(parameter):
            raise ValueError(f"no stage has the parameter {k}")
        if of == last and parameter not in ("n_components", "scale"):
            raise ValueError(f"{k} can't be searched")
    column, targets = pls.value("inputCol"), list(pls.value("targets"))
    before = {n: stages[n] for n in names}
    # A scaler in front of PLS is arithmetic on the sums: it is learnt from the same rows.
    scaler = names and isinstance(stages[names[-1]], StandardScaler) and not any(k.partition("__")[0] == names[-1] for k in grid)
    divided = bool(scaler and stages[names[-1]].value("with_std"))
    if scaler:
        column_of = before.pop(names[-1])
        if column_of.value("inputCol") != column_of.value("outputCol"):
            raise ValueError("stages must work on one column")
    tree = _Tree(before, grid, column)
    tops = points({k: v for k, v in grid.items() if k.partition("__")[0] == last}) or [{}]
    n_components = lambda top: int(top.get(f"{last}__n_components", pls.value("n_components")))
    scales = sorted({bool(t.get(f"{last}__scale", pls.value("scale"))) for t in tops})
    most, leaves = max(map(n_components, tops)), list(dict.fromkeys(tree.leaves.values()))
    made = tree.made(df.withColumn("_fold", folds_of(df, folds, id_col)))
    found: dict[bool, dict[tuple[int, int], float]] = {s: {} for s in scales}

    def judge(train, test: DataFrame, wanted: list[int]) -> None:
        """train: by g the moments to learn from."""
        held = {g: train(g) for g in wanted}
        for s in scales:
            models = {g: _models(m, len(targets), most, s, divided) for g, m in held.items() if m is not None}
            if models:
                found[s] |= _errors(test.where(F.col("g").isin(sorted(models))), models, targets, most)

    if not tree.learns():
        rows = _rows(made, leaves, targets, folds)
        sums = moments_by(rows, "x", tuple(targets), "g", len(leaves) * folds)
        # The rows of a leaf that are not of the fold.
        outside = lambda g: sums.but({k for k in sums.keys if k == g or k // folds != g // folds})
        judge(outside, rows, sums.keys)
    else:
        made = written(made, "grid")
        for k in range(folds):
            every, _ = tree.fitted(made, made.where(F.col("_fold") != k))
            rows = _rows(every.withColumn("_fold", (F.col("_fold") == k).cast("int")), leaves, targets, 2)
            sums = moments_by(rows, "x", tuple(targets), "g", len(leaves) * 2)
            own = {s: found[s] for s in scales}
            found = {s: {} for s in scales}
            judge(lambda g, sums=sums: sums[g - 1] if g - 1 in sums.keys else None, rows, [g for g in sums.keys if g % 2])
            found = {s: own[s] | {(g // 2 * folds + k, a): e for (g, a), e in found[s].items()} for s in scales}
    errors = []
    for point in points(grid):
        top = {k: v for k, v in point.items() if k.partition("__")[0] == last}
        leaf = leaves.index(tree.leaves[tuple((k, v) for k, v in point.items() if k not in top)])
        of = found[bool(top.get(f"{last}__scale", pls.value("scale")))]
        each = [of[g, a] for g in range(leaf * folds, (leaf + 1) * folds) if (g, a := n_components(top)) in of]
        if each:
            errors.append((point, sum(each) / len(each)))
    if not errors:
        raise ValueError("there are too few rows to judge any point")
    best = min(errors, key=lambda e: e[1])[0]
    return GridSearch(errors, best, Pipeline(stages=[placed(s, n, best) for n, s in stages.items()]).fit(df))
