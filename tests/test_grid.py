import itertools

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from prismark.operators import baseline, derivative, latent, scatter, select
from prismark.plans import grid


@pytest.fixture(scope="module")
def training(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(90, 30)).cumsum(axis=1)
    rows = [(i, v.tolist(), float(v[20] - v[10] + 0.1 * rng.normal()), float(v[5])) for i, v in enumerate(x)]
    path = str(tmp_path_factory.mktemp("grid") / "t")
    spark.createDataFrame(rows, "id long, x array<double>, y double, z double").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def by_hand(df, stages, point, folds, targets=("y",)):
    errors = []
    n = 90 // folds
    for k in range(folds):
        inside = (F.col("id") >= n * k) & (F.col("id") < n * (k + 1))
        model = Pipeline(stages=[grid.placed(s, name, point) for name, s in stages.items()]).fit(df.where(~inside))
        ready = df.where(inside)
        for s in model.stages[:-1]:
            ready = s.transform(ready)
        p = ready.select(*targets, model.stages[-1].prediction(F.col("x")).alias("p")).collect()
        errors.append(np.mean([abs(r[t] - r.p[i]) for r in p for i, t in enumerate(targets)]))
    return np.mean(errors)


def test_points_are_what_fits_one_by_one_give(spark, training):
    stages = {"cut": select.RangeCut(0, 29), "slope": derivative.SavitzkyGolay(5, 2, 1), "scale": latent.StandardScaler(), "pls": latent.PLSRegression(2, scale=False)}
    options = {"cut__end": [20, 29], "slope__window_size": [5, 9], "pls__n_components": [1, 3], "pls__scale": [False, True]}
    found = grid.grid_search(training, stages, options, folds=3)
    assert [p for p, _ in found.errors] == [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]
    for point, error in found.errors[::5]:
        assert abs(error - by_hand(training, stages, point, 3)) < 1e-8
    assert found.best == min(found.errors, key=lambda e: e[1])[0]
    best = found.model.stages
    assert best[1].value("window_size") == found.best["slope__window_size"] and best[-1].n_components == found.best["pls__n_components"]


def test_stages_that_learn_are_fitted_for_each_fold(spark, training):
    stages = {"msc": scatter.MultiplicativeScatterCorrection(), "line": baseline.LinearCorrection(), "centre": latent.StandardScaler(with_std=False), "pls": latent.PLSRegression(2, targets=["y", "z"])}
    found = grid.grid_search(training, stages, {"msc__method": ["mean", "median"], "pls__n_components": [1, 2]}, folds=3)
    for point, error in found.errors:
        assert abs(error - by_hand(training, stages, point, 3, ("y", "z"))) < 1e-8


def test_jobs_do_not_grow_with_the_grid(spark, training):
    sc = spark.sparkContext

    def jobs(windows):
        group = f"grid{len(windows)}"
        sc.setJobGroup(group, group)
        tree = grid.grid_search(training, {"snv": scatter.StandardNormalVariate(), "slope": derivative.SavitzkyGolay(5, 2, 1), "pls": latent.PLSRegression(2)}, {"slope__window_size": windows, "pls__n_components": [1, 2, 3]}, folds=3)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(tree.errors) == 3 * len(windows)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs([5]) == jobs([5, 7, 9, 11, 13])


def test_shared_prefixes_are_one_node():
    stages = {"snv": scatter.StandardNormalVariate(), "slope": derivative.SavitzkyGolay(5, 2, 1), "cut": select.RangeCut(0, 20)}
    tree = grid._Tree(stages, {"slope__window_size": [5, 7], "cut__end": [10, 20], "pls__n_components": [1, 2]}, "x")
    assert [n for *_, n in tree.nodes.values()] == ["snv", "slope", "cut", "cut", "slope", "cut", "cut"] and len(tree.leaves) == 4


def test_bad_grids_are_refused(training):
    stages = {"snv": scatter.StandardNormalVariate(), "pls": latent.PLSRegression(2)}
    for s, g in ((stages, {"snv__window": [1]}), (stages, {"none__x": [1]}), (stages, {"pls__targets": [["z"]]}), ({"snv": stages["snv"]}, {})):
        with pytest.raises(ValueError):
            grid.grid_search(training, s, g)
