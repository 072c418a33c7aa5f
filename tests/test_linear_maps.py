import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from prismark.functions import sql_functions
from prismark.operators import baseline, derivative, latent, linear_maps, scale, scatter, select, smooth
from prismark.sources import frames


@pytest.fixture(scope="module")
def spectra(spark):
    x = np.random.default_rng(31).normal(size=(50, 80)).cumsum(axis=1)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def values(df, column):
    return np.array([r[0] for r in df.orderBy("id").select(column).collect()])


LINEAR = [
    smooth.MeanFilter(5), smooth.SavitzkyGolayFilter(7, 2), smooth.WhittakerSmooth(20.0, 2), derivative.SavitzkyGolay(9, 2, 1, "interp"), derivative.NorrisWilliams(5, 3, 2),
    baseline.PolynomialCorrection(2), baseline.CubicSplineCorrection([0, 20, 50, 79]), baseline.LinearCorrection(), baseline.ConstantBaselineCorrection(3, 9), baseline.SubtractReference(list(range(80))), baseline.SubtractReference(),
    select.RangeCut(4, -7), select.IndexSelector([2, 70, 5]), select.IndexSelector(),
]


@pytest.mark.parametrize("stage", LINEAR, ids=lambda s: type(s).__name__)
def test_each_linear_stage_is_its_map(spectra, stage):
    want = values(stage.transform(spectra), "x")
    found = linear_maps.AffineMap.of(stage.kernel(), 80)(values(spectra, "x"))
    np.testing.assert_allclose(found, want, atol=1e-9)


def test_filters_stay_bands():
    both = [derivative.SavitzkyGolay(7, 2, 1).kernel(), smooth.MeanFilter(5).kernel()]
    of = linear_maps.AffineMap.of(lambda x: both[1](both[0](x)), 1000)
    assert of.weights.shape == (1000, 11)
    x = np.random.default_rng(1).normal(size=(3, 1000))
    np.testing.assert_allclose(of(x), both[1](both[0](x)), atol=1e-12)


def test_a_chain_is_one_python_node(spark, spectra, tmp_path):
    stages = [derivative.SavitzkyGolay(7, 2, 1), select.RangeCut(3, -3), latent.StandardScaler(with_std=False), latent.PCA(3)]
    fitted = Pipeline(stages=stages).fit(spectra)
    fused = PipelineModel(linear_maps.fused(fitted, 80))
    assert len(fused.stages) == 1 and len(fused.stages[0].value("offset")) == 3
    one, other = fitted.transform(spectra).select("id", "scores"), fused.transform(spectra).select("id", "scores")
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert nodes(one) == 2 and nodes(other) == 1
    np.testing.assert_allclose(values(other, "scores"), values(one, "scores"), atol=1e-9)
    fused.save(str(tmp_path / "m"))
    np.testing.assert_allclose(values(PipelineModel.load(str(tmp_path / "m")).transform(spectra), "scores"), values(one, "scores"), atol=1e-9)
    # What is not linear stays in its place and ends a run.
    mixed = [smooth.MeanFilter(3), smooth.MeanFilter(5), scatter.StandardNormalVariate(), baseline.LinearCorrection(), baseline.SubtractReference([1.0] * 80)]
    few = linear_maps.fused(mixed, 80)
    assert [type(s).__name__ for s in few] == ["LinearMap", "StandardNormalVariate", "LinearMap"]
    np.testing.assert_allclose(values(PipelineModel(few).transform(spectra), "x"), values(PipelineModel(mixed).transform(spectra), "x"), atol=1e-9)
    with pytest.raises(Exception, match="is for 80 values"):
        few[0].transform(spectra.withColumn("x", F.slice("x", 1, 9))).collect()


def test_a_cut_reads_only_its_columns(spark, tmp_path):
    names = [f"{400 + i}.5" for i in range(1047)]
    x = np.random.default_rng(2).normal(size=(4, 1047))
    wide = frames.to_wide(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), names)
    wide.write.parquet(str(tmp_path / "wide"))
    df = frames.transformed_wide(spark.read.parquet(str(tmp_path / "wide")), names, [select.RangeCut(100, 130), scatter.StandardNormalVariate()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = df._jdf.queryExecution().executedPlan().collectLeaves().head().schema().fieldNames()
    assert sorted(read) == sorted(["id", *names[100:130]]), plan[:500]
    part = x[:, 100:130]
    np.testing.assert_allclose(values(df, "x"), (part - part.mean(axis=1, keepdims=True)) / part.std(axis=1, keepdims=True))


def test_sql_functions_are_the_stages(spark, spectra):
    odd = spark.createDataFrame([(50, [2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0]), (51, None), (52, [0.0] * 9 + [-1.0])], "id long, x array<double>")
    df = spectra.unionByName(odd)
    names = sql_functions.register(spark)
    assert len(names) == len(set(names))
    df.createOrReplaceTempView("some_spectra")
    pairs = {
        "snv(x)": scatter.StandardNormalVariate(), "minmax_scale(x)": scale.MinMaxScaler(), "max_scale(x)": scale.MinMaxScaler(use_min=False), "norm_l1(x)": scale.NormScaler(1), "norm_l2(x)": scale.NormScaler(),
        "point_scale(x, 3)": scale.PointScaler(3), "nonneg_zero(x)": baseline.NonNegative(), "nonneg_abs(x)": baseline.NonNegative("abs"), "constant_baseline(x, 2, 6)": baseline.ConstantBaselineCorrection(2, 6), "linear_correction(x)": baseline.LinearCorrection(), "range_cut(x, 2, 8)": select.RangeCut(2, 8),
    }
    for call, stage in pairs.items():
        got = {r.id: r.x for r in spark.sql(f"select id, {call} as x from some_spectra").collect()}
        for r in stage.transform(df).collect():
            assert (got[r.id] is None) == (r.x is None), (call, r.id)
            if r.x is not None:
                np.testing.assert_allclose(got[r.id], r.x, atol=1e-12, err_msg=call)
