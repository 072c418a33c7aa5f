"""What the documented workflows do around the operators: splits, cross-validation, label codes, confusion counts, summaries."""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from prismark.functions.order_statistics import exact_quantiles, whole_cuts
from prismark.functions.selection import smallest
from prismark.operators.base import by_batch
from prismark.operators.latent import moments, moments_by, pls_path
from prismark.sources.scratch import written


def draw_key(seed: int, id_col: str) -> Column:
    """A draw for each id as a long of 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def quotas(counts: DataFrame, total: int) -> DataFrame:
    """(_c, quota) of (_c, n): total dealt in proportion to n, by largest remainder; of equal remainders the first class has it."""
    n = counts.agg(F.sum("n")).first()[0] or 1
    share = F.col("n").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    parts = counts.select("_c", share.alias("share")).withColumn("floor", F.expr(f"share div cast({n} as decimal(19,0))"))
    parts = parts.withColumn("rest", F.col("share") - F.col("floor").cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)"))
    left = total - (parts.agg(F.sum("floor")).first()[0] or 0)
    more = parts.orderBy(F.desc("rest"), "_c").limit(int(left)).select(F.col("_c").alias("_more")) if left else None
    if more is None:
        return parts.select("_c", F.col("floor").alias("quota"))
    met = parts.join(more, F.col("_c").eqNullSafe(F.col("_more")), "left")
    # A null class is not told from no match by its name.
    return met.join(more.where("_more is null").groupBy().agg(F.count("*").alias("_null")), how="cross").select("_c", (F.col("floor") + F.when(F.col("_more").isNotNull() | (F.col("_c").isNull() & (F.col("_null") > 0)), F.lit(1)).otherwise(F.lit(0))).alias("quota"))


def split(df: DataFrame, test_share: float, seed: int = 42, id_col: str = "id", stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): of n rows exactly ceil(test_share * n) are test rows, those with the smallest draws by seed and id, the same on any partitioning.

    With `stratify`, a column, the classes have test rows in proportion, by largest remainder; a class of one row is an error, and so are
    fewer test or train rows than classes. Equal draws are told apart by id, rows of one id by what they hold; null ids and classes are values like others.
    """
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    rows = df.withColumn("_key", draw_key(seed, id_col)).withColumn("_class", F.lit(0) if stratify is None else F.col(stratify))
    counts = rows.groupBy(F.col("_class").alias("_c")).agg(F.count("*").alias("n"))
    counts = counts if stratify is None else written(counts, "classes")
    n, classes, least = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.min("n")).first()
    total = math.ceil(Fraction(repr(test_share)) * n)
    if stratify is not None and n:
        if least < 2:
            raise ValueError("a class of one row can't be in both parts")
        if min(total, n - total) < classes:
            raise ValueError(f"{classes} classes need as many test and train rows")
    wanted = counts.select("_c", F.lit(total).alias("quota")) if stratify is None else quotas(counts, total)
    tie = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    out = smallest(rows, wanted.withColumnRenamed("_c", "_class"), "_key", "_class", tie, "_test")
    names = [F.col(f"`{c}`") for c in df.columns]
    return out.where("not _test").select(*names), out.where("_test").select(*names)


def label_codes(df: DataFrame, label: str, output: str = "code") -> DataFrame:
    """Labels numbered in alphabetical order; a null label has no number.

    Distinct labels are sorted once, by ranges, and numbered by how many there are in the ranges before; they meet the rows in a
    join, and Spark sends them to all tasks only if they are small.
    """
    names = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_name")).distinct().orderBy("_name")
    names = written(names.withColumn("_place", F.monotonically_increasing_id()), "labels")
    part = F.shiftright("_place", 33)
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    ahead = names.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    coded = names.join(F.broadcast(ahead), part == F.col("part")).select("_name", (F.col("_ahead") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(output))
    return df.drop(output).join(coded, F.col(label) == F.col("_name"), "left").drop("_name")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of (actual, rounded prediction); halves go to the even number."""
    return df.groupBy(F.col(actual).cast("long").alias("actual"), F.bround(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> Column:
    return F.avg((F.col(actual) == F.bround(predicted)).cast("double"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample standard deviation, minimum, exact quartiles and maximum."""
    c = F.col(column).cast("double")
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75]).get(0, [None] * 3)
    known = [F.lit(q).cast("double").alias(k) for k, q in zip(("q25", "q50", "q75"), quartiles, strict=True)]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), *known, F.max(c).alias("high"))


def folds_of(df: DataFrame, folds: int, id_col: str = "id") -> Column:
    """The fold of each row: runs of ids of even size, in the order of ids."""
    cuts = whole_cuts(df, id_col, [k / folds for k in range(1, folds)])
    return sum(((F.col(id_col) > c).cast("int") for c in cuts), F.lit(0))


def cross_validated_error(df: DataFrame, stages: list, components: list[int], target: str = "y", folds: int = 10, id_col: str = "id", scale: bool = False) -> dict[int, float]:
    """Mean over unshuffled folds of the mean absolute error of PLS, by number of components.

    Stages that learn nothing are applied once, and one aggregate of cross products by fold gives the models of all folds;
    stages that learn are fitted for each fold. Models of all numbers of components come out of the largest one's.
    """
    numbered = df.withColumn("_fold", folds_of(df, folds, id_col))
    most = max(components)
    errors: dict[int, list[float]] = {a: [] for a in components}

    def judge(test: DataFrame, models: dict[int, list]) -> None:
        """models: by fold the coefficients of each number of components, means and target's mean."""
        predicted = by_batch(functools.partial(_all_predictions, models=models), F.col("x"), F.col("_fold"))
        long = test.select("_fold", target, F.posexplode(predicted).alias("_a", "_p"))
        found = long.groupBy("_a", "_fold").agg(F.avg(F.abs(F.col(target) - F.col("_p"))).alias("e")).collect()
        for r in found:
            if r["e"] is not None and r["_a"] + 1 in errors:
                errors[r["_a"] + 1].append(r["e"])

    if not any(isinstance(s, Estimator) for s in stages):
        ready = numbered
        for s in stages:
            ready = s.transform(ready)
        parts = moments_by(ready, "x", (target,), "_fold", folds)
        models = {k: pls_path(parts.but({k}), 1, most, scale) for k in parts.keys if len(parts.keys) > 1}
        judge(ready, models)
    else:
        for k in range(folds):
            fitted = Pipeline(stages=list(stages)).fit(numbered.where(F.col("_fold") != k))
            ready = fitted.transform(numbered.where(F.col("_fold") != k))
            judge(fitted.transform(numbered.where(F.col("_fold") == k)), {k: pls_path(moments(ready, "x", (target,)), 1, most, scale)})
    return {a: sum(e) / len(e) for a, e in errors.items() if e}


def _all_predictions(x: np.ndarray, fold: np.ndarray, models: dict) -> np.ndarray:
    """One column for each number of components."""
    out = np.full((len(x), len(next(iter(models.values()))[0])), np.nan)
    for k in np.unique(fold):
        if k in models:
            coefficients, mean, level = models[k]
            out[fold == k] = (x[fold == k] - mean) @ np.stack([c[:, 0] for c in coefficients], axis=1) + level[0]
    return out


def latest_measurement(spectra: DataFrame, measured: DataFrame, ts: str, value: str, by: str, span: float = 86_400.0) -> DataFrame:
    """spectra with the last value measured at or before each row's time (as-of join): a union and windows, no range join.

    Windows are those of one `by` in one span of seconds, so a key with many rows is no single task; what is known when a
    span begins comes from the last value of each span before.
    """
    s = spectra.withColumn("_measured", F.lit(None).cast("double")).withColumn("_is", F.lit(1))
    m = measured.select(by, ts, F.col(value).cast("double").alias("_measured"), F.lit(0).alias("_is")).where("_measured is not null")
    both = s.unionByName(m, allowMissingColumns=True)
    time = F.col(ts).cast("timestamp") if isinstance(both.schema[ts].dataType, TimestampNTZType) else F.col(ts)
    both = both.withColumn("_span", F.floor(time.cast("double") / span))
    inside = Window.partitionBy(by, "_span").orderBy(ts, "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(by, "_span").agg(F.max(F.when(F.col("_is") == 0, F.struct(ts, "_measured")))["_measured"].alias("_end"))
    before = ends.select(F.col(by).alias("_by"), F.col("_span").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    out = both.withColumn("_now", F.last("_measured", ignorenulls=True).over(inside)).where("_is = 1")
    out = out.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_of")), "left")
    return out.withColumn(value, F.coalesce("_now", "_before")).drop("_measured", "_is", "_span", "_now", "_by", "_of", "_before")
