"""Spectra as wide, long and array tables; the array table (id, x: ARRAY<DOUBLE>) is what operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.operators.select import IndexSelector, RangeCut


def checked(x: Column, n: int | None = None) -> Column:
    """x, or an error when Spark meets a null array, a value that is null or not finite, or another length than n."""
    bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if n is not None:
        bad = bad | (F.size(x) != n)
    return F.when(bad, F.raise_error("spectra must be arrays of finite numbers" + (f" of length {n}" if n else ""))).otherwise(x)


def from_wide(df: DataFrame, columns: list[str], id_col: str = "id", name: str = "x") -> DataFrame:
    """One array from columns in the order given; the other columns stay."""
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(name))


def transformed_wide(df: DataFrame, columns: list[str], stages: list, name: str = "x") -> DataFrame:
    """The stages over spectra that are `columns` of a wide table, as one array.

    Selectors in front choose among the columns before there is an array, so a scan reads only the chosen ones.
    """
    stages = list(stages)
    rest = [c for c in df.columns if c not in set(columns)]
    while stages and isinstance(stages[0], IndexSelector | RangeCut):
        columns = stages.pop(0).feature_names_out(columns)
    out = from_wide(df.select(*rest, *[F.col(f"`{c}`") for c in columns]), columns, name=name)
    for stage in stages:
        out = stage.transform(out)
    return out


def to_wide(df: DataFrame, names: list[str], name: str = "x") -> DataFrame:
    """One column per feature."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.get(name, i).alias(c) for i, c in enumerate(names)])


def from_long(df: DataFrame, id_col: str, order: list[str], value: str, name: str = "x") -> DataFrame:
    """One array per id, its values in the order of the columns `order`."""
    values = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(id_col).agg(F.transform(values, lambda s: s["_v"]).alias(name))


def to_long(df: DataFrame, id_col: str = "id", name: str = "x", value: str = "value") -> DataFrame:
    """(id, pos from 0, value)."""
    long = df.select(id_col, F.posexplode(name).alias("pos", value))
    return long.withColumn("pos", F.col("pos").cast("long"))
