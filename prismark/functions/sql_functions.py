"""Pointwise stages as functions of SQL, over ARRAY<DOUBLE>: temporary functions whose bodies are lambdas, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_X = "x ARRAY<DOUBLE>"


def _let(names: str, use: str) -> str:
    """use, an expression over p.<name>, with the parameters evaluated once: what a lambda refers to is evaluated for each of its values."""
    return f"transform(array(named_struct({', '.join(f"'{n}', {n}" for n in names.split())})), p -> {use})[0]"


_DIVIDED = "CASE WHEN {b} != 0 THEN ({a}) / {b} WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') ELSE double('-Infinity') END"
#: Name, parameters, result and body; a body may use functions further up, but not inside a lambda.
FUNCTIONS = [
    ("ieee_div", "a DOUBLE, b DOUBLE", "DOUBLE", _let("a b", _DIVIDED.format(a="p.a", b="p.b"))),
    ("spectrum_mean", _X, "DOUBLE", "ieee_div(aggregate(x, 0D, (a, v) -> a + v), double(size(x)))"),
    ("spectrum_spread", f"{_X}, m DOUBLE", "DOUBLE", f"sqrt(ieee_div({_let('x m', 'aggregate(p.x, 0D, (a, v) -> a + (v - p.m) * (v - p.m))')}, double(size(x))))"),
    ("affine", f"{_X}, shift DOUBLE, by DOUBLE", "ARRAY<DOUBLE>", _let("x shift by", f"transform(p.x, v -> {_DIVIDED.format(a='(v - p.shift)', b='p.by')})")),
    ("snv", _X, "ARRAY<DOUBLE>", "affine(x, spectrum_mean(x), spectrum_spread(x, spectrum_mean(x)))"),
    ("minmax_scale", _X, "ARRAY<DOUBLE>", "affine(x, array_min(x), array_max(x) - array_min(x))"),
    ("max_scale", _X, "ARRAY<DOUBLE>", "affine(x, 0D, array_max(x))"),
    ("norm_l1", _X, "ARRAY<DOUBLE>", "affine(x, 0D, aggregate(x, 0D, (a, v) -> a + abs(v)))"),
    ("norm_l2", _X, "ARRAY<DOUBLE>", "affine(x, 0D, sqrt(aggregate(x, 0D, (a, v) -> a + v * v)))"),
    ("point_scale", f"{_X}, place INT", "ARRAY<DOUBLE>", "affine(x, 0D, element_at(x, place + 1))"),
    ("nonneg_zero", _X, "ARRAY<DOUBLE>", "transform(x, v -> greatest(v, 0D))"),
    ("nonneg_abs", _X, "ARRAY<DOUBLE>", "transform(x, v -> abs(v))"),
    ("subtract_reference", f"{_X}, reference ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(x, reference, (v, r) -> v - r)"),
    ("constant_baseline", f"{_X}, first INT, last INT", "ARRAY<DOUBLE>", "affine(x, spectrum_mean(slice(x, first + 1, last - first + 1)), 1D)"),
    ("linear_correction", _X, "ARRAY<DOUBLE>", _let("x", "transform(p.x, (v, i) -> v - (p.x[0] + (element_at(p.x, -1) - p.x[0]) * i / greatest(size(p.x) - 1, 1)))")),
    ("range_cut", f"{_X}, first INT, behind INT", "ARRAY<DOUBLE>", "slice(x, first + 1, greatest(0, least(behind, size(x)) - first))"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions in a session; their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
