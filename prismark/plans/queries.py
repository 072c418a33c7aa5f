"""Queries over spectra: each applies one operator to a whole table. Results are long (id, pos, value) or one row per spectrum.

The tables read as spectra: `embeddings`, 64 values each, and `events`, the values of a user in order of time.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prismark.functions import linear, sql_functions
from prismark.operators import augment, baseline, derivative, latent, linear_maps, outliers, scale, scatter, select, smooth
from prismark.operators.base import SpectralEstimator, SpectralTransformer, feature_names_out
from prismark.plans import evaluation, grid, iterated_sql
from prismark.sources import datasets, frames
from prismark.sources.scratch import new_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Features of an `embeddings` row.
N = 64


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y) of the embeddings."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), frames.checked(F.col("embedding").cast("array<double>")).alias("x"), F.col("label").cast("double").alias("y"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x) of the events: positive, of several lengths."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return frames.from_long(t, "user_id", ["ts", "event_id"], "value").withColumnRenamed("user_id", "id")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def long(df: DataFrame, name: str = "x", digits: int = 6) -> DataFrame:
    return frames.to_long(df, "id", name).withColumn("value", rounded(F.col("value"), digits))


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def stage(name: str, s: SpectralTransformer | SpectralEstimator, sql: str | None = None, source=spectra, digits: int = 6) -> None:
    """Registers a stage, fitted on the table where it learns, over that table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        fitted = s.fit(df) if isinstance(s, SpectralEstimator) else s
        return long(fitted.transform(df), digits=digits)

    add(name, query, sql)


E_CTE = "with e as (select vec_id as id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings)"
S_CTE = "with e as (select user_id as id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value as v from events)"
V = "round({}, 6) + 0.0 as value"


def each(value: str, more: str = "", cte: str = E_CTE, source: str = "e") -> str:
    """SQL of (id, pos, value) from the long table e."""
    return f"{cte}{', ' + more if more else ''} select id, pos::bigint as pos, {V.format(value)} from {source}"


# --- scaling and scatter -------------------------------------------------------------------------------------------
W = "over (partition by id)"
stage("minmax", scale.MinMaxScaler(), each(f"(v - min(v) {W}) / (max(v) {W} - min(v) {W})"))
stage("maxscale", scale.MinMaxScaler(use_min=False), each(f"v / max(v) {W}"))
stage("norm_l1", scale.NormScaler(1), each(f"v / sum(abs(v)) {W}"))
stage("norm_l2", scale.NormScaler(), each(f"v / sqrt(sum(v * v) {W})"))
stage("norm_l3", scale.NormScaler(3), each(f"v / (sum(abs(v) ** 3) {W}) ** (1 / 3.0)"))
stage("norm_linf", scale.NormScaler(float("inf")), each(f"v / max(abs(v)) {W}"))
stage("point_scale", scale.PointScaler(3), each("v / p", "p as (select id, v as p from e where pos = 3)", source="e join p using (id)"), source=series)
ORACLE_SQL["point_scale"] = each("v / p", "p as (select id, v as p from e where pos = 3)", cte=S_CTE, source="e join p using (id)")
stage("snv", scatter.StandardNormalVariate(), each(f"(v - avg(v) {W}) / stddev_pop(v) {W}"))
RNV = "q as (select id, quantile_cont(v, 0.25) as q from e group by id), s as (select e.id, any_value(q) as q, stddev_pop(v) as sd from e join q on e.id = q.id where v <= q group by e.id)"
stage("rnv", scatter.RobustNormalVariate(), each("(v - q) / sd", RNV, source="e join s using (id)"))
MSC = "r as (select pos, {}(v) as r from e group by pos), f as (select id, regr_slope(v, r) as m, regr_intercept(v, r) as c from e join r using (pos) group by id)"
stage("msc_mean", scatter.MultiplicativeScatterCorrection(), each("(v - c) / m", MSC.format("avg"), source="e join f using (id)"))
stage("msc_median", scatter.MultiplicativeScatterCorrection(method="median"), each("(v - c) / m", MSC.format("median"), source="e join f using (id)"))
stage("emsc_order0", scatter.ExtendedMultiplicativeScatterCorrection(order=0), each("(v - c) / m", MSC.format("avg"), source="e join f using (id)"))
# For a fixed reference the coefficients are fixed rows; here reference place^1.5 scaled, order 1.
REFERENCE = [round(float((i / N) ** 1.5), 6) for i in range(N)]


def _emsc_sql() -> str:
    design = np.column_stack([np.ones(N), np.arange(N, dtype=float), REFERENCE])
    rows = ", ".join(f"({i}, {', '.join(repr(float(c)) for c in col)}, {REFERENCE[i]!r})" for i, col in enumerate(np.linalg.pinv(design).T))
    more = f"k(pos, a, b, c, r) as (values {rows}), f as (select id, sum(v * a) as a, sum(v * b) as b, sum(v * c) as c from e join k using (pos) group by id)"
    return each("(v - f.a - f.b * pos) / f.c", more, source="e join f using (id)")


stage("emsc_order1", scatter.ExtendedMultiplicativeScatterCorrection(order=1, reference=REFERENCE), _emsc_sql())


def _emsc2_sql() -> str:
    """The mean as reference, and powers up to 2: what is left of both beside the parabolas gives the factor, the parabola of the rest is taken out."""
    basis, _ = np.linalg.qr(np.vander(np.linspace(-1, 1, N), 3))
    parts = ", ".join(f"({i}, {k}, {float(basis[i, k])!r})" for i in range(N) for k in range(3))
    more = f"""p(pos, k, c) as (values {parts}), r as (select pos, avg(v) as r from e group by pos),
rk as (select k, sum(r * c) as a from r join p using (pos) group by k), ro as (select pos, r, any_value(r) - sum(a * c) as o from r join p using (pos) join rk using (k) group by pos, r),
m as (select id, sum(v * o) / (select sum(o * o) from ro) as m from e join ro using (pos) group by id),
ek as (select id, k, sum((v - m * r) * c) as a from e join r using (pos) join m using (id) join p using (pos) group by id, k),
b as (select id, pos, sum(a * c) as b from ek join p using (k) group by id, pos)"""
    return each("(v - b) / m", more, source="e join b using (id, pos) join m using (id)")


stage("emsc", scatter.ExtendedMultiplicativeScatterCorrection(), _emsc2_sql())

# Weights multiply both sides: a regression with their squares as weights.
WEIGHTS = [round(0.5 + (i * 7 % N) / N, 6) for i in range(N)]
WEIGHTED = f"""w(pos, q) as (values {", ".join(f"({i}, {w * w!r})" for i, w in enumerate(WEIGHTS))}), r as (select pos, avg(v) as r from e group by pos),
a as (select id, sum(q * v) / sum(q) as mv, sum(q * r) / sum(q) as mr from e join r using (pos) join w using (pos) group by id),
f as (select id, sum(q * (v - mv) * (r - mr)) / sum(q * (r - mr) * (r - mr)) as m, any_value(mv) as mv, any_value(mr) as mr from e join r using (pos) join w using (pos) join a using (id) group by id)"""
stage("msc_weighted", scatter.MultiplicativeScatterCorrection(weights=WEIGHTS), each("(v - (mv - m * mr)) / m", WEIGHTED, source="e join f using (id)"))
stage("emsc_weighted", scatter.ExtendedMultiplicativeScatterCorrection(order=0, weights=WEIGHTS), each("(v - (mv - m * mr)) / m", WEIGHTED, source="e join f using (id)"))

# --- baselines -----------------------------------------------------------------------------------------------------
stage("constant_baseline", baseline.ConstantBaselineCorrection(7, 12), each("v - m", "m as (select id, avg(v) as m from e where pos between 7 and 12 group by id)", source="e join m using (id)"))
ENDS = "g as (select id, max(pos) as n, arg_min(v, pos) as a, arg_max(v, pos) as b from e group by id)"
stage("linear_correction", baseline.LinearCorrection(), each("v - (a + (b - a) * pos / n)", ENDS, source="e join g using (id)"))


def snv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scatter.StandardNormalVariate().transform(series(spark, sf_dir))
    return long(baseline.LinearCorrection().transform(df))


SNV_ENDS = "s as (select id, pos, (v - avg(v) over (partition by id)) / stddev_pop(v) over (partition by id) as v from e), g as (select id, max(pos) as n, arg_min(v, pos) as a, arg_max(v, pos) as b from s group by id)"
add("linear_correction_series", snv_line, each("v - (a + (b - a) * pos / n)", SNV_ENDS, cte=S_CTE, source="s join g using (id)"))
stage("cubic_spline", baseline.CubicSplineCorrection(), each("v - (a + (b - a) * pos / n)", ENDS, source="e join g using (id)"))
stage("nonneg_zero", baseline.NonNegative(), each("greatest(v, 0)"))
stage("nonneg_abs", baseline.NonNegative("abs"), each("abs(v)"))
stage("subtract_reference", baseline.SubtractReference(REFERENCE), each("v - r", f"r(pos, r) as (values {', '.join(f'({i}, {r!r})' for i, r in enumerate(REFERENCE))})", source="e join r using (pos)"))
LINE = "f as (select id, regr_slope(v, pos) as m, regr_intercept(v, pos) as c from e group by id)"
stage("poly_detrend_1", baseline.PolynomialCorrection(), each("v - (c + m * pos)", LINE, source="e join f using (id)"))


def _coefficients(matrix: np.ndarray, value: str = "v - b") -> str:
    """A value of v and b = x @ matrix in SQL, the matrix given by value."""
    i, j = np.nonzero(np.abs(matrix) > 1e-15)
    rows = ", ".join(f"({a}, {b}, {float(matrix[a, b])!r})" for a, b in zip(i, j, strict=True))
    return f"{E_CTE}, k(pos, o, c) as (values {rows}), b as (select id, o as pos, sum(v * c) as b from e join k using (pos) group by id, o) select id, pos::bigint as pos, {V.format(value)} from e join b using (id, pos)"


def _quadratic() -> np.ndarray:
    powers = np.vander(np.linspace(-1, 1, N), 3)
    q, _ = np.linalg.qr(powers)
    return q @ q.T


stage("poly_detrend_2", baseline.PolynomialCorrection(2), _coefficients(_quadratic()))
KNOTS = [0, 9, 20, 33, 47, 63]


def _truncated_powers() -> np.ndarray:
    """The not-a-knot spline through KNOTS written in truncated powers: its inner break points are all knots but the second and the last but one."""
    t, at = np.array(KNOTS) / N, np.arange(N) / N
    basis = lambda u: np.column_stack([u[:, None] ** np.arange(4), np.maximum(u[:, None] - t[2:-2], 0) ** 3])
    out = np.zeros((N, N))
    out[KNOTS] = (basis(at) @ np.linalg.inv(basis(t))).T
    return out


stage("cubic_spline_knots", baseline.CubicSplineCorrection(KNOTS), _coefficients(_truncated_powers()))
stage("airpls", baseline.AirPls(), iterated_sql.airpls(S_CTE, 100.0, 15), source=series)


def _solved(name: str, source: str) -> str:
    """CTEs up to `name`(id, pos, z): (W + 100 D'D) z = W v for `source`(id, pos, v, w), by elimination from the left and substitution from the right."""
    ends = f"case when s.pos = {N - 1} then 100.0 else 200.0 end"
    return f"""{name}_up(id, pos, c, d) as (
    select id, pos, -100.0::double / (w + 100.0), w * v / (w + 100.0) from {source} where pos = 0
    union all
    select s.id, s.pos, -100.0::double / (s.w + {ends} + 100.0 * u.c), (s.w * s.v + 100.0 * u.d) / (s.w + {ends} + 100.0 * u.c)
    from {name}_up u join {source} s on s.id = u.id and s.pos = u.pos + 1),
{name}(id, pos, z) as (
    select id, pos, d from {name}_up where pos = {N - 1}
    union all
    select u.id, u.pos, u.d - u.c * n.z from {name} n join {name}_up u on u.id = n.id and u.pos = n.pos - 1)"""


# Two solves: the second with weights from the first, unless that has converged.
AIR = f"""with recursive a as (select vec_id as id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v, 1.0::double as w from embeddings),
{_solved("z1", "a")},
d as (select id, pos, v, z, v - z as d from a join z1 using (id, pos)),
t as (select id, abs(sum(case when d < 0 then d end)) as s, max(case when d < 0 then d end) as m, 0.001 * sum(abs(v)) as small from d group by id),
b as (select id, pos, v, case when pos in (0, {N - 1}) then exp(m / s) when d >= 0 then 0.0 else exp(abs(d) / s) end as w from d join t using (id)),
{_solved("z2", "b")}
select id, pos::bigint as pos, {V.format("d.v - case when t.s < t.small then d.z else z2.z end")} from d join t using (id) join z2 using (id, pos)"""
stage("airpls_two_solves", baseline.AirPls(nr_iterations=3), AIR)
stage("arpls", baseline.ArPls(lam=1e2, ratio=1e-2), iterated_sql.arpls(S_CTE, 1e2, 1e-2, 100), source=series)

# --- selection -----------------------------------------------------------------------------------------------------
stage("index_select", select.IndexSelector([40, 3, 3, 17, 63]), each("v", "s as (select *, row_number() over (partition by id order by pos) - 1 as k from e where pos in (3, 17, 40, 63))", source="(select id, k as pos, v from s)"))
stage("index_select_all", select.IndexSelector(), each("v"))
AXIS = [400.0 + 2.5 * i for i in range(N)]
stage("range_cut", select.RangeCut(), each("v", source="e where pos < 63"))
stage("range_cut_axis", select.RangeCut(426.0, 502.4, AXIS), each("v", source="(select id, pos - 10 as pos, v from e where pos >= 10 and pos < 41)"))

# --- smoothing and derivatives -------------------------------------------------------------------------------------


def stencil(weights: list[float], left: int, cte: str = E_CTE) -> str:
    """Weighted sums over a window, places beyond the ends clamped to them."""
    rows = ", ".join(f"({k - left}, {float(w)!r})" for k, w in enumerate(weights))
    near = "greatest(0, least(n, a.pos + o))"
    body = f"g as (select id, max(pos) as n from e group by id), k(o, c) as (values {rows})"
    return f"{cte}, {body} select a.id, a.pos::bigint as pos, {V.format('sum(b.v * c)')} from e a join g on a.id = g.id cross join k join e b on b.id = a.id and b.pos = {near} group by a.id, a.pos"


stage("mean_filter", smooth.MeanFilter(5), stencil([0.2] * 5, 2))
stage("mean_filter_even", smooth.MeanFilter(4), stencil([0.25] * 4, 2))
stage("mean_filter_series", smooth.MeanFilter(5), stencil([0.2] * 5, 2, S_CTE), source=series)
MEDIAN = f"{E_CTE}, k as (select unnest([-2, -1, 0, 1, 2]) as o) select a.id, a.pos::bigint as pos, {V.format('median(b.v)')} from e a cross join k join e b on b.id = a.id and b.pos = greatest(0, least({N - 1}, a.pos + o)) group by a.id, a.pos"
stage("median_filter", smooth.MedianFilter(5), MEDIAN)
stage("savgol_smooth", smooth.SavitzkyGolayFilter(5, 2), stencil([c / 35 for c in (-3, 12, 17, 12, -3)], 2))
stage("savgol_derivative", derivative.SavitzkyGolay(5, 2, 1), stencil([c / 10 for c in (-2, -1, 0, 1, 2)], 2))
stage("savgol_second", derivative.SavitzkyGolay(5, 2, 2), stencil([c / 7 for c in (2, -1, -2, -1, 2)], 2))


def _edge_fits() -> np.ndarray:
    """Derivative of the parabola through the seven points around each place, or the seven at the end."""
    out = np.zeros((N, N))
    for i in range(N):
        first = min(max(i - 3, 0), N - 7)
        for k in range(7):
            c = np.polyfit(np.arange(7.0), np.eye(7)[k], 2)
            out[first + k, i] = np.polyval(np.polyder(c), i - first)
    return out


stage("savgol_interp", derivative.SavitzkyGolay(7, 2, 1, "interp"), _coefficients(_edge_fits(), "b"))


def _norris(weights: str) -> str:
    box = f"s as (select a.id, a.pos, avg(b.v) as v from e a cross join (select unnest([-2, -1, 0, 1, 2]) as o) k join e b on b.id = a.id and b.pos = greatest(0, least({N - 1}, a.pos + o)) group by a.id, a.pos)"
    near = f"greatest(0, least({N - 1}, a.pos + o))"
    return f"{E_CTE}, {box}, k(o, c) as (values {weights}) select a.id, a.pos::bigint as pos, {V.format('sum(b.v * c) / 3')} from s a cross join k join s b on b.id = a.id and b.pos = {near} group by a.id, a.pos"


stage("norris_williams_1", derivative.NorrisWilliams(), _norris("(1, 1), (-1, -1)"))
stage("norris_williams_2", derivative.NorrisWilliams(derivative_order=2), _norris("(1, 1), (0, -2), (-1, 1)"))
# Tridiagonal elimination from the left, then substitution from the right; 100 is lam.
stage(
    "whittaker",
    smooth.WhittakerSmooth(),
    f"""with recursive e as (select vec_id as id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings),
up(id, pos, c, d) as (
    select id, pos, -100.0::double / 101.0, v / 101.0 from e where pos = 0
    union all
    select e.id, e.pos, -100.0::double / (case when e.pos = {N - 1} then 101.0 else 201.0 end + 100.0 * up.c), (e.v + 100.0 * up.d) / (case when e.pos = {N - 1} then 101.0 else 201.0 end + 100.0 * up.c)
    from up join e on e.id = up.id and e.pos = up.pos + 1),
down(id, pos, z) as (
    select id, pos, d from up where pos = {N - 1}
    union all
    select up.id, up.pos, up.d - up.c * down.z from down join up on up.id = down.id and up.pos = down.pos - 1)
select id, pos::bigint as pos, {V.format("z")} from down""",
)
SECOND = np.diff(np.eye(N), 2, axis=0)
stage("whittaker_second", smooth.WhittakerSmooth(50.0, 2), _coefficients(np.linalg.solve(np.eye(N) + 50.0 * SECOND.T @ SECOND, np.eye(N)), "b"))

# --- augmentation --------------------------------------------------------------------------------------------------


def draw(*key: str) -> str:
    """random_draws.uniform in SQL."""
    text = " || ':' || ".join(f"({k})::varchar" for k in key)
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / {float(2**52)!r})"


U = draw("7", "id", "0")
stage("baseline_shift", augment.BaselineShift(scale=0.5, random_state=7), each(f"v + {U} * 0.5"))
stage("spectrum_scale", augment.SpectrumScale(scale=0.2, random_state=7), each(f"v * (0.8 + {U} * (1.2 - 0.8))"))
NORMAL = f"sqrt(-2.0 * ln(1.0 - {draw(chr(39) + 'u' + chr(39), '7', 'id', '0', 'pos')})) * cos(2 * pi() * {draw(chr(39) + 'v' + chr(39), '7', 'id', '0', 'pos')})"
stage("noise_gaussian", augment.AddNoise("gaussian", 0.1, random_state=7), each(f"v + 0.1 * {NORMAL}"))
EXPONENTIAL = f"-ln(1.0 - {draw(chr(39) + 'u' + chr(39), '7', 'id', '0', 'pos')})"
stage("noise_exponential", augment.AddNoise("exponential", 0.1, random_state=7), each(f"v + 0.1 * {EXPONENTIAL}"))
# Draws by inverse distribution function: how many counts have one of u or less.
POISSON = f"""u as (select id, pos, v, {draw(chr(39) + 'u' + chr(39), '7', 'id', '0', 'pos')} as u, ceil(v + 12 * sqrt(v) + 30)::bigint as most from e),
k as (select id, pos, v, u, unnest(range(0, most)) as k from u),
f as (select id, pos, v, u, sum(exp(k * ln(v) - v - lgamma(k + 1))) over (partition by id, pos order by k) as f from k),
d as (select id, pos, any_value(v) as v, count(*) filter (f <= u) as d from f group by id, pos)"""
stage("noise_poisson", augment.AddNoise("poisson", 0.1, random_state=7), each("v + 0.1 * d", POISSON, cte=S_CTE, source="d"), source=series)
BY = f"b as (select e.*, floor({U} * 7)::int - 3 as by from e)"


def _moved(outside: str, inside: str = "c.v") -> str:
    return f"{E_CTE}, {BY} select b.id, b.pos::bigint as pos, {V.format(f'case when b.pos - b.by between 0 and {N - 1} then {inside} else {outside} end')} from b left join e c on c.id = b.id and c.pos = b.pos - b.by"


stage("index_shift_zeros", augment.IndexShift(3, "zeros", random_state=7), _moved("0"))
stage("index_shift_constant", augment.IndexShift(3, "constant", 2.5, random_state=7), _moved("2.5", "case when abs(c.v) < 1e-10 then 2.5 else c.v end"))
stage("index_shift_wrap", augment.IndexShift(3, "wrap", random_state=7), f"{E_CTE}, {BY} select b.id, b.pos::bigint as pos, {V.format('c.v')} from b join e c on c.id = b.id and c.pos = (b.pos - b.by + {N}) % {N}")
stage("index_shift_extend", augment.IndexShift(3, "extend", random_state=7), f"{E_CTE}, {BY} select b.id, b.pos::bigint as pos, {V.format('c.v')} from b join e c on c.id = b.id and c.pos = greatest(0, least({N - 1}, b.pos - b.by))")
MIRROR = f"case when b.pos - b.by between 0 and {N - 1} then b.pos - b.by when b.by > 0 then b.by - 1 - b.pos else {2 * N - 2} - b.pos + b.by end"
stage("index_shift_mirror", augment.IndexShift(3, "mirror", random_state=7), f"{E_CTE}, {BY} select b.id, b.pos::bigint as pos, {V.format('c.v')} from b join e c on c.id = b.id and c.pos = {MIRROR}")
EDGE = f"{BY}, l as (select id, coalesce(regr_slope(v, pos), 0) as m, avg(v) - coalesce(regr_slope(v, pos), 0) * avg(pos) as c from b where (b.by > 0 and pos <= b.by) or (b.by < 0 and pos >= {N - 1} + b.by) group by id)"
stage("index_shift_linear", augment.IndexShift(3, "linear", random_state=7), f"{E_CTE}, {EDGE} select b.id, b.pos::bigint as pos, {V.format('coalesce(c.v, l.c + l.m * (b.pos - b.by))')} from b left join e c on c.id = b.id and c.pos = b.pos - b.by left join l on l.id = b.id")


def _curvature() -> str:
    """VALUES (pos, o, c): second derivatives at o of the not-a-knot spline through places 0 .. N - 1, from its slopes."""
    y = np.eye(N)
    slopes, sides = np.zeros((N, N)), np.zeros((N, N))
    for i in range(1, N - 1):
        slopes[i, i - 1 : i + 2], sides[i] = (1, 4, 1), 3 * (y[i + 1] - y[i - 1])
    slopes[0, [0, 2]], sides[0] = (1, -1), 2 * (2 * y[1] - y[0] - y[2])
    slopes[-1, [-1, -3]], sides[-1] = (1, -1), -2 * (2 * y[-2] - y[-1] - y[-3])
    s = np.linalg.solve(slopes, sides)
    m = np.vstack([6 * (y[1:] - y[:-1]) - 4 * s[:-1] - 2 * s[1:], 2 * s[-2:-1] + 4 * s[-1:] - 6 * (y[-1:] - y[-2:-1])])
    return ", ".join(f"({i}, {o}, {float(m[o, i])!r})" for o in range(N) for i in range(N) if abs(m[o, i]) > 1e-15)


def _fractional_sql(mode: str, shift: float) -> str:
    """The spline at shifted places; `outside` and `padding` as the mode has them. Leftward moves (s < 0) are padded at the start."""
    n = N
    outside = "case when s < 0 then p < 0 else p >= {} end"
    last = outside.format(n if mode == "linear" else n - 1)
    start, end = f"h.pos - m", f"h.pos - ({n} - m)"
    padding = {
        "zeros": "0.0", "constant": "2.5", "extend": "case when s < 0 then first else final end",
        "mirror": f"(select v from e where e.id = h.id and e.pos = greatest(0, least({n - 1}, case when s < 0 then -1 - ({start}) else {n - 2} - ({end}) end)))",
        "linear": f"case when s < 0 then a0 + b0 * ({start}) else a1 + b1 * (5 + {end}) end",
    }[mode]
    if mode in ("zeros", "constant"):
        last = f"(p < 0 or p >= {n - 1})"
    return f"""{E_CTE}, k(pos, o, c) as (values {_curvature()}), m as (select id, o as pos, sum(v * c) as m from e join k using (pos) group by id, o),
q as (select id, pos, {-shift!r} + {U} * {2 * shift!r} as s, pos + {-shift!r} + {U} * {2 * shift!r} as p from e),
j as (select *, greatest(0, least({n - 2}, floor(p)))::bigint as j from q),
y as (select j.id, j.pos, s, p, (j + 1 - p) * e0.v + (p - j) * e1.v + (((j + 1 - p) ** 3 - (j + 1 - p)) * m0.m + ((p - j) ** 3 - (p - j)) * m1.m) / 6 as y
    from j join e e0 on e0.id = j.id and e0.pos = j join e e1 on e1.id = j.id and e1.pos = j + 1 join m m0 on m0.id = j.id and m0.pos = j join m m1 on m1.id = j.id and m1.pos = j + 1),
g as (select id, arg_min(v, pos) as first, arg_max(v, pos) as final,
    regr_slope(v, pos) filter (pos < 5) as b0, regr_intercept(v, pos) filter (pos < 5) as a0,
    regr_slope(v, pos - {n - 5}) filter (pos >= {n - 5}) as b1, regr_intercept(v, pos - {n - 5}) filter (pos >= {n - 5}) as a1 from e group by id),
h as (select y.*, first, final, a0, b0, a1, b1, {last} as outside, count(*) filter ({last}) over (partition by y.id) as m from y join g using (id))
select id, pos::bigint as pos, {V.format(f"case when outside then {padding} else y end")} from h"""


for _mode in ("zeros", "constant", "extend", "mirror", "linear"):
    _name = "fractional_shift" if _mode == "extend" else f"fractional_shift_{_mode}"
    stage(_name, augment.FractionalShift(1.5, _mode, 2.5, random_state=7), _fractional_sql(_mode, 1.5))
GAUSS = f"k as (select unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) as o), s as (select id, {draw('7', 'id', '0')} * 1.0 as s from (select distinct id from e)), w as (select id, o, exp(-0.5 * (o / s) ** 2) as w from s, k where abs(o) <= floor(4.0 * s + 0.5)), n as (select id, sum(w) as n from w group by id)"
REFLECT = f"case when a.pos + o < 0 then -1 - a.pos - o when a.pos + o >= {N} then {2 * N - 1} - a.pos - o else a.pos + o end"
stage("gaussian_broadening", augment.GaussianBroadening(1.0, random_state=7), f"{E_CTE}, {GAUSS} select a.id, a.pos::bigint as pos, {V.format('sum(b.v * w / n)')} from e a join w on w.id = a.id join n on n.id = a.id join e b on b.id = a.id and b.pos = {REFLECT} group by a.id, a.pos")


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = augment.replicated(spectra(spark, sf_dir), 5)
    out = augment.BaselineShift(scale=0.5, random_state=7, replicateCol="replicate").transform(df)
    flat = out.select("id", F.col("replicate").cast("long").alias("replicate"), F.posexplode("x").alias("pos", "value"))
    return flat.select("id", "replicate", F.col("pos").cast("long").alias("pos"), rounded(F.col("value")).alias("value"))


add("augment_replicates", replicates, f"{E_CTE}, r as (select unnest([0, 1, 2, 3, 4]) as r) select id, r::bigint as replicate, pos::bigint as pos, {V.format(f'v + {draw("7", "id", "r")} * 0.5')} from e, r")

# --- learnt over all rows ------------------------------------------------------------------------------------------
stage("centre", latent.StandardScaler(with_std=False), each("v - m", "m as (select pos, avg(v) as m from e group by pos)", source="e join m using (pos)"))
stage("standard_scaler", latent.StandardScaler(), each("(v - m) / s", "m as (select pos, avg(v) as m, stddev_pop(v) as s from e group by pos)", source="e join m using (pos)"))

# A fixed model, so that SQL can follow: the first two cosine vectors as rotations and loadings, no centring.
COSINES = np.sqrt(2 / N) * np.cos(np.pi * (np.arange(N)[:, None] + 0.5) * np.arange(1, 3)[None, :] / N)
FIXED = latent.LatentModel(mean=np.zeros(N), scale=np.ones(N), rotations=COSINES, loadings=COSINES, variances=[0.02, 0.03], n_samples=500, outputCol="scores")
BASIS = f"k(pos, a, b) as (values {', '.join(f'({i}, {float(a)!r}, {float(b)!r})' for i, (a, b) in enumerate(COSINES))}), t as (select id, sum(v * a) as t1, sum(v * b) as t2 from e join k using (pos) group by id)"
SPE = f"{BASIS}, q as (select e.id, sum((v - t1 * a - t2 * b) ** 2) as q from e join k using (pos) join t on t.id = e.id group by e.id)"


def detector(name: str, make, sql: str, flags: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spectra(spark, sf_dir)
        out = make().fit(df).transform(df)
        value = rounded(F.col("residual")).alias("value")
        return out.select("id", value, F.col("outlier").cast("long").alias("outlier")) if flags else out.select("id", value)

    add(name, query, sql)


T2_LIMIT = linear.f_quantile(0.95, 2, 498) * 2 * 499 / 498
DMODX_LIMIT = float(np.sqrt(linear.f_quantile(0.95, N - 2, N - 3)))
detector("dmodx", lambda: outliers.DModX(FIXED), f"{E_CTE}, {SPE} select id, {V.format(f'sqrt(q / {N - 2})')}, (case when sqrt(q / {N - 2}) > {DMODX_LIMIT!r} then -1 else 1 end)::bigint as outlier from q", flags=True)
detector("hotelling_t2", lambda: outliers.HotellingT2(FIXED), f"{E_CTE}, {BASIS}, s as (select id, t1 * t1 / 0.02 + t2 * t2 / 0.03 as s from t) select id, {V.format('s')}, (case when s > {T2_LIMIT!r} then -1 else 1 end)::bigint as outlier from s", flags=True)
detector("q_residuals", lambda: outliers.QResiduals(FIXED), f"{E_CTE}, {SPE}, l as (select quantile_cont(q, 0.95) as l from q) select id, {V.format('q')}, (case when q > l then -1 else 1 end)::bigint as outlier from q, l", flags=True)
GRAM = f"{BASIS}, g as (select sum(t1 * t1) as a, sum(t1 * t2) as b, sum(t2 * t2) as d from t), h as (select id, t1, t2, (d * t1 * t1 - 2 * b * t1 * t2 + a * t2 * t2) / (a * d - b * b) as h from t, g)"
detector("leverage", lambda: outliers.Leverage(FIXED), f"{E_CTE}, {GRAM}, l as (select quantile_cont(h, 0.95) as l from h) select id, {V.format('h')}, (case when h > l then -1 else 1 end)::bigint as outlier from h, l", flags=True)
PREDICTS = latent.LatentModel(mean=np.zeros(N), scale=np.ones(N), rotations=COSINES, loadings=COSINES, variances=[0.02, 0.03], n_samples=500, coefficients=COSINES.sum(axis=1, keepdims=True), target_mean=[4.5])
STUDENT = f"{GRAM}, r as (select h.id, label - 4.5 - t1 - t2 as e, h from h join embeddings on vec_id = h.id), s as (select sqrt(sum(e * e) / (count(*) - 2)) as s from r), u as (select id, e / (s * sqrt(1 - h)) as u from r, s), l as (select quantile_cont(u, 0.95) as l from u)"
detector("studentized_residuals", lambda: outliers.StudentizedResiduals(PREDICTS), f"{E_CTE}, {STUDENT} select id, {V.format('u')}, (case when u > l then -1 else 1 end)::bigint as outlier from u, l", flags=True)


def q_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chi-square and the Jackson-Mudholkar limit."""
    df = spectra(spark, sf_dir)
    found = {m: outliers.QResiduals(FIXED, method=m).fit(df).value("critical") for m in ("chi-square", "jackson-mudholkar")}
    return df.limit(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.round(F.lit(v), 6).alias("critical")) for k, v in found.items()])).alias("s")).select("s.*")


CHI2, JM = float(linear.chi2_two_quantile(0.95)), (7 / 9 + float(np.sqrt(2 * linear.normal_quantile(0.95))) / 3) ** 3
TRACE = f"{E_CTE}, {BASIS}, r as (select pos, var_samp(v - t1 * a - t2 * b) as s from e join k using (pos) join t on t.id = e.id group by pos), t0 as (select sum(s) as t from r)"
add("q_residual_limits", q_limits, f"{TRACE} select 'chi-square' as method, round(t * {CHI2!r}, 6) as critical from t0 union all select 'jackson-mudholkar', round(t * {JM!r}, 6) from t0")


def pca_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction error and T2 of each spectrum under a fitted PCA: both are free of signs."""
    df = spectra(spark, sf_dir)
    model = latent.PCA(3).fit(df)
    t2 = outliers.HotellingT2(model).fit(df).transform(df).select("id", "x", F.col("residual").alias("t2"))
    return outliers.QResiduals(model).fit(df).transform(t2).select("id", rounded(F.col("t2")).alias("t2"), rounded(F.col("residual")).alias("spe"))


def pls_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir)
    model = latent.PLSRegression(4).fit(df)
    return df.select("id", rounded(F.get(model.prediction(F.col("x")), 0)).alias("prediction"))


def _pls1_sql() -> str:
    """With one component and no scaling the prediction is a closed form of x'y."""
    return f"""{E_CTE}, c as (select id, pos, v - avg(v) over (partition by pos) as v from e),
y as (select vec_id as id, label - avg(label) over () as y, avg(label) over () as m from embeddings),
w as (select pos, sum(v * y) as w from c join y using (id) group by pos), s as (select sqrt(sum(w * w)) as s from w),
t as (select id, sum(v * w / s) as t from c join w using (pos), s group by id),
q as (select sum(t * y) / sum(t * t) as q from t join y using (id))
select id, round(m + t * q, 6) + 0.0 as prediction from t join y using (id), q"""


def pls_one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir)
    model = latent.PLSRegression(1, scale=False).fit(df)
    return df.select("id", rounded(F.get(model.prediction(F.col("x")), 0)).alias("prediction"))


CENTRED = "x as materialized (select id, pos, v - avg(v) over (partition by pos) as v from e)"
SCORES = "t as (select id, k, sum(v * u) as t from x join b using (pos) group by id, k)"
add(
    "pca_reconstruction",
    pca_variances,
    f"""{E_CTE}, {CENTRED}, {iterated_sql.components("x", N, 3)}, {SCORES}, whole as (select id, sum(v * v) as s from x group by id)
select id, round(sum(t * t / value), 6) + 0.0 as t2, round(any_value(s) - sum(t * t), 6) + 0.0 as spe from t join l using (k) join whole using (id) group by id""",
)
SCALED = """x0 as materialized (select id, pos, (v - avg(v) over (partition by pos)) / stddev_samp(v) over (partition by pos) as v from e),
y0 as materialized (select vec_id as id, (label - avg(label) over ()) / stddev_samp(label) over () as y, true as train, avg(label) over () as level, stddev_samp(label) over () as spread from embeddings)"""
PLS4 = " + ".join(f"t{k}.t * n{k}.q" for k in range(4))
add(
    "pls_prediction",
    pls_prediction,
    f"""{E_CTE}, {SCALED}, {iterated_sql.deflated(4)}
select id, round(level + spread * ({PLS4}), 6) + 0.0 as prediction from y0 {" ".join(f"join t{k} using (id)" for k in range(4))}, n0, n1, n2, n3""",
)
add("pls_one_component", pls_one_component, _pls1_sql())

CLASSES = 3


def pls_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discriminant analysis: an indicator of each of three classes as targets of one model; predictions and the class with the largest one."""
    df = spectra(spark, sf_dir)
    names = [f"is{k}" for k in range(CLASSES)]
    df = df.withColumns({c: (F.col("y") % CLASSES == k).cast("double") for k, c in enumerate(names)})
    model = latent.PLSRegression(3, scale=False, targets=names).fit(df)
    found = df.withColumn("p", model.prediction(F.col("x"))).select("id", *[rounded(F.get("p", k)).alias(c) for k, c in enumerate(names)])
    best = F.greatest(*names)
    return found.withColumn("class", F.coalesce(*[F.when(F.col(c) == best, F.lit(k)) for k, c in enumerate(names)]).cast("long"))


def _pls_classes_sql() -> str:
    said = ", ".join(f"round(any_value(level{k}) + sum(t * q) filter (j = {k}), 6) + 0.0 as is{k}" for k in range(CLASSES))
    levels = ", ".join(f"avg((label % {CLASSES} = {k})::int) as level{k}" for k in range(CLASSES))
    terms = " union all ".join(f"select id, j, t, q from t{k}, q{k}" for k in range(3))
    best = " ".join(f"when is{k} = greatest({', '.join(f'is{i}' for i in range(CLASSES))}) then {k}" for k in range(CLASSES))
    return f"""{E_CTE}, x0 as materialized (select id, pos, v - avg(v) over (partition by pos) as v from e),
y0 as materialized (select vec_id as id, j, (label % {CLASSES} = j)::int - avg((label % {CLASSES} = j)::int) over (partition by j) as y from embeddings, (select unnest(range({CLASSES})) as j)),
l as (select {levels} from embeddings), {iterated_sql.deflated_many(3)},
f as (select id, {said} from ({terms}), l group by id)
select *, (case {best} end)::bigint as class from f"""


add("pls_classes", pls_classes, _pls_classes_sql())

# --- workflows -----------------------------------------------------------------------------------------------------


def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coded = evaluation.label_codes(t, "c_mktsegment")
    return coded.groupBy("c_mktsegment", F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


add("label_encoding", label_encoding, "select c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::bigint as code, n from (select c_mktsegment, count(*) as n from customer group by 1)")


def train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluation.split(spectra(spark, sf_dir), 0.2)
    return train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


KEY = "('0x' || substr(md5('42:' || vec_id), 1, 15))::bigint"
add("train_test_split", train_test, f"select vec_id as id, case when row_number() over (order by {KEY}, vec_id) <= ceil(count(*) over () / 5.0) then 'test' else 'train' end as part from embeddings")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, by priority and status as classes."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat("o_orderpriority", "o_orderstatus").alias("label"))
    train, test = evaluation.split(t, 0.2, id_col="o_orderkey", stratify="label")
    return train.select("o_orderkey", "label", F.lit("train").alias("part")).unionByName(test.select("o_orderkey", "label", F.lit("test").alias("part")))


add(
    "train_test_split_stratified",
    stratified,
    """with t as (select o_orderkey, o_orderpriority || o_orderstatus as label from orders), c as (select label, count(*) as n from t group by 1), s as (select sum(n) as all_, ceil(sum(n) / 5.0)::bigint as total from c),
f as (select label, (n * total // all_)::bigint as low, (n * total % all_)::bigint as rest from c, s),
q as (select label, low + (row_number() over (order by rest desc, label) <= (select any_value(total) from s) - sum(low) over ())::bigint as quota from f)
select o_orderkey, label, case when row_number() over (partition by label order by ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::bigint, o_orderkey) <= quota then 'test' else 'train' end as part
from t join q using (label)""",
)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir)
    predicted = df.withColumn("p", F.get(PREDICTS.prediction(F.col("x")), 0))
    return evaluation.confusion(predicted, "y", "p")


add("confusion", confusion, f"{E_CTE}, {BASIS} select label::bigint as actual, round_even(4.5 + t1 + t2, 0)::bigint as predicted, count(*) as n from t join embeddings on vec_id = id group by 1, 2")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = spectra(spark, sf_dir).withColumn("p", F.get(PREDICTS.prediction(F.col("x")), 0))
    return predicted.groupBy((F.col("id") % 10).alias("part")).agg(F.round(evaluation.accuracy(predicted, "y", "p"), 6).alias("accuracy"))


add("accuracy", accuracy, f"{E_CTE}, {BASIS} select id % 10 as part, round(avg((label = round_even(4.5 + t1 + t2, 0))::int), 6) as accuracy from t join embeddings on vec_id = id group by 1")
add("describe_values", lambda spark, d: evaluation.describe(spark.read.parquet(f"{d}/events.parquet"), "value").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "q25", "q50", "q75", "high")]),
    "select count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as low, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75, round(max(value), 6) as high from events")
add("value_counts", lambda spark, d: spectra(spark, d).groupBy(F.col("y").cast("long").alias("label")).agg(F.count("*").alias("n")), "select label::bigint as label, count(*) as n from embeddings group by 1")


FOLDS, MOST = 10, 10


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds, 1 to 10 components, and which number is best."""
    errors = evaluation.cross_validated_error(spectra(spark, sf_dir), [scatter.StandardNormalVariate()], list(range(1, MOST + 1)), folds=FOLDS)
    best = min(errors, key=lambda a: (errors[a], a))
    return spark.createDataFrame([(k, round(v, 6), k == best) for k, v in errors.items()], "components long, error double, best boolean")


def _cross_validation_sql() -> str:
    snv = "z as (select id, pos, (v - avg(v) over (partition by id)) / stddev_pop(v) over (partition by id) as v from e)"
    cuts = ", ".join(f"quantile_cont(vec_id, {k / FOLDS!r}) as c{k}" for k in range(1, FOLDS))
    fold = " + ".join(f"(vec_id > c{k})::int" for k in range(1, FOLDS))
    sums = " + ".join
    errors = " union all ".join(
        f"select {a}::bigint as components, avg(e) as error from (select y0.fold, avg(abs(y - ({sums(f't{k}.t * n{k}.q' for k in range(a))}))) as e from y0 "
        + " ".join(f"join t{k} on t{k}.fold = y0.fold and t{k}.id = y0.id join n{k} on n{k}.fold = y0.fold" for k in range(a))
        + " where not train group by y0.fold)"
        for a in range(1, MOST + 1)
    )
    return f"""{E_CTE}, {snv}, cuts as (select {cuts} from embeddings), f as (select vec_id as id, label, {fold} as own from embeddings, cuts),
folds as (select unnest(range({FOLDS})) as fold), y1 as (select fold, id, label, own != fold as train from f, folds),
y0 as materialized (select fold, id, label - avg(label) filter (train) over (partition by fold) as y, train from y1),
joined as (select fold, id, pos, v, train from z join y1 using (id)),
x0 as materialized (select fold, id, pos, v - avg(v) filter (train) over (partition by fold, pos) as v from joined), {iterated_sql.deflated(MOST, "fold, ")},
errors as ({errors})
select components, round(error, 6) as error, error = min(error) over () as best from errors"""


add("cross_validation", cross_validation, _cross_validation_sql())


def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derivative, a cut, centring and scores as one map: how far out each spectrum lies within the model, and along its first direction."""
    df = spectra(spark, sf_dir)
    fitted = screening_pipeline().fit(df)
    for s in linear_maps.fused(fitted, N):
        df = s.transform(df)
    squares = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v * v)
    return df.select("id", rounded(squares).alias("inside"), rounded(F.abs(F.get("scores", 0))).alias("first"))


def sql_functions_snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard normal variates by a function of SQL."""
    sql_functions.register(spark)
    spectra(spark, sf_dir).createOrReplaceTempView("prismark_spectra")
    return long(spark.sql("select id, snv(x) as x from prismark_spectra"))


def wide_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut of a wide Parquet table: only its columns are read."""
    names, folder = [f"w{i}" for i in range(N)], new_folder(spark, "wide")
    frames.to_wide(spectra(spark, sf_dir).drop("y"), names).write.parquet(folder)
    return long(frames.transformed_wide(spark.read.parquet(folder), names, [select.RangeCut(10, 22), scale.MinMaxScaler()]))


add("sql_function_snv", sql_functions_snv, ORACLE_SQL["snv"])
add("wide_selection", wide_selection, f"{E_CTE}, c as (select id, pos - 10 as pos, v from e where pos >= 10 and pos < 22) select id, pos::bigint as pos, {V.format(f'(v - min(v) {W}) / (max(v) {W} - min(v) {W})')} from c")
WINDOWS, FEW, PARTS = [5, 9, 13], 4, 5


def grid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a derivative by numbers of components, and which point is best."""
    stages = {"snv": scatter.StandardNormalVariate(), "slope": derivative.SavitzkyGolay(5, 2, 1), "pls": latent.PLSRegression(2, scale=False)}
    found = grid.grid_search(spectra(spark, sf_dir), stages, {"slope__window_size": WINDOWS, "pls__n_components": list(range(1, FEW + 1))}, folds=PARTS)
    rows = [(p["slope__window_size"], p["pls__n_components"], round(e, 6), p == found.best) for p, e in found.errors]
    return spark.createDataFrame(rows, "width long, components long, error double, best boolean")


def _grid_sql() -> str:
    # The slope of a least-squares parabola over a window: places over their sum of squares.
    stencils = ", ".join(f"({w}, {o}, {o / sum(i * i for i in range(-(w // 2), w // 2 + 1))!r})" for w in WINDOWS for o in range(-(w // 2), w // 2 + 1))
    cuts = ", ".join(f"quantile_cont(vec_id, {k / PARTS!r}) as c{k}" for k in range(1, PARTS))
    fold = " + ".join(f"(vec_id > c{k})::int" for k in range(1, PARTS))
    errors = " union all ".join(
        f"select leaf::bigint as width, {a}::bigint as components, avg(e) as error from (select y0.leaf, y0.fold, avg(abs(y - ({' + '.join(f't{k}.t * n{k}.q' for k in range(a))}))) as e from y0 "
        + " ".join(f"join t{k} on t{k}.leaf = y0.leaf and t{k}.fold = y0.fold and t{k}.id = y0.id join n{k} on n{k}.leaf = y0.leaf and n{k}.fold = y0.fold" for k in range(a))
        + " where not train group by y0.leaf, y0.fold) group by leaf"
        for a in range(1, FEW + 1)
    )
    return f"""{E_CTE}, z as materialized (select id, pos, (v - avg(v) over (partition by id)) / stddev_pop(v) over (partition by id) as v from e), k(leaf, o, c) as (values {stencils}),
d as materialized (select leaf, a.id, a.pos, sum(b.v * c) as v from z a cross join k join z b on b.id = a.id and b.pos = greatest(0, least({N - 1}, a.pos + o)) group by leaf, a.id, a.pos),
cuts as (select {cuts} from embeddings), f as (select vec_id as id, label, {fold} as own from embeddings, cuts),
y1 as (select leaf, fold, id, label, own != fold as train from f, (select unnest(range({PARTS})) as fold), (select distinct leaf from k)),
y0 as materialized (select leaf, fold, id, label - avg(label) filter (train) over (partition by leaf, fold) as y, train from y1),
x0 as materialized (select leaf, fold, id, pos, v - avg(v) filter (train) over (partition by leaf, fold, pos) as v from d join y1 using (leaf, id)),
{iterated_sql.deflated(FEW, "leaf, fold, ")}, errors as ({errors})
select width, components, round(error, 6) as error, error = min(error) over () as best from errors"""


add("grid_search", grid_windows, _grid_sql())


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click of a user with the value of the user's last purchase."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return evaluation.latest_measurement(clicks, bought, "ts", "value", "user_id").select("event_id", "user_id", "value")


add("as_of_measurement", as_of, "select c.event_id, c.user_id, p.value from (select * from events where event_type = 'click') c asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2) p on c.user_id = p.user_id and c.ts >= p.ts")
add("wide_and_long", lambda spark, d: long(frames.from_wide(frames.to_wide(spectra(spark, d).drop("y"), [f"f{i}" for i in range(N)]), [f"f{i}" for i in range(N)])), each("v"))


# --- sources and sinks ---------------------------------------------------------------------------------------------


def _csv(df: DataFrame, folder: str, name: str) -> None:
    """df in the order of its id, without it, as a CSV table that may have several files."""
    df.orderBy("id").drop("id").write.csv(f"{folder}/{name}.csv", header=True)


def loaded(load, spectra_name: str, table_name: str, columns: dict[str, str]):
    """Both tables of a dataset, written as CSV from the embeddings, read by its loader and put together by the rows' places."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, folder = spectra(spark, sf_dir), new_folder(spark, "datasets")
        _csv(frames.to_wide(df.drop("y"), [str(w) for w in AXIS]), folder, spectra_name)
        _csv(df.select("id", *[F.expr(c).alias(k) for k, c in columns.items()]), folder, table_name)
        x, table = load(spark, folder)
        total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
        both = x.select(F.col("id").alias("spectrum"), F.size("x").cast("long").alias("n"), rounded(total).alias("total")).join(table, F.col("id") == F.col("spectrum")).drop("spectrum")
        return both.select("id", "n", "total", *[rounded(F.col(k)).alias(k) if isinstance(table.schema[k].dataType, DoubleType) else k for k in columns])

    return query


def _loaded_sql(columns: dict[str, str]) -> str:
    said = ", ".join(f"{c} as {k}" for k, c in columns.items())
    return f"{E_CTE}, s as (select id, count(*) as n, round(sum(v * (pos + 1)), 6) + 0.0 as total from e group by id) select row_number() over (order by vec_id) - 1 as id, n, total, {said} from embeddings join s on s.id = vec_id"


add("load_fermentation_train", loaded(datasets.load_fermentation_train, "train_spectra", "train_hplc", {"glucose": "y * 1.5D"}), _loaded_sql({"glucose": "label * 1.5::double"}))
MEASURED = {"time": 1.25, "glucose": 2.0, "xylose": 0.5, "acetic_acid": 3.0, "ethanol": 4.0, "furfural": 0.25}
add(
    "load_fermentation_test",
    loaded(datasets.load_fermentation_test, "fermentation_spectra", "fermentation_hplc", {k: f"y * {c!r}D" for k, c in MEASURED.items()}),
    _loaded_sql({k: f"label * {c!r}::double" for k, c in MEASURED.items()}),
)
add("load_coffee", loaded(datasets.load_coffee, "coffee_spectra", "coffee_labels", {"labels": "concat('origin ', int(y))"}), _loaded_sql({"labels": "'origin ' || label"}))


def named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selectors in a row, as a wide table whose columns carry the names that are left, and back as (id, feature, value)."""
    stages = [select.RangeCut(10, 40), select.IndexSelector([0, 7, 29])]
    df = spectra(spark, sf_dir).drop("y")
    for s in stages:
        df = s.transform(df)
    names = feature_names_out(stages, [f"wn{i}" for i in range(N)])
    return frames.to_wide(df, names).unpivot("id", names, "feature", "value").withColumn("value", rounded(F.col("value")))


add("named_features", named_features, f"{E_CTE} select id, 'wn' || pos as feature, {V.format('v')} from e where pos in (10, 17, 39)")


def mask_and_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selector leaves, put back where it was, zeros elsewhere."""
    s = select.IndexSelector([5, 6, 50])
    return long(spectra(spark, sf_dir).select("id", select.restored(s.column(F.col("x")), select.support(N, s)).alias("x")))


add("mask_and_inverse", mask_and_inverse, each("case when pos in (5, 6, 50) then v else 0 end"))


def saved_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline, saved, loaded and applied."""
    df, folder = spectra(spark, sf_dir), new_folder(spark, "model")
    Pipeline(stages=[scatter.StandardNormalVariate(), latent.StandardScaler(with_std=False)]).fit(df).save(folder)
    return long(PipelineModel.load(folder).transform(df))


SAVED = "z as (select id, pos, (v - avg(v) over (partition by id)) / stddev_pop(v) over (partition by id) as v from e), m as (select pos, avg(v) as m from z group by pos)"
add("saved_pipeline", saved_and_loaded, each("v - m", SAVED, source="z join m using (pos)"))


def training_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir)
    return outliers.QResiduals(FIXED).fit_predict_residuals(df).select("id", rounded(F.col("residual")).alias("value"))


add("training_residuals", training_residuals, f"{E_CTE}, {SPE} select id, {V.format('q')} from q")


# --- longer spectra: the prices of a supplier's lines, in order, cut into runs -----------------------------------------
WIDE = 239


def price_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x): runs of WIDE prices in hundreds; a supplier's last run may be shorter, but not of less than 8."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("price", F.col("l_extendedprice") / 100)
    whole = frames.from_long(t, "l_suppkey", ["l_orderkey", "l_linenumber", "price"], "price")
    cut = whole.select("l_suppkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / WIDE).cast("int")), lambda k: F.slice("x", (k * WIDE + 1).cast("int"), WIDE))).alias("k", "x"))
    return cut.select((F.col("l_suppkey") * 10_000 + F.col("k")).alias("id"), "x").where(F.size("x") >= 8)


RUNS = f"""with e as (select l_suppkey * 10000 + k // {WIDE} as id, k % {WIDE} as pos, v, count(*) over (partition by l_suppkey, k // {WIDE}) as size
from (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_extendedprice / 100) - 1 as k, l_extendedprice / 100 as v from lineitem) qualify size >= 8)"""
stage("whittaker_239", smooth.WhittakerSmooth(), iterated_sql.whittaker(RUNS, 100.0, 4), source=price_runs, digits=4)
stage("airpls_239", baseline.AirPls(), iterated_sql.airpls(RUNS, 100.0, 15, 4), source=price_runs, digits=4)
# Both agree to 2e-9 of the values; of more decimals some of the many values would be rounded to either side.
stage("arpls_239", baseline.ArPls(), iterated_sql.arpls(RUNS, 1e4, 0.01, 100, 3), source=price_runs, digits=3)


def screening_pipeline() -> Pipeline:
    return Pipeline(stages=[scatter.StandardNormalVariate(), derivative.SavitzkyGolay(7, 2, 1), select.RangeCut(3, -3), latent.StandardScaler(with_std=False), latent.PCA(4)])


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: preprocessing, PCA and outliers by Q residuals."""
    df = spectra(spark, sf_dir)
    fitted: PipelineModel = screening_pipeline().fit(df)
    out = outliers.QResiduals(fitted).fit(df).transform(df)
    return out.select("id", rounded(F.col("residual")).alias("value"), F.col("outlier").cast("long").alias("outlier"))


_SG = "k(o, c) as (values (-3, -3), (-2, -2), (-1, -1), (0, 0), (1, 1), (2, 2), (3, 3))"
SCREENED = f"""{E_CTE}, z as (select id, pos, (v - avg(v) over (partition by id)) / stddev_pop(v) over (partition by id) as v from e), {_SG},
d as (select a.id, a.pos - 3 as pos, sum(b.v * c / 28.0) as v from z a cross join k join z b on b.id = a.id and b.pos = a.pos + o where a.pos between 3 and {N - 4} group by a.id, a.pos),
x as materialized (select id, pos, v - avg(v) over (partition by pos) as v from d), {iterated_sql.components("x", N - 6, 4)}, {SCORES}"""
add(
    "outlier_screening",
    screening,
    f"""{SCREENED}, whole as (select id, sum(v * v) as s from x group by id), q as (select id, any_value(s) - sum(t * t) as q from t join whole using (id) group by id),
lim as (select quantile_cont(q, 0.95) as c from q)
select id, {V.format("q")}, (case when q > c then -1 else 1 end)::bigint as outlier from q, lim""",
)
add("fused_scores", fused_scores, f"{SCREENED} select id, round(sum(t * t), 6) + 0.0 as inside, round(max(abs(t)) filter (k = 0), 6) + 0.0 as first from t group by id")
