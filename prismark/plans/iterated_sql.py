"""SQL of queries whose results come from iterations: penalised least squares, eigenvectors, deflation. Written for DuckDB."""

from __future__ import annotations

# --- penalised least squares ---------------------------------------------------------------------------------------
#: Diagonals of D'D for differences of first and second order, at place i of n.
_BANDS = {
    1: ("(i < n - 1)::int + (i > 0)::int", "-1.0 * (i < n - 1)::int", "0.0"),
    2: ("(i < n - 2)::int + 4 * (i between 1 and n - 2)::int + (i > 1)::int", "-2.0 * ((i < n - 2)::int + (i between 1 and n - 2)::int)", "1.0 * (i < n - 2)::int"),
}


def _smoothed(lam: float, order: int) -> str:
    """The list z of (W + lam D'D) z = W y for lists y, w of n values: a fold that factors the matrix and one that substitutes back."""
    a, c, b = _BANDS[order]
    item = f"""{{'a': w[i + 1] + {lam!r} * ({a}), 'c': {lam!r} * ({c}), 'b': {lam!r} * ({b}), 'r': w[i + 1] * y[i + 1],
        'd1': 1.0::double, 'p1': 0.0::double, 'q1': 0.0::double, 'z1': 0.0::double, 'd2': 1.0::double, 'q2': 0.0::double, 'z2': 0.0::double, 'kept': []::double[][]}}"""
    first = "{'a': 0.0::double, 'c': 0.0::double, 'b': 0.0::double, 'r': 0.0::double, 'd1': 1.0::double, 'p1': 0.0::double, 'q1': 0.0::double, 'z1': 0.0::double, 'd2': 1.0::double, 'q2': 0.0::double, 'z2': 0.0::double, 'kept': []::double[][]}"
    d = "(x.a - s.d2 * s.q2 * s.q2 - s.d1 * s.p1 * s.p1)"
    p, q, z = f"((x.c - s.d1 * s.p1 * s.q1) / {d})", f"(x.b / {d})", "(x.r - s.p1 * s.z1 - s.q2 * s.z2)"
    step = f"{{'a': x.a, 'c': x.c, 'b': x.b, 'r': x.r, 'd1': {d}, 'p1': {p}, 'q1': {q}, 'z1': {z}, 'd2': s.d1, 'q2': s.q1, 'z2': s.z1, 'kept': list_append(s.kept, [{p}, {q}, {z} / {d}])}}"
    cast = "::struct(a double, c double, b double, r double, d1 double, p1 double, q1 double, z1 double, d2 double, q2 double, z2 double, kept double[][])"
    forward = f"list_reduce(list_transform(range(n), lambda i: {item}{cast}), lambda s, x: {step}{cast}, {first}{cast}).kept"
    back = "::struct(k double[], x1 double, x2 double, z double[])"
    value = "(x.k[3] - x.k[1] * s.x1 - x.k[2] * s.x2)"
    items = f"list_transform(list_reverse({forward}), lambda k: {{'k': k, 'x1': 0.0, 'x2': 0.0, 'z': []}}{back})"
    fold = f"list_reduce({items}, lambda s, x: {{'k': x.k, 'x1': {value}, 'x2': s.x1, 'z': list_append(s.z, {value})}}{back}, {{'k': []::double[], 'x1': 0.0, 'x2': 0.0, 'z': []::double[]}}{back}).z"
    return f"list_reverse({fold})"


_LISTS = "s as (select id, list(v order by pos) as y, count(*)::bigint as n from e group by id)"


def _result(digits: int) -> str:
    return f"""last as (select id, any_value(y) as y, arg_max(z, k) as z from it where k > 0 group by id)
select id, (generate_subscripts(y, 1) - 1)::bigint as pos, round(unnest(list_transform(y, lambda v, i: v - z[i])), {digits}) + 0.0 as value from last"""



def whittaker(cte: str, lam: float, digits: int = 6) -> str:
    """Smoothed values for differences of first order; cte: `with e as (...)`, the long table (id, pos, v)."""
    return f"""{cte}, {_LISTS}, one as (select id, {_smoothed(lam, 1)} as z from (select *, list_transform(y, lambda v: 1.0::double) as w from s))
select id, (generate_subscripts(z, 1) - 1)::bigint as pos, round(unnest(z), {digits}) + 0.0 as value from one"""


def arpls(cte: str, lam: float, ratio: float, iterations: int, digits: int = 6) -> str:
    """cte: `with e as (...)`, the long table (id, pos, v)."""
    return f"""{cte.replace("with e", "with recursive e", 1)}, {_LISTS},
it(id, k, y, n, w, z, done) as (
    select id, 0, y, n, list_transform(y, lambda v: 1.0::double), y, false from s
    union all
    select id, k + 1, y, n, new, z, coalesce(len(low) = 0 or sqrt(list_sum(list_transform(w, lambda v, i: (v - new[i]) * (v - new[i])))) / sqrt(list_sum(list_transform(w, lambda v: v * v))) < {ratio!r}, true)
    from (select *, list_transform(d, lambda v: 1 / (1 + exp(greatest(-709.0, least(709.0, 2 * (v - (2 * sd - m)) / sd))))) as new
        from (select *, sqrt(list_avg(list_transform(low, lambda v: (v - m) * (v - m)))) as sd
            from (select *, list_avg(low) as m
                from (select *, list_filter(d, lambda v: v < 0) as low
                    from (select *, list_transform(y, lambda v, i: v - z[i]) as d
                        from (select id, k, y, n, w, {_smoothed(lam, 2)} as z from it where not done and k < {iterations}) as q1) as q2) as q3) as q4) as q5) as q6),
{_result(digits)}"""


def airpls(cte: str, lam: float, iterations: int, digits: int = 6) -> str:
    return f"""{cte.replace("with e", "with recursive e", 1)}, {_LISTS},
it(id, k, y, n, w, z, done) as (
    select id, 0, y, n, list_transform(y, lambda v: 1.0::double), y, false from s
    union all
    select id, k + 1, y, n,
        list_transform(d, lambda v, i: case when i in (1, n) then exp((k + 1) * near / size) when v >= 0 then 0.0::double else exp((k + 1) * abs(v) / size) end),
        z, coalesce(size < 0.001 * list_sum(list_transform(y, lambda v: abs(v))), true)
    from (select *, abs(list_sum(low)) as size, list_max(low) as near
        from (select *, list_filter(d, lambda v: v < 0) as low
            from (select *, list_transform(y, lambda v, i: v - z[i]) as d
                from (select id, k, y, n, w, {_smoothed(lam, 1)} as z from it where not done and k < {iterations - 1}) as q1) as q2) as q3) as q4),
{_result(digits)}"""


# --- principal components ------------------------------------------------------------------------------------------
def components(source: str, n: int, count: int, squarings: int = 13) -> str:
    """CTEs b(k, pos, u) and l(k, value) of the first components of the long table `source`(id, pos, v), centred: a covariance squared again and again has the first eigenvector in its columns; it is then taken out."""
    parts = [f"c0 as materialized (select a.pos as i, b.pos as j, sum(a.v * b.v) / (select count(distinct id) - 1 from {source}) as c from {source} a join {source} b using (id) group by 1, 2)"]
    for k in range(count):
        last = f"m{k}_0"
        parts.append(f"{last} as materialized (select i, j, c / (select sum(c) from c{k} where i = j) as c from c{k})")
        for t in range(1, squarings + 1):
            raw, now = f"r{k}_{t}", f"m{k}_{t}"
            parts.append(f"{raw} as materialized (select a.i, b.j, sum(a.c * b.c) as c from {last} a join {last} b on a.j = b.i group by 1, 2)")
            parts.append(f"{now} as materialized (select i, j, c / (select sum(c) from {raw} where i = j) as c from {raw})")
            last = now
        parts.append(f"h{k} as materialized (select arg_max(j, c) as j from {last} where i = j)")
        parts.append(f"v{k} as materialized (select i as pos, c / sqrt(sum(c * c) over ()) as u from {last} where j = (select j from h{k}))")
        parts.append(f"l{k} as materialized (select sum(x.u * c * y.u) as value from c{k} join v{k} x on x.pos = i join v{k} y on y.pos = j)")
        parts.append(f"c{k + 1} as materialized (select i, j, c - (select value from l{k}) * x.u * y.u as c from c{k} join v{k} x on x.pos = i join v{k} y on y.pos = j)")
    parts.append("b as materialized (" + " union all ".join(f"select {k} as k, pos, u from v{k}" for k in range(count)) + ")")
    parts.append("l as materialized (" + " union all ".join(f"select {k} as k, value from l{k}" for k in range(count)) + ")")
    return ", ".join(parts)


# --- partial least squares -----------------------------------------------------------------------------------------
def deflated(count: int, by: str = "") -> str:
    """CTEs up to t{count}: from x0({by}, id, pos, v) and y0({by}, id, y, train), both centred (and scaled), the scores and inner coefficients of `count` components, learnt from rows with train.

    by: a column that sets separate problems apart, with a comma behind it, e.g. `fold, `.
    """
    key = f"{by}id"
    parts = []
    for k in range(count):
        group = f"group by {by}pos" if by else "group by pos"
        one = f"group by {by.rstrip(', ')}" if by else ""
        using = f"using ({by.rstrip(', ')})" if by else "on true"
        parts += [
            f"g{k} as materialized (select {by}pos, sum(v * y) as w from x{k} join y0 using ({key}) where train {group})",
            f"s{k} as materialized (select {by}sqrt(sum(w * w)) as s from g{k} {one})",
            f"w{k} as materialized (select {by}pos, w / s as w from g{k} join s{k} {using})",
            f"t{k} as materialized (select {key}, sum(v * w) as t from x{k} join w{k} using ({by}pos) group by {key})",
            f"n{k} as materialized (select {by}sum(t * t) as tt, sum(t * y) / sum(t * t) as q from t{k} join y0 using ({key}) where train {one})",
            f"p{k} as materialized (select {by}pos, sum(v * t) / any_value(tt) as p from x{k} join t{k} using ({key}) join y0 using ({key}) join n{k} {using} where train {group})",
            f"x{k + 1} as materialized (select {key}, pos, v - t * p as v from x{k} join t{k} using ({key}) join p{k} using ({by}pos))",
        ]
    return ", ".join(parts)


def deflated_many(count: int, squarings: int = 13) -> str:
    """CTEs up to t{count}, q{count}: from x0(id, pos, v) and y0(id, j, y), several targets j, both centred, the scores and the inner coefficients of `count` components.

    A component's weights go by the first eigenvector of the targets' products through the features, a small matrix squared again and again.
    """
    parts = []
    for k in range(count):
        parts += [
            f"g{k} as materialized (select pos, j, sum(v * y) as w from x{k} join y0 using (id) group by pos, j)",
            f"r{k}_0 as materialized (select a.j as i, b.j as j, sum(a.w * b.w) as c from g{k} a join g{k} b using (pos) group by 1, 2)",
            f"m{k}_0 as materialized (select i, j, c / (select sum(c) from r{k}_0 where i = j) as c from r{k}_0)",
        ]
        for t in range(1, squarings + 1):
            parts.append(f"r{k}_{t} as materialized (select a.i, b.j, sum(a.c * b.c) as c from m{k}_{t - 1} a join m{k}_{t - 1} b on a.j = b.i group by 1, 2)")
            parts.append(f"m{k}_{t} as materialized (select i, j, c / (select sum(c) from r{k}_{t} where i = j) as c from r{k}_{t})")
        last = f"m{k}_{squarings}"
        parts += [
            f"e{k} as materialized (select i as j, c from {last} where j = (select arg_max(j, c) from {last} where i = j))",
            f"u{k} as materialized (select pos, sum(w * c) as w from g{k} join e{k} using (j) group by pos)",
            f"w{k} as materialized (select pos, w / sqrt(sum(w * w) over ()) as w from u{k})",
            f"t{k} as materialized (select id, sum(v * w) as t from x{k} join w{k} using (pos) group by id)",
            f"n{k} as materialized (select sum(t * t) as tt from t{k})",
            f"q{k} as materialized (select j, sum(t * y) / any_value(tt) as q from t{k} join y0 using (id), n{k} group by j)",
            f"p{k} as materialized (select pos, sum(v * t) / any_value(tt) as p from x{k} join t{k} using (id), n{k} group by pos)",
            f"x{k + 1} as materialized (select id, pos, v - t * p as v from x{k} join t{k} using (id) join p{k} using (pos))",
        ]
    return ", ".join(parts)
