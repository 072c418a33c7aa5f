"""Exact quantiles of columns, and of each place of a column of arrays, of any size: nothing is sorted, exploded or kept in
memory, and no group of values meets in one task.

Values are looked at as whole numbers of 64 bits in the same order: longs are such numbers, doubles are by their bits. A first
pass counts values and finds the least and the greatest; while there are many, the next passes count them in buckets between the
bounds of each wanted rank, and the bucket that holds the rank gives the next bounds. Each pass narrows bounds by the number
of buckets, whatever the values are, infinities too, so there are at most 16 passes. Counts are added up a tree of tasks; to the
driver come counts, and at last at most COLLECTED values.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType

from prismark.functions.trees import added, of_tasks
from prismark.sources.scratch import written

#: Buckets that one pass counts in all, and values that are few enough to be looked at.
BUCKETS, COLLECTED = 1 << 18, 100_000
_GREATEST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_REST = np.int64(_GREATEST)
#: What reads a batch: places and keys of its values, one behind the other.
Reader = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
#: Two neighbouring values and how far the quantile is from the first to the second.
Between = tuple[float, float, float]


def keys_of(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    if v.dtype.kind == "i":
        return v.astype(np.int64)
    bits = (v.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _REST, bits)


def value_of(key: int, whole: bool) -> float | int:
    if whole:
        return int(key)
    k = np.int64(key)
    return float((k ^ _REST if k < 0 else k).view(np.float64))


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which values are there and are numbers, the keys of these)."""
    if pa.types.is_integer(column.type):
        there = np.asarray(column.is_valid())
        return there, keys_of(np.asarray(column.fill_null(0))[there])
    v = np.asarray(column.cast(pa.float64()).fill_null(float("nan")))
    there = ~np.isnan(v)
    return there, keys_of(v[there])


def _of_arrays(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).drop_null()
    flat = x.flatten()
    if len(flat) != p * len(x):
        raise ValueError(f"the arrays must have {p} values each")
    there, keys = _valid(flat)
    return np.tile(np.arange(p), len(x))[there], keys


def _of_groups(batch: pa.RecordBatch, number: dict) -> tuple[np.ndarray, np.ndarray]:
    there, keys = _valid(batch.column(1))
    groups = batch.column(0).dictionary_encode()
    place = np.array([number[g] for g in groups.dictionary.to_pylist()] or [0], np.int64)
    return place[np.asarray(groups.indices.fill_null(0))][there] if groups.null_count == 0 else np.array([number[g] for g in batch.column(0).to_pylist()])[there], keys


# --- the first pass: [values, least, greatest] by place, then -1, or how many values there are, their places and keys --------
def _look(batches: Iterator[pa.RecordBatch], reader: Reader, p: int, few: int) -> np.ndarray:
    n, low, high = np.zeros(p, np.int64), np.full(p, _GREATEST), np.full(p, _LEAST)
    held: list | None = []
    for batch in batches:
        place, key = reader(batch)
        n += np.bincount(place, minlength=p)
        np.minimum.at(low, place, key)
        np.maximum.at(high, place, key)
        if held is not None:
            held.append((place, key))
            held = held if n.sum() <= few else None
    return np.concatenate([n, low, high, *_carried(held)])


def _carried(held: list | None) -> list[np.ndarray]:
    if held is None:
        return [np.array([-1])]
    place, key = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
    return [np.array([len(place)]), place, key]


def _looks(parts: list[np.ndarray], p: int, few: int) -> np.ndarray:
    n, low, high = (np.stack([a[k * p : (k + 1) * p] for a in parts]) for k in range(3))
    rest = [a[3 * p :] for a in parts]
    held = [(r[1 : 1 + r[0]], r[1 + r[0] :]) for r in rest] if n.sum() <= few and all(r[0] >= 0 for r in rest) else None
    return np.concatenate([n.sum(axis=0), low.min(axis=0), high.max(axis=0), *_carried(held)])


# --- the next passes -----------------------------------------------------------------------------------------------------
def _layers(brackets: list[tuple[int, int, int]], p: int) -> list[np.ndarray]:
    """Brackets (place, low, high) as rows [number or -1, low, high] by place; a place with several has one in each layer."""
    out: list[np.ndarray] = []
    depth = [0] * p
    for i, (place, low, high) in enumerate(brackets):
        if depth[place] == len(out):
            out.append(np.stack([np.full(p, -1), np.zeros(p, np.int64), np.zeros(p, np.int64)]))
        out[depth[place]][:, place] = i, low, high
        depth[place] += 1
    return out


def _inside(reader: Reader, batch: pa.RecordBatch, layers: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bracket, key) of the values inside a bracket, layer by layer."""
    place, key = reader(batch)
    for number, low, high in layers:
        some = (number[place] >= 0) & (key >= low[place]) & (key <= high[place])
        yield number[place[some]], key[some]


def _count(batches: Iterator[pa.RecordBatch], reader: Reader, layers: list[np.ndarray], low: np.ndarray, width: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(low) * size, np.int64)
    for batch in batches:
        for b, key in _inside(reader, batch, layers):
            bucket = (key.view(np.uint64) - low[b].view(np.uint64)) // width[b]
            out += np.bincount(b * size + bucket.astype(np.int64), minlength=len(out))
    return out


def _take(batches: Iterator[pa.RecordBatch], reader: Reader, layers: list[np.ndarray]) -> np.ndarray:
    found = [x for batch in batches for x in _inside(reader, batch, layers)]
    return np.concatenate([_pairs(b, k) for b, k in found]) if found else np.zeros(0, np.int64)


def _pairs(b: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.stack([b, key], axis=1).ravel()


def ranked(rows: DataFrame, reader: Reader, p: int, shares: list[float], again: Callable[[], DataFrame] | None = None) -> dict[int, list[tuple[int, int, float]]]:
    """{place: (key below, key above, how far between) of each share}; again(): where the next passes read the rows from, if there are any."""
    few, buckets = COLLECTED, BUCKETS
    head = of_tasks(rows, functools.partial(_look, reader=reader, p=p, few=few), functools.partial(_looks, p=p, few=few), np.int64)
    if head is None:
        return {}
    n, low, high = head[: 3 * p].reshape(3, p)
    wanted = {i: [s * (int(n[i]) - 1) for s in shares] for i in range(p) if n[i]}
    found: dict[tuple[int, int], int] = {}
    if head[3 * p] >= 0:
        place, key = head[3 * p + 1 :].reshape(2, -1)
        order = np.lexsort((key, place))
        key, first = key[order], np.cumsum(n) - n
        found = {(i, r): int(key[first[i] + r]) for i, hs in wanted.items() for h in hs for r in (math.floor(h), math.ceil(h))}
    else:
        rows = again() if again else rows
        # (place, rank) -> least and greatest key, values below, values between
        open_ = {(i, r): (int(low[i]), int(high[i]), 0, int(n[i])) for i, hs in wanted.items() for h in hs for r in (math.floor(h), math.ceil(h))}
        while open_:
            found |= {at: lo for at, (lo, hi, *_) in open_.items() if lo == hi}
            open_ = {at: x for at, x in open_.items() if x[0] != x[1]}
            if open_:
                open_ = _narrowed(rows, reader, p, open_, found, few, buckets)
    return {i: [(found[i, math.floor(h)], found[i, math.ceil(h)], h - math.floor(h)) for h in hs] for i, hs in wanted.items()}


def _narrowed(rows: DataFrame, reader: Reader, p: int, open_: dict, found: dict, few: int, buckets: int) -> dict:
    """One pass: open_ with narrower bounds, or nothing, where few values were left and all ranks were found among them."""
    inside = {(i, lo, hi): n for (i, _), (lo, hi, _, n) in open_.items()}
    brackets = sorted(inside)
    number = {b: k for k, b in enumerate(brackets)}
    layers = _layers(brackets, p)
    if sum(inside.values()) <= few:
        pairs = of_tasks(rows, functools.partial(_take, reader=reader, layers=layers), np.concatenate, np.int64).reshape(-1, 2)
        b, key = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        first = np.searchsorted(b, np.arange(len(brackets)))
        found |= {(i, r): int(key[first[number[i, lo, hi]] + r - below]) for (i, r), (lo, hi, below, _) in open_.items()}
        return {}
    size = max(16, buckets // len(brackets))
    widths = [(hi - lo) // size + 1 for _, lo, hi in brackets]
    counts = of_tasks(rows, functools.partial(_count, reader=reader, layers=layers, low=np.array([lo for _, lo, _ in brackets]), width=np.array(widths, np.uint64), size=size), added, np.int64)
    sums = np.cumsum(counts.reshape(len(brackets), size), axis=1)
    out = {}
    for (i, r), (lo, hi, below, _) in open_.items():
        k = number[i, lo, hi]
        at = int(np.searchsorted(sums[k], r - below, side="right"))
        before = int(sums[k][at - 1]) if at else 0
        out[i, r] = (lo + at * widths[k], min(hi, lo + (at + 1) * widths[k] - 1), below + before, int(sums[k][at]) - before)
    return out


def _is_whole(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def _as_numbers(df: DataFrame, value: str) -> tuple[DataFrame, bool]:
    """(df with `value` as long or double, whether it is long)."""
    kind = df.schema[value].dataType
    array = isinstance(kind, ArrayType)
    whole = _is_whole(kind.elementType if array else kind)
    name = "long" if whole else "double"
    return df.withColumn(value, F.col(value).cast(f"array<{name}>" if array else name)), whole


def between_neighbours(df: DataFrame, value: str, shares: list[float], group: str | None = None) -> dict[object, list[Between]]:
    """{group: (value below, value above, how far between) of each share}; longs stay whole numbers. Without `group` the one key is 0."""
    rows, whole = _as_numbers(df.select((F.lit(0) if group is None else F.col(group)).alias("g"), F.col(value).alias("v")), "v")
    groups = [0] if group is None else [r[0] for r in rows.where("v is not null").select("g").distinct().collect()]
    if not groups:
        return {}

    rows = rows.where("v is not null")
    found = ranked(rows, functools.partial(_of_groups, number={g: i for i, g in enumerate(groups)}), len(groups), shares, lambda: written(rows, "values"))
    return {groups[i]: [(value_of(a, whole), value_of(b, whole), f) for a, b, f in x] for i, x in found.items()}


def _at(a: float, b: float, f: float) -> float:
    return float(a + (b - a) * f) if a != b else float(a)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], group: str | None = None) -> dict:
    """{group: [quantile of each share, interpolated between neighbours]}; without `group` the one key is 0.

    Nulls and NaN are left out; a group without values is not in the result.
    """
    return {g: [_at(*x) for x in found] for g, found in between_neighbours(df, value, shares, group).items()}


def whole_cuts(df: DataFrame, value: str, shares: list[float]) -> list[int]:
    """Of a column of whole numbers the greatest ones that are not above the quantiles; exact for all longs."""
    return [int(a) + math.floor(Fraction(f) * (int(b) - int(a))) for a, b, f in between_neighbours(df, value, shares).get(0, [])]


def array_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[list[float] | None]:
    """For each place of a column of arrays of one length the quantiles of its values over all rows; None where there are none. Null arrays are left out."""
    rows, whole = _as_numbers(df.select(F.col(column).alias("x")).where("x is not null"), "x")
    first = rows.select(F.size("x")).first()
    if first is None:
        return []
    found = ranked(rows, functools.partial(_of_arrays, p=first[0]), first[0], shares)
    return [[_at(value_of(a, whole), value_of(b, whole), f) for a, b, f in found[i]] if i in found else None for i in range(first[0])]
