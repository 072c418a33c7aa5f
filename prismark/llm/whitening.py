"""Embedding whitening by a bidiagonal qd solver.

The fit list is the distinct vectors of whole numbers. Their sums, and then the triangular factor of their centred rows, are
merged up a tree: each task takes its rows in blocks and factors each block together with the factor so far (QR), tasks' factors
meet a few at a time. The last factor, as wide as a vector, is made bidiagonal by Householder reflections; dqds finds its
singular values, twisted factorisations the directions. The covariance is never formed, so small variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.trees import added, levels, merged
from prismark.llm.common import materialise
from prismark.llm.singular_values import leading

#: Rows of a block that is factored at once.
BLOCK = 1024
#: Whole numbers saturate here.
MOST = 1 << 53
_SPLIT = 26


def whole(c: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(np.floor(c * factor), -MOST, MOST).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """A vector of whole numbers in the narrowest kind that holds it: equal vectors give equal bytes."""
    most = int(np.abs(x).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, f"i{b[0]}", offset=1).astype(np.int64) for b in rows]) if rows else np.zeros((0, 1), np.int64)


def usable(v: Column) -> Column:
    """Not null, not empty, and all entries finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _packing(factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = np.asarray(batch.column("v").flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([packed(x) for x in whole(v, factor)], pa.binary())], ["id", "x"])

    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact difference n x - S where a long holds it."""
    return exact(x, n, sums).astype(float) / n


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S; as Python's numbers where longs may be too small."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None where a long does not hold it."""
    d = exact(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    whole_sums = [sum(int(v) ** 2 for v in row) for row in d]
    return [s if s < 1 << 63 else None for s in whole_sums]


def _parts(each: Callable[[Iterator[np.ndarray]], np.ndarray]):
    """One row for each task: what `each` makes of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = each(unpacked(b.column(0).to_pylist()) for b in batches if b.num_rows)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())], ["part", "payload"])

    return run


def gathered(fit: DataFrame, each: Callable, merge: Callable) -> np.ndarray:
    parts = fit.select("x").mapInArrow(_parts(each), "part long, payload binary")
    found = merged(parts, merge, height=levels(fit)).collect()  # one row, of the size of a row's dimensions squared
    return np.frombuffer(found[0]["payload"], np.float64)


def _sums(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """Rows, and sums of the upper and lower parts of the entries: whole numbers below 2^53 as doubles, so exact for 2^26 rows of a task at least."""
    n, high, low = 0, 0, 0
    for x in blocks:
        n, high, low = n + len(x), high + (x >> _SPLIT).sum(axis=0), low + (x & ((1 << _SPLIT) - 1)).sum(axis=0)
    return np.array([n, *high, *low], float) if n else None


def _factor(n: int, sums: list[int]):
    def each(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r, held = None, []
        for x in blocks:
            held.append(centred(x, n, sums))
            if sum(map(len, held)) >= BLOCK:
                r, held = triangular([*([] if r is None else [r]), *held]), []
        return triangular([*([] if r is None else [r]), *held]) if held or r is not None else None

    return each


def triangular(parts: list[np.ndarray]) -> np.ndarray:
    """The square upper triangular factor of rows put one below the other."""
    rows = np.vstack(parts)
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _squares(flat: list[np.ndarray]) -> np.ndarray:
    d = int(np.sqrt(len(flat[0])))
    return triangular([f.reshape(d, d) for f in flat])


def _moments(n: int, sums: list[int], directions: np.ndarray):
    """Rows, means and sums of products about the means of the whitened rows of a task."""

    def each(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        parts = []
        for x in blocks:
            w = centred(x, n, sums) @ directions
            m = w.mean(axis=0)
            parts.append(np.concatenate([[len(w)], m, ((w - m).T @ (w - m)).ravel()]))
        return _pooled(parts) if parts else None

    return each


def _pooled(parts: list[np.ndarray]) -> np.ndarray:
    k = int((np.sqrt(1 + 4 * (len(parts[0]) - 1)) - 1) / 2)
    count = np.array([p[0] for p in parts])
    means = np.array([p[1 : 1 + k] for p in parts])
    mean = count @ means / count.sum()
    off = means - mean
    products = sum(p[1 + k :] for p in parts) + ((off * count[:, None]).T @ off).ravel()
    return np.concatenate([[count.sum()], mean, products])


def whiten(vectors: DataFrame, components: int = 4, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row that takes part and each component: id_col, keep, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those of another length than most
    have. Entries become whole numbers x = floor(factor * entry), which saturate at 2^53. The model is fitted on each distinct x
    once (n of them, with sums S); its components are the unit eigenvectors of their covariance by falling eigenvalue e.
    deviation: sum of (n x - S)^2, exact (null if a long does not hold it). whitened: x - S / n along the component, over sqrt(e).
    explained: e over the sum of all. identity_error: largest entry of the whitened fit list's covariance less the identity.
    Components without variance have null whitened values and count in no error; a table without variance has explained and error 0.
    Fewer dimensions give fewer components. Null ids and repeated rows are kept; an empty table gives no rows.
    """
    carried = [f"keep{i}" for i in range(len(keep))]
    rows = vectors.select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)]).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [F.col("id.id").alias(id_col), *[F.col(f"id.{k}").alias(c) for c, k in zip(keep, carried, strict=True)]]
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, {numbers}").select(*names, "component", "n", "deviation", "whitened", "explained", "identity_error")
    d = sizes["d"]
    rows = materialise(rows.where(F.size("v") == d).mapInArrow(_packing(factor), f"id {kind}, x binary"), "whole")
    fit = materialise(rows.select("x").distinct(), "fit")

    found = gathered(fit, _sums, added)
    n, sums = int(found[0]), [(int(h) << _SPLIT) + int(low) for h, low in zip(found[1 : 1 + d], found[1 + d :], strict=True)]
    r = gathered(fit, _factor(n, sums), _squares).reshape(d, d)
    count = min(components, d)
    squares, directions, total = leading(r, count)
    there = squares > total * d * np.finfo(float).eps ** 2
    directions = np.where(there, directions / np.sqrt(np.where(there, squares / n, 1.0)), np.nan)
    k, error = int(there.sum()), 0.0
    if k:
        pooled = gathered(fit, _moments(n, sums, directions[:, there]), _pooled)
        error = float(np.abs(pooled[1 + k :].reshape(k, k) / n - np.eye(k)).max())
    explained = [float(s / total) if total else 0.0 for s in squares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("x").to_pylist())
            m = len(x)
            if not m:
                continue
            w = centred(x, n, sums) @ directions
            of, which = np.repeat(np.arange(m), count), np.tile(np.arange(count), m)
            each = [batch.column("id").take(pa.array(of)), pa.array(which + 1, pa.int32()), pa.array(np.full(len(of), n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(of))]
            yield pa.RecordBatch.from_arrays([*each, pa.array(w.ravel(), from_pandas=True), pa.array(np.array(explained)[which]), pa.array(np.full(len(of), error))], ["id", *(f.split()[0] for f in numbers.split(", "))])

    out = rows.mapInArrow(run, f"id {kind}, {numbers}")
    return out.select(*names, "component", "n", "deviation", "whitened", "explained", "identity_error")
