"""Streams whose results need more than the row itself: detectors whose statistic is of a window's rows, and the last measurement.

Results depend on events and their times only, not on how the stream is cut into micro-batches: a window is judged when the
watermark has passed its end, a spectrum when no measurement before it can come any more. Rows later than the watermark
are dropped by Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismark.operators.base import by_batch
from prismark.operators.outliers import OutlierModel

#: Parts that the rows of a window are dealt to, as a window may hold any number.
SALTS = 16


def _inverse(sums: np.ndarray, a: int) -> np.ndarray:
    """Inverses of the symmetric matrices whose upper triangles are the rows of sums, by the lines; of singular ones the least of all that fit."""
    i, j = np.triu_indices(a)
    gram = np.zeros((len(sums), a, a))
    gram[:, i, j] = gram[:, j, i] = sums
    return np.linalg.pinv(gram, hermitian=True).reshape(len(sums), a * a)


def _terms(t: Column, a: int) -> list[Column]:
    return [F.get(t, i) * F.get(t, j) for i in range(a) for j in range(i, a)]


def windowed_outliers(stream: DataFrame, model: OutlierModel, keep: tuple[str, ...] = ("id",), ts: str = "ts", window: str = "10 minutes", late: str = "5 minutes", salts: int = SALTS) -> DataFrame:
    """(start, keep, n, residual, outlier, limit) of each row of a stream, once its tumbling window has ended; the statistic is of the window's rows.

    model: a fitted Leverage or StudentizedResiduals; its critical value gives `outlier`. The sums that the statistic needs (of
    products of scores, and of squared errors) are an aggregate of the window that tasks begin; rows wait for them in a join.
    limit: how far a row may be out within its window, from these sums alone: 3 a / n for leverage, 3 for studentized residuals.
    """
    kind, latent = model.value("kind"), model.latent
    if kind not in ("Leverage", "StudentizedResiduals"):
        raise ValueError("only leverage and studentized residuals are of the scored rows themselves")
    student, a, x = kind == "StudentizedResiduals", latent.n_components, F.col(model.value("inputCol"))
    error = (F.col(model.value("target")) - F.get(latent.prediction(x), 0)) if student else F.lit(0.0)
    scored = stream.withWatermark(ts, late).select(F.window(ts, window).alias("w"), *keep, latent.column(x).alias("t"), error.alias("e"))
    sums = scored.groupBy("w").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in _terms(F.col("t"), a)]).alias("sums"), F.sum(F.col("e") * F.col("e")).alias("left"))
    sums = sums.select(F.col("w").alias("of"), "n", "left", by_batch(functools.partial(_inverse, a=a), F.col("sums")).alias("inverse"))
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = scored.withColumn("salt", F.pmod(F.xxhash64("t", "e"), F.lit(salts)).cast("int"))
    met = rows.join(sums, (F.col("w") == F.col("of")) & (F.col("salt") == F.col("part")))
    h = sum((F.get("t", i) * F.get("t", j) * F.get("inverse", i * a + j) for i in range(a) for j in range(a)), F.lit(0.0))
    if student:
        s = F.sqrt(F.col("left") / F.nullif(F.greatest(F.col("n") - a, F.lit(0)), F.lit(0)))
        value, limit = F.try_divide(F.col("e"), s * F.sqrt(1 - h)), F.lit(3.0)
    else:
        value, limit = h, F.lit(3.0 * a) / F.col("n")
    flag = F.when(value > F.lit(float(model.value("critical"))), F.lit(-1)).otherwise(F.lit(1))
    return met.select(F.col("w.start").alias("start"), *keep, "n", value.alias("residual"), flag.alias("outlier"), limit.alias("limit"))


STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("spectra", T.BinaryType()), T.StructField("measured", T.BinaryType())])
_NEVER = np.iinfo(np.int64).min


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def _of_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, columns: list[str], by: str) -> Iterator[pd.DataFrame]:
    """State of a key: the last measurement that is final, its time, and the rows that may still change or be changed."""
    at, value, spectra, measured = state.get if state.exists else (_NEVER, None, None, None)
    new = [b for b in batches if len(b)]
    waiting = [_unpacked(spectra)] if spectra else []
    known = [_unpacked(measured)] if measured else []
    for b in new:
        waiting.append(b.loc[b["_is"] == 1, ["_us", *columns]])
        known.append(b.loc[b["_is"] == 0, ["_us", "_measured"]])
    waiting = pd.concat([w for w in waiting if len(w)] or waiting[:1], ignore_index=True) if waiting else pd.DataFrame()
    known = pd.concat([w for w in known if len(w)] or known[:1], ignore_index=True) if known else pd.DataFrame()
    mark = state.getCurrentWatermarkMs() * 1000
    ready = waiting[waiting["_us"] <= mark] if len(waiting) else waiting
    if len(known):
        known = known.sort_values(["_us", "_measured"], kind="stable")
    if len(ready):
        times = np.r_[_NEVER, known["_us"].to_numpy()] if len(known) else np.array([_NEVER])
        values = np.r_[np.nan if value is None else value, known["_measured"].to_numpy()] if len(known) else np.array([np.nan if value is None else value])
        times[0] = at
        found = values[np.maximum(np.searchsorted(times, ready["_us"].to_numpy(), side="right") - 1, 0)]
        out = ready[columns].copy()
        out["_found"] = found
        yield out
        waiting = waiting[waiting["_us"] > mark]
    if len(known):
        final = known[known["_us"] <= mark]
        if len(final):
            at, value = int(final["_us"].iloc[-1]), float(final["_measured"].iloc[-1])
        known = known[known["_us"] > mark]
    state.update((at, value, _packed(waiting) if len(waiting) else None, _packed(known) if len(known) else None))
    first = min([int(x["_us"].min()) for x in (waiting, known) if len(x)], default=None)
    if first is not None:
        state.setTimeoutTimestamp(max(first // 1000 + 1, mark // 1000 + 1))


def latest_measurement(spectra: DataFrame, measured: DataFrame, ts: str, value: str, by: str, late: str = "10 minutes") -> DataFrame:
    """The streaming form of the as-of join: each spectrum with `value`, the last one measured for the same `by` at or before its time.

    Both are streams. A spectrum waits in the state of its key until the watermark has passed it, so measurements that come up to `late`
    behind count; then only the last final measurement of the key stays. Of several at one time the greatest counts; null measurements do not.
    """
    columns = spectra.columns
    s = spectra.select(*columns, F.lit(None).cast("double").alias("_measured"), F.lit(1).alias("_is"))
    m = measured.select(by, ts, F.col(value).cast("double").alias("_measured"), F.lit(0).alias("_is")).where("_measured is not null")
    both = s.unionByName(m, allowMissingColumns=True).withColumn(ts, F.col(ts).cast("timestamp"))
    both = both.withWatermark(ts, late).withColumn("_us", F.unix_micros(ts))
    schema = T.StructType([*both.select(*columns).schema.fields, T.StructField("_found", T.DoubleType())])
    out = both.groupBy(by).applyInPandasWithState(functools.partial(_of_key, columns=columns, by=by), schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*columns, F.nanvl("_found", F.lit(None).cast("double")).alias(value))
