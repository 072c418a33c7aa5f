"""Arrays that tasks have made of their rows, merged a few at a time up a tree of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
#: Tasks for each core that make an array: one takes several splits where there are more, so what is shuffled does not grow with the splits.
TASKS_PER_CORE = 8


def few_tasks(df: DataFrame) -> DataFrame:
    """df in a bounded number of tasks, without a shuffle."""
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def levels(df: DataFrame, fan_in: int = FAN_IN) -> int:
    """How high a tree over the tasks of df should be, from the size that Spark expects of it; any height gives the same result."""
    spark = df.sparkSession
    conf = lambda key, least: int(spark.conf.get(key, str(least)).rstrip("bkmgB") or least)
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(max(conf("spark.sql.shuffle.partitions", 200), size / (64 << 20)), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return next((k for k in (1, 2, 3) if fan_in**k >= tasks), 4)


def added(arrays: list[np.ndarray]) -> np.ndarray:
    return np.sum(arrays, axis=0)


def merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], by: tuple[str, ...] = (), height: int = 1, fan_in: int = FAN_IN, kind: type = np.float64) -> DataFrame:
    """(by, payload), one row for each `by`: of parts (by, part, payload: the bytes of doubles, or of another kind of number) fan_in neighbours by the number `part`
    are merged in a task, and what they give again, `height` times, the last time all that are left.

    Each level moves a fan_in-th of what the level below it did, and no task holds more than fan_in arrays, or, if the tree is
    lower than the parts ask for, what the last level is left with.
    """
    schema = parts.schema

    def run(table: pa.Table) -> pa.Table:
        whole = merge([np.frombuffer(b, kind) for b in table.column("payload").to_pylist()])
        out = table.slice(0, 1)
        return out.set_column(out.schema.get_field_index("payload"), "payload", pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary()))

    for k in range(height):
        up = F.lit(0).cast("long") if k == height - 1 else F.floor(F.col("part") / fan_in).cast("long")
        parts = parts.withColumn("part", up).select(*schema.names).groupBy(*by, "part").applyInArrow(run, schema)
    return parts.select(*by, "payload")


def of_tasks(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], merge: Callable[[list[np.ndarray]], np.ndarray], kind: type = np.float64) -> np.ndarray | None:
    """What `each` makes of the rows of each task (an array, or None), merged up a tree; the last array comes to the driver. None if there were none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = each(b for b in batches if b.num_rows)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.ascontiguousarray(out, kind).tobytes()], pa.binary())], ["part", "payload"])

    found = merged(few_tasks(df).mapInArrow(run, "part long, payload binary"), merge, height=levels(df), kind=kind).collect()
    return np.frombuffer(found[0]["payload"], kind) if found else None
