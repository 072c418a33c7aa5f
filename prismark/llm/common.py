"""What the operators of this subpackage share: tables, scratch space, sizes of Arrow batches."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bits of a bitmap that goes to every task, 16 MB.
MAX_BITS = 1 << 27
#: Rows of an Arrow batch: documents may be long, and a batch is held in memory as a whole.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where all share one disk, one of our own if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"prismark-scratch-{os.getuid()}")
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, of this application."""
    return f"{_scope(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _scope(spark: SparkSession) -> str:
    return "/".join([shared_folder(spark), "prismark", spark.sparkContext.applicationId, *_within])


_within: list[str] = []


@contextlib.contextmanager
def scratch_of(spark: SparkSession, label: str):
    """What is materialised inside is removed at the end; results that are still lazy must be written before."""
    _within.append(f"{label}-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        path = _scope(spark)
        _within.pop()
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: df written as Parquet to the shared folder, to a new place if none is given, and read from there.

    Unlike a cached frame it survives the loss of executors, and it is written once however often it is read.
    """
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove materialised frames that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has materialised; results that are still lazy must be written before."""
    _remove(spark, f"{shared_folder(spark)}/prismark/{spark.sparkContext.applicationId}")


def same(a: Column, b: Column) -> Column:
    """Equality for joins that also matches null with null."""
    return a.eqNullSafe(b)


def on_known(key: Column, other: Column, by: Column) -> Column:
    """key == other for a left join where many rows may have no key: these match nothing, and are dealt by `by` instead of to one task."""
    return (key == other) & (F.when(key.isNull(), F.pmod(F.xxhash64(by), F.lit(1 << 16))).otherwise(F.lit(0)) == F.when(other.isNull(), F.lit(-1)).otherwise(F.lit(0)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _place(on: tuple[str, ...], n_bits: int) -> Column:
    return F.xxhash64(*on).bitwiseAND(F.lit(n_bits - 1))


def apart(rows: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key `on` is surely not among keys, rows whose key may be), by a bitmap of the keys' hashes, which Spark fetches as a scalar subquery.

    keys must be distinct and written already. The bitmap has 16 bits a key and MAX_BITS at most; the more keys beyond
    that, the more rows may be among them.
    """
    n = keys.count()
    if not n:
        return rows, rows.where("false")
    n_bits = min(MAX_BITS, max(64, 1 << (16 * n - 1).bit_length()))
    bit = keys.select(_place(on, n_bits).alias("p"))
    words = bit.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("x"))
    words = words.unionByName(rows.sparkSession.range(n_bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x")))
    words = words.groupBy("w").agg(F.bit_or("x").alias("x"))
    # The one array has MAX_BITS / 64 longs at most.
    bits = materialise(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda e: e["x"]).alias("bits")), "bitmap")
    p = _place(on, n_bits)
    maybe = F.getbit(F.get(bits.scalar(), F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.where(~maybe), rows.where(maybe)


def without(rows: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The rows whose key is not among keys; only those that may be are shuffled."""
    sure, maybe = apart(rows, keys, on)
    return sure.unionByName(maybe.join(keys.select(*on).hint("merge"), [*on], "left_anti").select(*rows.columns))
