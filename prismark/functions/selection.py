"""The rows with the smallest keys, so many of each class as are wanted, exactly: without a sort and without a class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismark.sources.scratch import written

#: Bits of keys, and bits of them that one pass looks at.
KEY_BITS, DIGIT = 60, 12


def smallest(rows: DataFrame, wanted: DataFrame, key: str, by: str, tie: Column, output: str) -> DataFrame:
    """rows with a column `output`: whether a row is among the `quota` of its class `by` with the smallest keys.

    wanted: (by, quota), one row for each class; rows of other classes are none of them. Keys are longs from 0 below
    2 ** KEY_BITS. From pass to pass rows are counted by the next DIGIT bits of those keys that begin as the one looked for; one row for
    each class, digit and task is shuffled. Of rows with the very key where a class ends those with the smallest `tie` are taken.
    """
    keyed = rows.select(F.col(by).alias("_c"), F.col(key).alias("_k"))
    # prefix: how the key that is looked for begins; left: rows that are wanted of those that begin like it.
    open_ = wanted.select(F.col(by).alias("_of"), F.lit(0).cast("long").alias("prefix"), F.col("quota").cast("long").alias("left"))
    closed, known = None, F.col("left") <= 0
    for shift in range(KEY_BITS, -1, -DIGIT):
        # Nothing is left over: all keys below the prefix are in, none that begin like it or are above.
        done = open_.where(known).select("_of", (F.shiftleft("prefix", shift) if shift else F.col("prefix")).alias("below"), F.lit(0).cast("long").alias("ties"))
        closed = done if closed is None else closed.unionByName(done)
        open_ = open_.where(~known)
        if shift == 0 or open_.isEmpty():
            break
        digit = F.shiftright("_k", shift - DIGIT)
        counts = keyed.join(open_.select("_of", "prefix", "left"), F.col("_c").eqNullSafe(F.col("_of")) & (F.shiftright("_k", shift) == F.col("prefix")))
        counts = counts.groupBy("_of", digit.alias("digit")).agg(F.count("*").alias("n"), F.first("left").alias("left"))
        upto = F.sum("n").over(Window.partitionBy("_of").orderBy("digit"))
        counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        there = counts.where("before < left and left <= upto")
        # A digit that is wanted whole ends before the next one.
        whole = F.col("upto") == F.col("left")
        open_ = written(there.select("_of", F.when(whole, F.col("digit") + 1).otherwise(F.col("digit")).alias("prefix"), F.when(whole, F.lit(0)).otherwise(F.col("left") - F.col("before")).cast("long").alias("left")), "cuts")
    last = open_.select("_of", F.col("prefix").alias("below"), F.col("left").alias("ties"))
    closed = written(closed.unionByName(last), "cuts")
    met = rows.join(closed, F.col(by).eqNullSafe(F.col("_of")), "left")
    inside = F.coalesce(F.col(key) < F.col("below"), F.lit(False))
    if not closed.where("ties > 0").isEmpty():
        # Only rows of one and the same key are put in order.
        at = F.when((F.col(key) == F.col("below")) & (F.col("ties") > 0), F.lit(0))
        rank = F.row_number().over(Window.partitionBy("_of", at, F.when(at.isNull(), F.xxhash64(key, tie))).orderBy(tie))
        inside = inside | (at.isNotNull() & (rank <= F.col("ties")))
    return met.withColumn(output, inside).drop("_of", "below", "ties")
