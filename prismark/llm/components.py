"""Connected components by alternating large-star and small-star steps; every step is a few aggregates and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import discard, materialise


def _settled(e: DataFrame) -> bool:
    """Whether each node has one edge upwards at most, and none if it has edges downwards: then lo is the component of hi."""
    nodes = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(id, component) for each id that has an edge; component is the smallest id reachable.

    Ids are longs. Edges with a null end or from an id to itself link nothing. No list of neighbours is ever gathered:
    a node's minimum comes from a partially aggregated group, and edges of hubs are dealt by an ordinary (skew-splittable) join.
    """
    e = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where(f"{u} is not null and {v} is not null and hi != lo").distinct()
    e = materialise(e, "edges")
    while not _settled(e):
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("x")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        # A node's larger neighbours are the upper ends of the edges whose lower end it is: a row for each edge.
        large = e.join(least, F.col("lo") == F.col("n")).select("hi", F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, e = e, materialise(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(before)
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
