"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.workspace import discard, materialise


def _to_minimum(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours as m.

    The minimum is pre-aggregated before it is shuffled and joined back, so a node with
    very many edges is summed in parts, and adaptive execution can split its join.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _to_minimum(down)
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.filter("u <> m").select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) that is not its own root.

    root is the least node of the component. Loops, repeated edges and an empty table
    are fine. Every round is written to the shared folder.
    """
    now = materialise(spark, edges.filter("u <> v").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        new = materialise(spark, _small_star(_large_star(now).filter("u <> v").distinct()), "edges")
        state = _state(new)
        discard(spark, now)
        now = new
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
