"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Tables

ROUNDS = 60


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """For links(u, v): each node that has a link to another, and the smallest node of its component (node, root).

    u and v are of one orderable type. Loops, repeats and either direction of a link may occur; null ends are dropped.
    Each round is two joins whose hot keys adaptive execution can split, and a table in the shared folder. The result
    reads the last of these tables.
    """
    edges = tables.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(ROUNDS):
        # done if each node points to one smaller node that points to none
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 or (out = 1 and root = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join below can split a hub's rows or, if it is small, needs no shuffle
        least = tables.stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = tables.stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = tables.stored(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
