"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.session import cut, uncut


def least_member(pairs: DataFrame) -> DataFrame:
    """(fp, root): each node of ``pairs`` (a, b) and the least node it is connected to.

    Each round links every node's larger neighbours to its least neighbour, first over all
    neighbours, then over the smaller ones, until all edges are stars around a least node. Edges
    are rewritten, never joined among each other, so a node of high degree makes no more rows than
    its degree. Each round is written to the checkpoint folder.
    """
    edges = cut(pairs.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        # all neighbours: larger ones move to the least of the neighbourhood
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = cut(
            edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
            .join(least.withColumnRenamed("v", "x"), "x")
            .select(F.col("y").alias("v"), F.col("m").alias("u"))
            .where("v != u")
            .distinct()
        )
        # smaller neighbours and the node itself move to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        after = cut(
            large.join(low, "v")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select("e.v", F.col("e.m").alias("u"))
            .where("v != u")
            .distinct()
        )
        state = after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        uncut(edges, large)
        edges = after
        if state == before:
            break
        before = state
    roots = edges.select("u").distinct().select(F.col("u").alias("fp"), F.col("u").alias("root"))
    return edges.select(F.col("v").alias("fp"), F.col("u").alias("root")).unionByName(roots)
