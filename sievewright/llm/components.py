"""Connected components by alternating stars, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, stages) -> DataFrame:
    """(id, label) for every end of an edge (a, b): label is the smallest id of its component.

    A round is one job. The large star ties every vertex's larger neighbours to the least vertex it knows, the small star its
    smaller ones and itself; the graph becomes stars around the least vertices in a number of rounds that grows with the
    logarithm of the longest path. Least neighbours are combined before they are shuffled, and a vertex with very many edges
    is on the long side of a join only, which Spark can split. The rounds end when a round changes no edge: count and
    checksum of its edges come with the job that writes them.
    """
    measures = {"n": F.count("*"), "sum": F.bit_xor(F.xxhash64("a", "b"))}
    now, seen = stages.kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", measures)
    while seen["n"]:
        ends = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = ends.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = ends.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest.hint("merge"), "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        before, last = now, seen
        now, seen = stages.kept(small.where("a <> b").distinct(), "edges", measures)
        stages.drop(before)
        if (seen["n"], seen["sum"]) == (last["n"], last["sum"]):
            break
    # stars: every edge leads to its centre
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
