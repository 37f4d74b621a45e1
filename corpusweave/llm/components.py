"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusweave.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``); root is the smallest node reachable.

    Alternates two steps until nothing changes. In the first, every node hands its larger neighbours
    to the smallest node it knows; in the second, its smaller ones. Paths shrink by more than half each
    time, so the rounds grow with the logarithm of the longest path. Both steps are partial minima and
    equi joins (split by the planner where a node has very many edges), each round is written to the
    shared folder, and the driver sees two numbers a round.
    """
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = summary(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        passed = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(passed.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges")
        scratch.drop(current, large)
        current, before, state = after, state, summary(after)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first())
