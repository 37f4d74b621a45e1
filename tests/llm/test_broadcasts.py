"""What grows with the documents is never broadcast, also where the planner takes it for small."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusweave.llm import mixing, simhash
from corpusweave.llm.common import Scratch


@pytest.fixture
def eager(spark):
    """A session that broadcasts whatever it takes for smaller than 100 MB."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100 << 20))
    return own


class Plans(Scratch):
    """Keeps the first plan of each table that is written."""

    def __init__(self, spark, name):
        super().__init__(spark, name)
        self.plans = {}

    def write(self, df, name, *partition_by):
        self.plans[name] = plan(df)
        return super().write(df, name, *partition_by)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(eager):
    fps = eager.range(3000).select(F.xxhash64("id").alias("fp"))
    scratch = Plans(eager, "links")
    nodes = scratch.write(fps.unionByName(fps.limit(50).select(F.col("fp").bitwiseXOR(5).alias("fp"))).distinct(), "nodes")
    edges = simhash.links(nodes, scratch)
    assert "SortMergeJoin" in scratch.plans["members"] and "Broadcast" not in scratch.plans["members"]
    assert "SortMergeJoin" in plan(edges) and "Broadcast" not in plan(edges)
    assert edges.distinct().count() >= 50


def test_rows_of_a_mix_are_not_broadcast(eager):
    scratch = Scratch(eager, "mix")
    rows = eager.range(2000).select(
        F.col("id").alias("row_id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), (F.col("id") % 50).alias("size")
    )
    placed, _ = mixing._ordered(scratch.write(rows, "rows"), scratch)
    outermost = next(line for line in plan(placed).splitlines() if "Join" in line)
    assert "bucket" in outermost and "BuildLeft" not in outermost  # the rows are the left side
    found = placed.groupBy("source_no").agg(F.count("*").alias("n"), F.count("first_word").alias("placed"), F.countDistinct("first_word").alias("starts")).collect()
    assert len(found) == 3 and sum(r.n for r in found) == 1960 and all(r.n == r.placed == r.starts for r in found)
