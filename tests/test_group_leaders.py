"""The best of every group: a task ships what is best in a whole group, not in each block of vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import similarity as V


def plain(qids, queries, vids, groups, vectors, k, metric, exclude_self):
    """One list of ``k`` for each different query id, as ``row_number`` over all pairs gives it."""
    scores, out = V._scores(queries, vectors, metric), []
    for q in sorted(set(qids.tolist())):
        for g in sorted(set(groups.tolist())):
            pairs = [(-scores[i, j], vids[j]) for i in np.flatnonzero(qids == q) for j in np.flatnonzero(groups == g) if not (exclude_self and vids[j] == q)]
            out += [(q, g, v, -s, rank + 1) for rank, (s, v) in enumerate(sorted(pairs)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric,exclude_self", [("cosine", True), ("dot", False), ("l2", True)])
def test_leaders_of_blocks_are_those_of_all_pairs(monkeypatch, metric, exclude_self):
    rng = np.random.default_rng(5)
    for _ in range(12):
        monkeypatch.setattr(V, "BLOCK_ROWS", int(rng.integers(1, 60)))
        monkeypatch.setattr(V, "TILE_CELLS", int(rng.integers(1, 400)))
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 5))
        vids, groups, vectors = rng.permutation(n), np.sort(rng.integers(0, 6, n)), rng.integers(-2, 3, (n, 4)).astype(float)  # many ties
        qids = rng.permutation(n)[:30]
        queries = rng.integers(-2, 3, (len(qids), 4)).astype(float)
        blocks = [(vids[x], groups[x], vectors[x]) for x in np.array_split(np.arange(n), 4)]
        found = [tuple(r.values()) for b in V._group_leaders(qids, queries, blocks, k, metric, exclude_self) for r in b.to_pylist()]
        assert sorted(found) == plain(qids, queries, vids, groups, vectors, k, metric, exclude_self)


@pytest.mark.parametrize("layout", [{}, {"broadcast_bytes": 0, "block_rows": 40}])
@pytest.mark.parametrize("twice", [False, True])
def test_each_layout_and_repeated_ids(spark, layout, twice):
    rng = np.random.default_rng(6)
    ids, groups, vectors = np.arange(150), np.where(np.arange(150) < 90, 0, np.arange(150) % 7), rng.standard_normal((150, 4)).round(2)
    if twice:
        ids, groups, vectors = np.r_[ids, ids[:20]], np.r_[groups, groups[:20]], np.r_[vectors, vectors[:20]]
    rows = [(int(i), int(g), v.tolist()) for i, g, v in zip(ids, groups, vectors)]
    stored = spark.createDataFrame(rows, "vec_id long, group_id long, embedding array<double>").repartition(3)
    found = V.nearest(stored.withColumnRenamed("vec_id", "query_id"), stored, 2, mode="each", exclude_self=True, **layout)
    assert found.columns == ["query_id", "group_id", "vec_id", "score", "rank"]
    assert sorted(map(tuple, found.collect())) == plain(ids, vectors, ids, groups, vectors, 2, "cosine", True)


def test_a_group_leaves_a_task_once(spark):
    # 12 partitions of vectors: a row for each block would be 12 times the result, shuffled and sorted.
    vectors = spark.range(600, numPartitions=12).select(
        F.col("id").alias("vec_id"), (F.col("id") % 5).alias("group_id"), F.array(*[F.cos(F.col("id") * i) for i in range(1, 5)]).alias("embedding")
    )
    found = V.nearest(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 2, mode="each")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 600 * 5 * 2
    rng = np.random.default_rng(7)
    ids, groups, matrix = np.arange(600), np.repeat(np.arange(5), 120), rng.standard_normal((600, 4))
    blocks = [(ids[x], groups[x], matrix[x]) for x in np.array_split(np.arange(600), 12)]
    assert sum(b.num_rows for b in V._group_leaders(ids, matrix, blocks, 2, "cosine", False)) == 600 * 5 * 2


def test_fused_hits_are_dealt_out_by_query_alone(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cards = own.range(40).select((F.col("id") % 10).alias("query_id"), F.floor(F.col("id") / 10).alias("card"), (F.col("id") * 0.1).alias("score"), F.lit(1).alias("rank"))
    cards = cards.unionByName(cards.where("query_id = 3"))  # a query that comes twice
    pages = own.range(30).select((F.col("id") % 10).alias("query_id"), (F.floor(F.col("id") / 10) + 1).alias("card"), (F.col("id") * 0.2).alias("page_score")).where("query_id <> 7")
    found = V.top_k(V.fuse(cards, pages, 0.5), ["query_id"], [F.desc("fused"), F.col("card")], 100)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and not any("card" in line for line in dealt)
    best = {(r.query_id, r.card): r.page_score for r in pages.collect()}
    rows = found.collect()
    assert len(rows) == 44
    for r in rows:
        evidence = best.get((r.query_id, r.card), r.score)
        assert r.page_score == best.get((r.query_id, r.card)) and r.page_evidence == evidence and r.fused == pytest.approx(r.score + evidence / 2)
