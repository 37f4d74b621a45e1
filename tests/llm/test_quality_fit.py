"""The quality forest's limit is that of every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from corpusweave.llm import quality_forest as Q


def plain_limit(score, good):
    highest = np.sort(score[good])[::-1]
    floor = highest[min(int(Q.GOOD_LOST * len(highest)), len(highest) - 1)]
    places = np.unique(score[score >= floor])
    places = np.append((places[1:] + places[:-1]) / 2, places[-1] + 0.05)
    gain = [(score[~good] > p).mean() - (score[good] > p).mean() if (~good).any() else 0.0 for p in places.tolist()]
    return places[int(np.argmax(gain))] if (~good).any() else places[-1]


def test_limit():
    dice = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        for bad_share in (0, 0.1, 0.6):
            good = dice.random(n) >= bad_share
            good[0] = True
            score = np.round((dice.random(n) + ~good * 0.3) * 50) / 50
            places, at = np.unique(score, return_inverse=True)
            counts = [np.bincount(at, mask, len(places)).astype(int) for mask in (good, ~good)]
            assert Q._limit(places, *counts) == plain_limit(score, good)


def test_every_labelled_row_counts(spark):
    # The bad rows are the last 40 of 20,040 by hash: a fit on the first 20,000 saw none of them.
    last = {r.doc_id for r in spark.range(20_040).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id").desc(), F.desc("doc_id")).limit(40).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i: " ".join(letters[(i * j) % 26] * (2 + (i + j) % 6) + str(j) for j in range(25))
    rows = [(i, " ".join(f"#{j}$%&|<>{i}" for j in range(25)) if i in last else text(i), int(i not in last)) for i in range(20_040)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "quality")
    kept = {r.doc_id for r in Q.quality_verdicts(docs.where(F.col("doc_id").isin(list(last)) | (F.col("doc_id") < 400)), labels).where("kept").collect()}
    assert not kept & last and len(kept) > 300


def test_trees_of_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "TREES", 4)
    monkeypatch.setattr(Q, "TREE_ROWS", 8)
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(25 + i % 9)), int(i % 7 > 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    fits = [Q.fit(t.select("doc_id", "text"), t.select("doc_id", "quality")) for t in (table, table.repartition(5))]
    assert fits[0][1] == fits[1][1] and np.array_equal(fits[0][0].cut, fits[1][0].cut)


def test_labels_meet_numbers_not_texts(spark, monkeypatch):
    def joined(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [c.output().toString() for c in below if plan.nodeName() == "Join"] + [out for c in below for out in joined(c)]

    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(25 + i % 9)), int(i % 7 > 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    written, write = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df: written.append(df) or write(df))
    for judge in (Q.quality_verdicts, Q.keep_good):
        written.clear()
        verdicts = judge(table.select("doc_id", "text"), table.select("doc_id", "quality"))
        sides = [side for df in [*written, verdicts] for side in joined(df._jdf.queryExecution().optimizedPlan())]
        assert sides and not any("text#" in side for side in sides), sides
