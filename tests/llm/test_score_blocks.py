"""Blocks of text that language-model scores are asked in are bounded by their words, whatever the size of an Arrow batch."""

import numpy as np

from corpusweave.llm import lm_score
from tests.llm.conftest import text_of
from tests.llm.test_operators import check_scores


def test_blocks_go_on_over_batches(spark, monkeypatch):
    rows = [(i, text_of(i, 40 + i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks, ask, name = [], lm_score.questions, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(lm_score, "questions", lambda df, number: blocks.extend(df.collect()) or ask(df, number))
    before, found = spark.conf.get(name), {}
    spark.conf.set(name, "4")
    try:
        for group in (1 << 20, 200):
            blocks.clear()
            monkeypatch.setattr(lm_score, "GROUP", group)
            found[group] = sorted(lm_score.lm_scores(docs).collect())
            check_scores(rows, found[group])
            words = [sum(np.frombuffer(b.length, np.int64).tolist()) for b in blocks]
            assert sum(words) == sum(41 + i for i in range(30)) and max(words) <= group + 71
            assert len(blocks) == 1 if group > 200 else len(blocks) > 5
    finally:
        spark.conf.set(name, before)
    assert [r.score for r in found[200]] == [r.score for r in found[1 << 20]]
    assert all(r.n_tokens == 41 + r.doc_id for r in found[200])


def test_different():
    keys = np.array([3, 1, 3, 2, 1], np.uint64)
    assert lm_score.different(keys).tolist() == [1, 2, 3] and len(lm_score.different(keys[:0])) == 0
