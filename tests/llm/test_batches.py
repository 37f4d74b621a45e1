"""Batches of texts that Python gets are bounded in bytes, also in a session that names no bound."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusweave.llm import token_store
from corpusweave.llm.common import map_rows
from corpusweave.session import BATCH_BYTES


@pytest.fixture
def unbounded(spark):
    own = spark.newSession()
    own.conf.unset(BATCH_BYTES[0])
    return own


def test_rows_of_a_task_come_in_batches_of_bounded_bytes(unbounded):
    docs = unbounded.range(0, 2000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    sizes = map_rows(docs, lambda b: {"n": [b.num_rows], "size": [b.nbytes]}, "n long, size long").collect()
    assert sum(r.n for r in sizes) == 2000
    assert max(r.size for r in sizes) < 3 * int(BATCH_BYTES[1])  # 20 MB as one batch


def test_shards_are_written_and_read_in_bounded_batches(unbounded, tmp_path):
    docs = unbounded.createDataFrame([(i, "a few words") for i in range(20)], "doc_id long, text string")
    token_store.write_token_ids(docs, str(tmp_path / "shards"), token_store.default_tokenizer())
    assert unbounded.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]
    unbounded.conf.unset(BATCH_BYTES[0])
    found = token_store.read_token_ids(unbounded, str(tmp_path / "shards"))
    assert unbounded.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]
    assert sorted(r.doc_id for r in found.collect()) == list(range(20))
