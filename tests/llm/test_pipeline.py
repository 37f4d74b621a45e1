"""Each stage of the pipeline on its own input, against plain versions."""

import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
from corpusweave.llm import token_store
from corpusweave.llm.common import Scratch, table
from tests.llm.test_operators import plain_components, plain_contamination, plain_fingerprint, split


def test_stages(spark, sf):
    docs, columns = table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    scratch, before = Scratch(spark, "test"), docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf), name)
        after = docs.collect()
        assert name == "token_output" or docs.columns == columns
        seen[name] = (before, after)
        before = after
    kept = {r.doc_id for r in seen["quality"][1]}
    for r in seen["quality"][0]:
        if len(split(r.text)) < 20:
            assert r.doc_id not in kept
    bad = {r.doc_id for r in table(spark, sf, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    assert len(kept & bad) <= 0.2 * len(bad) and len(kept & good) >= 0.9 * len(good)
    one, two = seen["near_dedup"]
    roots, first = plain_components({plain_fingerprint(r.text) for r in one}), {}
    for r in sorted(one):
        first.setdefault(roots[plain_fingerprint(r.text)], r.doc_id)
    assert sorted(r.doc_id for r in two) == sorted(first.values())
    one, two = seen["decontamination"]
    judged = plain_contamination(one, [tuple(r) for r in table(spark, sf, "benchmark").collect()])
    assert sorted(r.doc_id for r in two) == sorted(r[0] for r in judged if not r[5]) and len(two) < len(one)
    one, two = seen["mixture"]
    size = {r.doc_id: len(split(r.text)) for r in one}
    taken = defaultdict(int)
    for r in two:
        taken[r.doc_id] += len(split(r.text))
    assert all(taken[d] <= 2 * n for d, n in size.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    one, two = seen["token_output"]
    whole = token_store.Encoder(token_store.default_tokenizer()).whole
    ids = lambda t: array("I", [*whole.encode(t, add_special_tokens=False).ids, 0]).tobytes()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in two) == Counter((r.doc_id, len(ids(r.text)) // 4, zlib.crc32(ids(r.text))) for r in one)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows_pass_all_stages(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "token_output" or out.columns == odd_docs.columns
            out.collect()
