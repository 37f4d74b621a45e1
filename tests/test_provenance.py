"""Context items against what is stored: every kind of failure by name, and nothing of what is sound."""

import hashlib

from pyspark.sql import functions as F

from corpusweave.operators import provenance


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ITEM = "query_id long, marker string, doc_id long, chunk_index int, text string, content_hash string, page_hash string"


def failures(spark, items):
    chunks = spark.createDataFrame([(d, n, sha(f"{d}-{n}")) for d in (1, 2) for n in range(3)], "doc_id long, chunk_index int, content_hash string")
    pages = spark.createDataFrame([(d, sha(f"page {d}")) for d in (1, 2)], "doc_id long, page_hash string")
    found = provenance.context_failures(spark.createDataFrame(items, ITEM).repartition(3), chunks, pages).collect()
    return {(r.query_id, r.marker, r.chunk_index): r.failures for r in found}


def sound(query=1, marker="S1", doc=1, n=0, **changes):
    fields = dict(query_id=query, marker=marker, doc_id=doc, chunk_index=n, text=f"{doc}-{n}", content_hash=sha(f"{doc}-{n}"), page_hash=sha(f"page {doc}"))
    return tuple((fields | changes).values())


def test_each_failure(spark):
    items = [
        sound(), sound(marker="S2", n=1), sound(2), sound(2, "S2", 2, 2),  # sound ones share chunks with spoilt ones
        sound(3, "S0"), sound(3, "[S1]", n=1), sound(3, None, n=2), sound(4, "S1"), sound(4, "S1", n=1),
        sound(5, "S1", doc=9), sound(5, "S2", n=7), sound(5, "S3", text="other"), sound(5, "S4", content_hash=sha("other")), sound(5, "S5", content_hash="abc"),
        sound(5, "S6", content_hash=None), sound(5, "S7", text=""), sound(5, "S8", text=None), sound(5, "S9", page_hash=sha("x")), sound(5, "S10", page_hash=None),
        sound(5, "S11", text="other", content_hash=sha("other")), sound(5, "S12", doc=None),
    ]
    assert failures(spark, items) == {
        (3, "S0", 0): "INVALID_MARKER", (3, "[S1]", 1): "INVALID_MARKER", (3, None, 2): "INVALID_MARKER", (4, "S1", 0): "DUPLICATE_MARKER", (4, "S1", 1): "DUPLICATE_MARKER",
        (5, "S1", 0): "PAGE_NOT_STORED", (5, "S2", 7): "CHUNK_NOT_STORED", (5, "S3", 0): "CONTENT_HASH_MISMATCH",
        (5, "S4", 0): "CONTENT_HASH_MISMATCH", (5, "S5", 0): "INVALID_CONTENT_HASH", (5, "S6", 0): "INVALID_CONTENT_HASH",
        (5, "S7", 0): "CHUNK_TEXT_MISSING,CONTENT_HASH_MISMATCH", (5, "S8", 0): "CHUNK_TEXT_MISSING", (5, "S9", 0): "PAGE_HASH_MISMATCH", (5, "S10", 0): "INVALID_PAGE_HASH",
        (5, "S11", 0): "CONTENT_HASH_MISMATCH", (5, "S12", 0): "PAGE_NOT_STORED",
    }


def test_sound_items_and_none(spark):
    assert failures(spark, [sound(q, f"S{m + 1}", d, m) for q in range(20) for m in range(3) for d in (1,)]) == {}
    assert failures(spark, []) == {}


def test_sums_tell_apart_what_cancels(spark):
    """Two wrong rows of one key do not make up for each other, and a repeated right one is right."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (2, "x"), (2, "x"), (3, "z")], "k int, v string")
    known = spark.createDataFrame([(1, "c"), (2, "x"), (4, "y")], "k int, v string")
    assert sorted(map(tuple, provenance.disagreeing(rows, known, ["k"], ["v"]).collect())) == [(1, True), (3, False)]
    assert provenance.disagreeing(rows.where(F.lit(False)), known, ["k"], ["v"]).count() == 0
