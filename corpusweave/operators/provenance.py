"""Context items against the chunks and pages they claim to come from, reconciled by summed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What a citation marker and a digest look like.
VALID_MARKER, DIGEST = r"^S[1-9]\d*$", r"^[0-9a-f]{64}$"


def _print(*columns: str) -> Column:
    """Fingerprints are summed as decimals, so neither their number nor their signs can make a sum overflow."""
    return F.xxhash64(*columns).cast("decimal(38,0)")


def disagreeing(items: DataFrame, sources: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of ``items`` whose rows are not all the one row that ``sources`` has for the key: ``key``, ``in_sources``.

    Both sides go through one aggregate that adds up, for each key, the items' fingerprints and how many they are, and the source's: a
    key agrees if the sum is that many times the source's fingerprint. A key that a large part of the items has is added up
    before it is shuffled, and no item meets a source row unless its key disagrees.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    one = items.select(*key, F.lit(1).alias("n"), _print(*columns).alias("sum"), F.lit(0).alias("known"), zero.alias("source"))
    two = sources.select(*key, F.lit(0).alias("n"), zero.alias("sum"), F.lit(1).alias("known"), _print(*columns).alias("source"))
    both = one.unionByName(two).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "known", "source")])
    agrees = (F.col("known") == 1) & (F.col("sum") == F.col("n") * F.col("source"))
    return both.where((F.col("n") > 0) & ~agrees).select(*key, (F.col("known") > 0).alias("in_sources"))


def context_failures(items: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``query_id, marker, doc_id, chunk_index, failures`` of every item that cannot be cited as it stands.

    ``items`` has ``query_id, marker, doc_id, chunk_index, text, content_hash, page_hash``, ``chunks`` ``doc_id, chunk_index,
    content_hash`` and ``pages`` ``doc_id, page_hash``, one row each. ``failures`` names all that is wrong, in the order of the alphabet:
    a marker of another form or one that an answer's context has twice, a page or chunk that is not stored, a digest of another form,
    one that the item's own text or the stored row does not have. Nothing is repaired.
    """
    items = items.select("query_id", "marker", "doc_id", "chunk_index", "text", "content_hash", "page_hash")
    twice = items.groupBy("query_id", "marker").agg(F.count("*").alias("n")).where("n > 1").select("query_id", "marker", F.lit(True).alias("twice"))
    bad_chunks = disagreeing(items, chunks, ["doc_id", "chunk_index"], ["content_hash"]).withColumnRenamed("in_sources", "chunk_known")
    bad_pages = disagreeing(items, pages, ["doc_id"], ["page_hash"]).withColumnRenamed("in_sources", "page_known")
    stored_chunks = chunks.join(bad_chunks.where("chunk_known"), ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", F.col("content_hash").alias("stored_content"))
    stored_pages = pages.join(bad_pages.where("page_known"), "doc_id").select("doc_id", F.col("page_hash").alias("stored_page"))
    judged = items.join(twice, ["query_id", "marker"], "left")
    judged = judged.join(bad_chunks, ["doc_id", "chunk_index"], "left").join(bad_pages, "doc_id", "left")
    judged = judged.join(stored_chunks, ["doc_id", "chunk_index"], "left").join(stored_pages, "doc_id", "left")
    digest = lambda c: F.coalesce(F.col(c).rlike(DIGEST), F.lit(False))
    other = lambda c, stored: F.col(stored).isNotNull() & (F.col(c) != F.col(stored))
    failures = {
        "CHUNK_NOT_STORED": (F.col("chunk_index").isNull() | F.coalesce(~F.col("chunk_known"), F.lit(False))) & F.col("doc_id").isNotNull() & F.coalesce("page_known", F.lit(True)),
        "CHUNK_TEXT_MISSING": F.coalesce(F.col("text") == "", F.lit(True)),
        "CONTENT_HASH_MISMATCH": digest("content_hash") & (other("content_hash", "stored_content") | F.coalesce(F.sha2("text", 256) != F.col("content_hash"), F.lit(False))),
        "DUPLICATE_MARKER": F.coalesce(F.col("twice"), F.lit(False)),
        "INVALID_CONTENT_HASH": ~digest("content_hash"),
        "INVALID_MARKER": ~F.coalesce(F.col("marker").rlike(VALID_MARKER), F.lit(False)),
        "INVALID_PAGE_HASH": ~digest("page_hash"),
        "PAGE_HASH_MISMATCH": digest("page_hash") & other("page_hash", "stored_page"),
        "PAGE_NOT_STORED": F.col("doc_id").isNull() | F.coalesce(~F.col("page_known"), F.lit(False)),
    }
    named = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in failures.items()]))
    found = judged.select("query_id", "marker", "doc_id", "chunk_index", named.alias("failures"))
    return found.where(F.size("failures") > 0).withColumn("failures", F.array_join("failures", ","))
