"""Structural audits of a chunked corpus."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave import rules


def _dense(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def offset_audit(chunks: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document: characters lost or introduced, gaps, overlaps and text that is not its slice.

    The chunks of one document are gathered in one row: they are a partition of that row's own text,
    so the row never outgrows the document it came from.
    """
    parts = chunks.groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct("char_start", "char_end", "chunk_text"))).alias("parts")
    )
    rows = docs.select(doc_id, F.col(text).alias("_t")).join(parts, doc_id)
    gaps = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("pos"), F.lit(0).alias("overlaps"), F.lit(0).alias("gap")),
        lambda a, p: F.struct(
            F.greatest(a["pos"], p["char_end"]).alias("pos"),
            (a["overlaps"] + (p["char_start"] < a["pos"]).cast("int")).alias("overlaps"),
            (
                a["gap"]
                + F.when(
                    p["char_start"] > a["pos"],
                    F.length(_dense(F.substring(F.col("_t"), a["pos"] + 1, p["char_start"] - a["pos"]))),
                ).otherwise(0)
            ).alias("gap"),
        ),
    )
    wrong = F.filter(
        "parts",
        lambda p: F.substring(F.col("_t"), p["char_start"] + 1, p["char_end"] - p["char_start"]) != p["chunk_text"],
    )
    measured = rows.select(
        doc_id,
        _dense(F.col("_t")).alias("src"),
        _dense(F.array_join(F.transform("parts", lambda p: p["chunk_text"]), "")).alias("got"),
        F.explode(F.array(gaps)).alias("g"),
        F.size(wrong).alias("slice_mismatches"),
    )
    return measured.select(
        doc_id,
        F.length("src").alias("source_chars"),
        F.when(F.col("src") == F.col("got"), 0).otherwise(
            F.greatest(F.lit(0), F.length("src") - F.length("got"))
        ).alias("lost_chars"),
        F.when(F.col("src") == F.col("got"), 0).otherwise(
            F.greatest(F.lit(0), F.length("got") - F.length("src"))
        ).alias("introduced_chars"),
        F.col("g.overlaps").alias("offset_overlaps"),
        F.col("g.gap").alias("gap_characters"),
        "slice_mismatches",
    )


def longest_repeat(prev: str, cur: str, least: int) -> int:
    """Longest suffix of ``prev`` (at least ``least`` characters) that ``cur`` starts with, else 0.

    The first characters of ``cur`` are looked for in ``prev``. Texts that hold them over and over get the border table
    of the prefix instead, so the time is in proportion to the lengths, not to their product.
    """
    most = min(len(prev), len(cur))
    if most < least:
        return 0
    tail, head, at = prev[len(prev) - most :], cur[:least], -1
    for _ in range(64):
        at = tail.find(head, at + 1)
        if at < 0:
            return 0
        if cur.startswith(tail[at:]):
            return most - at
    border, k = [0] * most, 0
    for i in range(1, most):
        while k and cur[i] != cur[k]:
            k = border[k - 1]
        k += cur[i] == cur[k]
        border[i] = k
    k = 0
    for c in tail:
        if k == most:
            k = border[k - 1]
        while k and c != cur[k]:
            k = border[k - 1]
        k += c == cur[k]
    return k if k >= least else 0


def overlap_repeat(prev: Column, cur: Column, least: int) -> Column:
    """``longest_repeat`` of two columns; null where one is null."""

    @F.pandas_udf("int")
    def repeats(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [None if a is None or b is None else longest_repeat(a, b, least) for a, b in zip(left, right)]
        return pd.Series(found, dtype="Int32")

    return repeats(prev, cur)


def adjacent_repeats(chunk_arrays: DataFrame, doc_id: str, chunks: str, least: int = rules.MIN_ADJACENT_REPEAT) -> DataFrame:
    """Repeated text between neighbouring chunks of the same document (its chunk array is one row)."""
    pairs = chunk_arrays.filter(F.size(chunks) > 1).select(
        doc_id,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(chunks) - 1),
                lambda i: F.struct(F.get(F.col(chunks), i - 1).alias("prev"), F.get(F.col(chunks), i).alias("cur")),
            )
        ).alias("p"),
    )
    scored = pairs.select(doc_id, overlap_repeat(F.col("p.prev"), F.col("p.cur"), least).alias("r"))
    return scored.groupBy(doc_id).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("r") > 0).alias("adjacent_repeats"), F.max("r").alias("max_repeat")
    )


def cross_source_duplicates(chunks: DataFrame, source: str, text: str) -> DataFrame:
    """Identical chunk texts under several sources.

    Grouping by (digest, source) first leaves one row per source and text, so a text copied into a
    third of all chunks is already reduced when the digests meet.
    """
    per_source = chunks.groupBy(F.sha2(text, 256).alias("digest"), source).agg(
        F.count("*").alias("n"), F.max(F.length(text)).alias("chars")
    )
    per_text = per_source.groupBy("digest").agg(
        F.sum("n").alias("n"), F.count("*").alias("sources"), F.max("chars").alias("chars")
    )
    shared = F.col("sources") > 1
    return per_text.agg(
        F.count_if(shared).alias("cross_source_groups"),
        F.sum(F.when(shared, F.col("n")).otherwise(0)).alias("cross_source_chunks"),
        F.sum(F.when(shared, F.col("n") * F.col("chars")).otherwise(0)).alias("cross_source_chars"),
        F.sum("n").alias("chunks"),
        F.sum(F.col("n") - 1).alias("duplicate_chunks"),
    )


def interval_union(spans: DataFrame, key: Sequence[str], start: str, end: str, width: float) -> DataFrame:
    """Covered length of possibly overlapping spans per key.

    Equal starts are merged first (only the furthest end matters), then the running maximum of the
    ends is computed per segment of ``width`` and carried across segments.
    """
    key = list(key)
    merged = spans.groupBy(*key, start).agg(
        F.max(end).alias("_e"), F.count("*").alias("_n"), F.sum(F.col(end) - F.col(start)).alias("_len")
    )
    seg = merged.withColumn("_seg", F.floor(F.col(start) / F.lit(width)))
    before = Window.partitionBy(*key, "_seg").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    reach = seg.groupBy(*key, "_seg").agg(F.max("_e").alias("_top")).withColumn("_carried", F.max("_top").over(across))
    joined = seg.withColumn("_near", F.max("_e").over(before)).join(reach.drop("_top"), [*key, "_seg"])
    seen = F.greatest(F.col(start), F.coalesce(F.greatest("_near", "_carried"), F.col(start)))
    return joined.groupBy(*key).agg(
        F.sum("_n").alias("intervals"),
        F.sum(F.greatest(F.lit(0), F.col("_e") - seen)).alias("covered_us"),
        F.sum("_len").alias("total_us"),
    )
