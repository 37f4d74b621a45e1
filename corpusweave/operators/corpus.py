"""Corpus build: cleaning, content hashes, de-duplication, fingerprints, validation and audits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.unicode import compat_fold
from corpusweave.operators.ordering import percentiles, value_ranks

STATUS_OK, STATUS_DUPLICATE, STATUS_EMPTY = "OK", "DUPLICATE_CONTENT", "EMPTY_CONTENT"


# ---------------------------------------------------------------- cleaning
_COUNTERS = (
    "title_duplicates_removed", "duplicate_lines_removed", "fragments_joined", "lines_in", "lines_out"
)
CLEAN_SCHEMA = StructType(
    [StructField("clean_text", StringType()), StructField("dropped_text", StringType())]
    + [StructField(name, IntegerType()) for name in _COUNTERS]
)
_TO_PLAIN = str.maketrans({**dict.fromkeys(rules.INVISIBLE_CHARS), **dict.fromkeys(rules.SPACE_CHARS, " ")})
_NEWLINE, _BLANKS = re.compile("\r\n?"), re.compile("[ \t]+")
_TAIL = re.compile(r"\W+$")


def _continues(head: str, line: str) -> bool:
    """Whether ``line`` is the rest of the sentence that ``head`` started."""
    if head.lower() in _LABELS or line.lower() in _LABELS:
        return False
    if line[0] in rules.NO_SPACE_BEFORE or line[0].islower() or head[-1] in "([" or head.count("(") > head.count(")"):
        return True
    dangling = _TAIL.sub("", head.rsplit(" ", 1)[-1]).lower() in _FUNCTION_WORDS
    return dangling and head[-1] not in ".!?:;"


_LABELS, _FUNCTION_WORDS = frozenset(rules.SECTION_LABELS), frozenset(rules.FUNCTION_WORDS)


def _clean_one(raw: str, title: str) -> tuple:
    text = _NEWLINE.sub("\n", unicodedata.normalize("NFC", raw)).translate(_TO_PLAIN)
    lines = [x for x in (_BLANKS.sub(" ", part).strip() for part in text.split("\n")) if x]
    kept, dropped, title_drops = [], [], 0
    for position, (line, copies) in enumerate(groupby(lines)):
        n = sum(1 for _ in copies)
        heads_page = position == 0 and (not title or line == title)
        keep = 1 if heads_page or len(line) >= rules.MIN_DUPLICATE_LINE else n
        kept += [line] * keep
        dropped += [line] * (n - keep)
        title_drops += n - keep if heads_page else 0
    whole: list[str] = []
    for line in kept:
        # The first line is the page title and never takes a continuation.
        if len(whole) > 1 and _continues(whole[-1], line):
            glue = "" if line[0] in rules.NO_SPACE_BEFORE or whole[-1][-1] in "([" else " "
            whole[-1] += glue + line
        else:
            whole.append(line)
    return (
        "\n".join(whole), "\n".join(dropped), title_drops, len(dropped) - title_drops, len(kept) - len(whole),
        len(lines), len(whole),
    )


@F.pandas_udf(CLEAN_SCHEMA)
def _clean(text: pd.Series, title: pd.Series) -> pd.DataFrame:
    rows = [_clean_one(a or "", (b or "").strip()) for a, b in zip(text, title)]
    return pd.DataFrame(rows, columns=CLEAN_SCHEMA.names)


def clean_documents(docs: DataFrame, text: str = "text", title: str | None = None) -> DataFrame:
    """Add ``clean_text``, ``dropped_text`` and counters of what the cleaner did.

    Unicode composition needs Python anyway, and joining fragments is a fold over lines, so the whole
    step is one Arrow-batched call per text instead of several nested array expressions.
    """
    heading = F.col(title) if title else F.lit("")
    return docs.withColumn("_clean", _clean(F.col(text), heading)).select(*docs.columns, "_clean.*")


def _sorted_letters(text: Column) -> Column:
    return F.sort_array(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), ""))


def faithful(raw: Column, clean: Column, dropped: Column) -> Column:
    """Letters and digits of the cleaned text are those of the raw text minus the dropped lines."""
    return F.array_join(_sorted_letters(raw), "") == F.array_join(
        _sorted_letters(F.concat(clean, F.coalesce(dropped, F.lit("")))), ""
    )


# ---------------------------------------------------------------- identity and duplicates
def content_hash(text: Column) -> Column:
    """SHA-256 of the white-space, case and compatibility insensitive form."""
    bare = F.translate(compat_fold(F.coalesce(text, F.lit(""))), rules.INVISIBLE_CHARS, "")
    return F.sha2(T.squeeze(bare), 256)


def document_key(guide: Column, page: Column) -> Column:
    return F.concat(F.lower(guide), F.lit("/"), F.lower(page))


def mark_duplicates(docs: DataFrame, doc_id: str, hash_col: str, empty: Column, priority: Sequence[Column]) -> DataFrame:
    """Add ``canonical_id``, ``duplicate_of`` and ``status``.

    The canonical document of a hash is the smallest by ``priority`` then id. It comes from a
    partially aggregated minimum, so a hash shared by a third of the corpus reaches one row before
    the shuffle, and the join back has one row per hash on its build side.
    """
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], F.col(doc_id).alias("id"))
    canonical = (
        docs.filter(~empty)
        .groupBy(hash_col)
        .agg(F.min(order).alias("_best"))
        .select(hash_col, F.col("_best.id").alias("canonical_id"))
    )
    joined = docs.withColumn("_empty", empty).join(canonical, hash_col, "left")
    is_dup = ~F.col("_empty") & (F.col("canonical_id") != F.col(doc_id))
    return (
        joined.withColumn("canonical_id", F.when(F.col("_empty"), F.col(doc_id)).otherwise(F.col("canonical_id")))
        .withColumn("duplicate_of", F.when(is_dup, F.col("canonical_id")))
        .withColumn(
            "status",
            F.when(F.col("_empty"), STATUS_EMPTY).when(is_dup, STATUS_DUPLICATE).otherwise(STATUS_OK),
        )
        .drop("_empty")
    )


def inherit_topic_refs(refs: DataFrame, marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Topic references of every canonical document, its own and those of its duplicates.

    The result stays one row per reference: nesting them would collect an unbounded group of copies
    into one row. ``via_doc_id`` names the duplicate a reference came from.
    """
    link = marked.select(doc_id, "canonical_id", "duplicate_of")
    moved = refs.join(link, doc_id)
    return moved.select(
        F.col("canonical_id").alias(doc_id),
        "topic_id",
        "role",
        F.when(F.col("duplicate_of").isNotNull(), F.col(doc_id)).alias("via_doc_id"),
    ).distinct()


def primary_topic(refs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Direct before inherited, topic page before descendant, then the lowest id."""
    rank = F.struct(
        F.col("via_doc_id").isNotNull().alias("inherited"),
        (F.col("role") != "topic_page").alias("descendant"),
        F.col("topic_id").alias("topic_id"),
    )
    return refs.groupBy(doc_id).agg(F.min(rank).alias("_r"), F.countDistinct("topic_id").alias("topics")).select(
        doc_id, F.col("_r.topic_id").alias("primary_topic"), "topics"
    )


# ---------------------------------------------------------------- fingerprints
def ordered_fingerprint(chunks: Column) -> Column:
    """SHA-1 of one document's chunk texts in order (the chunks are an array of that document)."""
    return F.sha1(F.array_join(chunks, "\n").cast("binary"))


def sharded_fingerprint(rows: DataFrame, key: Column, digest: Column, by: Sequence[str] = ()) -> DataFrame:
    """Fingerprint of a set of ``(key, digest)`` rows of any size.

    Rows are sharded by the leading hex digits of the key's hash and rolled up twice, so no task
    joins more than one shard of digests; equal sets have equal fingerprints and order is irrelevant.
    """
    by = list(by)
    lines = rows.select(
        *by,
        F.sha2(key.cast("string"), 256).alias("_h"),
        F.concat_ws(" ", key.cast("string"), digest).alias("_line"),
    )

    def roll(df: DataFrame, digits: int) -> DataFrame:
        keyed = df.withColumn("_p", F.substring("_h", 1, digits))
        return keyed.groupBy(*by, "_p").agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("_line")), "\n"), 256).alias("_d")
        ).select(*by, F.col("_p").alias("_h"), F.concat_ws(" ", "_p", "_d").alias("_line"))

    level = roll(roll(lines, 6), 3)
    return level.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_line")), "\n"), 256).alias("fingerprint"))


# ---------------------------------------------------------------- validation and statistics
def validation_errors(required: Sequence[str], nullable: Sequence[str] = (), may_be_empty: Sequence[str] = ("text",)) -> Column:
    """Array of messages for null or empty required columns."""
    checks = []
    for name in required:
        if name in nullable:
            continue
        checks.append(F.when(F.col(name).isNull(), F.lit(f"{name} is null")))
        if name not in may_be_empty:
            checks.append(F.when(F.col(name).cast("string") == "", F.lit(f"{name} is empty")))
    return F.array_compact(F.array(*checks))


def length_statistics(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, total, mean (1 decimal), exact median, minimum and maximum per group."""
    ranks = value_ranks(df, length, {"n": F.lit(1), "s": F.col(length)}, by)
    middle = percentiles(ranks, {"median": ("linear", 0.5)}, by)
    rest = ranks.groupBy(*by).agg(
        F.sum("s").alias("total"),
        F.round(F.sum("s") / F.sum("n"), 1).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return rest.join(middle.withColumnRenamed("n", "count"), list(by)) if by else rest.crossJoin(
        F.broadcast(middle.withColumnRenamed("n", "count"))
    )
