"""Near-duplicate documents by 64-bit fingerprints of their three-word shingles (query ``op1_simhash``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusweave.llm.common import Scratch, map_rows, words_of
from corpusweave.llm.components import connected_components

SHINGLE, SEED = 3, 42
#: Groups of up to this many fingerprints under one key are compared pair by pair, larger ones by finer keys. Both are exact.
PAIRWISE = 48
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; no words give zero."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, length = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    begins, ends = (ends - length)[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(begins), BLOCK):
        part = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[k : k + BLOCK], ends[k : k + BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array(fps)}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text"))
    return map_rows(rows, make, "doc_id long, text_hash long, fp long")


def _index(nodes: DataFrame) -> DataFrame:
    """Keys of every fingerprint: each half as it is, and the upper half with one bit left out, for every bit.

    Two fingerprints that differ in at most two bits either agree in a half, or differ in exactly one
    bit of each; then their upper halves agree once that bit is left out. ``bit`` is the bit left out.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    whole = F.lit(2)
    keys = [F.struct(high.alias("key"), whole.alias("bit")), F.struct((low + (1 << 32)).alias("key"), whole.alias("bit"))]
    for p in range(32):
        rest = high.bitwiseAND(0xFFFFFFFF ^ (1 << p)) + ((2 + p) << 32)
        keys.append(F.struct(rest.alias("key"), F.shiftright(high, p).bitwiseAND(1).cast("int").alias("bit")))
    return nodes.select("fp", F.inline(F.array(*keys)))


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints ``fp`` at two or fewer differing bits.

    Keys that one fingerprint has alone, or whose left-out bit is the same throughout, are dropped
    before anything is paired. In groups of up to ``PAIRWISE`` members every pair is verified. A larger
    group is cut by leaving out the remaining one or two bits as well: what then shares a key lies
    within two bits of each other, is at most four fingerprints, and is linked to its smallest member,
    so the rows grow with the group and not with its square.
    """
    index = _index(nodes)
    groups = index.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    groups = groups.where("n > 1 and (key < 8589934592 or (ones > 0 and ones < n))").select("key", "n")
    # The planner takes the keys for hardly larger than the fingerprints they were made of, so it is told to merge and not to
    # broadcast them; the members' files are packed, so the same holds where the members meet each other.
    members = scratch.write(index.hint("merge").join(groups, "key"), "members")
    few = members.where(F.col("n") <= PAIRWISE).select("key", "bit", "fp")
    other = few.select("key", F.col("bit").alias("bit_b"), F.col("fp").alias("b"))
    near = few.hint("merge").join(other, "key").where("((bit = 2 and fp < b) or bit < bit_b) and bit_count(fp ^ b) <= 2")
    pairs = near.select(F.col("fp").alias("a"), "b")

    many = members.where(F.col("n") > PAIRWISE)
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    half = F.when(F.col("key") < (1 << 32), low).otherwise(high)
    two = F.array(*[F.lit((1 << p) | (1 << q)) for p in range(32) for q in range(p)])
    one = F.array(*[F.lit(1 << p) for p in range(32)])
    exact = many.where("bit = 2").select("key", "fp", half.alias("half"), F.explode(two).alias("mask"))
    apart = many.where("bit < 2").select("key", "fp", low.alias("half"), F.explode(one).alias("mask"))
    finer = exact.unionByName(apart).withColumn("half", F.expr("half & ~mask"))
    close = finer.groupBy("key", "mask", "half").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = close.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows with the same fingerprint are one node, so copies cost one row each and no links. Missing and
    empty texts have fingerprint zero, which links like any other. A missing doc_id is never the
    smallest one; a component of such rows alone has no id. Repeated rows stay repeated.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = scratch.write(links(nodes.select("fp"), scratch).distinct(), "links")
    roots = connected_components(edges, scratch).withColumnRenamed("node", "fp")
    scratch.drop(edges)
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.write(named, "roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id``."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Ties (rows repeated under one doc_id) are broken by the text's hash and then by the other columns,
    a row without doc_id stays only where its group has no other. All columns are kept as they are.
    """
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    best = classes(docs).groupBy("root").agg(F.min(order).alias("best")).select("best.*")
    same = F.xxhash64("text").alias("text_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), same, F.struct("*").alias("row"))
    stay = rows.join(best, F.col("id").eqNullSafe(best.doc_id) & (rows.text_hash == best.text_hash), "left_semi")
    tie = F.to_json(F.col("row").dropFields("text")) if len(docs.columns) > 1 else F.lit("")
    return stay.groupBy("id", "text_hash").agg(F.min_by("row", tie).alias("row")).select("row.*")
