"""Mixing sources to target weights by a splitting tree of exact block quotas (query ``op3_mix_sources``)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusweave.llm.common import WORD, Scratch, map_rows, table

WEIGHTS, SHARE, MAX_REPEATS = (5, 2, 1), 1.5, 2
#: Words of a block, the unit that is drawn; words of a shard; rows of a stream's bucket; sources a mix may name.
BLOCK, SHARD_WORDS, BUCKET_ROWS, MAX_SOURCES = 64, 1 << 21, 20_000, 1_000_000
SEED = 11
WORD_AND_GAP = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def target_words(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MAX_REPEATS) -> np.ndarray:
    """Words to take of each source: ``share`` of all words by weight, at most ``most`` times a source's own.

    What sources at their limit leave over goes to the others by weight until none is above its limit.
    """
    limit, weights = most * np.asarray(sizes, float), np.asarray(weights, float)
    target, free = np.zeros(len(limit)), limit > 0
    left = share * float(np.sum(np.asarray(sizes, np.int64)))
    while free.any():
        offer = left * weights / weights[free].sum()
        full = free & (offer >= limit)
        if not full.any():
            target[free] = offer[free]
            break
        target[full] = limit[full]
        left -= float(limit[full].sum())
        free &= ~full
    return target


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of one output shard in every source.

    The tree halves the shards; at each node the left half's blocks are drawn from the node's exact quotas by a
    multivariate hypergeometric law, as if all blocks lay shuffled in one urn. A node's draw depends on its place
    only, so every shard walks from the root to itself on its own, and all shards together use every slot once.
    """
    first, own, low, high, node = np.zeros_like(quotas), quotas.copy(), 0, shards, 1
    while high - low > 1:
        middle = (low + high) // 2
        total = int(own.sum())
        left = multivariate_hypergeometric(np.random.default_rng([seed, node]), own, total * (middle - low) // (high - low))
        if shard < middle:
            own, high, node = left, middle, 2 * node
        else:
            first, own, low, node = first + left, own - left, middle, 2 * node + 1
    return first, own


def multivariate_hypergeometric(rng: np.random.Generator, quotas: np.ndarray, draws: int) -> np.ndarray:
    """Source by source; the generator's own method stops at a total of 10^9, above which halves are close to the mean."""
    taken, rest = np.zeros_like(quotas), int(quotas.sum())
    for s, q in enumerate(quotas.tolist()):
        rest -= q
        if draws and q:
            if q + rest < 1_000_000_000:
                taken[s] = rng.hypergeometric(q, rest, draws)
            else:
                p = draws / (q + rest)
                spread = (q * p * (1 - p) * (rest / (q + rest))) ** 0.5
                taken[s] = min(max(round(rng.normal(q * p, spread)), draws - rest, 0), q, draws)
            draws -= int(taken[s])
    return taken


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A fixed shuffle of 0..n-1 without a table: four mixing rounds on halves of the index, repeated until below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for step in range(4):
            mixed = (right + np.uint64((key * 4 + step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo &= out >= n
    return out.astype(np.int64)


def _ordered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with ``source_no`` and ``first_word``, sources): rows of a source laid end to end.

    Rows are dealt to buckets by hash, bucket sums are added up, and places are counted inside buckets, so
    a source that holds a third of all rows is spread over many tasks and the order depends on the rows only.
    """
    spark = rows.sparkSession
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    names = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "names")
    rows = rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    if (count := names.count()) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources, not {count}: group them first")
    # the bound just checked is what reaches the driver: a name and a number per source
    found = sorted(names.collect(), key=lambda r: (r.source is None, r.source or ""))
    target = target_words([r.source_size for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    sources = [(i, r.source, r.source_size, float(target[i])) for i, r in enumerate(found)]
    sources = spark.createDataFrame(sources, "source_no int, source string, source_size long, target double")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    keyed = sources.withColumnRenamed("source", "s").select("s", "source_no")
    starts = starts.join(keyed, starts.source.eqNullSafe(F.col("s"))).select("source", "bucket", "start", "source_no")
    starts = starts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    place = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(place), F.lit(0)))
    # every row has its bucket's start; a left join keeps the planner from broadcasting the rows, whose files are small
    placed = placed.join(starts, placed.source.eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    return placed.select("row_id", "size", "source_no", (F.col("start") + F.col("before")).alias("first_word")), sources


def draw(rows: DataFrame, scratch: Scratch, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(spans, sources) of a mix of ``rows``: ``row_id, doc_id, source, size``.

    ``spans`` has ``shard, place, row_id, copy, start, stop``: words start..stop-1 of the row stand at ``place`` of
    the shard. A source's words are cut into blocks; its target is a number of blocks, drawn without
    replacement from a first and then a second shuffle of all of them, so no word is taken more than twice
    and every source is within a block of its target. ``sources`` has ``source, source_size, target``.
    """
    placed, sources = _ordered(rows, scratch)
    placed = scratch.write(placed, "placed")
    plan = sources.orderBy("source_no").select("source_size", "target").collect()  # bounded by MAX_SOURCES
    sizes = np.array([r.source_size for r in plan], np.int64)
    blocks = -(-sizes // BLOCK)
    # a source's blocks are full but for the last; the words of a copy are spread evenly over its blocks
    quotas = np.array([min(round(r.target * b / max(r.source_size, 1)), MAX_REPEATS * b) for r, b in zip(plan, blocks.tolist())], np.int64)
    shards = max(1, -(-int(quotas.sum()) * BLOCK // SHARD_WORDS))

    def drawn(batches):
        for batch in batches:
            for shard in batch["id"].tolist():
                first, own = shard_quotas(quotas, shards, shard, seed)
                source = np.repeat(np.arange(len(own)), own)
                slot = np.repeat(first, own) + np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own)
                copy, block = slot // np.maximum(blocks[source], 1), np.empty(len(slot), np.int64)
                for s in np.unique(source).tolist():
                    for c in range(MAX_REPEATS):
                        at = (source == s) & (copy == c)
                        if at.any():
                            block[at] = permuted(slot[at] - c * blocks[s], int(blocks[s]), seed * 1_000_003 + 2 * s + c)
                place = np.random.default_rng([seed, 0, shard]).permutation(len(slot))
                yield pd.DataFrame({"shard": shard, "place": place, "source_no": source.astype(np.int32), "block": block, "copy": copy.astype(np.int32)})

    picks = rows.sparkSession.range(0, shards, 1, min(shards, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    picks = picks.mapInPandas(drawn, "shard long, place long, source_no int, block long, copy int")
    last = (F.col("first_word") + F.col("size") - 1) / BLOCK
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("first_word") / BLOCK), F.floor(last))).alias("block"))
    start = F.greatest(F.col("block") * BLOCK - F.col("first_word"), F.lit(0))
    stop = F.least((F.col("block") + 1) * BLOCK - F.col("first_word"), F.col("size"))
    cut = cut.select("row_id", "source_no", "block", start.alias("start"), stop.alias("stop"))
    # the planner takes the picks for as small as the list of shards, so it is told to merge and not to broadcast them
    return cut.join(picks.hint("merge"), ["source_no", "block"]).select("shard", "place", "row_id", "copy", "start", "stop"), sources


def sized(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, source, size``; ``row_id`` only tells rows apart."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.cast("long").alias("size"))


def mix_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id``, ``source``, ``text``).

    A missing source is a source of its own, the last. Missing, empty and blank texts have size 0 and nothing is taken
    of them; a source of such rows alone keeps its weight, and its target is 0. Rows that repeat each other are separate rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(sized(docs), "sizes")
    spans, sources = draw(rows, scratch)
    taken = spans.groupBy("row_id").agg(F.sum(F.col("stop") - F.col("start")).alias("words"))
    named = sources.withColumnRenamed("source", "s")
    return (
        rows.join(F.broadcast(named), rows.source.eqNullSafe(named.s), "left")
        .join(taken, "row_id", "left")
        .select(
            "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
            F.coalesce("words", F.lit(0)).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows like those of ``docs``, one for each time a document is (partly) taken.

    ``text`` has the taken words in their order with the white space that follows them, ``n_chars``, if there, its length;
    all other columns are the document's own. Documents of which nothing is taken are not in the mix.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row"))
    numbered = scratch.write(numbered, "rows")
    text, n_words = F.col("row.text"), F.regexp_count(F.col("row.text"), F.lit(WORD))
    size = F.when(text.isNull(), 0).otherwise(n_words).cast("long").alias("size")
    rows = numbered.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size)
    spans, _ = draw(scratch.write(rows, "sizes"), scratch)
    parts = spans.groupBy("row_id", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("parts"))
    taken = numbered.join(parts, "row_id").select("row", "copy", F.col("row.text").alias("text"), "parts")
    kind = taken.schema["row"].dataType.simpleString()

    def make(batch):
        texts = []
        for text, parts in zip(batch.column(1), batch.column(2)):
            found = WORD_AND_GAP.findall(text.as_py())
            texts.append("".join("".join(found[p["start"] : p["stop"]]) for p in parts.as_py()).rstrip(" \t\n\x0b\x0c\r"))
        return {"row": batch.column(0), "text": texts}

    out = map_rows(taken.select("row", "text", "parts"), make, f"row {kind}, text string")
    fields = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_counts(table(spark, folder, "documents"))
