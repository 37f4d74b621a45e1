"""Context assembly: a bounded list of ranked chunks per question becomes a marked, budgeted block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.operators.ordering import top_k

HIT = "struct<priority:bigint,rank:int,chunk_id:bigint,page:bigint,chunk_index:int,title:string,text:string>"


def select_chunks(hits: DataFrame, budget: int = rules.CONTEXT_BUDGET_TOKENS, most: int = rules.CONTEXT_MAX_CHUNKS, priority: str = "rank") -> DataFrame:
    """Walk each question's hits in priority order and decide every one of them.

    A hit is dropped as a duplicate (its text is contained in a chosen one), because enough chunks
    were chosen, or because it does not fit the token budget; later, smaller hits may still fit, so
    the decision depends on what was chosen before it and is a fold over the question's top-k list.
    Returns one row per hit with ``decision`` (``selected`` or the reason).
    """
    packed = hits.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(priority).cast("long").alias("priority"), F.col("rank").cast("int").alias("rank"), "chunk_id",
                    F.col("page").cast("long").alias("page"), F.col("chunk_index").cast("int").alias("chunk_index"),
                    "title", "text",
                )
            )
        ).alias("hits")
    )
    sized = packed.select(
        "query_id",
        F.transform(
            "hits",
            lambda h: F.struct(
                h.alias("hit"), T.token_estimate(h["text"]).alias("tokens"), T.squeeze(h["text"]).alias("norm")
            ),
        ).alias("hits"),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("texts"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("out")
    )

    def step(a: Column, h: Column) -> Column:
        n = F.size(a["texts"])
        why = (
            F.when(F.exists(a["texts"], lambda x: F.contains(x, h["norm"])), "duplicate")
            .when(n >= most, "max_chunks")
            .when((n > 0) & (a["used"] + h["tokens"] > budget), "budget")
            .otherwise("selected")
        )
        taken = why == "selected"
        return F.struct(
            F.when(taken, F.concat(a["texts"], F.array(h["norm"]))).otherwise(a["texts"]).alias("texts"),
            F.when(taken, a["used"] + h["tokens"]).otherwise(a["used"]).alias("used"),
            F.concat(a["out"], F.array(why)).alias("out"),
        )

    decided = bind(sized, decisions=F.aggregate("hits", start, step, lambda a: a["out"]))
    return decided.select(
        "query_id", F.inline(F.arrays_zip(F.col("hits").alias("h"), F.col("decisions").alias("decision")))
    ).select("query_id", "h.hit.*", "h.tokens", "decision").drop("priority")


def strip_overlap(text: Column, previous: Column) -> Column:
    """Drop leading lines that the previous chunk already ends with; the last line always stays."""
    lines = F.split(text, "\n")
    prior = T.squeeze(previous)
    head = F.slice(lines, 1, F.size(lines) - 1)
    repeated = F.transform(head, lambda x: (T.squeeze(x) != "") & F.contains(prior, T.squeeze(x)))
    stop = F.array_position(repeated, F.lit(False))
    cut = F.when(stop > 0, stop - 1).otherwise(F.size(head))
    return F.when(previous.isNull(), text).otherwise(
        F.array_join(F.slice(lines, (cut + 1).cast("int"), F.size(lines)), "\n")
    )


def context_items(decided: DataFrame) -> DataFrame:
    """Selected chunks in document order with markers ``S1..Sn`` and repeated lines removed."""
    order = Window.partitionBy("query_id").orderBy("page", "chunk_index")
    chosen = decided.filter(F.col("decision") == "selected")
    placed = chosen.select(
        "*",
        F.row_number().over(order).alias("position"),
        F.lag("page").over(order).alias("_page"), F.lag("chunk_index").over(order).alias("_index"),
        F.lag("text").over(order).alias("_text"),
    )
    adjacent = (F.col("_page") == F.col("page")) & (F.col("chunk_index") == F.col("_index") + 1)
    rendered = strip_overlap(F.col("text"), F.when(adjacent, F.col("_text")))
    bound = bind(placed, rendered_text=rendered)
    return bound.select(
        "query_id", F.concat(F.lit("S"), F.col("position").cast("string")).alias("marker"), "position", "chunk_id", "page",
        "chunk_index", "rank", "title", "text", "rendered_text", T.token_estimate(F.col("rendered_text")).alias("tokens"),
        (F.length("text") - F.length("rendered_text")).alias("overlap_removed"),
    )


def interleave(primary: DataFrame, aspect: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """Merge two ranked views of one question: ranks alternate, a chunk keeps its first appearance.

    The second view is re-ranked without the chunks of the first, so it keeps its own slots.
    """
    fresh = aspect.join(primary.select("query_id", key), ["query_id", key], "left_anti")
    fresh = top_k(fresh, ["query_id"], [F.col("rank")], limit, "_r").drop("rank").withColumnRenamed("_r", "rank")
    both = primary.select("query_id", key, "rank", F.lit(0).alias("view")).unionByName(
        fresh.select("query_id", key, "rank", F.lit(1).alias("view"))
    )
    return top_k(both.withColumnRenamed("rank", "view_rank"), ["query_id"], [F.col("view_rank"), F.col("view")], limit)


def promote(hits: DataFrame, supplies: Column) -> DataFrame:
    """Move the best hit that supplies the asked kind to rank one; the hits before it shift by one."""
    best = F.min(F.when(supplies, F.col("rank"))).over(Window.partitionBy("query_id"))
    moved = F.when(F.col("_b").isNull() | (F.col("rank") > F.col("_b")), F.col("rank")).when(
        F.col("rank") == F.col("_b"), 1
    ).otherwise(F.col("rank") + 1)
    return hits.withColumn("_b", best).withColumn("promoted_rank", moved).drop("_b")


def context_quality(items: DataFrame, has_evidence: Column) -> DataFrame:
    """Per question: share of chunks with evidence, word redundancy and total tokens."""
    words = F.filter(F.split(F.lower("rendered_text"), r"\s+"), lambda w: F.length(w) > 0)
    flagged = items.select("query_id", has_evidence.alias("flag"), "tokens", words.alias("w"))
    # At most ``max_chunks`` items per question, so the word lists of one question stay small.
    return flagged.groupBy("query_id").agg(
        F.max(F.col("flag").cast("int")).alias("evidence_in_context"),
        F.avg(F.col("flag").cast("int")).alias("precision"), F.sum("tokens").alias("context_tokens"),
        F.flatten(F.collect_list("w")).alias("w"),
    ).select(
        "query_id", "evidence_in_context", F.round("precision", 4).alias("context_precision"), "context_tokens",
        F.when(F.size("w") > 0, F.round(1 - F.size(F.array_distinct("w")) / F.size("w"), 4)).otherwise(0.0).alias("redundancy"),
    )
