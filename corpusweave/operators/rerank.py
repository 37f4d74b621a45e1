"""Reranking of a bounded candidate pool (at most a few dozen rows per question)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.vectors import dot
from corpusweave.operators.lexical import text_vectors
from corpusweave.operators.segment import packed_chunks


def lexical_scores(rows: DataFrame, question: str, title: str, body: str, distance: str) -> DataFrame:
    """Weighted sum of ``1 - squared distance``, title-term share and body-term share."""
    asked = T.query_terms(F.col(question))

    def share(text: str) -> Column:
        words = F.split(T.normalize_text(F.coalesce(F.col(text), F.lit(""))), " ")
        return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words)) / F.size(asked))

    semantic, w = F.greatest(F.lit(0.0), 1.0 - F.col(distance)), rules.LEXICAL_RERANK_WEIGHTS
    return rows.withColumn("final_score", w[0] * semantic + w[1] * share(title) + w[2] * share(body))


def one_per_source(rows: DataFrame, query: str, source: str, url: str, k: int) -> DataFrame:
    """First row per source in (rounded score, shortest url, url) order, then the best ``k``."""
    order = [F.desc(F.round("final_score", 5)), F.length(url), F.col(url)]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(query, source).orderBy(*order))).filter("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).drop("_n")


def page_similarity(pool: DataFrame, query_vectors: DataFrame, docs: DataFrame, digits: int = 4) -> DataFrame:
    """Best chunk similarity of every pooled page for the question that pooled it.

    Only pooled pages are chunked and embedded; the vectors meet in an equi join on the pool.
    """
    wanted = docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = packed_chunks(wanted).select(
        F.struct("doc_id", "chunk_index").alias("chunk"), F.col("chunk_text").alias("text")
    )
    vectors = text_vectors(chunks, "chunk").select("chunk.doc_id", F.col("embedding").alias("chunk_vector"))
    pairs = pool.select("query_id", "doc_id").join(query_vectors, "query_id").join(vectors, "doc_id")
    scored = pairs.select("query_id", "doc_id", F.round(dot(F.col("embedding"), F.col("chunk_vector")), 6).alias("s"))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.max("s"), digits).alias("page_similarity"))


def evidence_scores(
    rows: DataFrame,
    generic_terms: Sequence[str] = (),
    frame_terms: Sequence[str] = (),
    unrequested: Sequence[tuple[str, float]] = (),
    digits: int = 4,
    coverage_digits: int | None = 4,
) -> DataFrame:
    """Multi-signal score and rank of each question's pool.

    Needs ``question, title, text, card_similarity, page_similarity, phrase_match, tech_regime,
    ingested, resolved, initial_rank``. Weights switch to the technical regime per question, so one
    question's candidates share a scale. ``unrequested`` lists (word, penalty): a title word that the
    question does not mention costs the penalty.
    """
    asked, titled = T.term_set(F.col("question")), T.term_set(F.col("title"))
    regime = F.coalesce("tech_regime", F.lit(False))
    w_card = F.when(regime, rules.W_CARD_TECH).otherwise(rules.W_CARD)
    tech = F.greatest(F.coalesce("phrase_match", F.lit(0.0)), F.coalesce(*([F.col("code_match")] if "code_match" in rows.columns else []), F.lit(0.0)))
    coverage = T.coverage(asked, T.terms(F.col("text")))
    if coverage_digits is not None:
        coverage = F.round(coverage, coverage_digits)
    shared = F.size(F.array_intersect(asked, titled))
    both = (F.size(titled) > 0) & (F.size(asked) > 0)
    domain_title = F.array_except(titled, T.array_of(generic_terms) if generic_terms else F.array().cast("array<string>"))
    skip = tuple(generic_terms) + tuple(frame_terms)
    domain_asked = F.array_except(asked, T.array_of(skip) if skip else F.array().cast("array<string>"))
    domain_shared = F.size(F.array_intersect(domain_title, domain_asked))
    score = (
        w_card * F.col("card_similarity")
        + rules.W_PAGE * F.coalesce("page_similarity", F.lit(0.0))
        + rules.W_COVERAGE * coverage
        + F.when(regime, rules.W_TECH * tech).otherwise(0.0)
        + F.when(both, rules.TITLE_BOOST * shared / F.size(titled)).otherwise(0.0)
        + F.when(
            (F.size(domain_title) > 0) & (F.size(domain_asked) > 0),
            rules.DOMAIN_BOOST * domain_shared / F.size(domain_asked),
        ).otherwise(0.0)
    )
    for word, penalty in unrequested:
        absent = F.contains(F.lower("title"), F.lit(word)) & ~F.contains(F.lower("question"), F.lit(word))
        score = score - F.when(absent, penalty).otherwise(0.0)
    fallback = w_card * F.col("card_similarity") - F.when(
        F.col("resolved"), rules.NOT_INGESTED_PENALTY
    ).otherwise(rules.UNRESOLVED_PENALTY)
    final = F.round(F.when(F.col("ingested"), score).otherwise(fallback), digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("card_similarity"), F.col("initial_rank"))
    return rows.withColumn("final_score", final).withColumn("rank", F.row_number().over(order))
