"""Card to page joins, the identity decision ladder, corrections and page admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_cards(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per card: unresolved, URL only, or resolved to a usable local page, with the reason.

    ``cards``: source_id, url, guide_id, page_id (NULL when the URL cannot be parsed).
    ``pages``: guide_id, page_id, usable.
    """
    joined = cards.join(pages.select("guide_id", "page_id", "usable"), ["guide_id", "page_id"], "left")
    reason = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "NO_SOURCE_URL")
        .when(F.col("guide_id").isNull() | F.col("page_id").isNull(), "URL_NOT_PARSEABLE")
        .when(F.col("usable").isNull(), "NO_LOCAL_PAGE")
        .when(~F.col("usable"), "PAGE_NOT_USABLE")
    )
    state = (
        F.when(reason.isNull(), "resolved_page").when(reason.isin("NO_LOCAL_PAGE", "PAGE_NOT_USABLE"), "url_only").otherwise("unresolved")
    )
    return joined.select("source_id", "guide_id", "page_id", state.alias("state"), reason.alias("reason"))


def apply_corrections(topics: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched topics, rejected corrections with their errors).

    ``corrections``: topic_id, card_guide_id, resolved_guide_id, evidence_ok. Only the first correction
    of a topic counts; a correction must match the card, change the guide and carry evidence.
    """
    first = corrections.groupBy("topic_id").agg(
        F.min(F.struct("position", "card_guide_id", "resolved_guide_id", "evidence_ok")).alias("c"), F.count("*").alias("n")
    ).select("topic_id", "c.*", "n")
    joined = first.join(topics.select("topic_id", "guide_id"), "topic_id", "left")
    errors = F.array_compact(
        F.array(
            F.when(F.col("guide_id").isNull(), "unknown topic"),
            F.when(F.col("guide_id") != F.col("card_guide_id"), "card ids do not match the topic"),
            F.when(F.col("card_guide_id") == F.col("resolved_guide_id"), "nothing to correct"),
            F.when(~F.col("evidence_ok"), "no evidence records"),
        )
    )
    judged = joined.withColumn("errors", errors)
    accepted = judged.filter(F.size("errors") == 0).select("topic_id", "resolved_guide_id")
    patched = topics.join(accepted, "topic_id", "left").select(
        "topic_id", F.coalesce("resolved_guide_id", "guide_id").alias("guide_id"),
        F.col("resolved_guide_id").isNotNull().alias("corrected"),
    )
    rejected = judged.filter(F.size("errors") > 0).select("topic_id", F.array_join("errors", "; ").alias("errors"))
    repeats = judged.filter("n > 1").select("topic_id", F.lit("duplicate correction for this topic").alias("errors"))
    return patched, rejected.unionByName(repeats)


def identity_ladder(cards: DataFrame, toc: DataFrame, verified: DataFrame, corrections: DataFrame, seen_elsewhere: DataFrame) -> DataFrame:
    """Decide which page a card stands for.

    Order: an accepted correction, then a verified guide whose contents list the page, then a
    conflict when the page was only seen under another guide, then the card's word alone. A page seen
    under several guides is still one row for each card.
    """
    seen = seen_elsewhere.groupBy("page_id").agg(F.min("other_guide").alias("first_guide"), F.max("other_guide").alias("last_guide"))
    rows = (
        cards.join(verified.select("guide_id", F.lit(True).alias("verified")), "guide_id", "left")
        .join(toc.select("guide_id", "page_id", F.lit(True).alias("in_toc")), ["guide_id", "page_id"], "left")
        .join(corrections.select("source_id", "resolved_guide_id"), "source_id", "left")
        .join(seen, "page_id", "left")
    )
    target = toc.select(F.col("guide_id").alias("resolved_guide_id"), "page_id", F.lit(True).alias("target_in_toc"))
    rows = rows.join(target, ["resolved_guide_id", "page_id"], "left")
    foreign = F.coalesce((F.col("first_guide") != F.col("guide_id")) | (F.col("last_guide") != F.col("guide_id")), F.lit(False))
    verified_guide, in_toc = F.coalesce("verified", F.lit(False)), F.coalesce("in_toc", F.lit(False))
    status = (
        F.when(F.col("guide_id").isNull() | F.col("page_id").isNull(), "unresolved")
        .when(F.col("resolved_guide_id").isNotNull() & F.coalesce("target_in_toc", F.lit(False)), "corrected_identity")
        .when(F.col("resolved_guide_id").isNotNull(), "conflicting_identity")
        .when(verified_guide & in_toc, "identified")
        .when(verified_guide & foreign, "conflicting_identity")
        .when(verified_guide, "unresolved")
        .when(foreign, "conflicting_identity")
        .otherwise("card_identity_only")
    )
    effective = F.when(status == "corrected_identity", F.col("resolved_guide_id")).when(status == "identified", F.col("guide_id"))
    return rows.select("source_id", "guide_id", "page_id", status.alias("status"), effective.alias("effective_guide_id"))


def admit(identities: DataFrame, pages: DataFrame) -> DataFrame:
    """Corpus status of every card: ingested, rejected, not ingested, or excluded by its identity."""
    local = pages.select(F.col("guide_id").alias("effective_guide_id"), "page_id", "usable")
    joined = identities.join(local, ["effective_guide_id", "page_id"], "left")
    status = (
        F.when(F.col("status") == "conflicting_identity", "excluded_conflict")
        .when(F.col("status") == "card_identity_only", "excluded_identity_only")
        .when(F.col("status") == "unresolved", "excluded_unresolved")
        .when(F.col("usable").isNull(), "not_ingested")
        .when(F.col("usable"), "ingested")
        .otherwise("rejected")
    )
    return joined.select("source_id", "status", status.alias("corpus_status"))


def integrity_problems(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full outer comparison of stored pages with the admission manifest.

    ``records``: doc_id, digest; ``manifest``: doc_id, expected_digest.
    """
    joined = records.join(manifest, "doc_id", "full")
    problem = (
        F.when(F.col("expected_digest").isNull(), "unadmitted page")
        .when(F.col("digest").isNull(), "missing admitted page")
        .when(F.col("digest") != F.col("expected_digest"), "text digest mismatch")
    )
    return joined.select("doc_id", problem.alias("problem")).filter("problem is not null")
