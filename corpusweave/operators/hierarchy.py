"""Guide trees: descendants, plan folding and topic resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpusweave.session import materialise


def toc_nodes(responses: DataFrame, guide: str, toc: str) -> DataFrame:
    """Flatten nested table-of-contents arrays (``t`` title, ``u`` file, ``c`` children) level by level.

    A heading without a file adds to the path and depth of what is below it but is not a node.
    ``order`` is the list of positions from the root, which sorts in document order.
    """
    frontier = responses.select(
        guide, F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("path"),
        F.array().cast("array<int>").alias("order"), F.lit(0).alias("depth"), F.posexplode(toc).alias("pos", "node"),
    )
    found = []
    while True:  # as deep as the column's type goes
        title = F.coalesce("node.t", F.lit(""))
        here = frontier.select(
            guide, "parent", F.concat("path", F.array(title)).alias("path"), F.concat("order", F.array("pos")).alias("order"),
            "depth", title.alias("title"), F.coalesce("node.u", F.lit("")).alias("file_path"), F.col("node.c").alias("children")
            if "c" in frontier.schema["node"].dataType.names else F.lit(None).alias("children"),
        )
        found.append(here.drop("children"))
        if "c" not in frontier.schema["node"].dataType.names:
            break
        frontier = here.select(
            guide, F.when(F.col("file_path") == "", F.col("parent")).otherwise(F.col("file_path")).alias("parent"), "path",
            "order", (F.col("depth") + 1).alias("depth"), F.posexplode("children").alias("pos", "node"),
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    # Page id and alias suffix of ``<id>[-NN].html``.
    return out.filter("file_path <> ''").select(
        "*", F.lower(F.regexp_extract("file_path", r"^([^.]+?)(-\d+)?\.html$", 1)).alias("page_id"),
        F.regexp_extract("file_path", r"^([^.]+?)(-\d+)?\.html$", 2).alias("alias"),
    )


def descendants(edges: DataFrame, max_depth: int | None = None, limit: int = 64) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a parent-child table, with the path of names.

    One join per level: the frontier of each round joins the edges on the child, and ends as soon as a
    round adds nothing. Rounds are written to the checkpoint folder, so the plan does not grow.
    """
    edges = edges.select("parent", "child", "name")
    frontier = edges.select(F.col("parent").alias("ancestor"), "child", F.lit(1).alias("distance"), F.col("name").alias("path"))
    rounds = [frontier]
    while max_depth is None or len(rounds) < max_depth:
        step = edges.select(F.col("parent").alias("child"), F.col("child").alias("_c"), F.col("name").alias("_n"))
        frontier = materialise(
            frontier.join(step, "child").select(
                "ancestor", F.col("_c").alias("child"), (F.col("distance") + 1).alias("distance"),
                F.concat_ws(" > ", "path", "_n").alias("path"),
            )
        )
        if frontier.isEmpty():
            break
        if len(rounds) >= limit:
            raise ValueError("the hierarchy has a cycle or is deeper than the limit")
        rounds.append(frontier)
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out.select("ancestor", F.col("child").alias("descendant"), "distance", "path")


def fold_plan(references: DataFrame, key: Sequence[str]) -> DataFrame:
    """One plan entry per page from (page, topic, role) references.

    A topic page role beats a descendant role of the same topic. The page's topics are summarised,
    not nested, so a page referenced by very many topics stays one small row.
    """
    best = references.groupBy(*key, "topic_id").agg(F.max(F.col("role") == "topic_page").alias("direct"))
    return best.groupBy(*key).agg(
        F.count("*").alias("topics"), F.count_if("direct").alias("topic_pages"), F.min("topic_id").alias("first_topic"),
        F.min(F.when(F.col("direct"), F.col("topic_id"))).alias("first_direct_topic"),
    )


def scoped_references(topics: DataFrame, nodes: DataFrame, below: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    """(topic, page, role) references: the topic page, plus its descendants where the scope says so."""
    scoped = topics.join(overrides, "topic_id", "left").withColumn("scope", F.coalesce("scope", F.lit(default)))
    direct = scoped.select("topic_id", "page_id", F.lit("topic_page").alias("role"))
    wide = scoped.filter("scope = 'page_and_descendants'").join(below, scoped.page_id == below.ancestor).select(
        "topic_id", F.col("descendant").alias("page_id"), F.lit("descendant").alias("role")
    )
    return direct.unionByName(wide).join(nodes.select("page_id"), "page_id", "left_semi")


def resolve_topics(topics: DataFrame, guides: DataFrame, nodes: DataFrame) -> DataFrame:
    """Status and reason per topic: guide unknown, page not in the guide, or resolved."""
    known = topics.join(guides.select("guide_id", F.lit(True).alias("has_toc")), "guide_id", "left")
    placed = known.join(nodes.select("guide_id", "page_id", "depth", F.lit(True).alias("in_toc")), ["guide_id", "page_id"], "left")
    reason = F.when(F.col("has_toc").isNull(), "GUIDE_UNRESOLVED").when(F.col("in_toc").isNull(), "PAGE_NOT_IN_TOC")
    return placed.select(
        "topic_id", "guide_id", "page_id", "depth", reason.alias("reason"),
        F.when(reason.isNull(), "RESOLVED").otherwise("UNRESOLVED").alias("status"),
    )
