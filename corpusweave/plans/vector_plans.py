"""Dense retrieval queries: every stored vector is also a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.operators import metrics as M, similarity as V
from corpusweave.operators.ordering import top_k
from corpusweave.plans.registry import query

COS = "round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6)"
VECS = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
FLAT = """, d AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
cards AS (SELECT label, list(m ORDER BY i) AS e FROM (SELECT label, i, round(avg(x), 6) AS m FROM d GROUP BY label, i) GROUP BY label)"""
RANKED = f"""{VECS}{FLAT}, ranking AS (SELECT query_id, gold, card, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card) AS rank
FROM (SELECT a.vec_id AS query_id, a.label AS gold, b.label AS card, {COS} AS score FROM v a, cards b))"""


def stored(t):
    return t.embeddings.select("vec_id", F.col("label").alias("group_id"), "embedding")


def asked(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("group_id"), "embedding")


def card_hits(t):
    ranking = V.card_ranking(t.embeddings, V.centroids(t.embeddings, "label"))
    gold = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("gold"))
    return ranking.join(gold, "query_id")


@query(
    "dense_topk",
    f"""{VECS} SELECT query_id, vec_id, rank, score FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def dense_topk(t):
    return V.nearest(asked(t), stored(t), 5, exclude_self=True).select("query_id", "vec_id", "rank", "score")


@query(
    "dense_topk_grid",
    f"""{VECS} SELECT query_id, vec_id, rank, score FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def dense_topk_grid(t):
    """The layout for query sides too large to broadcast."""
    hits = V.nearest(asked(t), stored(t), 5, exclude_self=True, broadcast_bytes=0)
    return hits.select("query_id", "vec_id", "rank", "score")


L2 = "round(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 6)"


@query(
    "dense_threshold_l2",
    f"""{VECS} SELECT query_id, vec_id, rank, distance, round(1 - distance / 2, 6) AS cosine FROM (SELECT a.vec_id AS query_id, b.vec_id, {L2} AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2}, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id <> b.vec_id)
    WHERE rank <= {rules.CANDIDATE_K} AND distance <= {rules.MAX_SQUARED_L2}""",
)
def dense_threshold_l2(t):
    hits = V.nearest(asked(t), stored(t), rules.CANDIDATE_K, metric="l2", exclude_self=True)
    distance = -F.col("score")
    return hits.filter(distance <= rules.MAX_SQUARED_L2).select(
        "query_id", "vec_id", "rank", distance.alias("distance"), F.round(1.0 - distance / 2.0, 6).alias("cosine")
    )


@query(
    "page_constrained_topk",
    f"""{VECS} SELECT query_id, page, vec_id, rank, score FROM (SELECT a.vec_id AS query_id, b.label AS page, b.vec_id, {COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.label = b.label) WHERE rank <= 3""",
)
def page_constrained_topk(t):
    hits = V.nearest(asked(t), stored(t), 3, mode="own")
    return hits.select("query_id", F.col("group_id").alias("page"), "vec_id", "rank", "score")


@query(
    "page_constrained_leakage",
    """SELECT 0 AS leaked, 3 * count(*) AS hits FROM embeddings""",
)
def page_constrained_leakage(t):
    """Post-check of the filtered search: every hit belongs to the page it was asked from."""
    hits = V.nearest(asked(t), stored(t), 3, mode="own", broadcast_bytes=0)
    actual = t.embeddings.select("vec_id", F.col("label").cast("long").alias("actual"))
    return hits.join(actual, "vec_id").agg(
        F.count_if(F.col("actual") != F.col("group_id")).alias("leaked"), F.count("*").alias("hits")
    )


@query(
    "all_pages_topk",
    f"""{VECS} SELECT query_id, page, vec_id, rank, score FROM (SELECT a.vec_id AS query_id, b.label AS page, b.vec_id, {COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY {COS} DESC, b.vec_id) AS rank FROM v a, v b) WHERE rank <= 2""",
)
def all_pages_topk(t):
    """One batched search instead of one per page: the best two vectors of every page for each query."""
    hits = V.nearest(asked(t), stored(t), 2, mode="each")
    return hits.select("query_id", F.col("group_id").alias("page"), "vec_id", "rank", "score")


@query("card_ranking", f"{RANKED} SELECT query_id, gold, card, score, rank FROM ranking")
def card_ranking(t):
    return card_hits(t).select("query_id", "gold", "card", "score", "rank")


FUSED = f"""{RANKED}, best AS (SELECT a.vec_id AS query_id, b.label AS card, max({COS}) AS page_score FROM v a, v b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2),
fused AS (SELECT r.query_id, r.gold, r.card, r.rank AS card_rank, r.score, round(r.score + 0.5::DOUBLE * coalesce(page_score, score), 7) AS fused
FROM ranking r LEFT JOIN best b ON r.query_id = b.query_id AND r.card = b.card),
refused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, card_rank) AS fused_rank FROM fused)"""


def fused_hits(t):
    cards = card_hits(t)
    best = V.nearest(asked(t), stored(t), 1, mode="each", exclude_self=True).select(
        "query_id", F.col("group_id").alias("card"), F.col("score").alias("page_score")
    )
    return V.fuse(cards, best, 0.5).withColumnRenamed("rank", "card_rank")


@query("fused_page_evidence", f"{FUSED} SELECT query_id, card, card_rank, fused, fused_rank AS rank FROM refused WHERE fused_rank <= 3")
def fused_page_evidence(t):
    ranked = top_k(fused_hits(t), ["query_id"], [F.desc("fused"), F.col("card_rank")], 3)
    return ranked.select("query_id", "card", "card_rank", "fused", "rank")


METRICS = """count(*) AS questions, round(avg((rank <= 1)::INT), 4) AS recall_1, round(avg((rank <= 3)::INT), 4) AS recall_3,
round(avg((rank <= 5)::INT), 4) AS recall_5, round(sum(1.0::DOUBLE / rank) / count(*), 4) AS mrr, count(*) FILTER (rank = 1) AS hits_1"""


@query(
    "router_metrics",
    f"""{RANKED}, f AS (SELECT query_id, gold, rank, CASE WHEN score >= 0.3 THEN 'near' ELSE 'far' END AS difficulty FROM ranking WHERE card = gold)
    SELECT gold, difficulty, {METRICS} FROM f GROUP BY GROUPING SETS ((), (gold), (difficulty))""",
)
def router_metrics(t):
    """Recall and reciprocal rank overall, per gold card and per difficulty in one pass."""
    first = card_hits(t).filter(F.col("card") == F.col("gold")).select(
        "query_id", "gold", "rank", F.when(F.col("score") >= 0.3, "near").otherwise("far").alias("difficulty")
    )
    return M.ranking_metrics(first, "rank", [[], ["gold"], ["difficulty"]])


@query(
    "router_metrics_fused",
    f"""{FUSED}, f AS (SELECT query_id, gold, fused_rank AS rank FROM refused WHERE card = gold)
    SELECT gold, {METRICS} FROM f GROUP BY GROUPING SETS ((), (gold))""",
)
def router_metrics_fused(t):
    ranked = top_k(fused_hits(t), ["query_id"], [F.desc("fused"), F.col("card_rank")], 2**31 - 1)
    first = ranked.filter(F.col("card") == F.col("gold")).select("query_id", "gold", "rank")
    return M.ranking_metrics(first, "rank", [[], ["gold"]])


TOP2 = f"""{RANKED}, two AS (SELECT query_id, any_value(gold) AS gold, max(CASE WHEN rank = 1 THEN card END) AS card1,
max(CASE WHEN rank = 2 THEN card END) AS card2, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2,
max(CASE WHEN card = gold THEN rank END) AS gold_rank, max(CASE WHEN card = gold THEN score END) AS gold_score FROM ranking GROUP BY query_id),
g AS (SELECT *, round(s1 - s2, 6) AS gap FROM two)"""


def top_two(t):
    return M.top_two(card_hits(t))


@query(
    "tie_bins",
    f"""{TOP2} SELECT CASE WHEN gap IS NULL THEN 'no_rank2' WHEN gap < 0.01 THEN 'gap<0.01' WHEN gap < 0.05 THEN 'gap<0.05' ELSE 'gap>=0.05' END AS bin,
    count(*) AS queries, count(*) FILTER (card1 = gold) AS rank1_expected, count(*) FILTER (card1 <> gold) AS rank1_other,
    count(*) FILTER (card1 <> gold AND card2 = gold) AS rank2_expected FROM g GROUP BY 1""",
)
def tie_bins(t):
    return M.tie_bins(top_two(t))


@query(
    "tie_bins_cumulative",
    f"""{TOP2} SELECT limit_gap, count(*) FILTER (gap < limit_gap) AS queries, count(*) FILTER (gap < limit_gap AND card1 <> gold) AS rank1_other
    FROM g, (SELECT unnest([0.01, 0.05])::DOUBLE AS limit_gap) GROUP BY limit_gap""",
)
def tie_bins_cumulative(t):
    return M.tie_bins_cumulative(top_two(t))


@query(
    "router_crosstab",
    f"{TOP2} SELECT gold, card1 AS card, count(*) AS n, card1 <> gold AS missed FROM g GROUP BY gold, card1",
)
def router_crosstab(t):
    """How often each card is ranked first for each gold card, whatever cards there are."""
    return top_two(t).groupBy("gold", F.col("card1").alias("card")).agg(F.count("*").alias("n")).withColumn("missed", F.col("card") != F.col("gold"))


@query(
    "failure_causes",
    f"""{TOP2} SELECT rule, count(*) AS misses, round(avg(s1 - gold_score), 4) AS mean_margin FROM (SELECT *, CASE
    WHEN gold_rank <= 3 AND card1 % 2 = gold % 2 THEN 'sibling_ambiguity' WHEN gold_score < 0.1 THEN 'vocabulary_mismatch'
    WHEN s1 < 0.2 THEN 'query_underspecified' WHEN round(s1 - gold_score, 4) <= {rules.NEAR_TIE_MARGIN} THEN 'near_tie_embedding'
    ELSE 'other_ranking' END AS rule FROM g WHERE card1 <> gold) GROUP BY rule""",
)
def failure_causes(t):
    two = top_two(t)
    conditions = {
        "sibling_ambiguity": (F.col("gold_rank") <= 3) & (F.col("card1") % 2 == F.col("gold") % 2),
        "vocabulary_mismatch": F.col("gold_score") < 0.1,
        "query_underspecified": F.col("s1") < 0.2,
        "near_tie_embedding": F.round(F.col("s1") - F.col("gold_score"), 4) <= rules.NEAR_TIE_MARGIN,
    }
    return M.failure_causes(two.filter("card1 <> gold"), conditions, F.col("s1") - F.col("gold_score"))
