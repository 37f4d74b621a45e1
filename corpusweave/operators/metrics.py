"""Retrieval, answer and threshold metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusweave import rules
from corpusweave.operators.ordering import percentiles, value_ranks


# ---------------------------------------------------------------- rankings
def ranking_metrics(first_ranks: DataFrame, rank: str, sets: Sequence[Sequence[str]], digits: int = 4) -> DataFrame:
    """Recall@k, reciprocal rank and hits for several groupings at once (a missing rank is a miss)."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    r = F.col(rank)
    measures = [F.count("*").alias("questions")]
    for k in rules.RECALL_KS:
        measures.append(F.round(F.avg(F.when(r <= k, 1).otherwise(0)), digits).alias(f"recall_{k}"))
    measures += [
        F.round(F.sum(F.when(r.isNotNull(), 1.0 / r).otherwise(0.0)) / F.count("*"), digits).alias("mrr"),
        F.count_if(r == 1).alias("hits_1"),
    ]
    sets_of = [[F.col(c) for c in s] for s in sets]
    return first_ranks.groupingSets(sets_of, *[F.col(c) for c in columns]).agg(*measures)


def top_two(hits: DataFrame) -> DataFrame:
    """Best two cards of each query next to its gold card (one partially aggregated pass)."""

    def at(condition: Column, value: str) -> Column:
        return F.max(F.when(condition, F.col(value)))

    gold = F.col("card") == F.col("gold")
    two = hits.groupBy("query_id").agg(
        F.max("gold").alias("gold"),
        at(F.col("rank") == 1, "card").alias("card1"), at(F.col("rank") == 2, "card").alias("card2"),
        at(F.col("rank") == 1, "score").alias("s1"), at(F.col("rank") == 2, "score").alias("s2"),
        at(gold, "rank").alias("gold_rank"), at(gold, "score").alias("gold_score"),
    )
    return two.withColumn("gap", F.round(F.col("s1") - F.col("s2"), 6))


def tie_bins(two: DataFrame, bins: Sequence[float] = rules.NEAR_TIE_BINS) -> DataFrame:
    label = F.when(F.col("gap").isNull(), "no_rank2")
    for b in bins:
        label = label.when(F.col("gap") < b, f"gap<{b}")
    miss = F.col("card1") != F.col("gold")
    return two.groupBy(label.otherwise(f"gap>={bins[-1]}").alias("bin")).agg(
        F.count("*").alias("queries"), F.count_if(~miss).alias("rank1_expected"), F.count_if(miss).alias("rank1_other"),
        F.count_if(miss & (F.col("card2") == F.col("gold"))).alias("rank2_expected"),
    )


def tie_bins_cumulative(two: DataFrame, bins: Sequence[float] = rules.NEAR_TIE_BINS) -> DataFrame:
    miss = F.col("card1") != F.col("gold")
    row = two.agg(
        F.array(
            *[
                F.struct(
                    F.lit(float(b)).alias("limit_gap"), F.count_if(F.col("gap") < b).alias("queries"),
                    F.count_if((F.col("gap") < b) & miss).alias("rank1_other"),
                )
                for b in bins
            ]
        ).alias("r")
    )
    return row.select(F.inline("r"))


def confusion(two: DataFrame, gold: str, predicted: str, labels: Iterable[int]) -> DataFrame:
    """Gold by predicted counts; the label list is given, so no extra pass collects the pivot values."""
    return two.groupBy(gold).agg(
        *[F.count_if(F.col(predicted) == v).alias(f"card_{v}") for v in labels],
        F.count_if(F.col(predicted) != F.col(gold)).alias("misses"),
    )


def failure_causes(misses: DataFrame, conditions: Mapping[str, Column], margin: Column) -> DataFrame:
    """First matching condition names the cause."""
    rule = None
    for name, condition in conditions.items():
        rule = F.when(condition, name) if rule is None else rule.when(condition, name)
    return misses.groupBy(rule.otherwise("other_ranking").alias("rule")).agg(
        F.count("*").alias("misses"), F.round(F.avg(margin), 4).alias("mean_margin")
    )


# ---------------------------------------------------------------- intervals and tests
def wilson(k: Column, n: Column, z: float = rules.WILSON_Z, digits: int = 4) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; NULL bounds without trials."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), digits))
    high = F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), digits))
    return low, high


def sign_test(improved: Column, worsened: Column) -> Column:
    """Exact two-sided sign test: twice the lower binomial tail, 1.0 without discordant pairs.

    Terms are built from each other in log space, so large counts neither overflow nor recurse.
    """
    n = improved + worsened
    k = F.least(improved, worsened)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")),
        F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"),
            (acc["sum"] + F.exp(acc["term"])).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2.0 * tail), 4))


def paired_counts(pairs: DataFrame, base: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Improved / worsened / unchanged first ranks of two systems on the same questions."""
    b, o = F.col(base), F.col(other)
    counts = pairs.groupBy(*by).agg(
        F.count_if(o < b).alias("improved"), F.count_if(o > b).alias("worsened"), F.count_if(o == b).alias("unchanged"),
        F.count_if((b == 1) & (o > 1)).alias("lost_rank1"), F.count_if((b > 1) & (o == 1)).alias("gained_rank1"),
    )
    return counts.withColumn("sign_test_p", sign_test(F.col("improved"), F.col("worsened")))


# ---------------------------------------------------------------- score distributions
def class_ranks(scores: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with running positive and negative counts; the base of every threshold metric."""
    marked = scores.withColumn("_pos", positive.cast("int"))
    return value_ranks(
        marked.filter("_pos is not null"), score,
        {"n": F.lit(1), "pos": F.col("_pos"), "neg": 1 - F.col("_pos")}, by,
    )


def auroc(ranks: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Probability that a positive outscores a negative, ties one half; NULL without both classes.

    A rank sum over distinct scores replaces the positive x negative comparison.
    """
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return ranks.groupBy(*by).agg(
        F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"),
        F.when(pairs > 0, F.round(wins / pairs, digits)).alias("auroc"),
    )


def thresholds(ranks: DataFrame) -> DataFrame:
    """Candidate thresholds (midpoints of neighbouring scores) with refusal and acceptance rates.

    A score is accepted at or above the threshold: refused positives lie below it, accepted
    negatives above.
    """
    refused = F.col("pos_before") + F.col("pos")
    accepted = F.col("neg_total") - F.col("neg_before") - F.col("neg")
    return ranks.filter(F.col("next_value").isNotNull()).select(
        ((F.col("value") + F.col("next_value")) / 2).alias("t"),
        refused.alias("refused"), F.col("pos_total").alias("positives"),
        accepted.alias("accepted"), F.col("neg_total").alias("negatives"),
        F.round(refused / F.col("pos_total"), 4).alias("refusal_rate"),
        F.round(accepted / F.col("neg_total"), 4).alias("acceptance_rate"),
    )


def best_threshold(candidates: DataFrame, max_refusal: float) -> DataFrame:
    """Lowest acceptance among thresholds within the refusal limit; ties take the lowest threshold."""
    pick = F.struct("acceptance_rate", "t", "refusal_rate", "refused", "accepted")
    best = candidates.filter(F.col("refusal_rate") <= max_refusal).agg(F.min(pick).alias("b"))
    return best.filter("b is not null").select(
        F.round("b.t", 9).alias("t"), "b.refusal_rate", "b.acceptance_rate", "b.refused", "b.accepted"
    )


def score_overlap(scores: DataFrame, score: str, positive: Column) -> DataFrame:
    """Where the two classes' score ranges overlap, or the clean gap between them."""
    marked = scores.withColumn("_pos", positive.cast("int")).filter("_pos is not null")
    ends = marked.agg(
        F.min(F.when(F.col("_pos") == 1, F.col(score))).alias("min_in"),
        F.max(F.when(F.col("_pos") == 1, F.col(score))).alias("max_in"),
        F.min(F.when(F.col("_pos") == 0, F.col(score))).alias("min_out"),
        F.max(F.when(F.col("_pos") == 0, F.col(score))).alias("max_out"),
    )
    # One row of extremes joins the scores: a broadcast of a fixed size.
    joined = marked.crossJoin(F.broadcast(ends))
    return joined.groupBy("min_in", "max_in", "min_out", "max_out").agg(
        F.count_if((F.col("_pos") == 1) & (F.col(score) <= F.col("max_out"))).alias("in_at_or_below_max_out"),
        F.count_if((F.col("_pos") == 0) & (F.col(score) >= F.col("min_in"))).alias("out_at_or_above_min_in"),
        F.count_if(F.col("_pos") == 1).alias("in_n"), F.count_if(F.col("_pos") == 0).alias("out_n"),
    ).select(
        (F.col("max_out") < F.col("min_in")).alias("clean_gap"),
        F.greatest("min_in", "min_out").alias("overlap_low"), F.least("max_in", "max_out").alias("overlap_high"),
        "in_at_or_below_max_out", "out_at_or_above_min_in", "in_n", "out_n",
    )


def describe(df: DataFrame, value: str, by: Sequence[str], ps: Sequence[int] = rules.PERCENTILES, digits: int = 6) -> DataFrame:
    """Count, extremes, mean, sample deviation and interpolated percentiles per group, all exact."""
    by = list(by)
    ranks = value_ranks(df, value, {"n": F.lit(1)}, by)
    wanted = {f"p{p}": ("linear", p / 100) for p in ps}
    quantiles = percentiles(ranks, wanted, by)
    quantiles = quantiles.select(*by, *[F.round(f"p{p}", digits).alias(f"p{p}") for p in ps])
    weight, x = F.col("n"), F.col("value")
    # Weighted moments over distinct values, shifted by the mean to stay stable.
    mean = ranks.groupBy(*by).agg((F.sum(weight * x) / F.sum(weight)).alias("_mean"))
    moments = ranks.join(mean, by).groupBy(*by).agg(
        F.sum(weight).alias("n"), F.round(F.min(x), digits).alias("min"), F.round(F.max(x), digits).alias("max"),
        F.round(F.max("_mean"), digits).alias("mean"),
        F.round(
            F.when(F.sum(weight) > 1, F.sqrt(F.sum(weight * (x - F.col("_mean")) ** 2) / (F.sum(weight) - 1))).otherwise(0.0),
            digits,
        ).alias("stdev"),
    )
    return moments.join(quantiles, by)
