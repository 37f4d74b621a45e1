"""Topics for the concepts of a comparison question, and title matching of ranked results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.operators.ordering import top_k
from corpusweave.session import materialise

# Words that never identify a topic, and the score of each kind of match.
CONCEPT_STOP_WORDS = tuple("a an the on at to for of with by from itself is it its and or as well".split())
OWN_WORD, WHOLE_PHRASE, SHARED_TERM, AGGREGATE, OVERVIEW = 10, 8, 3, 15, 10
SHORTLIST = 8  # titles a token of a concept meets before the others are bounded


def concept_words(text: Column) -> Column:
    stop = T.array_of(CONCEPT_STOP_WORDS)
    pieces = F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("/"), F.lit(" "))), " ")
    return F.array_distinct(F.filter(pieces, lambda w: (F.length(w) > 0) & ~F.array_contains(stop, w)))


def topics_for_concepts(concepts: DataFrame, titles: DataFrame, key: Sequence[str], generic: Sequence[str] = (), shortlist: int = SHORTLIST) -> DataFrame:
    """Best topic of every concept.

    ``concepts``: key columns, ``concept_no``, ``concept``, ``others`` (text of the other concepts);
    ``titles``: ``topic_id, title``. Equal titles are one candidate, equal concepts are asked once.

    A title loses a point for each of its terms, so long titles seldom win. Every token of a concept first meets the
    ``shortlist`` shortest titles that hold it; the best score among them then bounds the length up to which any
    other title could still win, and only titles that short are paired as well. The result is that of all pairs.
    """
    key = [*key, "concept_no"]
    drop = T.array_of(generic) if generic else F.array().cast("array<string>")
    unique = titles.groupBy("title").agg(F.min("topic_id").alias("topic_id"))
    cards = bind(unique, t_words=concept_words(F.col("title")), t_terms=F.array_except(T.term_set(F.col("title")), drop))
    cards = materialise(cards.dropna(subset=["topic_id"]).withColumn("n_terms", F.size("t_terms")))
    concepts = concepts.dropna(subset=key).select(*key, "concept", F.coalesce("others", F.lit("")).alias("others"))
    different = concepts.select("concept", "others").distinct()
    asked = bind(
        different, c_words=concept_words(F.col("concept")), o_words=concept_words(F.col("others")),
        c_terms=F.array_except(T.term_set(F.col("concept")), drop),
    ).withColumn("own", F.array_except("c_words", "o_words"))
    asked = materialise(asked)

    def tokens(words: str, terms: str) -> Column:
        tagged_words = F.transform(F.col(words), lambda x: F.concat(F.lit("w:"), x))
        tagged_terms = F.transform(F.col(terms), lambda x: F.concat(F.lit("t:"), x))
        return F.explode(F.concat(tagged_words, tagged_terms))

    unit = ["concept", "others"]
    # A title with an own word of the concept is also found by that word, so a term need only bound the others.
    wanted = asked.select(
        *unit, tokens("own", "c_terms").alias("token"), (WHOLE_PHRASE + (SHARED_TERM + 1) * F.size("c_terms")).alias("_by_term"),
        (OWN_WORD * F.size("own")).alias("_by_word"),
    ).select(*unit, "token", (F.col("_by_term") + F.when(F.startswith("token", F.lit("w:")), F.col("_by_word")).otherwise(0)).alias("_most"))
    postings = cards.select("topic_id", "n_terms", tokens("t_words", "t_terms").alias("token"))
    postings = materialise(postings.join(wanted.select("token").distinct(), "token", "left_semi"))
    short = materialise(top_k(postings, ["token"], [F.col("n_terms"), F.col("topic_id")], shortlist))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.select(*unit, "topic_id").distinct().join(asked, unit).join(cards, "topic_id")
        foreign, title = F.array_except("o_words", "c_words"), F.lower("title")
        own_hits, term_hits = F.size(F.array_intersect("own", "t_words")), F.size(F.array_intersect("c_terms", "t_terms"))
        score = (
            OWN_WORD * own_hits
            + F.when(F.contains(title, F.lower(F.trim("concept"))), WHOLE_PHRASE).otherwise(0)
            + SHARED_TERM * term_hits
            - F.when(F.arrays_overlap(foreign, F.col("t_words")), AGGREGATE).otherwise(0)
            - F.when(F.contains(title, F.lit("overview")), OVERVIEW).otherwise(0)
            - F.size(F.array_except("t_terms", "c_terms"))
        )
        return rows.filter((own_hits > 0) | (term_hits > 0)).select(*unit, "topic_id", score.alias("score"))

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        return top_k(rows, by, [F.desc("score"), F.col("topic_id")], 1, "pick").drop("pick")

    first = materialise(best(scored(wanted.join(short.select("token", "topic_id"), "token")), unit))
    # The last title of a full list; what follows in the order of length and id may still win.
    ends = short.groupBy("token").agg(F.max("rank").alias("_n"), F.max(F.struct("n_terms", "topic_id")).alias("_end")).filter(F.col("_n") == shortlist)
    left = wanted.join(first.withColumnRenamed("topic_id", "_topic"), unit).join(ends, "token")
    lengths = F.sequence(F.col("_end.n_terms"), F.col("_most") - F.col("score"))
    left = left.filter(F.col("_most") - F.col("score") >= F.col("_end.n_terms")).select("*", F.explode(lengths).alias("n_terms"))
    ties = F.col("_most") - F.col("n_terms") == F.col("score")
    left = left.filter(~ties | (F.col("n_terms") > F.col("_end.n_terms")) | (F.col("_topic") > F.col("_end.topic_id")))
    more = left.withColumn("_ties", ties).join(postings, ["token", "n_terms"]).filter(
        (~F.col("_ties") | (F.col("topic_id") < F.col("_topic")))
        & ((F.col("n_terms") > F.col("_end.n_terms")) | (F.col("topic_id") > F.col("_end.topic_id")))
    )
    found = best(first.unionByName(scored(more)), unit)
    rows = concepts.join(found, unit)
    return best(rows, key).select(*key, "concept", "topic_id", "score")


def title_ranks(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """First rank whose title contains (loose) or equals (strict) an expected title.

    ``results``: key, rank, title; ``expected``: key, expected (distinct titles).
    """
    title, wanted = F.lower(F.trim("title")), F.lower(F.trim("expected"))
    joined = results.join(expected, key, "left")
    return joined.groupBy(key).agg(
        F.min(F.when(F.contains(title, wanted), F.col("rank"))).alias("loose_rank"),
        F.min(F.when(title == wanted, F.col("rank"))).alias("strict_rank"),
    )
