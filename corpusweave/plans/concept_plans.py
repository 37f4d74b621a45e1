"""Comparison topics and title matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.functions.binding import bind
from corpusweave.operators import concepts as Co, lexical as L, phrases as P, questions as Qn
from corpusweave.operators.ordering import top_k
from corpusweave.plans import sqlkit as S
from corpusweave.plans.lexical_plans import BM25, GOLD, pages, questions
from corpusweave.plans.question_plans import derived, written
from corpusweave.plans.registry import ORACLE, query


def _titles(t):
    return t.documents.select("doc_id", F.get(F.split("text", "\n"), 0).alias("title"))


WORDS = "list_distinct(list_filter(string_split(lower(replace({x}, '/', ' ')), ' '), lambda w: length(w) > 0 AND NOT list_contains(" + S.quoted(Co.CONCEPT_STOP_WORDS) + ", w)))"


def concept_rows(asked):
    parts = bind(asked, cs=Qn.comparison_concepts(F.col("question"))).filter(F.size("cs") >= 2)
    rows = parts.select("conv_id", "turn", "cs", F.posexplode("cs").alias("concept_no", "concept"))
    others = F.array_join(F.filter("cs", lambda x, i: i != F.col("concept_no")), " ")
    return rows.select("conv_id", "turn", "concept_no", "concept", others.alias("others"))


def _topics(t, asked):
    titles = _titles(t).select(F.col("doc_id").alias("topic_id"), "title")
    return Co.topics_for_concepts(concept_rows(asked), titles, ["conv_id", "turn"])


@query("concept_topics")
def concept_topics(t):
    """Best document title for every concept of the derived comparison questions."""
    return _topics(t, derived(t))


# The concepts come from the SQL of the comparison query, so both engines score the same phrases.
ORACLE["concept_topics"] = f"""WITH cc AS ({ORACLE['comparison_concepts']}), sp AS (SELECT conv_id, turn, string_split(concepts, '|') AS cs FROM cc WHERE contains(concepts, '|')),
co AS (SELECT conv_id, turn, unnest(cs) AS concept, unnest(range(len(cs))) AS concept_no, cs FROM sp),
cw AS (SELECT conv_id, turn, concept_no, concept, {WORDS.format(x='concept')} AS cw, {WORDS.format(x="array_to_string(list_filter(cs, lambda y, i: i <> concept_no + 1), ' ')")} AS ow, list_distinct({S.terms('concept')}) AS ct FROM co),
ti AS (SELECT string_split(text, chr(10))[1] AS title, min(doc_id) AS topic_id FROM documents GROUP BY 1), tw AS (SELECT topic_id, title, {WORDS.format(x='title')} AS tw, list_distinct({S.terms('title')}) AS tt FROM ti),
sc AS (SELECT conv_id, turn, concept_no, concept, topic_id, 10 * len(list_filter(list_intersect(cw, tw), lambda w: NOT list_contains(ow, w))) AS own, 3 * len(list_intersect(ct, tt)) AS shared,
    CASE WHEN contains(lower(title), lower(trim(concept))) THEN 8 ELSE 0 END - CASE WHEN len(list_filter(list_intersect(ow, tw), lambda w: NOT list_contains(cw, w))) > 0 THEN 15 ELSE 0 END
    - CASE WHEN contains(lower(title), 'overview') THEN 10 ELSE 0 END - len(list_filter(tt, lambda w: NOT list_contains(ct, w))) AS rest FROM cw, tw)
SELECT conv_id, turn, concept_no, concept, topic_id, own + shared + rest AS score FROM sc WHERE own > 0 OR shared > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, concept_no ORDER BY own + shared + rest DESC, topic_id) = 1"""


@query("written_concept_topics", ORACLE["concept_topics"].replace(ORACLE["comparison_concepts"], ORACLE["written_concepts"]))
def written_concept_topics(t):
    """Best document title for every concept that whole messages and questions compare."""
    return _topics(t, written(t))


@query(
    "title_match",
    f"""{BM25}, {GOLD}, top AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5),
    ti AS (SELECT doc_id, lower(trim(string_split(text, chr(10))[1])) AS title FROM documents), e AS (SELECT DISTINCT query_id, title AS expected FROM gold JOIN ti USING (doc_id))
    SELECT t.query_id, min(rank) FILTER (contains(ti.title, expected)) AS loose_rank, min(rank) FILTER (ti.title = expected) AS strict_rank FROM top t JOIN ti USING (doc_id) LEFT JOIN e ON e.query_id = t.query_id GROUP BY t.query_id""",
)
def title_match(t):
    """Loose and strict title hits of the lexical top five against the titles of the gold pages."""
    scores = L.bm25_scores(pages(t), questions(t))
    results = top_k(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], 5).join(_titles(t), "doc_id")
    expected = P.verbatim_pages(questions(t), pages(t)).join(_titles(t), "doc_id").select("query_id", F.col("title").alias("expected")).distinct()
    return Co.title_ranks(results.select("query_id", "rank", "title"), expected, "query_id")
