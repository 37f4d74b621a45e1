"""Text kernel queries: one row per document, digests instead of full token lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.plans import sqlkit as S
from corpusweave.plans.registry import query


@query(
    "text_normalize",
    f"""SELECT doc_id, length({S.normalize_text('text')}) AS norm_chars, md5({S.normalize_text('text')}) AS norm_md5,
        len({S.query_terms('text')}) AS query_terms FROM documents""",
)
def text_normalize(t):
    norm = T.normalize_text(F.col("text"))
    return t.documents.select(
        "doc_id", F.length(norm).alias("norm_chars"), F.md5(norm).alias("norm_md5"),
        F.size(T.query_terms(F.col("text"))).alias("query_terms"),
    )


@query(
    "text_terms",
    f"""SELECT doc_id, len({S.tokenize('text')}) AS tokens, len({S.terms('text')}) AS n_terms,
        len(list_distinct({S.terms('text')})) AS distinct_terms, md5(array_to_string({S.terms('text')}, ' ')) AS terms_md5
        FROM documents""",
)
def text_terms(t):
    docs = t.documents.select("doc_id", "text")
    return bind(docs, x=T.terms(F.col("text"))).select(
        "doc_id", F.size(T.tokenize(F.col("text"))).alias("tokens"), F.size("x").alias("n_terms"), F.size(F.array_distinct("x")).alias("distinct_terms"),
        F.md5(F.array_join("x", " ")).alias("terms_md5"),
    )


@query(
    "text_terms2",
    f"""SELECT doc_id, len(x) AS n_terms, len(list_distinct(x)) AS distinct_terms, md5(array_to_string(x, ' ')) AS terms_md5
        FROM (SELECT doc_id, {S.terms2('text')} AS x FROM documents)""",
)
def text_terms2(t):
    return bind(t.documents.select("doc_id", "text"), x=T.terms2(F.col("text"))).select(
        "doc_id", F.size("x").alias("n_terms"), F.size(F.array_distinct("x")).alias("distinct_terms"),
        F.md5(F.array_join("x", " ")).alias("terms_md5"),
    )


@query(
    "code_tokens",
    f"""SELECT doc_id, len(x) AS n_codes, array_to_string(list_sort(x), ',') AS codes
        FROM (SELECT doc_id, {S.code_tokens('text')} AS x FROM documents)""",
)
def code_tokens(t):
    return bind(t.documents.select("doc_id", "text"), x=T.code_tokens(F.col("text"))).select(
        "doc_id", F.size("x").alias("n_codes"), F.array_join(F.array_sort("x"), ",").alias("codes")
    )


@query(
    "sentence_split",
    f"""SELECT doc_id, len(x) AS sentences, md5(array_to_string(x, '|')) AS sentence_md5
        FROM (SELECT doc_id, {S.split_sentences('text')} AS x FROM documents)""",
)
def sentence_split(t):
    return bind(t.documents.select("doc_id", "text"), x=T.split_sentences(F.col("text"))).select(
        "doc_id", F.size("x").alias("sentences"), F.md5(F.array_join("x", "|")).alias("sentence_md5")
    )


@query(
    "token_estimate",
    f"SELECT conv_id, turn, {S.token_estimate('text')} AS tokens, "
    f"len(list_filter(string_split({S.squeeze('text')}, ' '), lambda w: length(w) > 0)) AS words FROM conversations",
)
def token_estimate(t):
    return t.conversations.select(
        "conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words")
    )
