"""Corpus build queries on documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.operators import corpus as C
from corpusweave.plans import sqlkit as S
from corpusweave.plans.registry import query
from corpusweave.session import materialise

CLEAN = S.clean_cte("documents")


@query(
    "clean_documents",
    f"""{CLEAN} SELECT doc_id, md5(clean_text) AS clean_md5, title_drops AS title_duplicates_removed,
        dup_drops AS duplicate_lines_removed, joins AS fragments_joined, n_in AS lines_in, n_out AS lines_out FROM cleaned""",
)
def clean_documents(t):
    return C.clean_documents(t.documents.select("doc_id", "text")).select(
        "doc_id", F.md5("clean_text").alias("clean_md5"), "title_duplicates_removed", "duplicate_lines_removed",
        "fragments_joined", "lines_in", "lines_out",
    )


@query(
    "faithfulness",
    f"""{CLEAN} SELECT doc_id, list_sort(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]'))
        = list_sort(regexp_extract_all(clean_text || dropped_text, '[\\p{{L}}\\p{{N}}]')) AS faithful FROM cleaned""",
)
def faithfulness(t):
    cleaned = C.clean_documents(t.documents.select("doc_id", "text"))
    return cleaned.select(
        "doc_id", C.faithful(F.col("text"), F.col("clean_text"), F.col("dropped_text")).alias("faithful")
    )


HASHED = f"""{CLEAN}, hashed AS (SELECT c.doc_id, c.lang, c.source, c.clean_text,
    sha256({S.squeeze("replace(lower(nfc_normalize(c.clean_text)), 'ß', 'ss')")}) AS content_hash,
    CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS role_rank
    FROM cleaned c LEFT JOIN labels l ON c.doc_id = l.doc_id),
best AS (SELECT content_hash, min({{'r': role_rank, 'i': doc_id}}).i AS canonical_id
    FROM hashed WHERE clean_text <> '' GROUP BY content_hash),
marked AS (SELECT h.*, CASE WHEN clean_text = '' THEN h.doc_id ELSE b.canonical_id END AS canonical_id,
    CASE WHEN clean_text <> '' AND b.canonical_id <> h.doc_id THEN b.canonical_id END AS duplicate_of,
    CASE WHEN clean_text = '' THEN 'EMPTY_CONTENT' WHEN b.canonical_id <> h.doc_id THEN 'DUPLICATE_CONTENT'
    ELSE 'OK' END AS status FROM hashed h LEFT JOIN best b ON h.content_hash = b.content_hash)"""


def marked_documents(t):
    """Content hash, role from the quality label, canonical id and status of every document.

    Texts are cleaned and hashed once; what is shuffled and written is a narrow row per document.
    """
    cleaned = C.clean_documents(t.documents.select("doc_id", "lang", "source", "text"))
    narrow = cleaned.select(
        "doc_id", "lang", "source", F.length("clean_text").alias("clean_chars"), C.content_hash(F.col("clean_text")).alias("content_hash")
    )
    roles = t.labels.select("doc_id", F.when(F.col("quality") == 1, 0).otherwise(1).alias("role_rank"))
    docs = materialise(narrow.join(roles, "doc_id", "left").withColumn("role_rank", F.coalesce("role_rank", F.lit(1))))
    return C.mark_duplicates(docs, "doc_id", "content_hash", F.col("clean_chars") == 0, [F.col("role_rank")])


@query("dedup_canonical", f"{HASHED} SELECT doc_id, content_hash, canonical_id, duplicate_of, status FROM marked")
def dedup_canonical(t):
    return marked_documents(t).select("doc_id", "content_hash", "canonical_id", "duplicate_of", "status")


def topic_refs(marked):
    return marked.select(
        "doc_id",
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("topic_id"),
        F.when(F.col("role_rank") == 0, "topic_page").otherwise("descendant").alias("role"),
    )


REFS = f"""{HASHED}, refs AS (SELECT DISTINCT canonical_id AS doc_id, regexp_extract(source, '(\\d+)$', 1)::INT AS topic_id,
    CASE WHEN role_rank = 0 THEN 'topic_page' ELSE 'descendant' END AS role,
    CASE WHEN duplicate_of IS NOT NULL THEN doc_id END AS via_doc_id FROM marked)"""


@query("dedup_topic_refs", f"{REFS} SELECT doc_id, topic_id, role, via_doc_id FROM refs")
def dedup_topic_refs(t):
    marked = marked_documents(t)
    return C.inherit_topic_refs(topic_refs(marked), marked)


@query(
    "primary_topic",
    f"""{REFS} SELECT doc_id, min({{'a': (via_doc_id IS NOT NULL)::INT, 'b': (role <> 'topic_page')::INT, 'c': topic_id}}).c
        AS primary_topic, count(DISTINCT topic_id) AS topics FROM refs GROUP BY doc_id""",
)
def primary_topic(t):
    marked = marked_documents(t)
    return C.primary_topic(C.inherit_topic_refs(topic_refs(marked), marked))


@query(
    "corpus_totals",
    f"""{HASHED} SELECT lang, count(*) AS documents, count(*) FILTER (status = 'OK') AS canonical_ok,
        count(*) FILTER (status = 'DUPLICATE_CONTENT') AS duplicate_content, count(*) FILTER (status = 'EMPTY_CONTENT') AS empty,
        sum(length(clean_text))::BIGINT AS cleaned_chars, count(DISTINCT source) AS topics FROM marked GROUP BY lang""",
)
def corpus_totals(t):
    return marked_documents(t).groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "OK").alias("canonical_ok"),
        F.count_if(F.col("status") == "DUPLICATE_CONTENT").alias("duplicate_content"),
        F.count_if(F.col("status") == "EMPTY_CONTENT").alias("empty"),
        F.sum("clean_chars").alias("cleaned_chars"),
        F.countDistinct("source").alias("topics"),
    )


@query(
    "topic_page_counts",
    f"""{REFS} SELECT topic_id, count(*) AS page_refs, count(DISTINCT doc_id) AS pages,
        count(*) FILTER (via_doc_id IS NOT NULL) AS inherited FROM refs GROUP BY topic_id""",
)
def topic_page_counts(t):
    marked = marked_documents(t)
    return C.inherit_topic_refs(topic_refs(marked), marked).groupBy("topic_id").agg(
        F.count("*").alias("page_refs"), F.countDistinct("doc_id").alias("pages"),
        F.count("via_doc_id").alias("inherited"),
    )


@query(
    "length_statistics",
    """SELECT lang, count(*) AS count, sum(n_chars)::BIGINT AS total, round(sum(n_chars) / count(*), 1) AS mean,
       min(n_chars) AS min, max(n_chars) AS max, median(n_chars)::DOUBLE AS median FROM documents GROUP BY lang""",
)
def length_statistics(t):
    return C.length_statistics(t.documents.select("lang", "n_chars"), "n_chars", ["lang"])


@query(
    "schema_validation",
    """SELECT d.doc_id, concat_ws('; ', CASE WHEN lang IS NULL THEN 'lang is null' WHEN lang = '' THEN 'lang is empty' END,
       CASE WHEN source IS NULL THEN 'source is null' WHEN source = '' THEN 'source is empty' END,
       CASE WHEN text IS NULL THEN 'text is null' END, CASE WHEN quality IS NULL THEN 'quality is null' END) AS errors
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def schema_validation(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select(
        "doc_id", F.array_join(C.validation_errors(["lang", "source", "text", "quality"]), "; ").alias("errors")
    )


@query(
    "suspicious_documents",
    f"""{CLEAN} SELECT doc_id, why FROM (SELECT c.doc_id, concat_ws('; ',
        CASE WHEN l.doc_id IS NULL THEN 'page belongs to no target topic' END,
        CASE WHEN clean_text = '' THEN 'empty after cleaning'
             WHEN length(clean_text) < 200 THEN 'very short (' || length(clean_text) || ' chars)' END,
        CASE WHEN length(text) > 0 AND length(clean_text) < 0.6 * length(text) THEN 'cleaning removed >40% of the text' END
        ) AS why FROM cleaned c LEFT JOIN labels l ON c.doc_id = l.doc_id) WHERE why <> ''""",
)
def suspicious_documents(t):
    cleaned = C.clean_documents(t.documents.select("doc_id", "text")).select(
        "doc_id", F.length("clean_text").alias("n"), F.length("text").alias("raw")
    )
    rows = cleaned.join(t.labels.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    why = F.array_compact(
        F.array(
            F.when(F.col("labelled").isNull(), "page belongs to no target topic"),
            F.when(F.col("n") == 0, "empty after cleaning").when(
                F.col("n") < 200, F.format_string("very short (%d chars)", F.col("n"))
            ),
            F.when((F.col("raw") > 0) & (F.col("n") < 0.6 * F.col("raw")), "cleaning removed >40% of the text"),
        )
    )
    return rows.select("doc_id", F.array_join(why, "; ").alias("why")).filter(F.col("why") != "")


@query(
    "exact_duplicate_texts",
    """SELECT count(*) AS texts, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS duplicates
       FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)""",
)
def exact_duplicate_texts(t):
    texts = t.documents.select("text").unionByName(t.conversations.select("text"))
    # Counting digests keeps whole texts out of the shuffle; equal texts meet in the partial aggregate.
    per_text = texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))
    return per_text.agg(
        F.sum("n").alias("texts"), F.count("*").alias("distinct_texts"), (F.sum("n") - F.count("*")).alias("duplicates")
    )


@query(
    "cross_guide_pages",
    """SELECT page, count(DISTINCT host) AS guides, min(host) AS first_guide, max(host) AS last_guide FROM (
       SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS page
       FROM pages) GROUP BY page HAVING count(DISTINCT host) > 1""",
)
def cross_guide_pages(t):
    parts = t.pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("page"),
    )
    return (
        parts.groupBy("page")
        .agg(F.countDistinct("host").alias("guides"), F.min("host").alias("first_guide"), F.max("host").alias("last_guide"))
        .filter("guides > 1")
    )


@query(
    "corpus_fingerprint",
    """WITH lines AS (SELECT lang, sha256(doc_id::VARCHAR) AS h, doc_id || ' ' || sha256(text) AS line FROM documents),
       l1 AS (SELECT lang, substr(h, 1, 6) AS h, substr(h, 1, 6) || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line
              FROM lines GROUP BY lang, substr(h, 1, 6)),
       l2 AS (SELECT lang, substr(h, 1, 3) || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line
              FROM l1 GROUP BY lang, substr(h, 1, 3))
       SELECT lang, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l2 GROUP BY lang""",
)
def corpus_fingerprint(t):
    return C.sharded_fingerprint(t.documents, F.col("doc_id"), F.sha2("text", 256), ["lang"])


@query(
    "metadata_flatten",
    f"""SELECT doc_id::VARCHAR AS id, lang || '/' || source AS guide, array_to_string({S.lines('text')}, ' > ') AS toc_path,
        to_json({{'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}})::VARCHAR AS metadata_json FROM documents""",
)
def metadata_flatten(t):
    return t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws("/", "lang", "source").alias("guide"),
        F.array_join(T.lines(F.col("text")), " > ").alias("toc_path"),
        F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("metadata_json"),
    )
