"""Segmentation and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.functions.binding import bind
from corpusweave.operators import chunk_audit as A, corpus as C, html as H, provenance as Pv, segment as G
from corpusweave.operators.ordering import micros
from corpusweave.plans import sqlkit as S
from corpusweave.plans.registry import query
from corpusweave.session import materialise

CHUNKS = f"""WITH chunk_arrays AS (SELECT doc_id, lang, source, {S.chunk_list('text')} AS cs FROM documents),
chunks AS (SELECT doc_id, lang, source, len(cs) AS chunk_count, unnest(cs) AS chunk_text,
    unnest(range(len(cs))) AS chunk_index FROM chunk_arrays)"""


@query(
    "chunk_packed",
    f"{CHUNKS} SELECT doc_id, chunk_index, chunk_count, length(chunk_text) AS chars, md5(chunk_text) AS chunk_md5 FROM chunks",
)
def chunk_packed(t):
    return G.packed_chunks(t.documents).select(
        "doc_id", "chunk_index", "chunk_count", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("chunk_md5")
    )


@query(
    "chunk_statistics",
    f"""{CHUNKS}, sized AS (SELECT *, {S.token_estimate('chunk_text')} AS tokens, length(chunk_text) AS chars FROM chunks)
    SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS pages, round(count(*) / count(DISTINCT doc_id), 2) AS chunks_per_page,
    min(tokens) AS tokens_min, max(tokens) AS tokens_max, round(avg(tokens), 1) AS tokens_mean, max(chars) AS chars_max,
    sum(chars)::BIGINT AS total_chars, count(*) FILTER (tokens > {rules.MODEL_MAX_TOKENS}) AS over_model_limit,
    count(*) FILTER (tokens < {rules.PAGE_CHUNK_MIN}) AS tiny_chunks, quantile_cont(tokens, 0.5) AS tokens_median,
    round(quantile_cont(tokens, 0.9), 4) AS tokens_p90, quantile_cont(chars, 0.5) AS chars_median FROM sized GROUP BY lang""",
)
def chunk_statistics(t):
    chunks = G.packed_chunks(t.documents).join(t.documents.select("doc_id", "lang"), "doc_id")
    return G.chunk_statistics(chunks, "doc_id", "chunk_text", ["lang"]).withColumn(
        "tokens_p90", F.round("tokens_p90", 4)
    )


@query(
    "document_fingerprint",
    f"""SELECT doc_id, sha1(array_to_string({S.chunk_list('text')}, chr(10))) AS fingerprint FROM documents""",
)
def document_fingerprint(t):
    return t.documents.select("doc_id", C.ordered_fingerprint(G.pack_text(F.col("text"))).alias("fingerprint"))


@query(
    "embedding_text_modes",
    f"""{CHUNKS} SELECT doc_id, chunk_index, mode, length(emb) AS chars, md5(emb) AS emb_md5 FROM (
    SELECT doc_id, chunk_index, 'none' AS mode, chunk_text AS emb FROM chunks UNION ALL
    SELECT doc_id, chunk_index, 'title', source || chr(10) || chunk_text FROM chunks UNION ALL
    SELECT doc_id, chunk_index, 'title_section', source || ' > ' || lang || chr(10) || chunk_text FROM chunks)""",
)
def embedding_text_modes(t):
    # The title columns ride along with the text, so the chunker runs once and nothing is shuffled.
    docs = t.documents.select("doc_id", "source", "lang", "text")
    chunks = bind(docs, cs=G.pack_text(F.col("text"))).select(
        "doc_id", "source", "lang", F.posexplode("cs").alias("chunk_index", "chunk_text")
    )
    modes = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                G.embedding_text(F.col("chunk_text"), F.col("source"), F.col("lang"), mode).alias("emb"),
            )
            for mode in ("none", "title", "title_section")
        ]
    )
    return chunks.select("doc_id", "chunk_index", F.inline(modes)).select(
        "doc_id", "chunk_index", "mode", F.length("emb").alias("chars"), F.md5("emb").alias("emb_md5")
    )


@query(
    "chunk_sections",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT doc_id, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS chunk_text FROM l WHERE trim(line) <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, length(chunk_text) AS chars, md5(chunk_text) AS chunk_md5 FROM k""",
)
def chunk_sections(t):
    return G.section_chunks(t.documents, "sections").select(
        "doc_id", "chunk_index", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("chunk_md5")
    )


@query("chunk_bounded")
def chunk_bounded(t):
    return G.section_chunks(t.documents, "bounded").select(
        "doc_id", "chunk_index", "section_index", "part_index", "part_count", "char_start", "char_end", "exceeds_max",
        F.md5("chunk_text").alias("chunk_md5"),
    )


@query(
    "chunk_bounded_audit",
    """SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS source_chars, 0 AS lost_chars, 0 AS introduced_chars,
       0 AS offset_overlaps, 0 AS gap_characters, 0 AS slice_mismatches FROM documents
       WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0""",
)
def chunk_bounded_audit(t):
    return A.offset_audit(G.section_chunks(t.documents, "bounded"), t.documents, "doc_id", "text")


@query(
    "chunk_repeat_audit",
    f"""{CHUNKS}, pairs AS (SELECT doc_id, chunk_index, chunk_text AS cur, lag(chunk_text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM chunks),
    rep AS (SELECT doc_id, coalesce(list_max(list_filter(range({rules.MIN_ADJACENT_REPEAT}, least(length(prev), length(cur)) + 1),
        lambda k: right(prev, k) = left(cur, k))), 0) AS r FROM pairs WHERE prev IS NOT NULL)
    SELECT doc_id, count(*) AS pairs, count(*) FILTER (r > 0) AS adjacent_repeats, max(r) AS max_repeat FROM rep GROUP BY doc_id""",
)
def chunk_repeat_audit(t):
    chunks = bind(t.documents.select("doc_id", "text"), cs=G.pack_text(F.col("text"))).select("doc_id", "cs")
    return A.adjacent_repeats(chunks, "doc_id", "cs")


@query(
    "chunk_duplicate_audit",
    f"""{CHUNKS}, g AS (SELECT chunk_text, count(*) AS n, count(DISTINCT source) AS sources FROM chunks GROUP BY chunk_text)
    SELECT count(*) FILTER (sources > 1) AS cross_source_groups, sum(CASE WHEN sources > 1 THEN n ELSE 0 END)::BIGINT AS cross_source_chunks,
    sum(CASE WHEN sources > 1 THEN n * length(chunk_text) ELSE 0 END)::BIGINT AS cross_source_chars, sum(n)::BIGINT AS chunks,
    sum(n - 1)::BIGINT AS duplicate_chunks FROM g""",
)
def chunk_duplicate_audit(t):
    docs = t.documents.select("doc_id", "source", "text")
    chunks = bind(docs, cs=G.pack_text(F.col("text"))).select("source", F.explode("cs").alias("chunk_text"))
    return A.cross_source_duplicates(chunks, "source", "chunk_text")


@query("chunk_structured")
def chunk_structured(t):
    cleaned = C.clean_documents(t.documents.select("doc_id", "lang", "text"))
    key = C.document_key(F.col("lang"), F.col("doc_id").cast("string"))
    return G.corpus_chunks(cleaned.filter("clean_text <> ''"), key, "clean_text").select(
        "chunk_id", "chunk_index", "chunk_count", "section", "char_start", "char_end", "heading_prefixed", "chunk_hash"
    )


@query(
    "interval_union",
    """WITH iv AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS e FROM events),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
    SELECT user_id, count(*) AS intervals, sum(greatest(0, e - greatest(s, coalesce(reach, s))))::BIGINT AS covered_us,
    sum(e - s)::BIGINT AS total_us FROM m GROUP BY user_id""",
)
def interval_union(t):
    spans = t.events.select(
        "user_id", micros("ts").alias("s"),
        (micros("ts") + F.round(F.col("value") * 60000000).cast("long")).alias("e"),
    )
    return A.interval_union(spans, ["user_id"], "s", "e", width=86_400_000_000)


@query(
    "url_parts",
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
    regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS guide, regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1) AS page,
    coalesce(regexp_extract(url, '\\?([^#]*)', 1), '') AS query_string,
    'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) || '/'
    || regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1) AS canonical_url FROM pages""",
)
def url_parts(t):
    url = F.col("url")
    scheme = F.regexp_extract(url, "^([a-z]+)://", 1)
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1))
    guide = F.regexp_extract(url, "^[a-z]+://[^/]+/([a-z]+)/", 1)
    page = F.regexp_extract(url, "^[a-z]+://[^/]+/[a-z]+/([0-9]+)", 1)
    return t.pages.select(
        "page_id", scheme.alias("scheme"), host.alias("host"), guide.alias("guide"), page.alias("page"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query_string"),
        F.concat(F.lit("https://"), host, F.lit("/"), guide, F.lit("/"), page).alias("canonical_url"),
    )


@query("html_blocks")
def html_blocks(t):
    pages = H.extract_pages(t.pages.select("page_id", "html"))
    return pages.select("page_id", F.inline("blocks")).select(
        "page_id", "block_index", "kind", F.array_join("heading_path", " > ").alias("heading_path"), "text"
    )


@query("html_page_validation")
def html_page_validation(t):
    pages = H.extract_pages(t.pages.select("page_id", "html"))
    reasons = H.extraction_errors(F.col("title"), F.col("html_title"), F.col("blocks"), F.col("page_text"))
    return pages.select(
        "page_id", "title", F.size("blocks").alias("blocks"), F.length("page_text").alias("text_chars"),
        "chrome_removed", F.array_join(reasons, ",").alias("reasons"),
    )


@query("html_page_chunks")
def html_page_chunks(t):
    pages = H.extract_pages(t.pages.select("page_id", "html"))
    return G.page_chunks(pages, "page_id").select(
        "chunk_id", "page_id", "chunk_index", "chunk_count", "token_count", "exceeds_model_limit", "split",
        "overlap_chars", "content_hash",
    )


@query("chunker_comparison")
def chunker_comparison(t):
    """Three chunkers over the same pages: packed characters, headings at 200 and at 128 tokens."""
    pages = H.extract_pages(t.pages.select("page_id", "html"))
    packed = G.packed_chunks(pages, "page_id", "page_text").select(
        F.lit("packed_1000c").alias("strategy"), "page_id", F.col("chunk_text").alias("text")
    )
    headed = [
        G.page_chunks(pages, "page_id", target).select(
            F.lit(f"heading_{target}").alias("strategy"), "page_id", F.col("embedding_text").alias("text")
        )
        for target in (200, 128)
    ]
    chunks = packed.unionByName(headed[0]).unionByName(headed[1])
    return G.chunk_statistics(chunks, "page_id", "text", ["strategy"])


@query("retrieval_units")
def retrieval_units(t):
    """Embedding text of each page: blocks kept by kind, navigation lists and captions dropped."""
    pages = H.extract_pages(t.pages.select("page_id", "url", "html"))
    kept = F.filter("blocks", lambda b: ~b["kind"].isin("list", "caption", "related"))
    body = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return pages.select(
        "page_id", F.size(kept).alias("kept_blocks"), F.length(body).alias("embedding_chars"),
        F.length("page_text").alias("full_chars"), F.sha2(body, 256).alias("embedding_sha256"),
    )


@query(
    "flat_text_blocks",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.squeeze('x')}), lambda x: length(x) > 0) AS ls FROM documents),
    u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
    h AS (SELECT *, regexp_matches(line, '^[A-Z][A-Za-z0-9/&,()\\- ]{{1,60}}$') AND NOT regexp_matches(line, '[.:,;]$')
        AND len(string_split(line, ' ')) <= 6 AND coalesce(length(lead(line) OVER (PARTITION BY doc_id ORDER BY n)), 0) > length(line) + 20 AS heading FROM u),
    s AS (SELECT *, last_value(CASE WHEN heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_index, line AS text, section FROM s WHERE NOT heading""",
)
def flat_text_blocks(t):
    return H.flat_text_blocks(t.documents, "doc_id", "text")


SPOILT = """s AS (SELECT doc_id AS query_id, CASE k WHEN 0 THEN 'S1' WHEN 5 THEN 'X9' ELSE 'S' || (chunk_index + 1) END AS marker, CASE k WHEN 3 THEN -doc_id - 1 ELSE doc_id END AS doc_id,
    CASE k WHEN 4 THEN chunk_index + 100000 ELSE chunk_index END AS chunk_index, CASE k WHEN 6 THEN chunk_text || '.' WHEN 7 THEN '' ELSE chunk_text END AS text,
    CASE k WHEN 1 THEN sha256(chunk_text || '!') WHEN 8 THEN 'none' ELSE sha256(chunk_text) END AS content_hash, CASE k WHEN 2 THEN sha256('other') WHEN 9 THEN NULL ELSE page END AS page_hash
    FROM (SELECT *, (doc_id * 7 + chunk_index) % 23 AS k FROM chunks JOIN (SELECT doc_id, sha256(text) AS page FROM documents) USING (doc_id))),
stored AS (SELECT doc_id, chunk_index, sha256(chunk_text) AS stored_content FROM chunks), pages_of AS (SELECT doc_id, sha256(text) AS stored_page FROM documents WHERE text IS NOT NULL),
j AS (SELECT s.*, stored_content, stored_page, count(*) OVER (PARTITION BY query_id, marker) AS n FROM s LEFT JOIN stored USING (doc_id, chunk_index) LEFT JOIN pages_of USING (doc_id)),
f AS (SELECT query_id, marker, doc_id, chunk_index, list_filter([
    CASE WHEN stored_content IS NULL AND stored_page IS NOT NULL THEN 'CHUNK_NOT_STORED' END, CASE WHEN text = '' THEN 'CHUNK_TEXT_MISSING' END,
    CASE WHEN length(content_hash) = 64 AND (content_hash <> stored_content OR sha256(text) <> content_hash) THEN 'CONTENT_HASH_MISMATCH' END,
    CASE WHEN n > 1 THEN 'DUPLICATE_MARKER' END, CASE WHEN length(content_hash) <> 64 THEN 'INVALID_CONTENT_HASH' END, CASE WHEN marker = 'X9' THEN 'INVALID_MARKER' END,
    CASE WHEN page_hash IS NULL THEN 'INVALID_PAGE_HASH' END, CASE WHEN page_hash <> stored_page THEN 'PAGE_HASH_MISMATCH' END,
    CASE WHEN stored_page IS NULL THEN 'PAGE_NOT_STORED' END], lambda x: x IS NOT NULL) AS failures FROM j)"""


@query("context_provenance", f"{CHUNKS}, {SPOILT} SELECT query_id, marker, doc_id, chunk_index, array_to_string(failures, ',') AS failures FROM f WHERE len(failures) > 0")
def context_provenance(t):
    """All chunks as context items, some spoilt in one way or another: what is wrong with each of those, and none of the others."""
    pages = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("page_hash"))
    chunks = bind(t.documents.select("doc_id", "text"), cs=G.pack_text(F.col("text")), page=F.sha2("text", 256))
    chunks = materialise(chunks.select("doc_id", "page", F.posexplode("cs").alias("chunk_index", "chunk_text")).withColumn("content_hash", F.sha2("chunk_text", 256)))
    k, c = (F.col("doc_id") * 7 + F.col("chunk_index")) % 23, F.col
    spoilt = chunks.select(
        c("doc_id").alias("query_id"), F.when(k == 0, "S1").when(k == 5, "X9").otherwise(F.concat(F.lit("S"), (c("chunk_index") + 1).cast("string"))).alias("marker"),
        F.when(k == 3, -c("doc_id") - 1).otherwise(c("doc_id")).alias("doc_id"), F.when(k == 4, c("chunk_index") + 100000).otherwise(c("chunk_index")).alias("chunk_index"),
        F.when(k == 6, F.concat("chunk_text", F.lit("."))).when(k == 7, "").otherwise(c("chunk_text")).alias("text"),
        F.when(k == 1, F.sha2(F.concat("chunk_text", F.lit("!")), 256)).when(k == 8, "none").otherwise(c("content_hash")).alias("content_hash"),
        F.when(k == 2, F.sha2(F.lit("other"), 256)).when(k == 9, F.lit(None)).otherwise(c("page")).alias("page_hash"),
    )
    return Pv.context_failures(spoilt, chunks.select("doc_id", "chunk_index", "content_hash"), pages)
