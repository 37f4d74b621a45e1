"""Question to answer: context assembly, sentence evidence, answer selection and citation checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.operators import (
    citations as Ci, context as X, evidence as Ev, evidence_rules as ER, lexical as L, questions as Qn, segment as G,
    similarity as V,
)
from corpusweave.operators.ordering import top_k
from corpusweave.plans import sqlkit as S
from corpusweave.plans.lexical_plans import HYBRID, pages, questions
from corpusweave.plans.registry import query
from corpusweave.session import materialise

HITS_PER_QUESTION = 5
#: Chunk ids of a document: more than an array can hold, so ids of two documents never meet.
CHUNK_IDS = 1 << 32


def chunk_table(t, only=None):
    """Chunks of all documents, or of those whose ``doc_id`` is in ``only``."""
    docs = t.documents if only is None else t.documents.join(only, "doc_id", "left_semi")
    docs = docs.select("doc_id", "text", F.get(F.split("text", "\n"), 0).alias("title"))
    cut = bind(docs, cs=G.pack_text(F.col("text"))).select("doc_id", "title", F.posexplode("cs").alias("chunk_index", "text"))
    return cut.select(
        (F.col("doc_id") * CHUNK_IDS + F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("page"), "chunk_index", "title", "text"
    )


def chunk_hits(t, k=HITS_PER_QUESTION):
    """Best chunks per question with their text (late: only pages of ranked ids are cut again, and only they carry titles)."""
    chunks = chunk_table(t).select(F.col("chunk_id").alias("doc_id"), "text")
    ranked = materialise(L.bm25_best(chunks, questions(t), k).withColumnRenamed("doc_id", "chunk_id"))
    hit = ranked.select(F.shiftright("chunk_id", CHUNK_IDS.bit_length() - 1).alias("doc_id")).distinct()
    return ranked.join(chunk_table(t, hit), "chunk_id")


def items_of(t):
    return materialise(X.context_items(X.select_chunks(chunk_hits(t))))


CTX = f"""WITH ca AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, {S.chunk_list('text')} AS cs FROM documents),
chunks AS (SELECT doc_id * {CHUNK_IDS} + i AS cid, doc_id AS page, i AS ci, title, c AS text FROM (SELECT doc_id, title, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM ca)),
ctok AS (SELECT cid, {S.tokenize('text')} AS tk FROM chunks), dt AS (SELECT cid, unnest(tk) AS term FROM ctok), tf AS (SELECT cid, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT cid, len(tk) AS dl FROM ctok), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest({S.tokenize('text')}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, tf.cid, round(sum(qtf * ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM q JOIN tf USING (term) JOIN dfreq USING (term) JOIN dl ON dl.cid = tf.cid, n GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT query_id, cid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM bm) WHERE rank <= {HITS_PER_QUESTION}),
hl AS (SELECT query_id, list({{'rank': rank, 'cid': cid, 'page': page, 'ci': ci, 'title': title, 'text': text, 'norm': {S.squeeze('text')}, 'tok': {S.token_estimate('text')}}} ORDER BY rank) AS hs
    FROM hits JOIN chunks USING (cid) GROUP BY query_id),
dec AS (SELECT query_id, hs, list_reduce(hs, lambda a, h: {{
    'texts': CASE WHEN len(list_filter(a.texts, lambda x: contains(x, h.norm))) = 0 AND len(a.texts) < {rules.CONTEXT_MAX_CHUNKS} AND NOT (len(a.texts) > 0 AND a.used + h.tok > {rules.CONTEXT_BUDGET_TOKENS}) THEN list_append(a.texts, h.norm) ELSE a.texts END,
    'used': CASE WHEN len(list_filter(a.texts, lambda x: contains(x, h.norm))) = 0 AND len(a.texts) < {rules.CONTEXT_MAX_CHUNKS} AND NOT (len(a.texts) > 0 AND a.used + h.tok > {rules.CONTEXT_BUDGET_TOKENS}) THEN a.used + h.tok ELSE a.used END,
    'out': list_append(a.out, CASE WHEN len(list_filter(a.texts, lambda x: contains(x, h.norm))) > 0 THEN 'duplicate' WHEN len(a.texts) >= {rules.CONTEXT_MAX_CHUNKS} THEN 'max_chunks'
        WHEN len(a.texts) > 0 AND a.used + h.tok > {rules.CONTEXT_BUDGET_TOKENS} THEN 'budget' ELSE 'selected' END)}},
    {{'texts': []::VARCHAR[], 'used': 0::BIGINT, 'out': []::VARCHAR[]}}) AS z FROM hl),
decided AS (SELECT query_id, unnest(hs) AS h, unnest(z.out) AS decision FROM dec),
items AS (SELECT query_id, h.cid AS chunk_id, h.page AS page, h.ci AS chunk_index, h.rank AS rank, h.tok AS tokens, h.title AS title, h.text AS text,
    row_number() OVER (PARTITION BY query_id ORDER BY h.page, h.ci) AS position FROM decided WHERE decision = 'selected')"""


@query("context_selection", f"{CTX} SELECT query_id, h.cid AS chunk_id, h.rank AS rank, h.tok AS tokens, decision FROM decided")
def context_selection(t):
    return X.select_chunks(chunk_hits(t)).select("query_id", "chunk_id", "rank", "tokens", "decision")


@query(
    "context_items",
    f"{CTX} SELECT query_id, 'S' || position AS marker, chunk_id, rank, tokens, 0 AS overlap_removed FROM items",
)
def context_items(t):
    return X.context_items(X.select_chunks(chunk_hits(t))).select(
        "query_id", "marker", "chunk_id", "rank", "tokens", "overlap_removed"
    )


@query(
    "context_quality",
    f"""{CTX}, f AS (SELECT i.*, contains({S.squeeze('i.text')}, {S.squeeze('b.text')}) AS flag,
    list_filter(string_split(regexp_replace(lower(i.text), '\\s+', ' ', 'g'), ' '), lambda w: length(w) > 0) AS w FROM items i JOIN benchmark b ON b.item_id = i.query_id)
    SELECT query_id, max(flag::INT) AS evidence_in_context, round(avg(flag::INT), 4) AS context_precision, sum(tokens)::BIGINT AS context_tokens,
    round(1 - len(list_distinct(flatten(list(w)))) / len(flatten(list(w)))::DOUBLE, 4) AS redundancy FROM f GROUP BY query_id""",
)
def context_quality(t):
    items = items_of(t).join(questions(t).withColumnRenamed("text", "question"), "query_id")
    return X.context_quality(items, F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("question"))))


@query(
    "interleaved_views",
    f"""{HYBRID}, p AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5),
    a AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense) WHERE rank <= 5),
    fr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = a.query_id AND p.chunk_id = a.chunk_id)),
    u AS (SELECT query_id, chunk_id, rank AS view_rank, 0 AS view FROM p UNION ALL SELECT query_id, chunk_id, rank, 1 FROM fr)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY view_rank, view) AS rank FROM u) WHERE rank <= 6""",
)
def interleaved_views(t):
    """Lexical and dense rankings of the same question merged rank by rank."""
    scores = L.bm25_scores(pages(t), questions(t))
    lexical = top_k(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], 5).select("query_id", F.col("doc_id").alias("chunk_id"), "rank")
    dense = V.nearest(
        L.text_vectors(questions(t), "query_id").withColumn("group_id", F.lit(0)),
        L.text_vectors(pages(t), "doc_id").select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("group_id"), "embedding"),
        5, metric="dot",
    ).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    return X.interleave(materialise(lexical), materialise(dense), 6)


@query(
    "evidence_promotion",
    f"""{CTX}, b AS (SELECT query_id, min(rank) FILTER (contains(text, '!') OR contains(text, 'x')) AS b FROM hits JOIN chunks USING (cid) GROUP BY query_id)
    SELECT query_id, cid AS chunk_id, rank, CASE WHEN b IS NULL OR rank > b THEN rank WHEN rank = b THEN 1 ELSE rank + 1 END AS promoted_rank FROM hits JOIN b USING (query_id)""",
)
def evidence_promotion(t):
    hits = chunk_hits(t)
    supplies = F.contains("text", F.lit("!")) | F.contains("text", F.lit("x"))
    return X.promote(hits, supplies).select("query_id", "chunk_id", "rank", "promoted_rank")


# ---------------------------------------------------------------- sentence evidence
def unit_sql(source, keys, order):
    """CTEs ending in ``units``: one row per sentence of ``source`` (needs text, title)."""
    k = ", ".join(keys)
    return f"""ul AS (SELECT {k}, title, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS li FROM (SELECT {k}, title, {S.lines('text')} AS ls FROM {source})),
us AS (SELECT {k}, title, li, line, CASE WHEN li > 1 AND len(string_split({S.squeeze('ls[li - 1]')}, ' ')) <= 8 AND NOT regexp_matches(ls[li - 1], '[.!?:]\\s*$') THEN ls[li - 1] END AS above, {S.line_sentences('line')} AS ss FROM ul),
units AS (SELECT *, row_number() OVER (PARTITION BY {keys[0]} ORDER BY {order}, li, si) AS unit_no FROM (
    SELECT {k}, title, li, line, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS si, CASE WHEN generate_subscripts(ss, 1) = 1 THEN above END AS prev_line FROM us))"""


@query(
    "sentence_units",
    f"""WITH src AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title FROM documents), {unit_sql('src', ['doc_id'], 'doc_id')}
    SELECT doc_id, unit_no, li - 1 AS line_no, si - 1 AS sentence_no, md5(sentence) AS sentence_md5, prev_line IS NOT NULL AS has_heading FROM units""",
)
def sentence_units(t):
    """Sentence units of whole documents; numbering stays inside the document's own rows."""
    docs = t.documents.select("doc_id", "text", F.get(F.split("text", "\n"), 0).alias("title"))
    units = Ev.sentence_units(docs, ["doc_id"], "text", "title")
    order = Window.partitionBy("doc_id").orderBy("line_no", "sentence_no")
    return units.select(
        "doc_id", F.row_number().over(order).alias("unit_no"), "line_no", "sentence_no", F.md5("sentence").alias("sentence_md5"),
        F.col("prev_line").isNotNull().alias("has_heading"),
    )


def ascii_sql(expr):
    """Letters outside ASCII become ``q`` so that word boundaries mean the same in both regex engines."""
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', 'q', 'g')"


def _sql_text(pattern):
    return pattern.replace("'", "''")


QUALITY = f"""CASE WHEN norm = '' THEN true WHEN label_norm <> '' AND norm = label_norm THEN true
    WHEN regexp_matches(asx, '(?i){_sql_text(ER.PREDICATE)}') OR regexp_matches(asx, '(?i){_sql_text(ER.IMPERATIVE)}') THEN false
    WHEN NOT ended AND NOT code AND regexp_matches(clean, '{_sql_text(ER.LIST_ITEM)}') THEN true
    WHEN regexp_matches(clean, '{_sql_text(ER.SEPARATOR)}') THEN true WHEN regexp_matches(asx, '(?i){_sql_text(ER.NAVIGATION_STRICT)}') THEN true
    WHEN regexp_matches(asx, '(?i){_sql_text(ER.NAVIGATION)}') AND (numbered OR NOT ended) THEN true WHEN regexp_matches(asx, '{_sql_text(ER.OCR_DIGIT)}') THEN true
    WHEN NOT ended AND len(list_distinct(w)) <= 8 AND label_norm <> '' AND len(list_intersect(w, lw)) >= 2 AND len(list_intersect(w, lw)) / len(list_distinct(w))::DOUBLE >= 0.66 THEN true
    WHEN numbered AND NOT ended AND len(w) <= 8 THEN true
    WHEN length(compact) >= 8 AND length(regexp_replace(compact, '[^\\p{{L}}]', '', 'g')) / length(compact)::DOUBLE < 0.55 THEN true ELSE false END"""


@query(
    "sentence_quality",
    f"""WITH src AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title FROM documents), {unit_sql('src', ['doc_id'], 'doc_id')},
    c AS (SELECT doc_id, title, trim(regexp_replace({S.squeeze('sentence')}, '\\[S\\d+\\]', '', 'g')) AS clean FROM units),
    e AS (SELECT doc_id, clean, {ascii_sql('clean')} AS asx, {S.novelty_norm('clean')} AS norm, {S.novelty_norm('title')} AS label_norm, regexp_matches(clean, '[.!?]["”’)}}\\]'']*\\s*$') AS ended,
        regexp_matches({ascii_sql('clean')}, '{ER.CODE_TOKEN}') AS code, regexp_matches(regexp_replace({ascii_sql('clean')}, '[ .!?;,:"'')\\]}}]+$', ''), '(?i){ER.TRAILING_NUMBER}') AS numbered,
        regexp_replace(clean, '\\s', '', 'g') AS compact FROM c), f AS (SELECT *, string_split(norm, ' ') AS w, string_split(label_norm, ' ') AS lw FROM e)
    SELECT doc_id, count(*) AS sentences, count(*) FILTER ({QUALITY}) AS low_quality FROM f GROUP BY doc_id""",
)
def sentence_quality(t):
    docs = t.documents.select("doc_id", "text", F.get(F.split("text", "\n"), 0).alias("title"))
    # A title may be a whole text of one line: its form is made once a document, not once a sentence.
    docs = bind(docs, label_norm=T.novelty_norm(F.coalesce("title", F.lit(""))))
    units = Ev.sentence_units(docs, ["doc_id", "label_norm"], "text", "title")
    flagged = units.select("doc_id", Ev.low_quality(F.col("sentence"), F.col("title"), label_norm=F.col("label_norm")).alias("low"))
    return flagged.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if("low").alias("low_quality"))


FRAME_SQL = f"list_transform({S.quoted(rules.FRAME_WORDS)}, lambda w: {S.stem2('w')})"
SCORED = f"""{CTX}, {unit_sql('items', ['query_id', 'position', 'chunk_id', 'rank'], 'position')},
foc AS (SELECT item_id AS query_id, list_filter(list_distinct({S.terms2('text')}), lambda x: NOT list_contains({FRAME_SQL}, x)) AS focus FROM benchmark),
ut AS (SELECT u.*, focus, list_distinct(list_concat({S.terms2('sentence')}, CASE WHEN prev_line IS NULL THEN [] ELSE {S.terms2('prev_line')} END)) AS own, list_distinct({S.terms2('title')}) AS head
    FROM units u JOIN foc USING (query_id)),
scored AS (SELECT *, round(CASE WHEN len(focus) = 0 OR len(list_intersect(focus, own)) = 0 THEN 0 ELSE
    (len(list_intersect(focus, own)) + 0.5::DOUBLE * len(list_filter(list_intersect(focus, head), lambda x: NOT list_contains(own, x)))) / len(focus) END, 6) AS score FROM ut)"""


def scored_units(t):
    """Sentence units of every question's context with focus terms, own and heading terms and score."""
    asked = questions(t).select(
        "query_id", F.col("text").alias("question"), Qn.focus_terms(F.col("text")).alias("focus"),
        Qn.asked_terms(F.col("text")).alias("asked"), Qn.kinds(F.col("text")).alias("kinds"),
        Qn.question_class(F.col("text")).alias("question_class"),
    )
    # A title may be a long line: its terms are made once an item, not once a sentence.
    items = bind(items_of(t), head=F.array_distinct(T.terms2(F.col("title"))))
    units = Ev.sentence_units(items, ["query_id", "position", "marker", "chunk_id", "page", "rank", "head"], "rendered_text", "title")
    order = Window.partitionBy("query_id").orderBy("position", "line_no", "sentence_no")
    numbered = Ev.with_terms(units.withColumn("unit_no", F.row_number().over(order)), "title")
    return numbered.join(asked, "query_id").withColumn(
        "score", F.round(Ev.unit_score(F.col("own"), F.col("head"), F.col("focus")), 6)
    )


@query("evidence_scores", f"{SCORED} SELECT query_id, unit_no, chunk_id, md5(sentence) AS sentence_md5, score FROM scored")
def evidence_scores(t):
    return scored_units(t).select("query_id", "unit_no", "chunk_id", F.md5("sentence").alias("sentence_md5"), "score")


@query(
    "evidence_focus_weights",
    f"""{SCORED}, tt AS (SELECT query_id, own, head, unnest(focus) AS term FROM scored)
    SELECT query_id, term, round(greatest(0.1, ln((count(*) + 1) / (count(*) FILTER (list_contains(own, term) OR list_contains(head, term)) + 0.5::DOUBLE))), 6) AS weight FROM tt GROUP BY ALL""",
)
def evidence_focus_weights(t):
    return Ev.focus_weights(scored_units(t))


@query(
    "evidence_sufficiency",
    f"""{SCORED} SELECT f.query_id, count(s.unit_no) AS units, max(s.score) AS best, CASE WHEN any_value(len(f.focus)) = 0 THEN 'NO_QUERY_TERMS'
    WHEN count(s.unit_no) = 0 THEN 'NO_EVIDENCE' WHEN max(s.score) < {rules.EVIDENCE_TAU} THEN 'LOW_FOCUS_COVERAGE' ELSE 'SUPPORTED' END AS reason
    FROM foc f LEFT JOIN scored s ON s.query_id = f.query_id GROUP BY f.query_id""",
)
def evidence_sufficiency(t):
    asked = questions(t).select("query_id", Qn.focus_terms(F.col("text")).alias("focus"))
    return Ev.assess(scored_units(t), asked).select("query_id", "units", "best", "reason")


@query(
    "answer_units",
    f"""{SCORED}, k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, {S.novelty_norm('sentence')} AS norm FROM scored),
    d AS (SELECT * FROM k WHERE score >= greatest({rules.EVIDENCE_TAU}, {rules.EVIDENCE_KEEP_RATIO} * best) AND norm <> ''
        QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY score DESC, unit_no) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_no) AS pick FROM d QUALIFY pick <= {rules.EXTRACTIVE_MAX_SENTENCES})
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY unit_no) AS answer_line, unit_no, pick, score, md5(sentence) AS sentence_md5 FROM p""",
)
def answer_units(t):
    return Ev.select_answer_units(scored_units(t)).select(
        "query_id", "answer_line", "unit_no", "pick", "score", F.md5("sentence").alias("sentence_md5")
    )


@query(
    "complementary_sections",
    f"""{SCORED}, k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_no) AS pos FROM k WHERE score >= greatest(0.1, {rules.EVIDENCE_KEEP_RATIO} * best)),
    l AS (SELECT *, max(CASE WHEN pos = 1 THEN chunk_id END) OVER (PARTITION BY query_id) AS lead FROM r)
    SELECT query_id, unit_no, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos = 1 THEN 0 WHEN chunk_id <> lead THEN 1 ELSE 2 END, pos) AS pick FROM l
    QUALIFY pick <= {rules.EXTRACTIVE_MAX_SENTENCES}""",
)
def complementary_sections(t):
    return Ev.complementary_units(scored_units(t), "chunk_id", 0.1).select("query_id", "unit_no", "chunk_id", "pick")


EXTRACT = f"""{CTX}, {unit_sql('items', ['query_id', 'position', 'chunk_id'], 'position')}, qq AS (SELECT item_id AS query_id, list_distinct({S.terms('text')}) AS qt FROM benchmark),
cov AS (SELECT u.*, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, {S.terms('sentence')})) / len(qt)::DOUBLE END, 6) AS score FROM units u JOIN qq USING (query_id)),
kk AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM cov),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_no) AS pick FROM kk WHERE best >= {rules.EXTRACTIVE_MIN_SCORE}
    AND score >= greatest({rules.EXTRACTIVE_MIN_SCORE}, round(0.6 * best, 6)) QUALIFY pick <= {rules.EXTRACTIVE_MAX_SENTENCES})"""


@query(
    "extractive_answers",
    f"{EXTRACT} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY unit_no) AS answer_line, sentence || ' [S' || position || ']' AS line, score FROM pk",
)
def extractive_answers(t):
    """Answer lines with their citation marker, best sentences first chosen, then document order."""
    asked = questions(t).select("query_id", T.term_set(F.col("text")).alias("question_terms"))
    units = Ev.sentence_units(items_of(t), ["query_id", "position", "marker", "chunk_id"], "rendered_text", "title")
    order = Window.partitionBy("query_id").orderBy("position", "line_no", "sentence_no")
    units = units.withColumn("unit_no", F.row_number().over(order)).join(asked, "query_id")
    return Ev.extractive_sentences(units).select(
        "query_id", "answer_line", F.format_string("%s [%s]", "sentence", "marker").alias("line"), "score"
    )


@query(
    "coverage_gates",
    f"""{CTX}, c AS (SELECT i.query_id, round(CASE WHEN len(list_distinct({S.terms('b.text')})) = 0 THEN 0 ELSE
        len(list_intersect(list_distinct({S.terms('b.text')}), {S.terms('i.text')})) / len(list_distinct({S.terms('b.text')}))::DOUBLE END, 6) AS cov FROM items i JOIN benchmark b ON b.item_id = i.query_id)
    SELECT query_id, max(cov) AS best_coverage, max(cov) >= {rules.TOPIC_COVERAGE_GATE} AS topic_gate, max(cov) >= {rules.CONTEXT_COVERAGE_GATE} AS context_gate FROM c GROUP BY query_id""",
)
def coverage_gates(t):
    rows = items_of(t).join(questions(t).withColumnRenamed("text", "question"), "query_id")
    covered = rows.select("query_id", F.round(T.coverage(T.terms(F.col("question")), T.terms(F.col("text"))), 6).alias("cov"))
    return covered.groupBy("query_id").agg(F.max("cov").alias("best_coverage")).select(
        "query_id", "best_coverage", (F.col("best_coverage") >= rules.TOPIC_COVERAGE_GATE).alias("topic_gate"),
        (F.col("best_coverage") >= rules.CONTEXT_COVERAGE_GATE).alias("context_gate"),
    )


# ---------------------------------------------------------------- citations on conversations
CITED = """ans AS (SELECT conv_id, turn, ls, unnest(ls) AS body, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, {lines} AS ls FROM conversations WHERE role = 'assistant')),
cl AS (SELECT conv_id, turn, i, body, CASE WHEN i % 2 = 1 THEN i ELSE i + 1 END AS m, len(ls) AS n FROM ans), cx AS (SELECT conv_id, turn, i AS j, body AS text FROM ans)""".format(
    lines=S.lines("text")
)


def cited_answers(t):
    """Assistant messages as cited answers: odd lines cite themselves, even lines the line after them.

    Every message is checked against its own lines as the supplied chunks, so correct, misplaced and
    phantom citations all occur.
    """
    said = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", T.lines(F.col("text")).alias("ls"))
    rows = said.select("conv_id", "turn", F.posexplode("ls").alias("p", "body"))
    cited = F.when(F.col("p") % 2 == 0, F.col("p") + 1).otherwise(F.col("p") + 2)
    lines = rows.select(
        "conv_id", "turn", (F.col("p") + 1).alias("line_no"), F.format_string("%s [S%d]", "body", cited).alias("line"),
    )
    context = rows.select("conv_id", "turn", F.format_string("S%d", F.col("p") + 1).alias("marker"), F.col("body").alias("text"))
    parsed = lines.select(
        "*", Ci.expand_markers(F.col("line")).alias("markers"), Ci.malformed_markers(F.col("line")).alias("malformed"),
        Ci.claim_body(F.col("line")).alias("body"),
    )
    return parsed, context


KEY = ["conv_id", "turn"]


@query(
    "citation_markers",
    f"WITH {CITED} SELECT conv_id, turn, i AS line_no, 'S' || m AS markers, length(body) AS body_chars, m > n AS phantom FROM cl",
)
def citation_markers(t):
    lines, context = cited_answers(t)
    known = context.select(*KEY, F.col("marker").alias("known"))
    joined = lines.select(*KEY, "line_no", "body", F.array_join("markers", ",").alias("markers")).join(
        known.withColumn("hit", F.lit(True)), (lines.conv_id == known.conv_id) & (lines.turn == known.turn) & (F.col("markers") == F.col("known")), "left"
    )
    return joined.select(
        lines.conv_id, lines.turn, "line_no", "markers", F.length("body").alias("body_chars"), F.col("hit").isNull().alias("phantom")
    )


@query(
    "cited_sentences",
    f"""WITH {CITED}, s AS (SELECT conv_id, turn, i, body || ' [S' || m || ']' AS line FROM cl)
    SELECT conv_id, turn, sum(len(regexp_extract_all(line, '\\[S\\d+\\]')))::BIGINT AS markers FROM s GROUP BY ALL""",
)
def cited_sentences(t):
    lines, _ = cited_answers(t)
    answers = lines.select(*KEY, "line")
    rows = answers.select(*KEY, F.explode(T.split_cited_sentences(F.col("line"))).alias("sentence"))
    return rows.groupBy(*KEY).agg(F.sum(F.size(T.citation_markers(F.col("sentence")))).alias("markers"))


GROUND = f"""WITH {CITED}, g AS (SELECT cl.*, cx.text AS ct FROM cl LEFT JOIN cx ON cx.conv_id = cl.conv_id AND cx.turn = cl.turn AND cx.j = cl.m),
gt AS (SELECT *, list_distinct({S.terms('body')}) AS bt, CASE WHEN ct IS NULL THEN [] ELSE {S.terms('ct')} END AS tt FROM g),
gs AS (SELECT *, round(CASE WHEN len(bt) = 0 THEN 1 ELSE len(list_intersect(bt, tt)) / len(bt)::DOUBLE END, 6) AS support FROM gt)"""


@query(
    "grounding_check",
    f"""{GROUND} SELECT conv_id, turn, i AS line_no, support, concat_ws(',', CASE WHEN ct IS NULL THEN 'PHANTOM_MARKER' END, CASE WHEN NOT regexp_matches(body, '[\\p{{L}}\\p{{N}}_]') THEN 'NO_CLAIM_BODY' END,
    CASE WHEN ct IS NULL THEN 'NO_CITATION' END, CASE WHEN len(list_filter({S.code_tokens('body')}, lambda c: ct IS NULL OR NOT contains(ct, c))) > 0 THEN 'TOKEN_NOT_IN_CITED_CHUNK' END,
    CASE WHEN ct IS NOT NULL AND support < {rules.SENTENCE_SUPPORT} THEN 'LOW_SUPPORT' END) AS violations FROM gs""",
)
def grounding_check(t):
    lines, context = cited_answers(t)
    return Ci.grounding(lines, context, KEY).select(*KEY, "line_no", "support", F.array_join("violations", ",").alias("violations"))


@query(
    "support_chain",
    f"""{GROUND} SELECT conv_id, turn, i AS line_no, concat_ws(',', CASE WHEN ct IS NULL THEN 'PHANTOM_MARKER' END,
    CASE WHEN ct IS NULL OR NOT (contains(lower({S.squeeze('ct')}), lower({S.squeeze('body')})) OR contains(lower({S.squeeze('ct')}), trim(regexp_replace(lower({S.squeeze('body')}), '^[-*•]\\s*', '')))) THEN 'NO_VERBATIM_SOURCE_MATCH' END) AS errors FROM gs""",
)
def support_chain(t):
    lines, context = cited_answers(t)
    return Ci.support_chain(lines, context, KEY)


@query("citation_repair")
def citation_repair(t):
    lines, context = cited_answers(t)
    return Ci.repair(lines, context, KEY)


@query(
    "citation_assembly",
    f"""WITH {CITED}, c AS (SELECT conv_id, turn, m, count(*) AS n FROM cl GROUP BY ALL)
    SELECT coalesce(x.conv_id, c.conv_id) AS conv_id, coalesce(x.turn, c.turn) AS turn, 'S' || coalesce(x.j, c.m) AS marker, coalesce(n, 0) AS citations,
    CASE WHEN x.j IS NULL THEN 'phantom' WHEN n IS NULL THEN 'supplied_only' ELSE 'cited' END AS state
    FROM cx x FULL JOIN c ON x.conv_id = c.conv_id AND x.turn = c.turn AND x.j = c.m""",
)
def citation_assembly(t):
    lines, context = cited_answers(t)
    return Ci.citation_assembly(lines, context, KEY)


@query(
    "citation_metrics",
    f"""WITH {CITED} SELECT conv_id, turn, count(*) AS lines, 1.0::DOUBLE AS citation_coverage, round(count(*) FILTER (m <= n) / count(*)::DOUBLE, 6) AS citation_precision FROM cl GROUP BY ALL""",
)
def citation_metrics(t):
    lines, context = cited_answers(t)
    return Ci.citation_metrics(lines, context, KEY)


@query(
    "documentation_coverage",
    f"""WITH {CITED} SELECT conv_id, turn, count(DISTINCT m) FILTER (m <= n) AS cited, any_value(n) AS sources,
    least(100.0, round(count(DISTINCT m) FILTER (m <= n) / any_value(n)::DOUBLE * 100, 1)) AS coverage_pct FROM cl GROUP BY ALL""",
)
def documentation_coverage(t):
    lines, context = cited_answers(t)
    state = Ci.citation_assembly(lines, context, KEY)
    return state.groupBy(*KEY).agg(
        F.count_if(F.col("state") == "cited").alias("cited"), F.count_if(F.col("state") != "phantom").alias("sources")
    ).withColumn("coverage_pct", Ci.documentation_coverage(F.col("cited"), F.col("sources")))


@query(
    "answer_sections",
    f"""WITH {CITED}, f AS (SELECT conv_id, turn, min(i) AS i FROM cl GROUP BY conv_id, turn, trim(body)) SELECT conv_id, turn, 'overview' AS section, count(*) AS lines, min(i) AS first_line FROM f GROUP BY ALL""",
)
def answer_sections(t):
    lines, _ = cited_answers(t)
    return Ci.structured_sections(lines.select(*KEY, "line_no", "line"), KEY)


FACT_SQL = "trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "key_fact_recall",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {FACT_SQL.format(x='a.text')} AS ans, {S.lines('u.text')} AS facts FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
    f AS (SELECT conv_id, turn, ans, unnest(facts) AS fact FROM p), g AS (SELECT *, {FACT_SQL.format(x='fact')} AS nf FROM f),
    h AS (SELECT *, list_filter(string_split(nf, ' '), lambda w: length(w) > 2 AND NOT list_contains({S.quoted(rules.STOP_WORDS)}, w)) AS w FROM g)
    SELECT conv_id, turn, count(*) AS facts, count(*) FILTER (contains(ans, nf) OR (len(w) > 0 AND len(list_filter(w, lambda x: contains(ans, x))) = len(w))) AS recalled FROM h GROUP BY ALL""",
)
def key_fact_recall(t):
    """Lines of the message before an answer are the expected facts."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), T.lines(F.col("text")).alias("facts"))
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    joined = bind(answers.join(before, KEY), ans=Ci.fact_norm(F.col("text")))
    rows = joined.select(*KEY, "ans", F.explode("facts").alias("fact"))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("facts"), F.count_if(Ci.fact_recalled(F.col("ans"), F.col("fact"))).alias("recalled")
    )


@query(
    "prohibited_claims",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {FACT_SQL.format(x='a.text')} AS ans, {FACT_SQL.format(x='u.text')} AS claim FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
    s AS (SELECT *, list_transform(list_filter(string_split(claim, ' '), lambda w: length(w) > 2 AND NOT list_contains({S.quoted(rules.STOP_WORDS)}, w)), lambda w: {S.stem2('w')}) AS cs,
        list_transform(list_filter(string_split(ans, ' '), lambda w: length(w) > 2 AND NOT list_contains({S.quoted(rules.STOP_WORDS)}, w)), lambda w: {S.stem2('w')}) AS av FROM p)
    SELECT conv_id, turn, CASE WHEN len(cs) = 0 THEN contains(ans, claim) ELSE len(list_filter(cs, lambda x: list_contains(av, x))) >= greatest(2, floor(0.75 * len(cs))) OR contains(ans, claim) END AS detected FROM s""",
)
def prohibited_claims(t):
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("claim"))
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    joined = bind(answers.join(before, KEY), ans=Ci.fact_norm(F.col("text")))
    return joined.select(*KEY, Ci.claim_detected(F.col("ans"), F.col("claim")).alias("detected"))


NOVEL = f"""WITH s AS (SELECT conv_id, turn, unnest({S.split_sentences('text')}) AS sentence FROM conversations WHERE role = 'assistant'),
n AS (SELECT *, {S.novelty_norm('sentence')} AS norm FROM s), tm AS (SELECT *, list_distinct({S.terms2('norm')}) AS ts FROM n),
j AS (SELECT a.conv_id, a.turn, a.sentence, bool_or(coalesce(a.norm = b.norm OR (len(list_intersect(a.ts, b.ts)) >= 5 AND len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts)))::DOUBLE >= 0.72)
    OR (len(list_intersect(a.ts, b.ts)) >= 4 AND len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts))::DOUBLE >= 0.90), false)) AS rep
    FROM tm a LEFT JOIN tm b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2 GROUP BY ALL)"""


@query("novel_sentences", f"{NOVEL} SELECT conv_id, turn, sentence, rep AS repeated FROM j")
def novel_sentences(t):
    """Sentences of an answer that the previous answer of the conversation already gave."""
    said = t.conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.explode(T.split_sentences(F.col("text"))).alias("sentence")
    )
    earlier = said.withColumn("turn", F.col("turn") + 2)
    return Ev.novel_sentences(said, earlier, KEY).select(*KEY, "sentence", "repeated").distinct()
