"""Lexical, hybrid and phrase queries: ``benchmark`` texts are the questions, ``documents`` the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.operators import lexical as L, metrics as M, phrases as P, rerank as R, similarity as V
from corpusweave.operators.ordering import top_k
from corpusweave.plans import sqlkit as S
from corpusweave.plans.registry import query
from corpusweave.session import materialise


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def pages(t):
    return t.documents.select("doc_id", "text")


BM25 = f"""WITH dt AS (SELECT doc_id, unnest({S.tokenize('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc_id, len({S.tokenize('text')}) AS dl FROM documents),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest({S.tokenize('text')}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {rules.BM25_K1 + 1}::DOUBLE
    / (tf + {rules.BM25_K1}::DOUBLE * (1 - {rules.BM25_B}::DOUBLE + {rules.BM25_B}::DOUBLE * dl / avgdl))), 6) AS score
    FROM q JOIN tf USING (term) JOIN dfreq USING (term) JOIN dl ON dl.doc_id = tf.doc_id, n GROUP BY 1, 2)"""


@query("bm25_scores", f"{BM25} SELECT query_id, doc_id, score FROM bm")
def bm25_scores(t):
    return L.bm25_scores(pages(t), questions(t))


@query(
    "bm25_topk",
    f"""{BM25}, every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN documents d
    LEFT JOIN bm ON bm.query_id = b.item_id AND bm.doc_id = d.doc_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every) WHERE rank <= 10""",
)
def bm25_topk(t):
    scores = materialise(L.bm25_scores(pages(t), questions(t)))
    return L.bm25_topk(scores, pages(t), questions(t), 10)


@query(
    "corpus_term_stats",
    f"""WITH dt AS (SELECT doc_id, unnest({S.tokenize('text')}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM dt
    WHERE term IN (SELECT unnest({S.tokenize('text')}) FROM benchmark) GROUP BY term""",
)
def corpus_term_stats(t):
    tf = L.term_frequencies(pages(t), L.query_term_counts(questions(t)))
    return tf.filter(F.col("term") != L.CORPUS_ROW).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences")
    )


HASHED = f"""hv AS (SELECT k, id, list_transform(c, lambda x: CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE round(x / sqrt(z::DOUBLE), 6)::FLOAT::DOUBLE END) AS e FROM (
SELECT k, id, c, list_sum(list_transform(c, lambda x: x * x)) AS z FROM (SELECT k, id, list_transform(range({L.HASH_DIMS}), lambda d: len(list_filter(b, lambda y: y = d))) AS c FROM (
SELECT k, id, list_transform({S.tokenize('text')}, lambda w: ('0x' || substr(md5(w), 1, 6))::INT % {L.HASH_DIMS}) AS b FROM (
SELECT 'q' AS k, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents))))),
dense AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_inner_product(q.e, d.e), 6) AS score FROM hv q, hv d WHERE q.k = 'q' AND d.k = 'd')"""
HYBRID = f"""{BM25}, {HASHED}, pairs AS (SELECT dense.query_id, dense.doc_id, dense.score AS d, coalesce(bm.score, 0) AS l FROM dense LEFT JOIN bm USING (query_id, doc_id)),
normed AS (SELECT query_id, doc_id, CASE WHEN max(d) OVER w - min(d) OVER w < 1e-12 THEN 0 ELSE (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) END AS d,
CASE WHEN max(l) OVER w - min(l) OVER w < 1e-12 THEN 0 ELSE (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) END AS l FROM pairs WINDOW w AS (PARTITION BY query_id)),
mixed AS (SELECT w AS weight, query_id, doc_id, round(w * d + (1 - w) * l, 6) AS score FROM normed, (SELECT unnest([1.0, 0.75, 0.5, 0.25, 0.0])::DOUBLE AS w)),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, doc_id) AS rank FROM mixed) WHERE rank <= 10)"""
WEIGHTS = (1.0, *rules.HYBRID_WEIGHTS, 0.0)


def hybrid(t, k=10):
    scores = materialise(L.bm25_scores(pages(t), questions(t)))
    lexical = L.minmax(scores, t.documents.count())
    return L.hybrid_topk(lexical, L.text_vectors(questions(t), "query_id"), L.text_vectors(pages(t), "doc_id"), WEIGHTS, k)


@query("hybrid_topk", f"{HYBRID} SELECT weight, query_id, doc_id, score, rank FROM hyb")
def hybrid_topk(t):
    return hybrid(t).select("weight", "query_id", "doc_id", "score", "rank")


GOLD = f"""gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d
ON contains({S.squeeze('d.text')}, {S.squeeze('b.text')}))"""
FIRST = f"""{HYBRID}, {GOLD}, first_rank AS (SELECT weight, g.query_id, min(rank) AS rank FROM gold g JOIN (SELECT unnest([1.0, 0.75, 0.5, 0.25, 0.0])::DOUBLE AS weight) ON true
LEFT JOIN hyb USING (weight, query_id, doc_id) GROUP BY ALL)"""


def first_ranks(t):
    """Best rank of a page that contains the question's passage, per system; NULL when it is not in the top ten."""
    gold = P.verbatim_pages(questions(t), pages(t))
    hits = hybrid(t).join(gold, ["query_id", "doc_id"]).groupBy("weight", "query_id").agg(F.min("rank").alias("rank"))
    systems = t.spark.range(1).select(F.explode(F.array(*[F.lit(float(w)) for w in WEIGHTS])).alias("weight"))
    every = gold.select("query_id").distinct().crossJoin(F.broadcast(systems))  # five fixed rows
    return every.join(hits, ["weight", "query_id"], "left")


@query(
    "hybrid_metrics",
    f"""{FIRST} SELECT weight, count(*) AS questions, round(avg((coalesce(rank, 99) <= 1)::INT), 4) AS recall_1, round(avg((coalesce(rank, 99) <= 3)::INT), 4) AS recall_3,
    round(avg((coalesce(rank, 99) <= 5)::INT), 4) AS recall_5, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 4) AS mrr, count(*) FILTER (rank = 1) AS hits_1
    FROM first_rank GROUP BY weight""",
)
def hybrid_metrics(t):
    return M.ranking_metrics(first_ranks(t), "rank", [["weight"]])


PAIRED = f"""{FIRST}, p AS (SELECT o.weight, coalesce(b.rank, 11) AS b, coalesce(o.rank, 11) AS o FROM first_rank o JOIN first_rank b ON b.query_id = o.query_id AND b.weight = 1.0 WHERE o.weight < 1.0),
c AS (SELECT weight, count(*) FILTER (o < b) AS improved, count(*) FILTER (o > b) AS worsened, count(*) FILTER (o = b) AS unchanged,
count(*) FILTER (b = 1 AND o > 1) AS lost_rank1, count(*) FILTER (b > 1 AND o = 1) AS gained_rank1 FROM p GROUP BY weight)"""
SIGN = """CASE WHEN improved + worsened = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(improved, worsened) + 1),
lambda i: exp(lgamma(improved + worsened + 1) - lgamma(i + 1) - lgamma(improved + worsened - i + 1) - (improved + worsened) * ln(2))))), 4) END"""


def paired(t):
    ranks = first_ranks(t).withColumn("rank", F.coalesce("rank", F.lit(11)))
    base = ranks.filter("weight = 1.0").select("query_id", F.col("rank").alias("base"))
    pairs = ranks.filter("weight < 1.0").join(base, "query_id")
    return M.paired_counts(pairs, "base", "rank", ["weight"])


@query("paired_systems", f"{PAIRED} SELECT *, {SIGN} AS sign_test_p FROM c")
def paired_systems(t):
    return paired(t)


@query(
    "adoption_rule",
    f"""{PAIRED} SELECT weight, improved > worsened AS more_improved, {SIGN} <= 0.1 AS significant, lost_rank1 <= gained_rank1 AS rank1_kept,
    improved > worsened AND {SIGN} <= 0.1 AND lost_rank1 <= gained_rank1 AS adopt FROM c""",
)
def adoption_rule(t):
    """A system is adopted only when every declared criterion passes."""
    c = paired(t).select(
        "weight", (F.col("improved") > F.col("worsened")).alias("more_improved"),
        (F.col("sign_test_p") <= 0.1).alias("significant"), (F.col("lost_rank1") <= F.col("gained_rank1")).alias("rank1_kept"),
    )
    return c.withColumn("adopt", F.col("more_improved") & F.col("significant") & F.col("rank1_kept"))


@query(
    "rare_term_slices",
    f"""{BM25}, {GOLD}, s AS (SELECT b.item_id AS query_id, len(list_filter(string_split({S.squeeze('b.text')}, ' '), lambda w: length(w) > 0)) AS words FROM benchmark b)
    SELECT s.query_id, words, CASE WHEN words <= 4 THEN 'very_short' WHEN words <= 7 THEN 'short' WHEN words <= 20 THEN 'long' ELSE 'very_long' END AS length_bucket,
    EXISTS (SELECT 1 FROM q JOIN dfreq USING (term) JOIN tf USING (term) JOIN gold g ON g.doc_id = tf.doc_id AND g.query_id = q.query_id
        WHERE q.query_id = s.query_id AND df <= {rules.RARE_DF_MAX}) AS rare_term FROM s""",
)
def rare_term_slices(t):
    """Evaluation slices: length bucket, and whether a gold page holds a query term found in at most two pages."""
    asked = L.query_term_counts(questions(t))
    tf = materialise(L.term_frequencies(pages(t), asked)).filter(F.col("term") != L.CORPUS_ROW)
    rare = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= rules.RARE_DF_MAX)
    gold = P.verbatim_pages(questions(t), pages(t))
    hit = (
        asked.join(rare, "term").join(tf.select("doc_id", "term"), "term").join(gold, ["query_id", "doc_id"])
        .select("query_id").distinct().withColumn("rare_term", F.lit(True))
    )
    sized = questions(t).select("query_id", T.word_count(F.col("text")).alias("words"))
    return sized.join(hit, "query_id", "left").select(
        "query_id", "words", L.length_bucket(F.col("words")).alias("length_bucket"),
        F.coalesce("rare_term", F.lit(False)).alias("rare_term"),
    )


@query(
    "phrase_list",
    f"""WITH tk AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda w: length(w) >= 3) AS tk FROM benchmark),
    g AS (SELECT query_id, list_concat(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i + 2], ' ')),
        list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i + 1], ' '))) AS g FROM tk),
    u AS (SELECT query_id, unnest(g) AS phrase, generate_subscripts(g, 1) AS p FROM g),
    f AS (SELECT query_id, phrase, min(p) AS p FROM u GROUP BY ALL)
    SELECT query_id, phrase, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS phrase_no FROM f QUALIFY phrase_no < {rules.PHRASE_MAX}""",
)
def phrase_list(t):
    return P.query_phrases(questions(t)).select("query_id", "phrase", "phrase_no")


PHRASES = f"""WITH tk AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda w: length(w) >= 3) AS tk FROM benchmark),
g AS (SELECT query_id, list_concat(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i + 2], ' ')),
    list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i + 1], ' '))) AS g FROM tk),
u AS (SELECT query_id, unnest(g) AS phrase, generate_subscripts(g, 1) AS p FROM g), f AS (SELECT query_id, phrase, min(p) AS p FROM u GROUP BY ALL),
ph AS (SELECT query_id, phrase FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= {rules.PHRASE_MAX})"""


@query(
    "phrase_pages",
    f"""{PHRASES} SELECT phrase, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page
    FROM (SELECT DISTINCT phrase FROM ph) JOIN documents d ON contains(lower(d.text), phrase) GROUP BY phrase""",
)
def phrase_pages(t):
    """Substring containment of every question phrase in every page, through n-gram keys."""
    return P.phrase_pages(P.query_phrases(questions(t)), pages(t)).groupBy("phrase").agg(
        F.count("*").alias("pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page")
    )


OWNERS = f"""{PHRASES}, own AS (SELECT phrase, min(doc_id) AS doc_id FROM (SELECT DISTINCT phrase FROM ph) JOIN documents d
ON contains(lower(d.text), phrase) GROUP BY phrase HAVING count(*) = 1),
owners AS (SELECT query_id, doc_id, count(*) AS phrases, sum(CASE WHEN length(phrase) >= {rules.STRONG_PHRASE_CHARS} THEN 2 ELSE 1 END)::BIGINT AS weight
FROM ph JOIN own USING (phrase) GROUP BY ALL HAVING sum(CASE WHEN length(phrase) >= {rules.STRONG_PHRASE_CHARS} THEN 2 ELSE 1 END) >= {rules.PHRASE_CORROBORATION})"""


@query("phrase_owners", f"{OWNERS} SELECT query_id, doc_id, phrases, weight FROM owners")
def phrase_owners(t):
    return P.unique_owners(P.query_phrases(questions(t)), pages(t))


@query(
    "code_pages",
    f"""WITH c AS (SELECT DISTINCT query_id, lower(unnest({S.code_tokens('text')})) AS word FROM (
        SELECT conv_id * 1000 + turn AS query_id, text FROM conversations)),
    w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS word FROM documents)
    SELECT query_id, doc_id, count(*) AS codes FROM c JOIN w USING (word) GROUP BY ALL""",
)
def code_pages(t):
    """Identifiers of every conversation turn as whole words of the documents."""
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return P.code_pages(turns, pages(t))


@query(
    "candidate_injection",
    f"""WITH {HASHED}, pool AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense) WHERE rank <= {rules.TOP_K_CARDS}),
    wl AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(text, '[a-z0-9_-]+'), lambda w: length(w) > 2 AND NOT list_contains({S.quoted(rules.STOP_WORDS)}, w)) AS tk FROM benchmark),
    g AS (SELECT query_id, list_concat(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i + 2], ' ')), list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i + 1], ' '))) AS g FROM wl),
    ph AS (SELECT query_id, unnest(g) AS phrase, generate_subscripts(g, 1) AS p FROM g),
    pg AS (SELECT phrase, d.doc_id FROM (SELECT DISTINCT phrase FROM ph) JOIN documents d ON contains(lower(d.text), phrase)),
    rare AS (SELECT phrase FROM pg GROUP BY phrase HAVING count(*) <= 2),
    c AS (SELECT DISTINCT item_id AS query_id, lower(unnest({S.code_tokens('text')})) AS word FROM benchmark),
    w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS word FROM documents),
    m AS (SELECT query_id, doc_id, min([1, p, doc_id]) AS o FROM ph JOIN pg USING (phrase) JOIN rare USING (phrase) GROUP BY ALL
        UNION ALL SELECT DISTINCT query_id, doc_id, [0, 0, doc_id] FROM c JOIN w USING (word)),
    m2 AS (SELECT query_id, doc_id, min(o) AS o FROM m WHERE NOT EXISTS (SELECT 1 FROM pool WHERE pool.query_id = m.query_id AND pool.doc_id = m.doc_id) GROUP BY ALL),
    cnt AS (SELECT query_id, count(*) AS m, arg_max(doc_id, o) AS last FROM m2 GROUP BY query_id)
    SELECT p.query_id, p.doc_id, p.rank, false AS injected FROM pool p LEFT JOIN cnt USING (query_id) WHERE m IS NULL OR p.rank < {rules.TOP_K_CARDS}
    UNION ALL SELECT query_id, last, {rules.TOP_K_CARDS}, true FROM cnt""",
)
def candidate_injection(t):
    """Dense pool of fifteen, then identifier and rare-phrase matches take its last slot."""
    docs, asked = pages(t), questions(t)
    pool = V.nearest(
        L.text_vectors(asked, "query_id").withColumn("group_id", F.lit(0)),
        L.text_vectors(docs, "doc_id").select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("group_id"), "embedding"),
        rules.TOP_K_CARDS, metric="dot",
    ).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    matched = P.code_matches(asked, docs).unionByName(P.rare_phrase_pages(P.injection_phrases(asked), docs))
    return P.inject(materialise(pool), matched, rules.TOP_K_CARDS)


@query(
    "contamination_runs",
    f"""WITH qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
    dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    qs AS (SELECT query_id, len(w) AS qn, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s, unnest(range(1, len(w) - 3)) AS q FROM qw WHERE len(w) >= 5),
    ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s, unnest(range(1, len(w) - 3)) AS d FROM dw WHERE len(w) >= 5),
    h AS (SELECT query_id, doc_id, q, qn, d - q AS dia, q - row_number() OVER (PARTITION BY query_id, doc_id, d - q ORDER BY q) AS isl FROM qs JOIN ds USING (s)),
    r AS (SELECT query_id, doc_id, count(*) + 4 AS run, any_value(qn) AS qn FROM h GROUP BY query_id, doc_id, dia, isl)
    SELECT query_id, doc_id, max(run) AS longest_run, any_value(qn) AS q_words FROM r GROUP BY ALL""",
)
def contamination_runs(t):
    return P.shared_runs(questions(t), pages(t), 5)


@query("verbatim_evidence", f"WITH {GOLD} SELECT query_id, doc_id FROM gold")
def verbatim_evidence(t):
    return P.verbatim_pages(questions(t), pages(t))


@query(
    "partial_word_quotes",
    f"""WITH b AS (SELECT item_id, {S.squeeze('text')} AS t FROM benchmark), q AS (SELECT item_id * 4 + n AS query_id, {S.squeeze("substr(t, (length(t) * n) // 4 + 1, [3, 9, 15, 24][n + 1])")} AS quote FROM b, range(4) AS r(n))
    SELECT query_id, doc_id FROM q JOIN (SELECT doc_id, {S.squeeze('text')} AS page FROM documents) ON quote <> '' AND contains(page, quote)""",
)
def partial_word_quotes(t):
    """Four short quotes cut out of each benchmark text, mostly within words: the documents that hold them."""
    text = T.normalize_ws(F.col("text"))
    n = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(size).alias("size")) for n, size in enumerate((3, 9, 15, 24))])).alias("p")
    cut = t.benchmark.select("item_id", text.alias("t"), n)
    start = (F.floor(F.char_length("t") * F.col("p.n") / 4) + 1).cast("int")
    quotes = cut.select((F.col("item_id") * 4 + F.col("p.n")).alias("query_id"), F.col("t").substr(start, F.col("p.size")).alias("text"))
    return P.verbatim_pages(quotes, pages(t))


TITLE = "string_split(d.text, chr(10))[1]"


@query(
    "lexical_rerank",
    f"""WITH {HASHED}, cand AS (SELECT * FROM (SELECT query_id, doc_id, round(2 - 2 * score, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM dense)
        WHERE r <= {rules.CANDIDATE_K} AND distance <= {rules.MAX_SQUARED_L2}),
    qt AS (SELECT item_id AS query_id, {S.query_terms('text')} AS qt FROM benchmark),
    sc AS (SELECT c.query_id, c.doc_id, sha256(d.text) AS fp, d.source || '/' || d.doc_id AS url, 0.6::DOUBLE * greatest(0.0, 1 - distance)
        + 0.3::DOUBLE * CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, string_split({S.normalize_text(TITLE)}, ' '))) / len(qt)::DOUBLE END
        + 0.1::DOUBLE * CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, string_split({S.normalize_text('d.text')}, ' '))) / len(qt)::DOUBLE END AS f
        FROM cand c JOIN qt USING (query_id) JOIN documents d ON d.doc_id = c.doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 5) DESC, length(url), url) AS pos FROM sc),
    one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, fp ORDER BY pos) = 1)
    SELECT query_id, doc_id, round(f, 5) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM one QUALIFY rank <= {rules.TOP_K}""",
)
def lexical_rerank(t):
    """Dense candidates within the distance limit, lexical rerank, one row per distinct content, top three."""
    asked, docs = questions(t), pages(t)
    hits = V.nearest(
        L.text_vectors(asked, "query_id").withColumn("group_id", F.lit(0)),
        L.text_vectors(docs, "doc_id").select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("group_id"), "embedding"),
        rules.CANDIDATE_K, metric="dot",
    )
    candidates = hits.select(
        "query_id", F.col("vec_id").alias("doc_id"), F.round(2.0 - 2.0 * F.col("score"), 6).alias("distance")
    ).filter(F.col("distance") <= rules.MAX_SQUARED_L2)
    about = t.documents.select(
        "doc_id", F.get(F.split("text", "\n"), 0).alias("title"), F.col("text").alias("body"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"), F.sha2("text", 256).alias("fingerprint"),
    )
    rows = candidates.join(about, "doc_id").join(asked.withColumnRenamed("text", "question"), "query_id")
    scored = R.lexical_scores(rows, "question", "title", "body", "distance")
    return R.one_per_source(scored, "query_id", "fingerprint", "url", rules.TOP_K).select(
        "query_id", "doc_id", F.round("final_score", 5).alias("final_score"), "rank"
    )


@query(
    "evidence_rerank",
    f"""{OWNERS}, {HASHED}, pool AS (SELECT * FROM (SELECT query_id, doc_id, score AS card, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM dense) WHERE r <= {rules.TOP_K_CARDS}),
    cc AS (SELECT doc_id, unnest({S.chunk_list('text')}) AS chunk FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)),
    ch AS (SELECT row_number() OVER () AS cid, doc_id, chunk FROM cc),
    cv AS (SELECT cid, doc_id, list_transform(c, lambda x: CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE round(x / sqrt(z::DOUBLE), 6)::FLOAT::DOUBLE END) AS e FROM (SELECT cid, doc_id, c, list_sum(list_transform(c, lambda x: x * x)) AS z FROM (
        SELECT cid, doc_id, list_transform(range({L.HASH_DIMS}), lambda d: len(list_filter(b, lambda y: y = d))) AS c FROM (SELECT cid, doc_id, list_transform({S.tokenize('chunk')}, lambda w: ('0x' || substr(md5(w), 1, 6))::INT % {L.HASH_DIMS}) AS b FROM ch)))),
    ps AS (SELECT p.query_id, p.doc_id, max(round(list_inner_product(q.e, cv.e), 6)) AS page FROM pool p JOIN hv q ON q.k = 'q' AND q.id = p.query_id JOIN cv ON cv.doc_id = p.doc_id GROUP BY ALL),
    feat AS (SELECT p.query_id, p.doc_id, p.r, card, coalesce(page, 0) AS page, {S.terms('b.text')} AS qt, {S.terms('d.text')} AS dt, {S.terms(TITLE)} AS tt,
        (l.toxic IS NULL OR l.toxic = 0) AS ingested, (o.doc_id IS NOT NULL) AS phrase, EXISTS (SELECT 1 FROM owners o2 WHERE o2.query_id = p.query_id) AS regime
        FROM pool p LEFT JOIN ps USING (query_id, doc_id) JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.doc_id
        LEFT JOIN labels l ON l.doc_id = p.doc_id LEFT JOIN owners o ON o.query_id = p.query_id AND o.doc_id = p.doc_id),
    s AS (SELECT query_id, doc_id, r, card, round(CASE WHEN NOT ingested THEN (CASE WHEN regime THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END) * card - 0.1::DOUBLE ELSE
        (CASE WHEN regime THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END) * card + 0.4::DOUBLE * page
        + 0.1::DOUBLE * (CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qt), dt)) / len(list_distinct(qt))::DOUBLE END)
        + (CASE WHEN regime AND phrase THEN 0.12::DOUBLE ELSE 0 END)
        + (CASE WHEN len(tt) > 0 AND len(qt) > 0 THEN 0.10::DOUBLE * len(list_intersect(list_distinct(qt), tt)) / len(list_distinct(tt)) ELSE 0 END)
        + (CASE WHEN len(tt) > 0 AND len(qt) > 0 THEN 0.16::DOUBLE * len(list_intersect(list_distinct(qt), tt)) / len(list_distinct(qt)) ELSE 0 END) END, 8) AS final_score FROM feat)
    SELECT query_id, doc_id, r AS initial_rank, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, card DESC, r) AS rank FROM s""",
)
def evidence_rerank(t):
    """Fifteen dense candidates reranked by page evidence, coverage, unique phrases and title overlap."""
    asked, docs = questions(t), pages(t)
    asked_vectors = L.text_vectors(asked, "query_id")
    hits = V.nearest(
        asked_vectors.withColumn("group_id", F.lit(0)),
        L.text_vectors(docs, "doc_id").select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("group_id"), "embedding"),
        rules.TOP_K_CARDS, metric="dot",
    )
    pool = materialise(
        hits.select("query_id", F.col("vec_id").alias("doc_id"), F.col("rank").alias("initial_rank"), F.col("score").alias("card_similarity"))
    )
    page_scores = R.page_similarity(pool, asked_vectors, docs, digits=6)
    owners = P.unique_owners(P.query_phrases(asked), docs)
    facts = t.documents.select("doc_id", "text", F.get(F.split("text", "\n"), 0).alias("title")).join(
        t.labels.select("doc_id", "toxic"), "doc_id", "left"
    )
    rows = (
        pool.join(page_scores, ["query_id", "doc_id"], "left")
        .join(owners.select("query_id", "doc_id", F.lit(1.0).alias("phrase_match")), ["query_id", "doc_id"], "left")
        .join(owners.select("query_id", F.lit(True).alias("tech_regime")).distinct(), "query_id", "left")
        .join(facts, "doc_id").join(asked.withColumnRenamed("text", "question"), "query_id")
    )
    rows = rows.select(
        "*", F.coalesce("toxic", F.lit(0)).alias("_toxic"),
    ).withColumn("ingested", F.col("_toxic") == 0).withColumn("resolved", F.lit(True))
    return R.evidence_scores(rows, digits=8, coverage_digits=None).select("query_id", "doc_id", "initial_rank", "final_score", "rank")
