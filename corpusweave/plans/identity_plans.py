"""Hierarchy, plan and identity queries on regions, orders, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import hierarchy as H, identity as I
from corpusweave.plans.registry import query

EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_name AS name FROM nation UNION ALL
SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_name FROM supplier)"""


def edges(t):
    def tag(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    nations = t.nation.select(tag("r", "n_regionkey").alias("parent"), tag("n", "n_nationkey").alias("child"), F.col("n_name").alias("name"))
    customers = t.customer.select(tag("n", "c_nationkey").alias("parent"), tag("c", "c_custkey").alias("child"), F.col("c_name").alias("name"))
    suppliers = t.supplier.select(tag("n", "s_nationkey").alias("parent"), tag("s", "s_suppkey").alias("child"), F.col("s_name").alias("name"))
    return nations.unionByName(customers).unionByName(suppliers)


@query(
    "hierarchy_descendants",
    f"""WITH RECURSIVE {EDGES}, d AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance, name AS path FROM edges UNION ALL
    SELECT d.ancestor, e.child, d.distance + 1, d.path || ' > ' || e.name FROM d JOIN edges e ON e.parent = d.descendant) SELECT * FROM d""",
)
def hierarchy_descendants(t):
    return H.descendants(edges(t))


@query(
    "hierarchy_depth_limit",
    f"""WITH {EDGES} SELECT parent AS ancestor, count(*) AS children FROM edges GROUP BY parent""",
)
def hierarchy_depth_limit(t):
    return H.descendants(edges(t), max_depth=1).groupBy("ancestor").agg(F.count("*").alias("children"))


REFERENCES = """refs AS (SELECT l_suppkey AS page_id, o_orderpriority AS topic_id, CASE WHEN l_linenumber = 1 THEN 'topic_page' ELSE 'descendant' END AS role
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(
    "plan_fold",
    f"""WITH {REFERENCES}, b AS (SELECT page_id, topic_id, bool_or(role = 'topic_page') AS direct FROM refs GROUP BY ALL)
    SELECT page_id, count(*) AS topics, count(*) FILTER (direct) AS topic_pages, min(topic_id) AS first_topic, min(topic_id) FILTER (direct) AS first_direct_topic FROM b GROUP BY page_id""",
)
def plan_fold(t):
    """Suppliers are pages, order priorities topics; a first line item is a topic-page reference."""
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("page_id"), "l_linenumber")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("topic_id"))
    refs = lines.join(orders, "l_orderkey").select(
        "page_id", "topic_id", F.when(F.col("l_linenumber") == 1, "topic_page").otherwise("descendant").alias("role")
    )
    return H.fold_plan(refs, ["page_id"])


@query(
    "scoped_references",
    f"""WITH {EDGES}, topics AS (SELECT 100 + n_nationkey AS topic_id, 'n' || n_nationkey AS page_id, n_regionkey FROM nation)
    SELECT topic_id, page_id, 'topic_page' AS role FROM topics UNION ALL SELECT topic_id, child, 'descendant' FROM topics JOIN edges ON parent = page_id WHERE n_regionkey <> 0""",
)
def scoped_references(t):
    """Nations of region zero are overridden to page-only scope; the others take their descendants."""
    topics = t.nation.select((100 + F.col("n_nationkey")).alias("topic_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("page_id"))
    overrides = t.nation.filter("n_regionkey = 0").select((100 + F.col("n_nationkey")).alias("topic_id"), F.lit("page_only").alias("scope"))
    tree = edges(t)
    nodes = tree.select(F.col("child").alias("page_id"))
    return H.scoped_references(topics, nodes, H.descendants(tree), overrides, "page_and_descendants").select("topic_id", "page_id", "role")


GUIDE_SQL = "nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), '')"
PAGE_SQL = "try_cast(nullif(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1), '') AS BIGINT)"
CARDS = f"""cards AS (SELECT page_id AS source_id, url, {GUIDE_SQL} AS guide_id, {PAGE_SQL} AS page_id FROM pages),
local AS (SELECT d.lang AS guide_id, d.doc_id AS page_id, coalesce(l.toxic, 0) = 0 AS usable FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def cards(t):
    guide = F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1), F.lit(""))
    page = F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+/([0-9]+)", 1), F.lit(""))
    return t.pages.select(F.col("page_id").alias("source_id"), "url", guide.alias("guide_id"), page.try_cast("long").alias("page_id"))


def local_pages(t):
    toxic = t.labels.select("doc_id", "toxic")
    return t.documents.select("doc_id", "lang").join(toxic, "doc_id", "left").select(
        F.col("lang").alias("guide_id"), F.col("doc_id").alias("page_id"), (F.coalesce("toxic", F.lit(0)) == 0).alias("usable")
    )


@query(
    "card_page_join",
    f"""WITH {CARDS}, r AS (SELECT c.*, CASE WHEN trim(coalesce(url, '')) = '' THEN 'NO_SOURCE_URL' WHEN c.guide_id IS NULL OR c.page_id IS NULL THEN 'URL_NOT_PARSEABLE' WHEN usable IS NULL THEN 'NO_LOCAL_PAGE'
    WHEN NOT usable THEN 'PAGE_NOT_USABLE' END AS reason FROM cards c LEFT JOIN local l ON l.guide_id = c.guide_id AND l.page_id = c.page_id)
    SELECT source_id, guide_id, page_id, reason, CASE WHEN reason IS NULL THEN 'resolved_page' WHEN reason IN ('NO_LOCAL_PAGE', 'PAGE_NOT_USABLE') THEN 'url_only' ELSE 'unresolved' END AS state FROM r""",
)
def card_page_join(t):
    return I.join_cards(cards(t), local_pages(t)).select("source_id", "guide_id", "page_id", "reason", "state")


@query(
    "topic_resolution",
    f"""WITH {CARDS} SELECT c.source_id AS topic_id, c.guide_id, c.page_id, CASE WHEN l.page_id IS NOT NULL THEN length(l.guide_id) END AS depth,
    CASE WHEN g.guide_id IS NULL THEN 'GUIDE_UNRESOLVED' WHEN l.page_id IS NULL THEN 'PAGE_NOT_IN_TOC' END AS reason,
    CASE WHEN g.guide_id IS NULL OR l.page_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status
    FROM cards c LEFT JOIN (SELECT DISTINCT lang AS guide_id FROM documents) g ON g.guide_id = c.guide_id LEFT JOIN local l ON l.guide_id = c.guide_id AND l.page_id = c.page_id""",
)
def topic_resolution(t):
    topics = cards(t).select(F.col("source_id").alias("topic_id"), "guide_id", "page_id")
    nodes = local_pages(t).withColumn("depth", F.length("guide_id"))
    return H.resolve_topics(topics, t.documents.select(F.col("lang").alias("guide_id")).distinct(), nodes)


LADDER = f"""{CARDS}, corr AS (SELECT source_id, min(d.lang) AS resolved_guide_id FROM cards c JOIN documents d ON d.doc_id = c.page_id AND d.lang <> c.guide_id JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY source_id),
other AS (SELECT doc_id AS page_id, lang AS other_guide FROM documents), ver AS (SELECT DISTINCT lang AS guide_id FROM documents WHERE lang <> 'de'),
ladder AS (SELECT c.source_id, c.guide_id, c.page_id, CASE WHEN c.guide_id IS NULL OR c.page_id IS NULL THEN 'unresolved' WHEN resolved_guide_id IS NOT NULL AND tt.page_id IS NOT NULL THEN 'corrected_identity'
    WHEN resolved_guide_id IS NOT NULL THEN 'conflicting_identity' WHEN ver.guide_id IS NOT NULL AND tc.page_id IS NOT NULL THEN 'identified'
    WHEN ver.guide_id IS NOT NULL AND other_guide <> c.guide_id THEN 'conflicting_identity' WHEN ver.guide_id IS NOT NULL THEN 'unresolved'
    WHEN other_guide <> c.guide_id THEN 'conflicting_identity' ELSE 'card_identity_only' END AS status, resolved_guide_id
    FROM cards c LEFT JOIN ver ON ver.guide_id = c.guide_id LEFT JOIN local tc ON tc.guide_id = c.guide_id AND tc.page_id = c.page_id LEFT JOIN corr ON corr.source_id = c.source_id
    LEFT JOIN other ON other.page_id = c.page_id LEFT JOIN local tt ON tt.guide_id = corr.resolved_guide_id AND tt.page_id = c.page_id),
ident AS (SELECT source_id, guide_id, page_id, status, CASE status WHEN 'corrected_identity' THEN resolved_guide_id WHEN 'identified' THEN guide_id END AS effective_guide_id FROM ladder)"""


def identities(t):
    card, local = cards(t), local_pages(t)
    quality = t.labels.filter("quality = 1").select("doc_id")
    moved = (
        card.join(t.documents.join(quality, "doc_id", "left_semi").select(F.col("doc_id").alias("page_id"), "lang"), "page_id")
        .filter(F.col("lang") != F.col("guide_id")).groupBy("source_id").agg(F.min("lang").alias("resolved_guide_id"))
    )
    elsewhere = t.documents.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("other_guide"))
    verified = t.documents.filter("lang <> 'de'").select(F.col("lang").alias("guide_id")).distinct()
    return I.identity_ladder(card, local, verified, moved, elsewhere)


@query("identity_ladder", f"WITH {LADDER} SELECT source_id, guide_id, page_id, status, effective_guide_id FROM ident")
def identity_ladder(t):
    return identities(t)


@query(
    "page_admission",
    f"""WITH {LADDER}, a AS (SELECT i.source_id, i.status, CASE status WHEN 'conflicting_identity' THEN 'excluded_conflict' WHEN 'card_identity_only' THEN 'excluded_identity_only' WHEN 'unresolved' THEN 'excluded_unresolved'
    ELSE CASE WHEN usable IS NULL THEN 'not_ingested' WHEN usable THEN 'ingested' ELSE 'rejected' END END AS corpus_status FROM ident i LEFT JOIN local l ON l.guide_id = i.effective_guide_id AND l.page_id = i.page_id)
    SELECT corpus_status, count(*) AS cards FROM a GROUP BY corpus_status""",
)
def page_admission(t):
    return I.admit(identities(t), local_pages(t)).groupBy("corpus_status").agg(F.count("*").alias("cards"))


@query(
    "topic_corrections",
    """WITH topics AS (SELECT doc_id AS topic_id, lang AS guide_id FROM documents), c AS (SELECT d.doc_id AS topic_id, CASE WHEN l.toxic = 1 THEN 'xx' ELSE d.lang END AS card_guide_id,
    CASE WHEN l.quality = 1 THEN d.lang ELSE 'zz' END AS resolved_guide_id, d.n_chars > 500 AS evidence_ok FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
    SELECT t.topic_id, CASE WHEN c.topic_id IS NOT NULL AND card_guide_id = guide_id AND card_guide_id <> resolved_guide_id AND evidence_ok THEN resolved_guide_id ELSE guide_id END AS guide_id,
    (c.topic_id IS NOT NULL AND card_guide_id = guide_id AND card_guide_id <> resolved_guide_id AND evidence_ok) AS corrected FROM topics t LEFT JOIN c ON c.topic_id = t.topic_id""",
)
def topic_corrections(t):
    return I.apply_corrections(*_corrections(t))[0]


def _corrections(t):
    topics = t.documents.select(F.col("doc_id").alias("topic_id"), F.col("lang").alias("guide_id"))
    labelled = t.documents.join(t.labels, "doc_id")
    corrections = labelled.select(
        F.col("doc_id").alias("topic_id"), F.lit(0).alias("position"), F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang")).alias("card_guide_id"),
        F.when(F.col("quality") == 1, F.col("lang")).otherwise("zz").alias("resolved_guide_id"), (F.col("n_chars") > 500).alias("evidence_ok"),
    )
    return topics, corrections


@query(
    "rejected_corrections",
    """WITH c AS (SELECT d.doc_id AS topic_id, d.lang, CASE WHEN l.toxic = 1 THEN 'xx' ELSE d.lang END AS cg, CASE WHEN l.quality = 1 THEN d.lang ELSE 'zz' END AS rg, d.n_chars > 500 AS ok FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
    SELECT * FROM (SELECT topic_id, concat_ws('; ', CASE WHEN lang <> cg THEN 'card ids do not match the topic' END, CASE WHEN cg = rg THEN 'nothing to correct' END, CASE WHEN NOT ok THEN 'no evidence records' END) AS errors FROM c) WHERE errors <> ''""",
)
def rejected_corrections(t):
    return I.apply_corrections(*_corrections(t))[1]


@query(
    "corpus_integrity",
    """WITH rec AS (SELECT doc_id, sha256(text) AS d FROM documents), man AS (SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'stale' ELSE sha256(d.text) END AS e FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
    SELECT * FROM (SELECT coalesce(rec.doc_id, man.doc_id) AS doc_id, CASE WHEN e IS NULL THEN 'unadmitted page' WHEN d IS NULL THEN 'missing admitted page' WHEN d <> e THEN 'text digest mismatch' END AS problem
    FROM rec FULL JOIN man ON man.doc_id = rec.doc_id) WHERE problem IS NOT NULL""",
)
def corpus_integrity(t):
    """Labels act as the admission manifest; toxic ones carry an outdated digest."""
    records = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    manifest = t.labels.join(records, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, "stale").otherwise(F.col("digest")).alias("expected_digest")
    )
    return I.integrity_problems(records, manifest)


@query(
    "legacy_comparison",
    """WITH old AS (SELECT sha256(text) AS h, length(text) AS n FROM conversations), new AS (SELECT sha256(text) AS h, length(text) AS n FROM documents)
    SELECT 'conversations' AS corpus, count(*) AS texts, count(DISTINCT h) AS unique_texts, sum(n)::BIGINT AS chars, count(*) FILTER (h IN (SELECT h FROM new)) AS shared FROM old
    UNION ALL SELECT 'documents', count(*), count(DISTINCT h), sum(n)::BIGINT, count(*) FILTER (h IN (SELECT h FROM old)) FROM new""",
)
def legacy_comparison(t):
    """Two corpora side by side; digests are counted per corpus first, then meet once."""
    both = t.conversations.select(F.lit("conversations").alias("corpus"), "text").unionByName(t.documents.select(F.lit("documents").alias("corpus"), "text"))
    per = both.groupBy(F.sha2("text", 256).alias("h"), "corpus").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    homes = per.groupBy("h").agg(F.count("*").alias("corpora"))
    return per.join(homes, "h").groupBy("corpus").agg(
        F.sum("n").alias("texts"), F.count("*").alias("unique_texts"), F.sum("chars").alias("chars"),
        F.sum(F.when(F.col("corpora") > 1, F.col("n")).otherwise(0)).alias("shared"),
    )


@query(
    "canonical_spelling",
    """WITH c AS (SELECT lower(p_type) AS k, p_type AS spelling, count(*) AS n FROM part GROUP BY ALL) SELECT k AS product, arg_max(spelling, {'n': n, 's': spelling}) AS spelling, sum(n)::BIGINT AS uses FROM c GROUP BY k""",
)
def canonical_spelling(t):
    """Most frequent spelling of each product name, ignoring case."""
    counts = t.part.groupBy(F.lower("p_type").alias("product"), F.col("p_type").alias("spelling")).agg(F.count("*").alias("n"))
    return counts.groupBy("product").agg(
        F.max_by("spelling", F.struct("n", "spelling")).alias("spelling"), F.sum("n").alias("uses")
    )


@query(
    "shared_ids",
    """SELECT l_partkey AS numeric_id, count(DISTINCT l_suppkey) AS guides FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
)
def shared_ids(t):
    """Numeric ids used by more than one guide."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("numeric_id")).agg(F.countDistinct("l_suppkey").alias("guides")).filter("guides > 1")


@query(
    "manifest_validation",
    """SELECT count(*) FILTER (n > 1) AS duplicate_ids, count(*) FILTER (page IS NULL) AS missing_page, count(*) FILTER (guide IS NULL) AS missing_guide, count(*) AS topics FROM (
    SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), '') AS guide, nullif(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1), '') AS page FROM pages)""",
)
def manifest_validation(t):
    per_id = cards(t).groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("page_id").isNull()).alias("no_page"), F.count_if(F.col("guide_id").isNull()).alias("no_guide")
    )
    return per_id.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_ids"), F.sum("no_page").alias("missing_page"),
        F.sum("no_guide").alias("missing_guide"), F.sum("n").alias("topics"),
    )
