"""Sentence evidence: units with context, quality rules, scores, sufficiency and answer selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.binding import bind, let
from corpusweave.operators import evidence_rules as E
from corpusweave.operators.ordering import top_k
from corpusweave.operators.questions import kinds_satisfied, matches


# ---------------------------------------------------------------- units
def sentence_units(items: DataFrame, keys: list[str], text: str, title: str) -> DataFrame:
    """One row per sentence with its neighbours.

    ``prev_line`` is a short heading-like line directly above; ``follow`` the sentence after one that
    ends with a colon; ``list_items`` the list lines such a lead-in introduces. All of it comes from
    the item's own line array, so no window is needed.
    """
    lined = bind(items.select(*keys, text, title), lines=T.lines(F.col(text)))
    per_line = lined.select(*keys, title, "lines", F.posexplode("lines").alias("line_no", "line"))
    above = F.get("lines", F.col("line_no") - 1)
    heading_like = (T.word_count(above) <= 8) & ~above.rlike(r"[.!?:]\s*$")
    following = F.slice("lines", F.col("line_no") + 2, F.size("lines"))
    stop = F.array_position(F.transform(following, lambda x: x.rlike(E.LIST_ITEM + r"\S")), F.lit(False))
    run = F.when(stop > 0, F.slice(following, F.lit(1), (stop - 1).cast("int"))).otherwise(following)
    with_line = per_line.select(
        *keys, title, "line_no", "line", F.when(heading_like, above).alias("above"),
        F.when(F.col("line").rlike(r":\s*$") & ~F.col("line").rlike(E.LIST_ITEM + r"\S"), run).alias("run"),
    )
    sentences = bind(with_line, ss=T.line_sentences(F.col("line"))).select(
        *keys, title, "line_no", "line", "above", "run", "ss", F.posexplode("ss").alias("sentence_no", "sentence")
    )
    colon = F.col("sentence").rlike(r":\s*$")
    last = F.col("sentence_no") == F.size("ss") - 1
    return sentences.select(
        *keys, title, "line_no", "line", "sentence_no", "sentence",
        F.when(F.col("sentence_no") == 0, F.col("above")).alias("prev_line"),
        F.when(colon & ~last, F.get("ss", F.col("sentence_no") + 1)).alias("follow"),
        F.when(colon & last, F.coalesce("run", F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>")
        ).alias("list_items"),
    )


def with_terms(units: DataFrame, title: str) -> DataFrame:
    """Own terms (with attached list items and the line above) and, unless there already, heading terms of each unit."""
    body = F.concat_ws(" ", "sentence", F.array_join("list_items", " "))
    own = F.array_distinct(F.concat(T.terms2(body), T.terms2(F.coalesce("prev_line", F.lit("")))))
    return bind(units, own=own, **({} if "head" in units.columns else {"head": F.array_distinct(T.terms2(F.col(title)))}))


# ---------------------------------------------------------------- quality
def has_predicate(text: Column) -> Column:
    def around(bare: Column) -> Column:
        bare = F.regexp_replace(bare, r"(?i)\bstart\s+(?:and|or)\s+end(?:\s+of)?\b", " ")
        return F.regexp_replace(bare, r"(?i)\b(?:the|at\s+the|from\s+the|to\s+the|before\s+the|after\s+the)\s+start\b", " ")

    bare = F.regexp_replace(text, r"\(\s*[A-Z][A-Z0-9]*(?:[-‐‑‒–—][A-Z0-9]+)*\s*\)", " ")
    bare = let(bare, lambda x: F.when(matches(x, "start"), around(x)).otherwise(x))
    return let(bare, lambda x: matches(x, E.PREDICATE) | matches(x, E.IMPERATIVE))


def low_quality(text: Column, label: Column, lone_line: Column | None = None, label_norm: Column | None = None) -> Column:
    """Headings, breadcrumbs and extraction debris; a clause with a predicate always stays.

    Rules run in order: repeats its label, has a predicate (kept), bare list entry, short line on its
    own, separator, navigation word, digit inside a word, label overlap, page number, few letters.
    ``label_norm``: the label's ``novelty_norm``, where many texts share a label that may be long.
    """
    clean = F.trim(F.regexp_replace(T.squeeze(F.coalesce(text, F.lit(""))), r"\[S\d+\]", ""))
    label_norm = T.novelty_norm(F.coalesce(label, F.lit(""))) if label_norm is None else label_norm
    start = F.struct(clean.alias("clean"), label_norm.alias("label"))
    sized = lambda v: F.struct(v["clean"].alias("clean"), v["label"].alias("label"), T.novelty_norm(v["clean"]).alias("norm"))
    return let(start, lambda v: let(sized(v), lambda w: _low_quality(w["clean"], w["norm"], w["label"], lone_line)))


def _low_quality(clean: Column, norm: Column, label_norm: Column, lone_line: Column | None) -> Column:
    ended = clean.rlike(E.SENTENCE_END)
    code = clean.rlike(E.CODE_TOKEN)
    trimmed = F.regexp_replace(clean, r"[ .!?;,:\"'”’)\]}]+$", "")
    numbered = matches(trimmed, E.TRAILING_NUMBER)
    words = F.split(norm, " ")
    shared = F.size(F.array_intersect(words, F.split(label_norm, " ")))
    distinct = F.size(F.array_distinct(words))
    compact = F.regexp_replace(clean, r"\s", "")
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    lone = F.lit(False) if lone_line is None else lone_line & (F.size(F.split(clean, " ")) <= 12)
    body = F.regexp_replace(clean, E.LIST_ITEM, "")
    return (
        F.when(norm == "", True)
        .when((label_norm != "") & (norm == label_norm), True)
        .when(has_predicate(clean), False)
        .when(~ended & ~code & clean.rlike(E.LIST_ITEM) & ~has_predicate(body), True)
        .when(~ended & ~code & lone, True)
        .when(clean.rlike(E.SEPARATOR), True)
        .when(matches(clean, E.NAVIGATION_STRICT), True)
        .when(matches(clean, E.NAVIGATION) & (numbered | ~ended), True)
        .when(clean.rlike(E.OCR_DIGIT), True)
        .when(~ended & (distinct <= 8) & (label_norm != "") & (shared >= 2) & (shared / distinct >= 0.66), True)
        .when(numbered & ~ended & (F.size(words) <= 8), True)
        .when((F.length(compact) >= 8) & (letters / F.length(compact) < 0.55), True)
        .otherwise(False)
    )


def incomplete_lead_in(text: Column, follow: Column, list_items: Column) -> Column:
    """A sentence ending with a colon whose list is missing or holds only ``label : value`` entries."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[S\d+\]", ""))
    lead = clean.rlike(r":$")
    next_text = F.trim(F.coalesce(follow, F.lit("")))
    usable = next_text.rlike(E.LIST_ITEM + r"\S") | has_predicate(next_text) | next_text.rlike(E.SENTENCE_END)
    return F.when(
        F.size(list_items) > 0, lead & F.forall(list_items, lambda x: x.rlike(E.CONFIG_ITEM))
    ).otherwise(lead & ((next_text == "") | next_text.rlike(r":$") | ~usable))


# ---------------------------------------------------------------- scores and decisions
def unit_score(own: Column, head: Column, focus: Column, weights: Column | None = None) -> Column:
    """Weighted share of focus terms in the sentence, heading-only terms at half weight."""

    def total(terms: Column) -> Column:
        if weights is None:
            return F.size(terms).cast("double")
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(weights, x), F.lit(0.0)))

    hit = F.array_intersect(focus, own)
    side = F.array_except(F.array_intersect(focus, head), own)
    return F.when((F.size(focus) == 0) | (F.size(hit) == 0), 0.0).otherwise(
        (total(hit) + rules.HEADING_WEIGHT * total(side)) / total(focus)
    )


def focus_weights(units: DataFrame) -> DataFrame:
    """Inverse frequency of each focus term over the question's retrieved sentences, at least 0.1."""
    present = units.select("query_id", F.explode("focus").alias("term"), "own", "head").select(
        "query_id", "term", (F.array_contains("own", F.col("term")) | F.array_contains("head", F.col("term"))).cast("int").alias("hit")
    )
    return present.groupBy("query_id", "term").agg(
        F.round(F.greatest(F.lit(0.1), F.log((F.count("*") + 1) / (F.sum("hit") + 0.5))), 6).alias("weight")
    )


def assess(units: DataFrame, questions: DataFrame | None = None, tau: float = rules.EVIDENCE_TAU) -> DataFrame:
    """Sufficiency decision of every question from its scored units.

    ``units`` has ``query_id, focus, asked, kinds, own, head, sentence, prev_line, score``. Gates in
    order: nothing to look for, asked-for noun not in evidence next to another focus term, kind of
    evidence missing, best score below ``tau``. With ``questions`` (``query_id, focus``) those without any
    unit are answered too: nothing to look for, or no evidence.
    """
    full = F.concat_ws(" ", "prev_line", "sentence")
    kind_ok = kinds_satisfied(F.col("kinds"), full)
    met = F.filter(
        "asked",
        lambda a: F.array_contains("own", a)
        & (
            F.arrays_overlap(F.array_remove("focus", a), F.col("own"))
            | F.arrays_overlap(F.array_remove("focus", a), F.col("head"))
        ),
    )
    loose = F.filter(
        "asked", lambda a: (F.size("focus") <= 2) & (F.array_contains("own", a) | F.array_contains("head", a))
    )
    flagged = units.select(
        "query_id", "focus", "asked", "kinds", kind_ok.alias("kind_ok"), "score", F.array_union(met, loose).alias("met")
    )
    # Flags are aggregated, not units: ``met`` holds at most one entry per asked-for noun.
    grouped = flagged.groupBy("query_id").agg(
        F.first("focus").alias("focus"), F.first("asked").alias("asked"), F.first("kinds").alias("kinds"),
        F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"), F.count("*").alias("units"),
        F.max(F.when(F.col("kind_ok"), F.col("score"))).alias("best"),
    )
    missing = F.array_except("asked", "met")
    reason = (
        F.when(F.size("focus") == 0, "NO_QUERY_TERMS")
        .when(F.size(missing) > 0, "ASKED_TERM_NOT_IN_EVIDENCE")
        .when((F.size("kinds") > 0) & F.col("best").isNull(), "KIND_NOT_IN_EVIDENCE")
        .when(F.coalesce("best", F.lit(0.0)) < tau, "LOW_FOCUS_COVERAGE")
        .otherwise("SUPPORTED")
    )
    decided = grouped.select("query_id", "units", F.round("best", 6).alias("best"), reason.alias("reason"))
    if questions is None:
        return decided
    nothing = F.when(F.size("focus") == 0, "NO_QUERY_TERMS").otherwise("NO_EVIDENCE")
    return questions.select("query_id", "focus").join(decided, "query_id", "left").select(
        "query_id", F.coalesce("units", F.lit(0)).alias("units"), "best", F.coalesce("reason", nothing).alias("reason")
    )


def select_answer_units(units: DataFrame, tau: float = rules.EVIDENCE_TAU, most: int = rules.EXTRACTIVE_MAX_SENTENCES) -> DataFrame:
    """Answer sentences per question: class-dependent cut, tiers, exact de-duplication, source order.

    Needs ``query_id, question_class, kinds, sentence, prev_line, list_items, score, unit_no, line``.
    """
    full = F.concat_ws(" ", "prev_line", "sentence")
    usable = units.filter(kinds_satisfied(F.col("kinds"), full))
    best = F.max("score").over(Window.partitionBy("query_id"))
    ratio = F.when(F.col("question_class") == "causal", 0.75).otherwise(rules.EVIDENCE_KEEP_RATIO)
    flat = F.col("question_class").isin("workflow", "comparison")
    cut = F.when(flat, F.lit(tau)).otherwise(F.greatest(F.lit(tau), ratio * F.col("_best")))
    numbered = F.col("line").rlike(r"^\s*\d{1,3}[.)]\s+\S") | F.exists("list_items", lambda x: x.rlike(r"^\s*\d+[.)]"))
    bullet = F.col("line").rlike(r"^\s*[-*•]\s+\S")
    definitional = matches(F.col("sentence"), E.DEFINITIONAL)
    tier = (
        F.when(F.col("question_class") == "workflow", F.when(numbered, 0).when(bullet, 3).otherwise(2))
        .when(F.col("question_class") == "comparison", F.when(definitional, 0).otherwise(1))
        .otherwise(0)
    )
    kept = (
        usable.withColumn("_best", best).filter(F.col("score") >= cut)
        .filter(~matches(F.col("sentence"), E.DIAGRAM))
        .filter((F.col("question_class") != "causal") | matches(F.col("sentence"), E.EXPLANATORY))
        .withColumn("tier", tier).withColumn("norm", T.novelty_norm(F.col("sentence"))).filter("norm <> ''")
    )
    order = [F.col("tier"), F.desc("score"), F.col("unit_no")]
    distinct = kept.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "norm").orderBy(*order))).filter("_n = 1")
    chosen = top_k(distinct, ["query_id"], order, most, "pick")
    return chosen.withColumn("answer_line", F.row_number().over(Window.partitionBy("query_id").orderBy("unit_no"))).drop("_n", "_best")


def complementary_units(scored: DataFrame, section: str, tau: float, most: int = rules.EXTRACTIVE_MAX_SENTENCES) -> DataFrame:
    """Best unit first, then the best units of the other sections, then the rest."""
    best = Window.partitionBy("query_id")
    kept = scored.withColumn("_best", F.max("score").over(best)).filter(
        F.col("score") >= F.greatest(F.lit(tau), rules.EVIDENCE_KEEP_RATIO * F.col("_best"))
    )
    order = [F.desc("score"), F.col("unit_no")]
    ranked = kept.withColumn("_pos", F.row_number().over(best.orderBy(*order)))
    lead = F.max(F.when(F.col("_pos") == 1, F.col(section))).over(best)
    grouped = ranked.withColumn("_lead", lead)
    priority = F.when(F.col("_pos") == 1, 0).when(F.col(section) != F.col("_lead"), 1).otherwise(2)
    return top_k(grouped.withColumn("_pri", priority), ["query_id"], [F.col("_pri"), F.col("_pos")], most, "pick").drop(
        "_pri", "_pos", "_lead", "_best"
    )


def extractive_sentences(units: DataFrame, least: float = rules.EXTRACTIVE_MIN_SCORE, most: int = rules.EXTRACTIVE_MAX_SENTENCES) -> DataFrame:
    """Top sentences by question-term share, kept above 0.6 of the best, in document order.

    ``units`` has ``query_id, question_terms, sentence, marker, unit_no``.
    """
    scored = units.withColumn("score", F.round(T.coverage(F.col("question_terms"), T.terms(F.col("sentence"))), 6))
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("_best", best).filter(
        (F.col("_best") >= least) & (F.col("score") >= F.greatest(F.lit(least), F.round(0.6 * F.col("_best"), 6)))
    )
    chosen = top_k(kept, ["query_id"], [F.desc("score"), F.col("unit_no")], most, "pick")
    return chosen.withColumn("answer_line", F.row_number().over(Window.partitionBy("query_id").orderBy("unit_no"))).drop("_best")


# ---------------------------------------------------------------- novelty
def redundant(left: Column, right: Column, left_terms: Column, right_terms: Column) -> Column:
    """Exact repeat, or a large lexical overlap of two sentences' term sets."""
    shared = F.size(F.array_intersect(left_terms, right_terms))
    union = F.size(F.array_union(left_terms, right_terms))
    smaller = F.least(F.size(left_terms), F.size(right_terms))
    n = rules.NOVELTY
    return (left == right) | ((shared >= n["overlap"]) & (shared / union >= n["jaccard"])) | (
        (shared >= n["short_overlap"]) & (shared / smaller >= n["short_coverage"])
    )


def novel_sentences(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences of ``current`` that repeat none of ``previous`` under the same keys.

    Both sides have ``sentence`` and a key is one message: the previous message is attached as one
    array, so pairs of sentences are never emitted as rows.
    """

    def prepared(df: DataFrame) -> DataFrame:
        normed = bind(df, norm=T.novelty_norm(F.col("sentence")))
        return bind(normed, tset=F.array_distinct(T.terms2(F.col("norm"))))

    earlier = prepared(previous).groupBy(*keys).agg(F.collect_list(F.struct("norm", "tset")).alias("earlier"))
    joined = prepared(current).join(earlier, keys, "left")
    repeats = F.exists(
        F.coalesce("earlier", F.array().cast("array<struct<norm:string,tset:array<string>>>")),
        lambda e: redundant(F.col("norm"), e["norm"], F.col("tset"), e["tset"]),
    )
    return joined.withColumn("repeated", repeats).drop("earlier", "tset")
