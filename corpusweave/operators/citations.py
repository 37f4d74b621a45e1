"""Citation parsing, grounding checks, repair and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.operators import evidence_rules as E
from corpusweave.operators.questions import matches


def expand_markers(text: Column) -> Column:
    """All cited markers in order, compound ones expanded: ``[S1, S3]`` gives ``S1, S3``."""
    groups = T.extract_all(F.coalesce(text, F.lit("")), f"({E.COMPOUND_MARKER})")
    numbers = F.flatten(F.transform(groups, lambda g: T.extract_all(g, r"(\d+)")))
    return F.transform(numbers, lambda n: F.concat(F.lit("S"), n))


def malformed_markers(text: Column) -> Column:
    """Marker-like spellings that are not well-formed references, and references to ``S0``."""
    like = T.extract_all(F.coalesce(text, F.lit("")), f"({E.MARKER_LIKE})")
    bad = F.filter(like, lambda m: ~m.rlike("^" + E.COMPOUND_MARKER + "$"))
    zero = F.filter(expand_markers(text), lambda m: ~m.rlike(r"^S[1-9]\d*$"))
    return F.concat(bad, F.transform(zero, lambda m: F.concat(F.lit("["), m, F.lit("]"))))


def claim_body(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), E.MARKER_LIKE, ""))


def answer_lines(answers: DataFrame, key: list[str], answer: str) -> DataFrame:
    """One row per cited sentence: markers, malformed references and the text without markers."""
    split = bind(answers.select(*key, answer), ss=T.split_cited_sentences(F.col(answer)))
    rows = split.select(*key, F.posexplode("ss").alias("line_no", "line"))
    return rows.select(
        *key, "line_no", "line", expand_markers(F.col("line")).alias("markers"),
        malformed_markers(F.col("line")).alias("malformed"), claim_body(F.col("line")).alias("body"),
    )


def _cited_context(lines: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Attach the context items of the question; a context holds a handful of marked chunks."""
    block = context.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("marker", "text"))).alias("items"))
    joined = lines.join(block, key, "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<marker:string,text:string>>"))
    )
    return joined.withColumn(
        "known", F.transform("items", lambda i: i["marker"])
    ).withColumn("cited", F.filter("items", lambda i: F.array_contains("markers", i["marker"])))


def _text_of(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: i["text"]), "\n")


def grounding(lines: DataFrame, context: DataFrame, key: list[str], least: float = rules.SENTENCE_SUPPORT) -> DataFrame:
    """Violations of each answer line against the chunks it cites."""
    rows = _cited_context(lines, context, key)
    cited, everything = _text_of(F.col("cited")), _text_of(F.col("items"))
    rows = bind(rows, cited_text=cited, all_text=everything, codes=T.code_tokens(F.col("body")), body_terms=T.term_set(F.col("body")))
    rows = bind(rows, support=F.when(F.size("body_terms") == 0, 1.0).otherwise(T.coverage(F.col("body_terms"), T.terms(F.col("cited_text")))))
    outside = F.filter("codes", lambda c: ~F.contains(F.col("all_text"), c))
    elsewhere = F.filter("codes", lambda c: F.contains(F.col("all_text"), c) & ~F.contains(F.col("cited_text"), c))
    has_body = F.col("body").rlike(r"[\p{L}\p{N}_]")
    phantom = F.array_except("markers", "known")
    violations = F.array_compact(
        F.array(
            F.when(F.size("malformed") > 0, "MALFORMED_MARKER"),
            F.when(F.size("markers") > F.size(F.array_distinct("markers")), "DUPLICATE_MARKER"),
            F.when(F.size(phantom) > 0, "PHANTOM_MARKER"),
            F.when(~has_body, "NO_CLAIM_BODY"),
            F.when(has_body & (F.size("cited") == 0), "NO_CITATION"),
            F.when(has_body & (F.size(outside) > 0), "TOKEN_NOT_IN_CONTEXT"),
            F.when(has_body & (F.size(elsewhere) > 0), "TOKEN_NOT_IN_CITED_CHUNK"),
            F.when(has_body & (F.size("cited") > 0) & (F.col("support") < least), "LOW_SUPPORT"),
        )
    )
    return rows.select(*key, "line_no", F.round("support", 6).alias("support"), violations.alias("violations"))


def support_chain(lines: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Every line must cite a known chunk that contains it verbatim; citations are never inherited."""
    rows = _cited_context(lines, context, key)
    rows = bind(rows, norm=F.lower(T.squeeze(F.col("body"))))
    bare = F.trim(F.regexp_replace("norm", r"^[-*•]\s*", ""))
    verbatim = F.exists(
        "cited", lambda i: F.contains(F.lower(T.squeeze(i["text"])), F.col("norm")) | F.contains(F.lower(T.squeeze(i["text"])), bare)
    )
    errors = F.array_compact(
        F.array(
            F.when(F.size("malformed") > 0, "MALFORMED_MARKER"),
            F.when(F.size("markers") > F.size(F.array_distinct("markers")), "DUPLICATE_MARKER"),
            F.when(F.size(F.array_except("markers", "known")) > 0, "PHANTOM_MARKER"),
            F.when(F.size("markers") == 0, "NO_EXPLICIT_CITATION"),
            F.when(~F.col("body").rlike(r"[\p{L}\p{N}_]"), "NO_CLAIM_BODY").when(~verbatim, "NO_VERBATIM_SOURCE_MATCH"),
        )
    )
    return rows.select(*key, "line_no", F.array_join(errors, ",").alias("errors"))


def repair(lines: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """New markers for mis-attributed lines.

    Rule A: the line is verbatim in exactly one other chunk, which replaces the citation. Rule B: one
    other chunk supports it clearly better, and is added. Lines without a valid marker stay.
    """
    rows = _cited_context(lines, context, key)

    def strict(text: Column) -> Column:
        return F.regexp_replace(T.squeeze(F.lower(text)), r"\s+([.,;:!?])", "$1")

    rows = bind(rows, body_norm=strict(F.col("body")), body_terms=T.term_set(F.col("body")))
    others = F.filter("items", lambda i: ~F.array_contains("markers", i["marker"]))

    def support(text: Column) -> Column:
        return F.when(F.size("body_terms") == 0, 0.0).otherwise(T.coverage(F.col("body_terms"), T.terms(text)))

    holds = F.exists("cited", lambda i: F.contains(strict(i["text"]), F.col("body_norm")))
    exact = F.filter(others, lambda i: F.contains(strict(i["text"]), F.col("body_norm")))
    scored = F.transform(others, lambda i: F.struct(F.round(support(i["text"]), 6).alias("s"), i["marker"].alias("m")))
    rows = bind(rows, exact=exact, scored=scored, own=F.round(support(_text_of(F.col("cited"))), 6), holds=holds)
    better = F.filter(
        "scored", lambda x: (x["s"] >= rules.REPAIR_MIN_SUPPORT) & (x["s"] > F.col("own") + rules.REPAIR_MARGIN)
    )
    best = F.array_max(F.transform(better, lambda x: x["s"]))
    pick = F.get(F.filter(better, lambda x: x["s"] == best), 0)
    valid = F.transform("cited", lambda i: i["marker"])
    eligible = (F.size("cited") > 0) & (F.col("body_norm") != "") & (F.size("body_terms") > 0) & ~F.col("holds")
    rule = F.when(~eligible, "none").when(F.size("exact") == 1, "A_verbatim").when(pick.isNotNull(), "B_support").otherwise("none")
    target = (
        F.when(rule == "A_verbatim", F.transform("exact", lambda i: i["marker"]))
        .when(rule == "B_support", F.concat(valid, F.array(pick["m"])))
        .otherwise(valid)
    )
    return rows.select(
        *key, "line_no", rule.alias("rule"), F.array_join(valid, "/").alias("from_markers"), F.array_join(target, "/").alias("to_markers")
    )


def citation_assembly(lines: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Context rows flagged as cited or only supplied, plus phantom markers without a context row."""
    cited = lines.select(*key, F.explode("markers").alias("marker")).groupBy(*key, "marker").agg(F.count("*").alias("citations"))
    supplied = context.select(*key, "marker").withColumn("supplied", F.lit(True))
    joined = supplied.join(cited, [*key, "marker"], "full")
    state = (
        F.when(F.col("supplied").isNull(), "phantom").when(F.col("citations").isNull(), "supplied_only").otherwise("cited")
    )
    return joined.select(*key, "marker", F.coalesce("citations", F.lit(0)).alias("citations"), state.alias("state"))


# ---------------------------------------------------------------- presentation and answer metrics
def line_category(line: Column) -> Column:
    low = F.lower(line)

    def any_of(words) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        return found

    path = F.contains(line, F.lit(">")) & any_of(("choose", "menu", "path", "create", "display", "change"))
    return (
        F.when(any_of(E.PREREQUISITE_WORDS), "conditions_and_prerequisites")
        .when(any_of(E.PROCEDURE_WORDS) | path, "procedure_and_usage")
        .when(any_of(E.DETAIL_WORDS), "key_details")
        .otherwise("overview")
    )


def structured_sections(lines: DataFrame, key: list[str]) -> DataFrame:
    """Answer sections: repeated bodies dropped, short answers and lone lines fold into the overview."""
    body = F.trim(F.regexp_replace("line", r"\s*\[S\d+\]", ""))
    first = Window.partitionBy(*key, "body").orderBy("line_no")
    unique = lines.withColumn("body", body).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    step = F.col("line").rlike(r"(?i)^\s*(?:\d+[.)]|step\s+\d+|[-*•])\s+") | (
        F.contains("line", F.lit(">")) & matches(F.col("line"), "(choose|menu|path|navigate)")
    )
    tagged = unique.withColumn("cat", line_category(F.col("line"))).withColumn("step", step)
    whole, part = Window.partitionBy(*key), Window.partitionBy(*key, "cat")
    folded = F.when(
        (F.count("*").over(whole) < 3) | ((F.count("*").over(part) < 2) & ~F.col("step")), "overview"
    ).otherwise(F.col("cat"))
    return tagged.withColumn("section", folded).groupBy(*key, "section").agg(
        F.count("*").alias("lines"), F.min("line_no").alias("first_line"),
    )


def documentation_coverage(cited: Column, sources: Column) -> Column:
    """Cited share of the supplied sources in percent, one decimal, capped."""
    return F.when(sources > 0, F.least(F.lit(100.0), F.round(cited / sources * 100.0, 1))).otherwise(
        F.when(cited > 0, 100.0).otherwise(0.0)
    )


def fact_norm(text: Column) -> Column:
    return T.squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " "))


def fact_recalled(answer_norm: Column, fact: Column) -> Column:
    """The fact is a substring of the answer, or all its content words are."""
    norm = fact_norm(fact)
    words = F.filter(
        F.split(norm, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(T.array_of(sorted(rules.STOP_WORDS)), w)
    )
    return F.contains(answer_norm, norm) | (
        (F.size(words) > 0) & F.forall(words, lambda w: F.contains(answer_norm, w))
    )


def claim_detected(answer_norm: Column, claim: Column) -> Column:
    """At least 75 % (and two) of the claim's stems occur in the answer, or the claim itself does."""

    def stems(text: Column) -> Column:
        stop = T.array_of(sorted(rules.STOP_WORDS))
        return F.transform(
            F.filter(F.split(text, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), T.stem2
        )

    norm = fact_norm(claim)
    wanted, present = stems(norm), F.array_distinct(stems(answer_norm))
    hits = F.size(F.filter(wanted, lambda s: F.array_contains(present, s)))
    enough = F.greatest(F.lit(2), F.floor(0.75 * F.size(wanted)).cast("int"))
    return F.when(F.size(wanted) == 0, F.contains(answer_norm, norm)).otherwise(
        (hits >= enough) | F.contains(answer_norm, norm)
    )


def citation_metrics(lines: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Citation coverage and precision per answer."""
    known = context.groupBy(*key).agg(F.collect_set("marker").alias("known"))
    rows = lines.join(known, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return rows.groupBy(*key).agg(
        F.count("*").alias("lines"), F.count_if(F.size("markers") > 0).alias("cited_lines"),
        F.sum(F.size("markers")).alias("markers"),
        F.sum(F.size(F.filter("markers", lambda m: ~F.array_contains("known", m)))).alias("invalid"),
    ).select(
        *key, "lines", F.round(F.col("cited_lines") / F.greatest(F.lit(1), F.col("lines")), 6).alias("citation_coverage"),
        F.round((F.col("markers") - F.col("invalid")) / F.greatest(F.lit(1), F.col("markers")), 6).alias("citation_precision"),
    )
