"""Question analysis: intent, needs, follow-ups and query normalisation, all as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.text import stem2
from corpusweave.operators import question_rules as Q
from corpusweave.operators.ordering import carry_forward


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return text.rlike("(?i)" + pattern)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, [matches(text, p) for p in patterns])


def _case(text: Column, table: Mapping[str, str], otherwise: str | None) -> Column:
    out = None
    for label, pattern in table.items():
        condition = matches(text, pattern)
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


# ---------------------------------------------------------------- normalisation
def valid_question(text: Column) -> Column:
    return F.length(F.trim(text)).between(1, rules.MAX_QUESTION_CHARS)


def strip_instructions(text: Column) -> Column:
    """Delete prompt-manipulation phrases, conversational openers and trailing source hints, in order.

    An empty result falls back to the original text.
    """
    original = F.trim(F.coalesce(text, F.lit("")))
    out = original
    for pattern in Q.INSTRUCTION_DELETIONS:
        out = F.trim(F.regexp_replace(out, "(?i)" + pattern, ""))
    return F.coalesce(F.nullif(out, F.lit("")), original)


def expand_aliases(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Append the alias of every matching (pattern, alias) rule that the text does not already contain."""
    q = F.trim(F.coalesce(text, F.lit("")))
    additions = [
        F.when(matches(q, pattern) & ~F.contains(F.lower(q), F.lit(alias.lower())), F.lit(alias)) for pattern, alias in aliases
    ]
    if not additions:
        return q
    return F.array_join(F.concat(F.array(q), F.array_distinct(F.array_compact(F.array(*additions)))), " ")


# ---------------------------------------------------------------- intent
def intents(text: Column) -> Column:
    """Matching intent labels in their fixed order."""
    flags = [F.when(matches(text, p), F.lit(label)) for label, p in Q.INTENTS.items()]
    return F.array_compact(F.array(*flags))


def primary_intent(text: Column) -> Column:
    return F.coalesce(F.get(intents(text), 0), F.lit("general"))


def question_class(text: Column) -> Column:
    """Exclusive class that drives answer selection: comparison, causal, workflow, definition, general."""
    comparison = any_match(text, Q.CUES["comparison"]) | matches(text, Q.COMPARISON_WORDS)
    return (
        F.when(comparison, "comparison")
        .when(matches(text, Q.CAUSAL_QUESTION), "causal")
        .when(matches(text, Q.PROCESS_QUESTION), "workflow")
        .when(matches(text, Q.DEFINITION_QUESTION), "definition")
        .otherwise("general")
    )


# ---------------------------------------------------------------- needs
def _frame_stems() -> Column:
    return T.array_of(T.stem_words(rules.FRAME_WORDS, second=True))


def kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_match(F.lower(text), p), F.lit(k)) for k, p in Q.CUES.items()]))


def focus_terms(text: Column) -> Column:
    """Distinct content stems without question-frame words; cue words step aside when a cue was found."""
    plain = F.array_except(F.array_distinct(T.terms2(text)), _frame_stems())
    cue = T.array_of(T.stem_words(Q.CUE_WORDS, second=True))
    cue_kind = F.arrays_overlap(kinds(text), F.array(F.lit("limit"), F.lit("default")))
    reduced = F.array_except(plain, cue)
    return F.when(cue_kind & (F.size(reduced) > 0), reduced).otherwise(plain)


def asked_terms(text: Column) -> Column:
    """First content stem after each ``which``, ``what``, ``how many`` or ``how much``."""
    tokens = T.extract_all(F.lower(F.replace(text, F.lit("-"), F.lit(" "))), "([a-z0-9][a-z0-9_]*)")
    skip = T.array_of(sorted(rules.STOP_WORDS | rules.ASK_SKIP_WORDS))
    frame = _frame_stems()

    def following(w: Column, i: Column) -> Column:
        asks = w.isin("which", "what") | (w.isin("many", "much") & (F.get(tokens, i - 1) == "how"))
        window = F.filter(
            F.slice(tokens, i + 2, 4),
            lambda x: (F.length(x) > 2) & ~F.array_contains(skip, x) & ~F.array_contains(frame, stem2(x)),
        )
        return F.when(asks & (F.size(window) > 0), stem2(F.get(window, 0)))

    cue = T.array_of(T.stem_words(Q.CUE_WORDS, second=True))
    return F.array_except(F.array_distinct(F.array_compact(F.transform(tokens, following))), cue)


def kind_satisfied(kind: str, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    if kind == "code":
        return text.rlike(r"\b[A-Z][A-Z0-9_]*[0-9_][A-Z0-9_]*\b")
    if kind in ("number", "time"):
        words = Q.NUMBER_WORDS if kind == "number" else Q.TIME_WORDS
        found = low.rlike(r"(^|[^a-z0-9_])\d+([.,]\d+)?($|[^a-z0-9_])") | low.rlike(r"\b(" + "|".join(words) + r")\b")
        return found | F.contains(low, F.lit("%")) if kind == "number" else found
    if kind == "limit":
        return low.rlike(r"\b(" + "|".join(w for g in Q.LIMIT_GROUPS.values() for w in g) + r")\b")
    if kind == "default":
        return low.rlike("(" + "|".join(Q.DEFAULT_WORDS) + ")")
    return F.lit(True)


def kinds_satisfied(wanted: Column, text: Column) -> Column:
    ok = F.lit(True)
    for kind in Q.CUES:
        ok = ok & (~F.array_contains(wanted, kind) | kind_satisfied(kind, text))
    return ok


# ---------------------------------------------------------------- follow-ups
def message_norm(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), "\u2019\u2018\u201c\u201d", "''\"\"")
    out = F.translate(out, "\u200b\u200c\u200d\ufeff", "")
    out = F.trim(F.regexp_replace(T.squeeze(out), '^"+|"+$', ""))
    out = F.regexp_replace(out, r"(?i)^(ok(ay)?|hey|hi|hello|so|well|and|also|but|please)[,\s]+", "")
    return F.lower(F.regexp_replace(out, r"[.!?,;: ]+$", ""))


def one_edit_apart(left: Column, right: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    n = F.length(left)
    swaps = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)), F.substring(left, i, F.lit(1)),
            F.substring(left, i + 2, n),
        ),
    )
    return (F.levenshtein(left, right) <= 1) | ((n > 1) & F.array_contains(swaps, right))


def followup_category(text: Column) -> Column:
    """Follow-up category of a whole message, NULL when it stands on its own."""
    norm = message_norm(text)
    out = None
    for pattern, label in Q.FOLLOWUP_PATTERNS:
        condition = norm.rlike("^(?:" + pattern + ")$")
        out = F.when(condition, label) if out is None else out.when(condition, label)
    typo = ~F.contains(norm, F.lit(" ")) & ~norm.isin("elaborated", "elaborates") & one_edit_apart(norm, F.lit("elaborate"))
    category = out.when(typo, "elaborate")
    return F.when((norm != "") & (F.length(norm) <= Q.MAX_MESSAGE_CHARS), category)


def ordinal_target(text: Column) -> Column:
    """Number of the step a message points at (``third step``, ``step 3``), else NULL."""
    low = F.lower(F.coalesce(text, F.lit("")))
    word = F.coalesce(
        F.nullif(F.regexp_extract(low, Q.ORDINAL_BEFORE, 1), F.lit("")), F.nullif(F.regexp_extract(low, Q.ORDINAL_AFTER, 1), F.lit(""))
    )
    pairs = [x for w, n in Q.ORDINALS.items() for x in (F.lit(w), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), word)


def numbered_steps(answer: Column) -> Column:
    """Lines that start with a step number, as a map from number to text (the first text of a number)."""
    rows = F.transform(
        T.lines(answer),
        lambda x: F.struct(
            F.regexp_extract(x, Q.NUMBERED_LINE, 1).alias("n"),
            F.trim(F.regexp_replace(F.regexp_extract(x, Q.NUMBERED_LINE, 2), r"\[S\d+\]", "")).alias("t"),
        ),
    )
    kept = F.filter(rows, lambda r: (r["n"] != "") & (r["t"] != ""))
    first = F.filter(
        kept, lambda r, i: F.array_position(F.transform(kept, lambda k: k["n"]), r["n"]) == i + 1
    )
    return F.map_from_entries(F.transform(first, lambda r: F.struct(r["n"].cast("int").alias("key"), r["t"].alias("value"))))


def resolve_followups(turns: DataFrame, width: int = 512) -> DataFrame:
    """Attach to every user message its category, its anchor (the last standalone question of the
    conversation) and the query to run.

    ``turns`` has ``conv_id, turn, role, text``. The anchor is carried across segments of a long
    conversation, so one conversation never has to fit into one task.
    """
    asked = turns.filter(F.col("role") == "user")
    classified = asked.withColumn("category", followup_category(F.col("text")))
    standalone = F.col("category").isNull() & (F.size(T.terms(F.col("text"))) >= 1)
    anchored = carry_forward(
        classified, ["conv_id"], F.col("turn"), width, F.when(standalone, T.squeeze(F.col("text"))), "anchor"
    )
    own = F.array_except(
        F.array_except(T.term_set(F.col("text")), T.term_set(F.col("anchor"))), T.array_of(T.stem_words(Q.FOLLOWUP_VOCABULARY))
    )
    clauses = F.create_map(*[x for k, v in Q.CLAUSES.items() for x in (F.lit(k), F.lit(v))])
    followed = F.col("category").isNotNull() & F.col("anchor").isNotNull()
    form = F.when(followed & (F.size(own) > 0), "message").when(followed, "clause")
    added = F.when(F.size(own) > 0, T.squeeze(F.col("text"))).otherwise(F.try_element_at(clauses, F.col("category")))
    query = F.when(followed, T.squeeze(F.substring(F.concat_ws(" ", "anchor", added), 1, Q.MAX_RESOLVED_CHARS))).otherwise(F.col("text"))
    return anchored.withColumn("form", form).withColumn("query", query)


# ---------------------------------------------------------------- comparisons
def comparison_concepts(text: Column) -> Column:
    """The compared concepts (two to four), or an empty array."""
    q = F.trim(F.coalesce(text, F.lit("")))
    listed = F.regexp_extract(q, "(?i)" + Q.COMPARE_LIST, 1)
    between = F.regexp_extract(q, "(?i)" + Q.DIFFERENCE_BETWEEN, 1)
    left, right = F.regexp_extract(q, "(?i)" + Q.VERSUS, 1), F.regexp_extract(q, "(?i)" + Q.VERSUS, 2)

    def parts(body: Column, pattern: str) -> Column:
        return F.slice(
            F.filter(F.transform(F.split(body, "(?i)" + pattern), lambda x: F.trim(x)), lambda x: F.length(x) > 0), 1, 4
        )

    first = parts(listed, r",\s*(?:and\s+)?|\s+(?:and|with|to)\s+")
    second = parts(between, r",\s*(?:and\s+)?|\s+and\s+")
    third = F.array(F.trim(left), F.trim(right))
    return (
        F.when(F.size(first) >= 2, first)
        .when(F.size(second) >= 2, second)
        .when((left != "") & (right != ""), third)
        .otherwise(F.array().cast("array<string>"))
    )


def common_subsequence(left: str, right: str) -> Column:
    """Length of the longest common subsequence of two term lists (column names).

    A row of the dynamic programme is kept as bits, 62 in a word: where a bit is 0 the length grows by one. A term of ``right`` turns
    one row into the next with an addition whose carry runs through the words, so a term costs a few operations for each word
    and nothing is copied but the words themselves.
    """
    words = f"sequence(0, CAST((size({left}) - 1) div 62 AS INT))"
    width = f"least(62, size({left}) - 62 * l)"
    mask = f"aggregate(sequence(0, {width} - 1), 0L, (m, i) -> if(get({left}, 62 * l + i) = y, m | shiftleft(1L, i), m))"
    step = (
        f"aggregate(transform({words}, l -> named_struct('v', get(v, l), 'm', {mask})), named_struct('c', 0L, 'o', cast(array() AS array<bigint>)), "
        "(s, w) -> named_struct('c', shiftright(w.v + (w.v & w.m) + s.c, 62), 'o', concat(s.o, array(((w.v + (w.v & w.m) + s.c) & 4611686018427387903L) | (w.v & ~w.m)))), s -> s.o)"
    )
    start = f"transform({words}, l -> shiftleft(1L, {width}) - 1)"
    zeros = f"aggregate(transform({words}, l -> {width} - bit_count(get(v, l) & (shiftleft(1L, {width}) - 1))), 0, (n, z) -> n + z)"
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0).otherwise(F.expr(f"aggregate({right}, {start}, (v, y) -> {step}, v -> {zeros})"))


def terms_like(text: Column, wanted: Column) -> Column:
    """``T.terms`` of a text without those that are not in ``wanted``, in order and with repeats.

    Stemming leaves a word's first three letters, so only words that begin like a wanted term are stemmed at all.
    """
    heads = F.transform(wanted, lambda t: F.substring(t, 1, 3))
    alike = F.filter(T.content_words(text), lambda w: F.array_contains(heads, F.substring(w, 1, 3)))
    return F.filter(T.stemmed(alike), lambda t: F.array_contains(wanted, t))
