"""Text kernel as Column expressions; everything here stays on the JVM side.

Character classes are written out (``[a-z0-9]``, ``[\\p{L}\\p{N}_]``) instead of ``\\w`` and ``\\b`` so
that results do not depend on the regex dialect of the engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from corpusweave import rules

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9(\"“‘\[])"
LIST_PREFIX = r"^\d{1,3}[.)]\s+"
WORD_RUN = r"([\p{L}\p{M}\p{N}_]+)"
CITED_SENTENCE = r"(.+?[.!?](?:\s*\[S\d+\])*(?=\s+[A-Z0-9(\"“‘\-]|\s*$)|.+$)"


def array_of(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def extract_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern with exactly one capture group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_ws(text: Column) -> Column:
    """No-break space to space, runs of white space to one space, trimmed."""
    return squeeze(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "))


def normalize_text(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))


def query_terms(text: Column) -> Column:
    words = F.split(normalize_text(text), " ")
    stop = array_of(sorted(rules.QUERY_STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def _alternatives(words: Iterable[str]) -> str:
    """Pattern that matches any of ``words``, factored by first letter so that few branches are tried."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by_letter.setdefault(word[:1], []).append(word[1:])
    optional = "" in by_letter
    branches = [c + (_alternatives(rest) if rest != [""] else "") for c, rest in by_letter.items() if c]
    body = branches[0] if len(branches) == 1 and not optional else "(?:" + "|".join(branches) + ")"
    return body + ("?" if optional else "")


def _not_one_of(words: Iterable[str], chars: str) -> str:
    """Look-ahead that refuses a run equal to one of ``words``."""
    return "(?!" + _alternatives(words) + f"(?![{chars}]))"


def tokenize(text: Column, drop_stop_words: bool = True) -> Column:
    """Lower-cased ``[a-z0-9]+`` runs in order, with repetition.

    Stop words are refused inside the pattern, in the same pass over the text.
    """
    guard = r"(?<![a-z0-9])" + _not_one_of(rules.BM25_STOP_WORDS, "a-z0-9") if drop_stop_words else ""
    return extract_all(F.lower(F.coalesce(text, F.lit(""))), f"({guard}[a-z0-9]+)")


def stem(word: Column) -> Column:
    """First suffix that leaves at least three letters is replaced."""
    chain = None
    for suffix, replacement in rules.STEM_SUFFIXES:
        cond = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        value = F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(word)


def content_words(text: Column, extra_stop_words: Iterable[str] = ()) -> Column:
    """Words of three or more characters that are no stop words, in order."""
    guard = _not_one_of(rules.STOP_WORDS | set(extra_stop_words), "a-z0-9_")
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" ")))
    return extract_all(plain, rf"(?<![a-z0-9_])_*({guard}[a-z0-9][a-z0-9_]{{2,}})")


def _stem_all(words: Column, passes: Iterable[tuple[str, str]]) -> Column:
    """Stem a whole word list with a few passes over its joined text.

    A longer suffix starts further left, so the leftmost match of a pass is the first suffix of the
    stemmer's list that leaves a long enough stem.
    """
    joined = F.array_join(words, " ")
    for pattern, replacement in passes:
        joined = F.regexp_replace(joined, pattern + r"(?= |$)", replacement)
    return F.array_remove(F.split(joined, " "), "")


_STEM_PASSES = ((r"(?<=[a-z0-9_]{3})i(?:es|ed)", "y"), (r"(?<=[a-z0-9_]{3})(?:ations?|ings?|es|ed|s)", ""))
_STEM2_PASSES = (
    (r"(?<=[a-z0-9_]{3})ations?", "at"),
    (r"(?<=[a-z0-9_]{3})i(?:es|ed)", "y"),
    (r"(?:(?<=[a-z0-9_]{4})ments?|(?<=[a-z0-9_]{3})(?:ings?|es|ed|(?<!s)s))", ""),
    (r"(?<=[a-z0-9_]{4})e", ""),
    (r"(?<=[a-z0-9_]{3})izat", "iz"),
    (r"(?<=[a-z0-9_]{3})urat", "ur"),
)


def stem_words(words: Iterable[str], second: bool = False) -> list[str]:
    """Stems of a fixed word list, computed once on the driver with the same passes."""
    out = []
    for word in sorted(set(words)):
        for pattern, replacement in _STEM2_PASSES if second else _STEM_PASSES:
            word = re.sub(pattern + r"(?= |$)", replacement, word)
        out.append(word)
    return sorted(set(out))


def stemmed(words: Column) -> Column:
    return _stem_all(words, _STEM_PASSES)


def terms(text: Column, extra_stop_words: Iterable[str] = ()) -> Column:
    return stemmed(content_words(text, extra_stop_words))


def term_set(text: Column, extra_stop_words: Iterable[str] = ()) -> Column:
    return F.array_distinct(terms(text, extra_stop_words))


def stem2(word: Column) -> Column:
    """Evidence stemmer: suffix, then a final ``e``, then two tail rules."""
    chain = None
    for suffix, replacement, shortest in rules.STEM2_SUFFIXES:
        cond = word.endswith(suffix) & (F.length(word) - len(suffix) >= shortest)
        if suffix == "s":
            cond = cond & ~word.endswith("ss")
        value = F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    out = F.regexp_replace(chain.otherwise(word), r"^(.{4,})e$", "$1")
    for tail, replacement in rules.STEM2_TAILS:
        out = F.regexp_replace(out, rf"^(.{{3,}}){tail}$", f"$1{replacement}")
    return out


def terms2(text: Column, extra_stop_words: Iterable[str] = ()) -> Column:
    return _stem_all(content_words(text, extra_stop_words), _STEM2_PASSES)


def coverage(wanted: Column, present: Column) -> Column:
    """Share of the distinct ``wanted`` terms found in ``present``; 0.0 when nothing is wanted."""
    distinct = F.array_distinct(wanted)
    return F.when(F.size(distinct) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(distinct, present)) / F.size(distinct)
    )


def code_tokens(text: Column) -> Column:
    """Identifiers: whole word runs with a digit or underscore, or all-capital codes."""
    runs = extract_all(F.coalesce(text, F.lit("")), WORD_RUN)
    return F.array_distinct(
        F.filter(
            runs,
            lambda r: (r.rlike("^[A-Za-z0-9_]{3,}$") & r.rlike("[0-9_]")) | r.rlike("^[A-Z]{2,}[A-Z0-9_]*$"),
        )
    )


def lines(text: Column) -> Column:
    """Trimmed non-empty lines in order."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
        lambda x: F.length(x) > 0,
    )


def _line_parts(line: Column, pieces) -> Column:
    prefix = F.regexp_extract(line, f"({LIST_PREFIX})", 1)
    body = F.regexp_replace(line, LIST_PREFIX, "")
    parts = F.filter(F.transform(pieces(body), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p, i: F.when(i == 0, F.concat(prefix, p)).otherwise(p))


def line_sentences(line: Column) -> Column:
    """Sentences of one line; a list number stays attached to its first sentence."""
    return _line_parts(line, lambda body: F.split(body, SENTENCE_BREAK))


def split_sentences(text: Column) -> Column:
    return F.flatten(F.transform(lines(text), line_sentences))


def split_cited_sentences(text: Column) -> Column:
    """Sentences with their trailing ``[S1]`` markers kept attached."""
    return F.flatten(
        F.transform(lines(text), lambda line: _line_parts(line, lambda body: extract_all(body, CITED_SENTENCE)))
    )


def citation_markers(text: Column) -> Column:
    return F.transform(extract_all(F.coalesce(text, F.lit("")), r"\[S(\d+)\]"), lambda n: F.concat(F.lit("S"), n))


def token_estimate(text: Column) -> Column:
    """Model-free token count: words plus punctuation marks plus the two special tokens."""
    return F.size(extract_all(F.coalesce(text, F.lit("")), r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])")) + 2


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(normalize_ws(text), " "), lambda w: F.length(w) > 0))


def header_text(heading_path: Column, title: Column) -> Column:
    parts = F.filter(heading_path, lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(F.coalesce(title, F.lit("")))


def novelty_norm(text: Column) -> Column:
    """Case-folded word runs, citation markers removed; the form compared for repeats."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[S\d+\]", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{M}\p{N}_]+", " "))
