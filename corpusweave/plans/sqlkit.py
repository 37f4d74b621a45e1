"""SQL fragments shared by the check queries (dialect of the second engine)."""

from __future__ import annotations

from corpusweave import rules


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def normalize_text(expr: str) -> str:
    return squeeze(f"regexp_replace(lower({expr}), '[^a-z0-9\\s]', ' ', 'g')")


def query_terms(expr: str) -> str:
    return (
        f"list_distinct(list_filter(string_split({normalize_text(expr)}, ' '), lambda w: length(w) > 2 "
        f"AND NOT list_contains({quoted(rules.QUERY_STOP_WORDS)}, w)))"
    )


def tokenize(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({expr}), '[a-z0-9]+'), "
        f"lambda t: NOT list_contains({quoted(rules.BM25_STOP_WORDS)}, t))"
    )


def stem(w: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN substr({w}, 1, length({w}) - {len(s)}) || '{r}'"
        for s, r in rules.STEM_SUFFIXES
    )
    return f"(CASE {cases} ELSE {w} END)"


def content_words(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(replace({expr}, '-', ' ')), '[a-z0-9][a-z0-9_]*'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({quoted(rules.STOP_WORDS)}, w))"
    )


def terms(expr: str) -> str:
    return f"list_transform({content_words(expr)}, lambda w: {stem('w')})"


def stem2(w: str) -> str:
    cases = []
    for s, r, shortest in rules.STEM2_SUFFIXES:
        cond = f"ends_with({w}, '{s}') AND length({w}) >= {len(s) + shortest}"
        if s == "s":
            cond += f" AND NOT ends_with({w}, 'ss')"
        cases.append(f"WHEN {cond} THEN substr({w}, 1, length({w}) - {len(s)}) || '{r}'")
    out = f"(CASE {' '.join(cases)} ELSE {w} END)"
    out = f"regexp_replace({out}, '^(.{{4,}})e$', '\\1')"
    for tail, r in rules.STEM2_TAILS:
        out = f"regexp_replace({out}, '^(.{{3,}}){tail}$', '\\1{r}')"
    return out


def terms2(expr: str) -> str:
    return f"list_transform({content_words(expr)}, lambda w: {stem2('w')})"


def code_tokens(expr: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all({expr}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda r: "
        f"(regexp_matches(r, '^[A-Za-z0-9_]{{3,}}$') AND regexp_matches(r, '[0-9_]')) "
        f"OR regexp_matches(r, '^[A-Z]{{2,}}[A-Z0-9_]*$')))"
    )


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def lines(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 0)"


def line_sentences(line: str) -> str:
    """Marker insertion stands in for look-behind, which this regex engine lacks."""
    body = f"regexp_replace({line}, '^\\d{{1,3}}[.)]\\s+', '')"
    marked = f"regexp_replace({body}, '([.!?])\\s+([A-Z0-9(\"“‘\\[])', '\\1' || chr(1) || '\\2', 'g')"
    parts = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {strip('p')}), lambda p: length(p) > 0)"
    prefix = f"regexp_extract({line}, '^\\d{{1,3}}[.)]\\s+')"
    return f"list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN {prefix} || p ELSE p END)"


def split_sentences(expr: str) -> str:
    return f"flatten(list_transform({lines(expr)}, lambda l: {line_sentences('l')}))"


def token_estimate(expr: str) -> str:
    return f"(len(regexp_extract_all({expr}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) + 2)"


def novelty_norm(expr: str) -> str:
    bare = f"regexp_replace({expr}, '\\[S\\d+\\]', '', 'g')"
    return f"trim(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"


def legacy_chunks(expr: str, limit: int = rules.LEGACY_CHUNK_CHARS) -> str:
    """Greedy packing of paragraph and sentence parts; the length test ignores the joining space."""
    marked = f"regexp_replace(regexp_replace({expr}, '\\n\\s*\\n', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    parts = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {strip('p')}), lambda p: length(p) > 0)"
    folded = (
        f"list_reduce({parts}, lambda a, p: CASE WHEN length(a.cur) + length(p) <= {limit} "
        f"THEN {{'done': a.done, 'cur': a.cur || ' ' || p}} "
        f"WHEN length(trim(a.cur)) > 0 THEN {{'done': list_append(a.done, trim(a.cur)), 'cur': p}} "
        f"ELSE {{'done': a.done, 'cur': p}} END, {{'done': []::VARCHAR[], 'cur': ''}})"
    )
    # list_reduce needs a list of the accumulator type, so the parts are wrapped first.
    return folded


def chunk_list(expr: str, limit: int = rules.LEGACY_CHUNK_CHARS) -> str:
    f = legacy_chunks(expr, limit)
    return f"(SELECT list_filter(list_append(z.done, trim(z.cur)), lambda c: length(c) > 0) FROM (SELECT {f} AS z))"


def clean_cte(table: str) -> str:
    """WITH clause building ``cleaned`` (one row per document) the way the corpus cleaner does."""
    labels = quoted(rules.SECTION_LABELS)
    functions = quoted(rules.FUNCTION_WORDS)
    collapsed = strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")
    plain = (
        "list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), "
        f"lambda x: {collapsed}), lambda x: length(x) > 0)"
    )
    joins = (
        f"NOT list_contains({labels}, lower(a.cur)) AND NOT list_contains({labels}, lower(p)) AND ("
        f"regexp_matches(p, '^[,.;:)\\]}}]') OR regexp_matches(p, '^\\p{{Ll}}') OR regexp_matches(a.cur, '[(\\[]$') "
        f"OR length(regexp_replace(a.cur, '[^(]', '', 'g')) > length(regexp_replace(a.cur, '[^)]', '', 'g')) "
        f"OR (list_contains({functions}, lower(regexp_replace(list_last(string_split(a.cur, ' ')), '[^\\p{{L}}\\p{{N}}_]+$', ''))) "
        f"AND NOT regexp_matches(a.cur, '[.!?:;]$')))"
    )
    glue = "CASE WHEN regexp_matches(p, '^[,.;:)\\]}]') OR regexp_matches(a.cur, '[(\\[]$') THEN '' ELSE ' ' END"
    return f"""WITH l1 AS (SELECT *, {plain} AS ls FROM {table}),
l2 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: x = ls[1]), false), 0) AS dif FROM l1),
l3 AS (SELECT *, CASE WHEN len(ls) > 0 AND (CASE WHEN dif > 0 THEN dif - 1 ELSE len(ls) END) > 1
    THEN list_concat(ls[1:1], ls[(CASE WHEN dif > 0 THEN dif - 1 ELSE len(ls) END) + 1:]) ELSE ls END AS ls2 FROM l2),
l4 AS (SELECT *, list_filter(ls2, lambda x, i: NOT (i > 1 AND length(x) >= {rules.MIN_DUPLICATE_LINE} AND x = ls2[i - 1])) AS ls3,
    list_filter(ls2, lambda x, i: i > 1 AND length(x) >= {rules.MIN_DUPLICATE_LINE} AND x = ls2[i - 1]) AS dups FROM l3),
l5 AS (SELECT *, list_reduce(ls3, lambda a, p: CASE WHEN a.cur IS NULL THEN {{'done': a.done, 'cur': p, 'joins': a.joins}}
    WHEN len(a.done) > 0 AND {joins} THEN {{'done': a.done, 'cur': a.cur || {glue} || p, 'joins': a.joins + 1}}
    ELSE {{'done': list_append(a.done, a.cur), 'cur': p, 'joins': a.joins}} END,
    {{'done': []::VARCHAR[], 'cur': NULL::VARCHAR, 'joins': 0}}) AS z FROM l4),
cleaned AS (SELECT * EXCLUDE (ls, ls2, ls3, dups, z, dif),
    array_to_string(list_filter(list_append(z.done, z.cur), lambda x: x IS NOT NULL), chr(10)) AS clean_text,
    array_to_string(list_concat(list_transform(range(len(ls) - len(ls2)), lambda q: ls[1]), dups), chr(10)) AS dropped_text,
    len(ls) - len(ls2) AS title_drops, len(ls2) - len(ls3) AS dup_drops, z.joins AS joins, len(ls) AS n_in,
    len(list_filter(list_append(z.done, z.cur), lambda x: x IS NOT NULL)) AS n_out FROM l5)"""
