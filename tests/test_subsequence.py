"""Ordered overlap of titles and lines against a plain dynamic programme, whole table included."""

import random
import re

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.operators import questions
from corpusweave.plans import question_plans
from corpusweave.plans.registry import CATALOG


def overlap(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        new = [0]
        for j, b in enumerate(right):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence(spark):
    dice = random.Random(4)
    pairs = [([], []), (["a"], []), ([], ["a"]), (["a"], ["a"])]
    for top, most in ((2, 8), (3, 70), (20, 200), (400, 130)):
        pairs += [([str(dice.randrange(top)) for _ in range(dice.randint(0, most))], [str(dice.randrange(top)) for _ in range(dice.randint(0, most))]) for _ in range(25)]
    for n in (61, 62, 63, 124, 125):  # whole words of bits and one more
        pairs += [([str(i) for i in range(n)],) * 2, ([str(i) for i in range(n)], [str(i) for i in reversed(range(n))]), (["x"] * n, ["x"] * (n + 3))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = dict(rows.select("i", questions.common_subsequence("a", "b").alias("n")).collect())
    assert [found[i] for i in range(len(pairs))] == [overlap(a, b) for a, b in pairs]


def test_terms_like(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.substring("text", 1, 3000).alias("text"))
    wanted = F.slice(T.terms(F.col("text")), 1, 9)
    both = docs.select(wanted.alias("w"), "text").select("w", questions.terms_like(F.col("text"), F.col("w")).alias("a"), T.terms(F.col("text")).alias("b"))
    rows = both.collect()
    assert rows and all(r.a == [t for t in r.b if t in r.w] for r in rows)


def plain_terms(text):
    """Content words with their suffix taken off: one suffix, a stem of three letters or more."""
    out = []
    for word in re.findall(r"[a-z0-9][a-z0-9_]{2,}", text.lower().replace("-", " "), re.ASCII):
        if word in rules.STOP_WORDS:
            continue
        for suffix, replacement in rules.STEM_SUFFIXES:
            if word.endswith(suffix) and len(word) - len(suffix) >= 3:
                word = word[: -len(suffix)] + replacement
                break
        out.append(word)
    return out


def test_title_subsequence_of_the_table(spark, sf):
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.lines(F.coalesce("text", F.lit(""))).alias("ls")).collect():
        title = plain_terms(r.ls[0] if r.ls else "")
        for n, line in enumerate(r.ls[1:], 2):
            both = overlap(title, plain_terms(line))
            expected.append((r.doc_id, n, len(title), both, both >= 3 and 4 * both >= 3 * len(title)))
        if len(r.ls) < 2:
            expected.append((r.doc_id, None, len(title), 0, False))
    found = [tuple(r) for r in CATALOG["title_subsequence"](spark, sf).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert question_plans  # registers the query
