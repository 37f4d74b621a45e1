import pytest
from pyspark.sql import types as T

WORDS = "the of and that onesen erblest hein inenan eranenes whou therouou thon than heoron eratsh therin blees esheon erstlyat eronthwh reer anat tisher".split()


def text_of(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 4) % 3 else str(x % 97)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, near copies."""
    long, line = text_of(1, 6000), "A line that several documents share, word by word."
    near = text_of(2, 300)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \t\n ", "en", None, 4), (None, text_of(3, 40), "en", "b", 1),
        (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (6, near, "en", "a", 9),
        (7, near + " once", "en", None, 9), (8, "One two", "de", "c", 7), (9, "one  TWO", "de", "c", 8), (10, "É é\u0085x \x1f y", "fr", "c", 8),
        (11, f"{line}\nfirst\n{line}", "en", "b", 5), (12, f"  {line.upper()}\t\nsecond", "en", "b", 5), (13, f"third\n{line}\n", "en", "b", 5),
        (14, text_of(5, 60) + "\n" + " ".join(text_of(9, 40).split()[:30]), "en", "d", 1), (15, "### Assistant: \\ </turn>\n<|endoftext|> !", "en", "", 3),
        (16, "same words again " * 30, "en", "d", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """As ``documents``, with more columns whose names operators might use themselves."""
    extra = ["row", "fp", "hash", "words", "size", "bucket", "key", "id", "target", "kept", "item", "root", "best", "copy", "lost", "features"]
    schema = T.StructType(
        [T.StructField(n, t) for n, t in zip(("doc_id", "text", "lang", "source", "n_chars"), (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType()))]
        + [T.StructField(n, T.StringType()) for n in extra]
    )
    return spark.createDataFrame([(*r, *(["x"] * len(extra))) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
