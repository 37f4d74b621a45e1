"""Ranked lexical search over hashed max-sketches of documents (query ``op13_ranked_search``)."""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusweave.llm.common import CAPITALS, SMALL, Scratch, table

#: Best documents of an item, cells of a sketch for each different term (or up to twice as many), an impact of one level.
TOP, CELLS, LEVEL = 10, 16, 4_000
#: Items and different terms of a block, different terms a task counts at once.
BLOCK_ITEMS, BLOCK_TERMS, COUNTED = 1024, 1 << 18, 1 << 19
#: Cells of sketches a task holds together, lookups it makes at once.
TOGETHER, LOOKUPS = 1 << 23, 1 << 21
#: Every byte that is no ASCII letter or digit separates; bytes of other characters belong to terms.
TERMS = bytes.maketrans(
    bytes(range(128)), bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(128))
)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TERMS).split()


def length_factor(n: int, documents: int, total: int) -> int:
    return 100 - 75 + 75 * n * documents // total


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Index:
    """What a search reads: ``documents`` and ``total`` (N and L), ``dictionary`` (term, df), ``sketches`` (doc_id, text, sketch)."""

    documents: int
    total: int
    dictionary: DataFrame
    sketches: DataFrame


def count_terms(docs: DataFrame) -> DataFrame:
    """``term, df, total``: documents that hold a term; the row without term has the documents with terms and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number, total = Counter(), 0, 0

        def rows():
            terms = [None, *(t.decode("utf-8", "surrogatepass") for t in seen)]
            columns = [pa.array(terms, pa.string()), pa.array([number, *seen.values()], pa.int64()), pa.array([total, *[0] * len(seen)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "df", "total"])

        for batch in batches:
            for text in batch.column(0):
                terms = terms_of(text.as_py())
                seen.update(set(terms))
                number, total = number + bool(terms), total + len(terms)
                if len(seen) > COUNTED:
                    yield rows()
                    seen, number, total = Counter(), 0, 0
        yield rows()

    counted = docs.select("text").mapInArrow(run, "term string, df long, total long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def sketch(counts: Counter, m: int) -> bytes:
    """Levels (impacts, rounded up) of a document's terms, folded into the maxima of hashed cells; a power of two of them."""
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    level = -(-(1_000_000_000 * tf // (1000 * tf + 8 * m)) // LEVEL)
    cells = np.zeros(1 << (CELLS * len(counts) - 1).bit_length(), np.uint8)
    place = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & (len(cells) - 1)
    order = np.argsort(level, kind="stable")  # of levels put into one cell the last one stays
    cells[place[order]] = level[order]
    return cells.tobytes()


def build_index(docs: DataFrame) -> Index:
    """The index of ``docs`` (``doc_id``, ``text``); a document without terms has no sketch and is never found."""
    scratch = Scratch(docs.sparkSession, "sketches")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = scratch.write(count_terms(rows), "dictionary")
    documents, total = dictionary.where("term is null").select("df", "total").first() or (0, 0)  # no partitions, no counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                made.append(zstandard.compress(sketch(Counter(terms), length_factor(len(terms), documents, total))) if terms else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], ["doc_id", "text", "sketch"])

    made = rows.mapInArrow(run, "doc_id long, text string, sketch binary").where("sketch is not null")
    return Index(documents, total, dictionary.where("term is not null").select("term", "df"), scratch.write(made, "sketches"))


class Asked:
    """A block of items: their terms with weights for exact scores, and all their lookups in a row for bounds."""

    def __init__(self, items: list[list[tuple[str, int]]]):
        self.exact = [{t.encode("utf-8", "surrogatepass"): w for t, w in terms} for terms in items]
        self.hashes = np.array([zlib.crc32(t) for terms in self.exact for t in terms], np.int64)
        self.weights = np.array([w for terms in self.exact for w in terms.values()], np.float64) * LEVEL
        self.first = np.cumsum([0] + [len(terms) for terms in self.exact[:-1]])

    def bounds(self, sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Upper bounds (sketches, items) for sketches of one length, some sketches at a time, each time with the first one's place.

        A lookup gives at least the level of the item's term, so the weighted sum is never below the score. Bounds are whole numbers
        below 2^53, so double precision is exact.
        """
        size, step = len(sketches[0]), max(1, LOOKUPS // len(self.hashes))
        places = self.hashes & (size - 1)
        for k in range(0, len(sketches), step):
            cells = np.frombuffer(b"".join(sketches[k : k + step]), np.uint8).reshape(-1, size)
            yield k, np.add.reduceat(np.take(cells, places, axis=1) * self.weights, self.first, axis=1)


class Best:
    """The best documents found for each item of a block, best first, equal scores by ascending doc_id (a missing one last)."""

    def __init__(self, asked: Asked, documents: int, total: int):
        self.exact, self.documents, self.total = asked.exact, documents, total
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in self.exact]
        self.least = np.ones(len(self.exact))

    def look(self, doc_ids: list, texts: list[pa.StringScalar], bounds: np.ndarray) -> None:
        """Score documents exactly in descending order of bounds, for each item until its bound is below the last place's score."""
        counts: dict[int, tuple[Counter, int]] = {}
        reach = bounds >= self.least
        for item in np.flatnonzero(reach.any(axis=0)).tolist():
            rows = np.flatnonzero(reach[:, item])
            terms, found = self.exact[item], self.found[item]
            for row in rows[np.argsort(-bounds[rows, item], kind="stable")].tolist():
                if bounds[row, item] < self.least[item]:
                    break
                if row not in counts:
                    words = terms_of(texts[row].as_py())
                    counts[row] = Counter(words), length_factor(len(words), self.documents, self.total)
                own, m = counts[row]
                score = sum(w * impact(own[t], m) for t, w in terms.items() if t in own)
                if score > 0:
                    insort(found, (-score, doc_ids[row] is None, doc_ids[row] or 0))
                    del found[TOP:]
                    if len(found) == TOP:
                        self.least[item] = -found[-1][0]


def best_of_tasks(index: Index, asked) -> DataFrame:
    """``item, doc_id, score``: every task's ``TOP`` best documents for each item of a block.

    A task looks up the bounds of its sketches for all items at once and scores texts exactly only as long as a bound reaches the score
    of the item's last place so far; texts whose bound does not reach it cannot take a place.
    """
    documents, total = index.documents, index.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        best, waiting = Best(own, documents, total), {}

        def look(doc_ids: list, texts: list, sketches: list[bytes]) -> None:
            for k, bounds in own.bounds(sketches):
                best.look(doc_ids[k : k + len(bounds)], texts[k : k + len(bounds)], bounds)

        for batch in batches:
            for doc_id, text, packed in zip(*batch.columns):
                cells = zstandard.decompress(packed.as_py())
                held = waiting.setdefault(len(cells), ([], [], []))
                for column, value in zip(held, (doc_id.as_py(), text, cells)):
                    column.append(value)
                if len(held[0]) * len(cells) >= TOGETHER:
                    look(*waiting.pop(len(cells)))
        for held in waiting.values():
            look(*held)
        rows = [(item, None if missing else doc_id, -score) for item, found in enumerate(best.found) for score, missing, doc_id in found]
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.sketches.select("doc_id", "text", "sketch").mapInArrow(run, "item int, doc_id long, score long")


def search(index: Index, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``TOP`` best documents for every row of ``items`` (``item_id``, ``text``).

    Items with the same text are looked for once; repeated rows of items have repeated results. An item without terms, or with terms
    no document has, gives no rows. Items go in blocks of bounded size, each against all sketches.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession, "search")
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("item_id", "text", F.sha2("text", 256).alias("ask"))
    words = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(TERM), 0)
    counts = rows.dropDuplicates(["ask"]).select("ask", F.explode(words).alias("term")).groupBy("ask", "term").agg(F.count("*").alias("times"))
    terms = scratch.write(counts.join(index.dictionary, "term"), "terms")  # terms of no document add nothing
    asks, total = terms.agg(F.countDistinct("ask"), F.count("*")).first()
    blocks = max(1, -(-asks // BLOCK_ITEMS), -(-total // BLOCK_TERMS))
    found = spark.createDataFrame([], "ask string, doc_id long, score long")
    for block in range(blocks):
        held: dict[str, list] = {}
        for ask, term, times, df in terms.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == block).select("ask", "term", "times", "df").collect():
            held.setdefault(ask, []).append((term, times * weight(index.documents, df)))
        if held:
            asked = spark.sparkContext.broadcast(Asked(list(held.values())))
            names = spark.createDataFrame(list(enumerate(held)), "item int, ask string")
            found = found.unionByName(best_of_tasks(index, asked).join(F.broadcast(names), "item").select("ask", "doc_id", "score"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return rows.select("item_id", "ask").join(found, "ask").select("item_id", "rank", "doc_id", "score")


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), all_terms AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM words
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, all_terms GROUP BY term, docs
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), all_terms GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
