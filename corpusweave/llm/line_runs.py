"""Repeated lines across documents, kept in levelled sorted runs of line hashes (query ``op2_line_dedup``)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, map_rows, table

MIN_CHARS, MIN_DOCS = 20, 3
#: One job judges a table in this many batches; a level is merged into the next once it holds FANOUT runs.
BATCHES, FANOUT = 4, 2


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line without blanks at its ends and with small A-Z; None if it is too short to count."""
    line = line.strip().lower()
    if len(line) < MIN_CHARS or len(line) - sum(b & 0xC0 == 0x80 for b in line if b > 127) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(line)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, line``: each counting line of a row once."""

    def make(batch: pa.RecordBatch) -> dict:
        ids, keys = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = {key for line in lines_of(text.as_py()) if (key := line_key(line))}
            ids += [doc_id] * len(own)
            keys += own
        return {"doc_id": ids, "line": keys}

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, line binary")


class LineRuns:
    """What is known of all lines seen so far, and which of a batch's lines are new.

    A run is a table ``line, docs, last`` (documents holding it, the largest doc_id) bucketed and sorted by the line's hash. Every line
    has one entry, in the run of the batch that brought it: ``add`` merge-anti-joins a batch against the runs, stores the lines that are
    left as a run of level 0, and notes the others as increments of entries that are there. Once a level has ``FANOUT`` runs they are
    merged into one of the next level, so n batches leave about log n runs and each entry is rewritten log n times. Runs lie in the
    shared folder; a lost executor costs the running batch only.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        self.increments: list[DataFrame] = []

    def add(self, lines: DataFrame) -> DataFrame:
        """Store a batch ``doc_id, line`` of documents that no earlier batch held; returns ``line, docs, last`` of its new lines."""
        own = self.scratch.write(lines.distinct().groupBy("line").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch")
        new = reduce(lambda left, run: left.join(run.select("line"), "line", "left_anti"), self.runs(), own)
        new = self.scratch.write(new.select("line", "docs", "last"), "new")
        if self.levels:
            self.increments.append(self.scratch.write(own.join(new.select("line"), "line", "left_anti").select("line", "docs", "last"), "increments"))
        self.scratch.drop(own)
        self._store(new, 0)
        return new

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def known(self) -> DataFrame:
        """``line, docs, last`` of every line: its entry, and what later batches added to it."""
        entries = reduce(DataFrame.unionByName, [run.select("line", "docs", "last") for run in self.runs()])
        if not self.increments:
            return entries
        more = reduce(DataFrame.unionByName, self.increments).groupBy("line").agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        docs = (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")
        return entries.join(more, "line", "left").select("line", docs, F.greatest("last", "later").alias("last"))

    def close(self) -> None:
        """Drop all runs."""
        for level in self.levels:
            self._forget(level)
        self.levels = []

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(path)

    def _store(self, rows: DataFrame, level: int) -> None:
        path = self.scratch.path(f"run{level}")
        name = "run_" + path.rpartition("line-runs-")[2].replace("/", "_").replace("-", "_")
        rows = rows.repartition(self.buckets, "line")
        rows.write.bucketBy(self.buckets, "line").sortBy("line").option("path", path).format("parquet").saveAsTable(name)
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            self._store(reduce(DataFrame.unionByName, [self.spark.table(n) for n, _ in old]), level + 1)  # no line is in two runs
            self._forget(old)


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, kept, n_lines, n_dropped`` for every row of ``docs`` (``doc_id``, ``text``).

    A line of at least 20 code points (trimmed, small A-Z) that at least three documents hold stays only in
    the document with the largest doc_id. Rows that repeat a doc_id are one document, and rows without
    doc_id are one document smaller than any other. A missing or empty text is one empty line; texts without any
    line that counts come back as they are. Extra columns are not read.

    Lines become 16-byte hashes in one scan. A line that a large part of the documents share is summed
    before it is shuffled, and only the lines each document loses go back to it: no task gathers the
    holders of a line.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-runs")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines = scratch.write(line_keys(docs).select("doc_id", "line", batch), "lines", "batch")
    runs = LineRuns(spark, scratch)
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n).select("doc_id", "line"))
    repeated = scratch.write(runs.known().where(F.col("docs") >= MIN_DOCS).select("line", "last"), "repeated")
    runs.close()
    lost = lines.select("doc_id", "line").join(repeated, "line").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = lost.groupBy("doc_id").agg(F.collect_set("line").alias("lost")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = rows.join(lost, rows.doc_id.eqNullSafe(lost.id), "left").select("doc_id", "text", "lost")

    def make(batch: pa.RecordBatch) -> dict:
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2)):
            lines, gone = lines_of(text.as_py()), gone.as_py()
            stay = lines
            if gone:
                gone = set(gone)
                stay = [line for line in lines if line_key(line) not in gone]
            kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return {"doc_id": batch.column(0), "kept": kept, "n_lines": n_lines, "n_dropped": n_dropped}

    return map_rows(both, make, "doc_id long, kept string, n_lines long, n_dropped long")


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = without_repeated_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
