"""Writers: page tables, JSON lines, embedding records, vectors, inventories, logs and result ledgers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_pages(pages: DataFrame, folder: str, guide: str = "guide_id") -> None:
    """Page documents as JSON, one directory per guide; the commit protocol makes it all or nothing.

    Rows are spread by guide and a salt, so a guide with most pages is written by many tasks.
    """
    salted = pages.repartition(F.col(guide), F.pmod(F.xxhash64(*pages.columns), F.lit(64)))
    salted.write.mode("overwrite").partitionBy(guide).json(folder)


def write_json_lines(rows: DataFrame, folder: str, order: list[str]) -> None:
    """JSON lines with columns in name order, range-sorted by ``order``."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("overwrite").json(folder)


def embedding_records(chunks: DataFrame, chunk_id: str, document: Column, scalars: list[str], lists: dict[str, str]) -> DataFrame:
    """``id, document, metadata`` with scalar-only metadata: lists are joined by their separator."""
    joined = [F.array_join(F.col(c).cast("array<string>"), sep).alias(c) for c, sep in lists.items()]
    return chunks.select(F.col(chunk_id).alias("id"), document.alias("document"), F.struct(*scalars, *joined).alias("metadata"))


def write_vectors(vectors: DataFrame, folder: str, expected: int | None = None) -> int:
    """Rebuild a vector table and check how many rows it holds."""
    vectors.write.mode("overwrite").parquet(folder)
    stored = vectors.sparkSession.read.parquet(folder).count()
    if expected is not None and stored != expected:
        raise ValueError(f"expected {expected} vectors, stored {stored}")
    return stored


def write_inventory(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Append build or request events as JSON lines."""
    events.write.mode("append").json(folder)


class ResultLedger:
    """Append-only evaluation results with a pinned header.

    A resumed run skips finished ``(config, id, mode)`` keys; a ledger written for another header
    (question set, model or configuration list) is refused.
    """

    KEY = ("config", "id", "mode")

    def __init__(self, spark: SparkSession, folder: str, header: dict):
        self.spark, self.rows = spark, f"{folder}/rows"
        pinned = json.dumps(header, sort_keys=True)
        heads = f"{folder}/header"
        try:
            found = [r.value for r in spark.read.text(heads).collect()]  # one line by construction
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            spark.range(1).select(F.lit(pinned).alias("value")).coalesce(1).write.text(heads)
            found = [pinned]
        if found != [pinned]:
            raise ValueError("the ledger belongs to a different header")

    def _done(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.rows)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def pending(self, work: DataFrame) -> DataFrame:
        done = self._done()
        return work if done is None else work.join(done.select(*self.KEY), list(self.KEY), "left_anti")

    def append(self, results: DataFrame) -> None:
        self.pending(results).write.mode("append").parquet(self.rows)
