"""Incremental ingestion: idempotent appends of pages that are not stored yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusweave.operators import corpus as C


def missing_pages(plan: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Plan entries without a stored page; NULL never equals a stored key."""
    return plan.join(stored.select(*key), key, "left_anti")


def append_new(batch: DataFrame, store: str, key: list[str]) -> None:
    """Append the rows of a micro-batch whose key is not in ``store`` yet.

    Replaying a batch after a failure finds its keys stored and adds nothing.
    """
    spark = batch.sparkSession
    unique = batch.dropDuplicates(key)
    try:
        unique = missing_pages(unique, spark.read.parquet(store), key)
    except Exception as error:  # the store does not exist before the first append
        if "PATH_NOT_FOUND" not in str(error):
            raise
    unique.write.mode("append").parquet(store)


def ingest_stream(documents: DataFrame, store: str, checkpoint: str, key: list[str] | None = None):
    """Clean, hash and store arriving documents; returns the started query."""
    key = key or ["doc_id"]

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        cleaned = C.clean_documents(batch.select("doc_id", "lang", "source", "text")).select(
            "doc_id", "lang", "source", "clean_text", C.content_hash(F.col("clean_text")).alias("content_hash")
        )
        append_new(cleaned, store, key)

    return (
        documents.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drain(stream: DataFrame, folder: str, name: str, mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet table and read it back.

    ``close`` adds a last row to the stream's input once all else is read; its time moves the watermark past
    everything still open, which a second run of the same query then emits.
    """
    spark: SparkSession = stream.sparkSession
    target = f"{folder}/{name}"
    for step in (None, close) if close else (None,):
        if step:
            step()
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", f"{target}/data")
            .option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")
