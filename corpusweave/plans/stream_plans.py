"""Structured Streaming over the given tables, drained into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweave.plans.registry import ORACLE, query
from corpusweave.session import shared_folder
from corpusweave.plans.metric_plans import RATE_MAX, RATE_SECONDS
from corpusweave.streaming import conversation_state, ingest, rate_limit, windows


def _stream(t, table):
    # A stream reads folders; the pattern, which only this name fits, also takes a table that is a single file.
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


def _events(t, folder, *more):
    """(event stream, what closes it): a folder beside the events takes one row, a month after the last event and of nobody."""
    events = t.spark.read.parquet(f"{t.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "user_id", "event_type", "value", *more)
    closing = f"{folder}/closing"
    events.limit(0).write.parquet(closing)

    def close():
        last = events.agg(F.max("ts").alias("ts")).select(F.expr("ts + interval 30 days").alias("ts"))
        none = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns[1:]]
        last.select("ts", *none).write.mode("append").parquet(closing)

    stream = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*events.columns)
    return stream.unionByName(t.spark.readStream.schema(events.schema).parquet(closing)), close


def _folder(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("stream_sessions", ORACLE["sessions"])
def stream_sessions(t):
    """Conversation sessions, closed by a gap or by the end of the input: the same as over the whole table."""
    folder = _folder(t)
    events, close = _events(t, folder)
    closed = ingest.drain(conversation_state.stream_sessions(events), folder, "sessions", close=close)
    return closed.where("user_id is not null").select("user_id", "session", "events", "start_us", "end_us")


@query(
    "stream_route_counts",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS requests, round(sum(value), 4) AS value FROM events GROUP BY ALL",
)
def stream_route_counts(t):
    """Tumbling one-hour windows, all closed at the end of the input."""
    folder = _folder(t)
    events, close = _events(t, folder)
    return ingest.drain(windows.route_counts(events), folder, "routes", close=close).where("event_type is not null")


@query(
    "stream_ingest",
    "SELECT count(*) AS stored, count(DISTINCT doc_id) AS documents FROM documents",
)
def stream_ingest(t):
    """Documents ingested twice by a replayed stream are stored once."""
    folder = _folder(t)
    for attempt in ("first", "replay"):
        started = ingest.ingest_stream(_stream(t, "documents"), f"{folder}/store", f"{folder}/{attempt}")
        started.awaitTermination()
    store = t.spark.read.parquet(f"{folder}/store")
    return store.agg(F.count("*").alias("stored"), F.countDistinct("doc_id").alias("documents"))


@query("stream_rate_limit", ORACLE["rate_limit_decisions"])
def stream_rate_limit(t):
    """At most two accepted requests per user and hour, every event delivered twice: the same as over the whole table."""
    folder = _folder(t)
    events, close = _events(t, folder, "event_id")
    again, _ = _events(t, f"{folder}/again", "event_id")
    limited = rate_limit.stream_rate_limit(events.unionByName(again), RATE_MAX, RATE_SECONDS)
    return ingest.drain(limited, folder, "limited", close=close).where("user_id is not null")
