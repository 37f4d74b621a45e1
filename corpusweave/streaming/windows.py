"""Declarative stream operators: event-time counts and rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusweave import rules


def route_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests and errors per route and tumbling window."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("requests"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "requests", F.round("value", 4).alias("value"))
    )


def busy_clients(events: DataFrame, limit: int = rules.RATE_LIMIT, seconds: int = rules.RATE_WINDOW_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Clients over the limit in a sliding window (the offered load, not the exact admission rule)."""
    counted = (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds", f"{max(1, seconds // 6)} seconds").alias("w"), "user_id")
        .agg(F.count("*").alias("requests"))
    )
    return counted.filter(F.col("requests") > limit).select("user_id", F.col("w.start").alias("window_start"), "requests")
