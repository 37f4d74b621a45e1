"""Log summaries, rate windows, sessions, overlap and breaker runs over event tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusweave import rules
from corpusweave.operators.ordering import carry_forward, micros, percentiles, running_total, value_ranks
from corpusweave.session import materialise

SECOND = 1_000_000


def parse_json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of well-formed lines; blank and malformed lines are skipped."""
    parsed = lines.filter(F.trim(column) != "").withColumn(
        "_r", F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    return parsed.filter("_r is not null and _r._bad is null").withColumn("record", F.col("_r")).drop("_r")


def log_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, errors, abstention rate and interpolated latency percentiles.

    Needs ``status, http_status, error, route, latency_ms``; an error is a status code of 400 or more,
    the status ``error`` or a non-empty error field. Empty latency gives 0.0 percentiles.
    """
    by = list(by)
    failed = (F.coalesce("http_status", F.lit(200)) >= 400) | (F.coalesce("status", F.lit("")) == "error") | F.coalesce(
        F.col("error") != "", F.lit(False)
    )
    abstained = ~failed & F.col("status").isin("unable_to_verify", "out_of_scope", "documentation_unavailable")
    answered = ~failed & (F.col("status") == "answered")
    counts = records.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("errors"), F.count_if(abstained).alias("_abstained"),
        F.count_if(answered).alias("_answered"),
    )
    done = F.col("_abstained") + F.col("_answered")
    rate = F.when(done > 0, F.round(F.col("_abstained") / done, 4)).otherwise(0.0)
    counts = counts.withColumn("abstention_rate", rate).drop("_abstained", "_answered")
    ranks = value_ranks(records, "latency_ms", {"n": F.lit(1)}, by)
    lat = percentiles(ranks, {"p50": ("linear", 0.5), "p95": ("linear", 0.95)}, by).drop("n")
    joined = counts.join(lat, by, "left") if by else counts.crossJoin(F.broadcast(lat))
    return joined.select(
        *by, "requests", "errors", "abstention_rate", F.coalesce(F.round("p50", 2), F.lit(0.0)).alias("p50_latency_ms"),
        F.coalesce(F.round("p95", 2), F.lit(0.0)).alias("p95_latency_ms"),
    )


# ---------------------------------------------------------------- rate windows
def offered_in_window(events: DataFrame, key: str, ts: str, seconds: int = rules.RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests of the key in the ``seconds`` up to and including each distinct instant.

    Instants are counted first; each then serves its own time slot and the next one, so a window only
    ever scans two slots of one key, however busy the key is.
    """
    width = seconds * SECOND
    instants = events.groupBy(key, micros(ts).alias("us")).agg(F.count("*").alias("n"))
    slots = instants.select(
        key, "us", "n", F.explode(F.array(F.floor(F.col("us") / width), F.floor(F.col("us") / width) + 1)).alias("slot")
    )
    recent = Window.partitionBy(key, "slot").orderBy("us").rangeBetween(-width + 1, 0)
    counted = slots.withColumn("offered", F.sum("n").over(recent))
    return counted.filter(F.col("slot") == F.floor(F.col("us") / width)).drop("slot")




def rate_limit(events: DataFrame, key: str, ts: str, limit: int = rules.RATE_LIMIT, seconds: int = rules.RATE_WINDOW_SECONDS) -> DataFrame:
    """Exact accept/reject of a sliding-window limit in which rejected requests are not recorded.

    An instant whose offered count stays within the limit is accepted whatever came before. Only
    over-limit instants need the sequential rule, and they only look back one window: chains of them
    with smaller gaps than the window (storms) are independent of each other. A storm is streamed in
    time order together with the accepted instants it can see, remembering at most ``limit`` instants;
    everything else never leaves the JVM.
    """
    width, segment = seconds * SECOND, 3600 * SECOND
    offered = materialise(offered_in_window(events, key, ts, seconds).withColumn("over", F.col("offered") > limit))
    over = offered.filter("over").select(key, "us")
    gaps = carry_forward(over, [key], F.col("us"), segment, F.col("us"), "before")
    starts = (F.col("before").isNull() | (F.col("us") - F.col("before") >= width)).cast("long")
    storms = running_total(gaps.withColumn("_start", starts), [key], F.col("us"), segment, F.col("_start"), "storm")
    tagged = offered.join(storms.select(key, "us", "storm"), [key, "us"], "left")
    # The next over-limit instant of every row, found by carrying against the direction of time.
    ahead = carry_forward(
        tagged, [key], -F.col("us"), segment, F.when(F.col("over"), F.struct("us", "storm")), "ahead", inclusive=True
    )
    seen = F.col("ahead").isNotNull() & (F.col("ahead.us") - F.col("us") < width)
    feed = ahead.filter(seen).select(key, F.col("ahead.storm").alias("storm"), "us", "n", F.col("over").cast("int").alias("live"))
    calm = offered.filter("not over").select(F.col(key), "us", "n", F.col("n").alias("accepted"))
    stormy = offered.filter("over")
    kind = offered.schema[key].dataType  # client addresses as well as numbers
    admitted = StructType([StructField("key", kind), StructField("us", LongType()), StructField("accepted", LongType())])
    ordered = feed.select(F.col(key).alias("key"), "storm", "us", F.col("n").cast("long"), "live").repartition("key", "storm").sortWithinPartitions("key", "storm", "us")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("key", "storm", "us", "n", "live")]
            out = []
            for k, storm, us, n, live in zip(*rows):
                if (k, storm) != current:
                    current, recent = (k, storm), deque()
                while recent and recent[0] <= us - width:
                    recent.popleft()
                taken = min(n, max(0, limit - len(recent))) if live else n
                recent.extend([us] * min(taken, limit))
                if live:
                    out.append((k, us, taken))
            types = (batch.schema.field("key").type, pa.int64(), pa.int64())
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=admitted.names)

    replayed = ordered.mapInArrow(replay, admitted).join(stormy.select(F.col(key).alias("key"), "us", "n"), ["key", "us"])
    return calm.select(F.col(key).alias("key"), "us", "n", "accepted").unionByName(
        replayed.select("key", "us", "n", "accepted")
    ).select(F.col("key").alias(key), "us", F.col("n").alias("requests"), "accepted", (F.col("n") - F.col("accepted")).alias("rejected"))


# ---------------------------------------------------------------- sessions, overlap, breaker
def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = rules.CONVERSATION_TTL_SECONDS) -> DataFrame:
    """Sessions that end after an idle gap longer than the time to live.

    Gap flags and session numbers come from segmented scans, then one partial aggregate per session.
    """
    instants = events.groupBy(key, micros(ts).alias("us")).agg(F.count("*").alias("n"))
    segment = 24 * 3600 * SECOND
    before = carry_forward(instants, [key], F.col("us"), segment, F.col("us"), "before")
    starts = (F.col("before").isNull() | (F.col("us") - F.col("before") > gap_seconds * SECOND)).cast("long")
    numbered = running_total(before.withColumn("_s", starts), [key], F.col("us"), segment, F.col("_s"), "session")
    return numbered.groupBy(key, "session").agg(
        F.sum("n").alias("events"), F.min("us").alias("start_us"), F.max("us").alias("end_us")
    )


def max_overlap(spans: DataFrame, key: Sequence[str], start: str, end: str, segment: float) -> DataFrame:
    """Largest number of spans open at once per key (an end at the same instant closes first)."""
    key = list(key)
    edges = spans.select(*key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    net = edges.groupBy(*key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("delta"))
    level = running_total(net, key, F.col("at"), segment, F.col("delta"), "open")
    return level.groupBy(*key).agg(F.max("open").alias("max_open"), F.count("*").alias("instants"))


def breaker_runs(events: DataFrame, key: str, order: Column, failed: Column, limit: int, segment: float) -> DataFrame:
    """Longest run of consecutive failures per key and whether the breaker would open."""
    rows = events.withColumn("_o", order).withColumn("_f", failed.cast("int"))
    broken = running_total(rows, [key], F.col("_o"), segment, 1 - F.col("_f"), "run")
    runs = broken.filter("_f = 1").groupBy(key, "run").agg(F.count("*").alias("length"))
    return runs.groupBy(key).agg(F.max("length").alias("longest_run"), (F.max("length") >= limit).alias("opens"))
