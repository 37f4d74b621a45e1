"""Reuse distances and what a bounded store of conversations evicts, without a global order in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusweave import rules
from corpusweave.operators.ordering import carry_forward, micros
from corpusweave.session import materialise

SECOND = 1_000_000
#: Positions of a time range, and the most ranges: a grid of ranges by ranges is the only table that grows with their square.
RANGE, RANGES = 1 << 16, 2048


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For every place the number of earlier places with a smaller value, by merging ever longer sorted stretches.

    In each step neighbouring stretches of ``width`` places are ordered together; what of the left one comes before a place of the right
    one is counted by a running sum.
    """
    n = len(values)
    count, place = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(values, kind="stable")
    width = 1
    while width < n:
        pair = place // (2 * width)
        by_pair = order[np.argsort(pair[order], kind="stable")]  # by pair of stretches, then value
        left = (by_pair // width) % 2 == 0
        seen = np.cumsum(left)
        first = np.searchsorted(pair[by_pair], pair[by_pair], side="left")
        before = seen - np.concatenate([[0], seen])[first]
        # of equal values those of the left stretch are ordered first; they are not smaller
        own = values[by_pair]
        key = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (pair[by_pair][1:] != pair[by_pair][:-1])]))
        group = np.repeat(np.arange(len(key)), np.diff(np.append(key, n)))
        smaller = np.concatenate([[0], seen])[key][group] - np.concatenate([[0], seen])[first]
        count[by_pair] += np.where(left, 0, np.minimum(before, smaller))
        width *= 2
    return count


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``pos``: 0, 1, 2 and so on in the order of the columns; ranges are sorted on their own and start where earlier ones end."""
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_row", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = rows.withColumn("_part", F.shiftright("_row", 33)).join(starts, "_part")
    return joined.withColumn("pos", F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_row")


def _counted(rows: DataFrame, cell: str, order: list, value: str, out: str) -> DataFrame:
    """``pos`` and the number of rows of its ``cell`` that come earlier in ``order`` with a smaller ``value``; a cell is a task's array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def flushed():
            pos, values = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(pos), pa.array(smaller_before(values))], ["pos", out])

        for batch in batches:
            cells, pos, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if a == b:
                    continue
                if held and cells[a] != current:
                    yield flushed()
                    held = []
                current = cells[a]
                held.append((pos[a:b], values[a:b]))
        if held:
            yield flushed()

    # the sort columns are dropped in the same stage, so order and cell survive as they are
    ordered = rows.repartition(cell).sortWithinPartitions(cell, *order).select(cell, "pos", value)
    return ordered.mapInArrow(run, f"pos long, {out} long")


def reuse_distances(touches: DataFrame, key: str, ts: str, range_rows: int = RANGE, most_ranges: int = RANGES) -> DataFrame:
    """``key, us, pos, before_us, distance``: how many other keys were touched since the key's touch before; null for its first.

    Touches of one key at one instant are one. Touch i, whose key was touched before at p, has seen as many other keys as touches j in
    between are the first of their key since p: those with ``prev(j) < p``. All touches up to p have one, so the distance is the number
    of j before i with ``prev(j) < p``, less the touches up to p. Pairs are counted in three parts: j in the time range of i (an array
    in a task), j in an earlier range with ``prev(j)`` in an earlier range than p (running sums over a grid of ranges, pre-aggregated),
    and j in an earlier range with ``prev(j)`` in the range of p (an array in a task). A range has a bounded number of positions and
    positions are distinct, so no key, however busy, makes a task larger than others.
    """
    instants = touches.groupBy(key, micros(ts).alias("us")).agg(F.count("*").alias("touches")).withColumn("_null", F.col(key).isNull())
    placed = numbered(instants.drop("touches"), "us", "_null", key).drop("_null")
    # a missing key is a conversation too, and the last one of an instant
    placed = placed.withColumn("_id", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")))
    total = placed.count()
    width = max(range_rows, -(-total // most_ranges))
    before = carry_forward(placed, ["_id"], F.col("pos"), 4 * width, F.struct("pos", "us"), "_before")
    rows = before.select(key, "us", "pos", F.col("_before.pos").alias("prev"), F.col("_before.us").alias("before_us"))
    rows = rows.withColumn("_range", F.floor(F.col("pos") / width)).withColumn("_bucket", F.coalesce(F.floor(F.col("prev") / width) + 1, F.lit(0)))
    rows = materialise(rows.withColumn("_prev", F.coalesce("prev", F.lit(-1))))

    near = _counted(rows, "_range", ["pos"], "_prev", "near")
    # within a bucket, touches of the same range must not count: of these the later prev comes first
    far = _counted(rows.where("prev is not null"), "_bucket", ["_range", F.desc("prev")], "_prev", "far")
    ranges = max(1, -(-total // width))
    grid = rows.groupBy("_range", "_bucket").agg(F.count("*").alias("n"))
    cells = rows.sparkSession.range(ranges).select(F.col("id").alias("_range"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges).cast("long"))).alias("_bucket"))
    cells = cells.join(grid, ["_range", "_bucket"], "left")
    along = cells.withColumn("row", F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grid = along.select("_range", "_bucket", F.coalesce(F.sum("row").over(Window.partitionBy("_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("grid"))

    found = rows.join(near, "pos").join(far, "pos", "left").join(grid, ["_range", "_bucket"])
    seen = F.col("near") + F.coalesce("far", F.lit(0)) + F.col("grid") - F.col("prev") - 1
    return found.select(key, "us", "pos", "before_us", seen.alias("distance"))


def evictions(
    touches: DataFrame, key: str, ts: str, capacity: int, ttl_seconds: float = rules.CONVERSATION_TTL_SECONDS, range_rows: int = RANGE
) -> DataFrame:
    """``key, us, idle_us, distance, outcome`` of every touch of a store that keeps the ``capacity`` conversations touched last.

    ``new``: never seen before; ``expired``: idle for longer than the time to live; ``evicted``: at least ``capacity`` other
    conversations were touched since; ``kept`` otherwise. An expired conversation is gone before capacity is looked at.
    """
    rows = reuse_distances(touches, key, ts, range_rows).withColumn("idle_us", F.col("us") - F.col("before_us"))
    outcome = (
        F.when(F.col("before_us").isNull(), "new").when(F.col("idle_us") > int(ttl_seconds * SECOND), "expired")
        .when(F.col("distance") >= capacity, "evicted").otherwise("kept")
    )
    return rows.select(key, "us", "idle_us", "distance", outcome.alias("outcome"))
