"""Ordered computations that never put a whole key, or the whole table, into one task.

Three ideas cover the ordered operators of the library:

* values are pre-aggregated to one row per distinct value before anything is sorted;
* a global order is split into value ranges, each range is scanned on its own and receives the
  totals of the ranges before it;
* a long history of one key is split into segments of the ordering column, and a summary row per
  segment carries state from one segment to the next.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusweave.session import materialise

ROWS_PER_RANGE = 200_000


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (zone-less ones are UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def value_ranks(
    df: DataFrame,
    value: str,
    measures: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per distinct value of each group, with running totals.

    For each measure ``m`` the result has ``m`` (in this row), ``m_before`` (in smaller values) and
    ``m_total``; ``next_value`` is the next larger distinct value of the group.
    """
    by = list(by)
    measures = dict(measures or {"n": F.lit(1)})
    counts = materialise(
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    )
    ranges = math.ceil(counts.count() / rows_per_range)
    keyed = counts.withColumn("_key", F.col("value").cast("double"))
    cuts: list[float] = []
    if ranges > 1:
        # A bounded number of cut points; the values themselves never reach the driver.
        probabilities = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(keyed.approxQuantile("_key", probabilities, 1 / (4 * ranges))))
    if cuts:
        splits = [-math.inf, *cuts, math.inf]
        keyed = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("_range", F.lit(0.0))

    inside = Window.partitionBy(*by, "_range").orderBy("value")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    scanned = keyed
    for name in measures:
        scanned = scanned.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
    scanned = scanned.withColumn("next_value", F.lead("value").over(inside))

    # One row per range: a few hundred rows per group at most, whatever the table size.
    across = Window.partitionBy(*by).orderBy("_range")
    totals = keyed.groupBy(*by, "_range").agg(
        *[F.sum(name).alias(f"_{name}_sum") for name in measures], F.min("value").alias("_first")
    )
    for name in measures:
        running = F.sum(f"_{name}_sum").over(across.rowsBetween(Window.unboundedPreceding, -1))
        totals = totals.withColumn(f"_{name}_off", F.coalesce(running, F.lit(0)))
        totals = totals.withColumn(f"{name}_total", F.sum(f"_{name}_sum").over(Window.partitionBy(*by)))
    totals = totals.withColumn("_next_first", F.lead("_first").over(across))
    totals = totals.select(
        *by, "_range", "_next_first", *[c for name in measures for c in (f"_{name}_off", f"{name}_total")]
    )
    out = scanned.join(totals, [*by, "_range"])
    return out.select(
        *by,
        "value",
        *measures,
        *[(F.col(f"{name}_before") + F.col(f"_{name}_off")).alias(f"{name}_before") for name in measures],
        *[f"{name}_total" for name in measures],
        F.coalesce("next_value", "_next_first").alias("next_value"),
    )


def _value_at(position: Column) -> Column:
    hit = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(hit, F.col("value")))


def percentiles(ranks: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles from ``value_ranks``; ``wanted`` maps an output name to (definition, fraction).

    Definitions: ``linear`` (interpolated between closest ranks), ``nearest`` (1-based ceil rank),
    ``floor_prev`` (index ``int(n*p) - 1``) and ``floor`` (index ``int(n*p)``).
    """
    total = F.col("n_total")
    aggregates: list[Column] = []
    for name, (kind, p) in wanted.items():
        if kind == "linear":
            low = F.floor((total - 1) * F.lit(p))
            aggregates += [
                _value_at(low).alias(f"{name}__lo"),
                _value_at(F.least(low + 1, total - 1)).alias(f"{name}__hi"),
            ]
        else:
            index = {
                "nearest": F.greatest(F.lit(1), F.least(total, F.ceil(F.lit(p) * total))) - 1,
                "floor_prev": F.greatest(F.lit(0), F.floor(total * F.lit(p)) - 1),
                "floor": F.least(F.floor(total * F.lit(p)), total - 1),
            }[kind]
            aggregates.append(_value_at(index).alias(name))
    grouped = ranks.groupBy(*by).agg(F.max("n_total").alias("n"), *aggregates)
    columns: list[Column] = [F.col(c) for c in by] + [F.col("n")]
    for name, (kind, p) in wanted.items():
        if kind == "linear":
            fraction = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
            low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
            columns.append((low + (high - low) * fraction).alias(name))
        else:
            columns.append(F.col(name))
    return grouped.select(*columns)


def carry_forward(
    df: DataFrame, key: Sequence[str], order: Column, width: float, value: Column, out: str, inclusive: bool = False
) -> DataFrame:
    """Last non-null ``value`` among the earlier rows of the key.

    The key's rows are cut into segments of ``width`` units of ``order``; a window runs inside each
    segment and one summary row per segment carries the state on, so a key holding a large share of
    the table is spread over as many tasks as it has segments.
    """
    key = list(key)
    work = df.withColumn("_ord", order).withColumn("_seg", F.floor(F.col("_ord") / F.lit(width)))
    work = work.withColumn("_val", value)
    inside = Window.partitionBy(*key, "_seg").orderBy("_ord").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    scanned = work.withColumn("_near", F.last("_val", ignorenulls=True).over(inside))
    summary = (
        work.groupBy(*key, "_seg")
        .agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_ord"))).alias("_last"))
        .withColumn(
            "_carried",
            F.last("_last", ignorenulls=True).over(
                Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*key, "_seg", "_carried")
    )
    joined = scanned.join(summary, [*key, "_seg"])
    return joined.withColumn(out, F.coalesce("_near", "_carried")).drop("_ord", "_seg", "_val", "_near", "_carried")


def running_total(
    df: DataFrame, key: Sequence[str], order: Column, width: float, amount: Column, out: str
) -> DataFrame:
    """Inclusive running sum per key, computed segment by segment like ``carry_forward``."""
    key = list(key)
    work = df.withColumn("_ord", order).withColumn("_seg", F.floor(F.col("_ord") / F.lit(width)))
    work = work.withColumn("_amt", amount)
    inside = Window.partitionBy(*key, "_seg").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    scanned = work.withColumn("_near", F.sum("_amt").over(inside))
    summary = (
        work.groupBy(*key, "_seg")
        .agg(F.sum("_amt").alias("_sum"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_sum").over(
                    Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*key, "_seg", "_offset")
    )
    joined = scanned.join(summary, [*key, "_seg"])
    return joined.withColumn(out, F.col("_near") + F.col("_offset")).drop("_ord", "_seg", "_amt", "_near", "_offset")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The rank filter is pushed below the shuffle as a group limit, so a
    task ships at most ``k`` rows of a group, however large the group is."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
