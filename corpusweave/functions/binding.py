"""Evaluate an expensive expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-element generator, so that later uses read the value instead of
    having the optimizer copy the whole expression into every place that mentions it."""
    for name, expression in columns.items():
        df = df.select("*", F.explode(F.array(expression)).alias(name))
    return df


def let(expression: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``expression``, which is evaluated once however often ``body`` reads it."""
    return F.get(F.transform(F.array(expression), body), F.lit(0))
