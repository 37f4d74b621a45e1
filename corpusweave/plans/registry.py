"""Query catalogue: every entry is a DataFrame plan over the given tables plus an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from corpusweave.session import bound_batches

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one directory: ``tables.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give a table that sits in fewer files than there are cores one partition per core.

    A single small file is one scan task, and text work would then run on one core. Tables with
    enough files are left as they are; filters and column pruning still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _run(plan, spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return plan(Tables(spark, folder))


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` is the text a second engine runs on the same tables."""

    def register(plan):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = partial(_run, plan)
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return register
