"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that Python gets: ten thousand texts, Spark's only bound by default, may be any size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    BATCH_BYTES[0]: BATCH_BYTES[1],
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def get_session(app: str = "corpusweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; extra settings use ``__`` for dots in their names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of a Python batch in a session that does not say how large one may be."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process may do without the setting; elsewhere a
    local folder would be written by each executor for itself, and later reads would miss rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="corpusweave-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and continue from that table.

    Used where a plan would otherwise be evaluated twice, or twice with results that must agree. The
    written copy survives the loss of executors, is read back by column, and its size is known to the
    planner, so joins with it are planned from facts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
