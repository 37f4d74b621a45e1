"""What several training-data operators share: intermediate tables, word splitting, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave.session import bound_batches, shared_folder

#: Words are runs of anything but these (Java regex); ``bytes.split()`` splits at exactly the same characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables below the folder all executors share; a table can be dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.written = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.written += 1
        return f"{self.folder}/{self.written:03d}-{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = self.path(name)
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Only A-Z become small; other letters stay (``lower`` would change them too)."""
    return F.translate(text, CAPITALS, SMALL)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8; a missing text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply ``make`` to Arrow batches; it returns columns in the order of ``schema``, or nothing.

    A batch is bounded in rows and bytes by the session, so a task holds a few texts and never a partition.
    """
    bound_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (columns := make(batch)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(v, f.type) for v, f in zip(columns.values(), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
