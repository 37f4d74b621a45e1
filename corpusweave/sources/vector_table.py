"""A keyed table with upserts: files of disjoint key ranges, rewritten only where a key falls into them."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusweave.session import materialise

ROWS_PER_FILE = 100_000


class VectorTable:
    """Rows by ``key`` below ``folder``; readers see the last committed version, whatever a running or broken writer does.

    ``data`` holds files of rows, ``manifest/<version>`` a row for each file of a version (``file, low, high, rows``), and
    ``heads/<version>`` one row (``version, batch, rows``). A version exists once its head does: the head is a single file that
    Spark moves into place, written last. A second writer of the same version fails there and leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.folder, self.key, self.rows_per_file = spark, folder.rstrip("/"), key, rows_per_file

    def heads(self) -> list:
        """(version, batch, rows) of all versions, oldest first: a row for each upsert."""
        try:
            found = self.spark.read.schema("version long, batch string, rows long").parquet(f"{self.folder}/heads/*").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(found, key=lambda r: r.version)

    def files(self, version: int | None = None) -> list:
        """(file, low, high, rows) of a version's files in key order; the last version if none is named."""
        heads = self.heads()
        version = version if version is not None else heads[-1].version if heads else None
        found = self.spark.read.parquet(f"{self.folder}/manifest/{version:010d}").collect() if version is not None else []
        return sorted(found, key=lambda r: ordered(r.low))

    def read(self, version: int | None = None) -> DataFrame:
        files = self.files(version)
        if not files:
            raise ValueError("nothing was written yet")
        return self.spark.read.parquet(*[f.file for f in files])

    def upsert(self, rows: DataFrame, batch: str | None = None, newest: str | None = None) -> int:
        """Insert rows and replace those whose key is stored; returns the version that holds them.

        A ``batch`` that is already in is not applied again. Of rows with one key the one with the largest ``newest`` counts, ties and
        tables without it go by the rows' hashes. A null key is an error. Without rows the version stays.
        """
        heads = self.heads()
        done = [h.version for h in heads if batch is not None and h.batch == batch]
        if done:
            return done[0]
        key = self.key
        order = F.struct(*([F.col(newest)] if newest else []), F.xxhash64(*[F.col(c) for c in rows.columns]))
        new = materialise(rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*"))
        if new.where(F.col(key).isNull()).limit(1).count():
            raise ValueError(f"rows without {key}")
        files = self.files(heads[-1].version) if heads else []
        placed = self._placed(new, [f.low for f in files])
        counts = dict(placed.groupBy("slot").agg(F.count("*").alias("n")).collect())  # a row for each file at most
        if not counts:
            return heads[-1].version if heads else 0
        touched = [f for n, f in enumerate(files) if n in counts]
        kept = [f for n, f in enumerate(files) if n not in counts]
        merged = placed
        if touched:
            old = self.spark.read.parquet(*[f.file for f in touched]).select(*rows.columns)
            old = old.join(new.select(key), key, "left_anti").select(*rows.columns)
            merged = placed.unionByName(self._placed(old, [f.low for f in files]))
        size = sum(f.rows for f in touched) + sum(counts.values())
        version = heads[-1].version + 1 if heads else 1
        written = self._write(merged, f"{self.folder}/data/{version:010d}-{uuid.uuid4().hex}", max(1, -(-size // self.rows_per_file)))
        self._commit(version, batch, kept, written)
        return version

    def _placed(self, rows: DataFrame, lows: list) -> DataFrame:
        """``slot``: which file's range a key belongs to; what is below all ranges belongs to the first."""
        shared = self.spark.sparkContext.broadcast([ordered(v) for v in lows])  # one key for each file

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts = shared.value
            for batch in batches:
                keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
                slots = pa.array([max(0, bisect_right(starts, ordered(k)) - 1) for k in keys], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, slots], [*batch.schema.names, "slot"])

        key = self.key
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("slot", IntegerType())]))

    def _write(self, rows: DataFrame, path: str, number: int) -> DataFrame:
        """Files in key order; none has keys of two slots, so ranges stay disjoint. Returns their manifest rows."""
        laid = rows.repartitionByRange(number, "slot", self.key).sortWithinPartitions("slot", self.key)
        laid.write.partitionBy("slot").parquet(path)
        stored = self.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), self.key)
        return stored.groupBy("file").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))

    def _commit(self, version: int, batch: str | None, kept: list, written: DataFrame) -> None:
        schema = StructType([StructField("file", StringType()), *written.schema.fields[1:]])
        manifest = written.select("file", "low", "high", "rows").unionByName(self.spark.createDataFrame([tuple(f) for f in kept], schema))
        manifest.coalesce(1).write.parquet(f"{self.folder}/manifest/{version:010d}")
        total = self.spark.read.parquet(f"{self.folder}/manifest/{version:010d}").agg(F.sum("rows")).first()[0]
        head = self.spark.createDataFrame([(version, batch, total)], "version long, batch string, rows long")
        head.coalesce(1).write.parquet(f"{self.folder}/heads/{version:010d}")


def ordered(key):
    """Keys compare as Spark orders them: strings by their bytes."""
    return key.encode("utf-8", "surrogatepass") if isinstance(key, str) else key
