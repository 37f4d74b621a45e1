"""Readers: page directories, tolerant line files, JSON lines, vector tables and card texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave import rules
from corpusweave.functions import text as T


def read_page_directory(spark: SparkSession, folder: str, schema: str, text: str = "text") -> DataFrame:
    """One JSON document per file; pages without text are skipped, ``source_file`` keeps the order key."""
    rows = spark.read.schema(schema).json(folder, multiLine=True)
    return rows.withColumn("source_file", F.input_file_name()).filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def decode_bytes(content: Column) -> Column:
    """UTF-16 with a byte-order mark, else UTF-8; marks and zero-width characters are removed."""
    mark = F.hex(F.substring(content, 1, 2))
    decoded = F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    return F.translate(decoded, rules.INVISIBLE_CHARS, "")


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """URLs of hand-written list files: any encoding mark, ``#`` comments and blank lines tolerated."""
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.col("path").alias("source_file"), F.posexplode(F.split(decode_bytes(F.col("content")), "\r\n?|\n")).alias("line_no", "line"))
    url = F.trim(F.regexp_replace(F.trim("line"), r"^[\"'<]+|[\"'>]+$", ""))
    return lines.select("source_file", "line_no", url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_raw_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(usable, corrupt) stored pages; a page whose text does not match its digest is corrupt."""
    rows = spark.read.parquet(folder)
    sound = F.coalesce(F.sha2("text_raw", 256) == F.col("page_hash"), F.lit(False))
    return rows.filter(sound), rows.filter(~sound)


def read_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Vector table; a row of another length fails the read instead of distorting distances."""
    rows = spark.read.parquet(path)
    return rows.withColumn(
        "embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong vector length")))
    )


def card_fields(cards: DataFrame, text: str, labels: Mapping[str, str]) -> DataFrame:
    """Fields printed between labels of a card's text, in label order, plus the labels not found.

    ``labels`` maps an output column to its printed label; a field runs to the next label.
    """
    names = list(labels)
    stop = "|".join(rf"\Q{labels[n]}\E" for n in names)
    fields = {
        n: T.squeeze(F.regexp_extract(F.col(text), rf"(?s)\Q{labels[n]}\E\s*(.*?)\s*(?:{stop}|$)", 1)) for n in names
    }
    missing = F.array_compact(F.array(*[F.when(~F.contains(F.col(text), F.lit(labels[n])), F.lit(n)) for n in names]))
    return cards.select("*", *[c.alias(n) for n, c in fields.items()], missing.alias("missing_fields"))
