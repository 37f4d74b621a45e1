"""Sources and sinks: a given table is written to the shared folder in a format, read back and compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweave.functions.binding import bind
from corpusweave.operators import hierarchy, segment as G
from corpusweave.plans.registry import query
from corpusweave.plans.segment_plans import CHUNKS
from corpusweave.session import shared_folder
from corpusweave.sources import readers, writers
from corpusweave.sources.vector_table import VectorTable


def _folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("source_page_directory", "SELECT item_id, md5(text) AS text_md5 FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def source_page_directory(t):
    """One JSON document per file, blank texts skipped."""
    folder = _folder(t, "page-directory")
    t.benchmark.write.option("maxRecordsPerFile", 1).json(folder)
    pages = readers.read_page_directory(t.spark, folder, "item_id string, text string")
    kind = t.benchmark.schema["item_id"].dataType
    return pages.select(F.col("item_id").cast(kind), F.md5("text").alias("text_md5"))


@query("source_raw_store", "SELECT page_id, page_id % 10 = 3 AS corrupt, length(html) AS chars FROM pages")
def source_raw_store(t):
    """Stored pages with their digests; the digests of some pages are spoilt, and those come back as corrupt."""
    folder = _folder(t, "raw-store")
    digest = F.when(F.col("page_id") % 10 == 3, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256))
    t.pages.select("page_id", F.col("html").alias("text_raw"), digest.alias("page_hash")).write.parquet(folder)
    usable, corrupt = readers.read_raw_store(t.spark, folder)
    both = usable.withColumn("corrupt", F.lit(False)).unionByName(corrupt.withColumn("corrupt", F.lit(True)))
    return both.select("page_id", "corrupt", F.length("text_raw").alias("chars"))


@query("source_url_lines", "SELECT url, count(*) AS lines FROM pages GROUP BY url")
def source_url_lines(t):
    """A list of quoted URLs with byte-order marks, comments and blank lines in between."""
    folder = _folder(t, "url-lines")
    written = F.array(
        F.concat(F.lit("# page "), F.col("page_id").cast("string")), F.lit("  "), F.concat(F.lit('﻿ "'), "url", F.lit('" ')),
    )
    t.pages.where("url is not null").select(F.explode(written).alias("value")).write.text(folder)
    return readers.read_url_lines(t.spark, folder).groupBy("url").agg(F.count("*").alias("lines"))


@query(
    "source_toc_tree",
    """SELECT l_orderkey AS guide, l_partkey || '-' || l_linenumber || '.html' AS file_path, l_partkey::VARCHAR AS page_id, '-' || l_linenumber AS alias,
    1 AS depth, 'Lines > Line ' || l_linenumber AS toc_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place FROM lineitem""",
)
def source_toc_tree(t):
    """The lines of an order (seven at most) as a table of contents below a heading without a page."""
    number = F.col("l_linenumber").cast("string")
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.concat(F.lit("Line "), number).alias("t"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), number, F.lit(".html")).alias("u"),
    )
    orders = t.lineitem.groupBy(F.col("l_orderkey").alias("guide")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    children = F.transform("lines", lambda x: F.struct(x["t"].alias("t"), x["u"].alias("u")))
    heading = F.array(F.struct(F.lit("Lines").alias("t"), F.lit("").alias("u"), children.alias("c")))
    folder = _folder(t, "toc")
    orders.select("guide", heading.alias("toc")).write.json(folder)
    kind = t.lineitem.schema["l_orderkey"].dataType.simpleString()
    stored = t.spark.read.schema(f"guide {kind}, toc array<struct<t: string, u: string, c: array<struct<t: string, u: string>>>>").json(folder)
    nodes = hierarchy.toc_nodes(stored, "guide", "toc")
    return nodes.select(
        "guide", "file_path", "page_id", "alias", "depth", F.array_join("path", " > ").alias("toc_path"), F.element_at("order", -1).alias("place"),
    )


@query("vector_store", "SELECT vec_id, len(embedding) AS dims, embedding[1]::DOUBLE AS first_value FROM embeddings")
def vector_store(t):
    """A vector table rebuilt, its rows counted, and read with a check of each vector's length."""
    folder = _folder(t, "vectors")
    rows = t.embeddings.select("vec_id", "embedding")
    writers.write_vectors(rows, folder, expected=rows.count())
    dims = rows.select(F.size("embedding").alias("n")).first().n
    stored = readers.read_vectors(t.spark, folder, dims)
    return stored.select("vec_id", F.size("embedding").alias("dims"), F.get("embedding", 0).cast("double").alias("first_value"))


@query(
    "vector_upsert",
    """SELECT vec_id, len(embedding) AS dims, (CASE WHEN label % 2 = 1 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE AS first_value, 3::BIGINT AS version FROM embeddings""",
)
def vector_upsert(t):
    """Vectors of labels below 5, then an upsert of the others, then one that turns those of odd labels round and comes twice."""
    store = VectorTable(t.spark, _folder(t, "vector-table"), rows_per_file=max(50, t.embeddings.count() // 20))
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    turned = rows.where("label % 2 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    store.upsert(rows.where("label < 5").drop("label"), "first")
    store.upsert(rows.where("label >= 5").drop("label"), "second")
    for _ in range(2):
        version = store.upsert(turned.drop("label"), "turned")
    return store.read().select("vec_id", F.size("embedding").alias("dims"), F.get("embedding", 0).alias("first_value"), F.lit(version).cast("long").alias("version"))


@query("source_golden_cases", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def source_golden_cases(t):
    """One case a line; blank and broken lines between the cases are dropped."""
    folder = _folder(t, "cases")
    case = F.to_json(F.struct(F.col("item_id").cast("string").alias("item_id"), "text"))
    t.benchmark.select(F.explode(F.array(case, F.lit(""), F.lit('{"item_id": '))).alias("value")).write.text(folder)
    cases = readers.read_json_lines(t.spark, folder, "item_id string, text string")
    return cases.select(F.col("item_id").cast(t.benchmark.schema["item_id"].dataType), F.md5("text").alias("text_md5"))


@query("sink_page_records", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def sink_page_records(t):
    """Documents as JSON records in a directory per language."""
    folder = _folder(t, "page-records")
    writers.write_pages(t.documents.select("doc_id", "lang", "text"), folder, "lang")
    return t.spark.read.schema("doc_id long, text string, lang string").json(folder).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("sink_json_lines", "SELECT doc_id, source, md5(text) AS text_md5, true AS in_name_order FROM documents")
def sink_json_lines(t):
    """Documents as JSON lines; the keys of a line stand in name order."""
    folder = _folder(t, "json-lines")
    writers.write_json_lines(t.documents.select("text", "source", "doc_id"), folder, ["doc_id"])
    keys = F.json_object_keys("value")
    return t.spark.read.text(folder).select(
        F.from_json("value", "doc_id long, source string, text string").alias("r"), (keys == F.array_sort(keys)).alias("in_name_order"),
    ).select("r.doc_id", "r.source", F.md5("r.text").alias("text_md5"), "in_name_order")


@query(
    "sink_embedding_records",
    f"""{CHUNKS} SELECT doc_id || '/' || chunk_index AS id, md5(source || chr(10) || chunk_text) AS document_md5, lang, source || ' > ' || lang AS toc_path FROM chunks""",
)
def sink_embedding_records(t):
    """Chunks as ``id, document, metadata`` lines; lists in the metadata are joined."""
    folder = _folder(t, "records")
    docs = t.documents.select("doc_id", "source", "lang", "text")
    chunks = bind(docs, cs=G.pack_text(F.col("text"))).select("doc_id", "source", "lang", F.posexplode("cs").alias("n", "chunk"))
    chunks = chunks.withColumn("chunk_id", F.format_string("%d/%d", "doc_id", "n")).withColumn("toc_path", F.array("source", "lang"))
    document = G.embedding_text(F.col("chunk"), F.col("source"), F.col("lang"), "title")
    writers.write_json_lines(writers.embedding_records(chunks, "chunk_id", document, ["lang"], {"toc_path": " > "}), folder, ["id"])
    stored = t.spark.read.schema("id string, document string, metadata struct<lang: string, toc_path: string>").json(folder)
    return stored.select("id", F.md5("document").alias("document_md5"), "metadata.lang", "metadata.toc_path")


@query("sink_inventory", "SELECT page_id, url, length(html) AS chars FROM pages")
def sink_inventory(t):
    """An inventory of all pages as CSV with a header."""
    folder = _folder(t, "inventory")
    writers.write_inventory(t.pages.select("page_id", "url", F.length("html").alias("chars")), folder)
    kind = t.pages.schema["page_id"].dataType.simpleString()
    return t.spark.read.schema(f"page_id {kind}, url string, chars int").option("header", True).csv(folder)


@query("sink_event_log", "SELECT event_type, count(*) AS events, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def sink_event_log(t):
    """Events appended to a log of JSON lines in two runs."""
    folder = _folder(t, "event-log")
    events = t.events.select("user_id", "event_type", "value")
    later = F.coalesce(F.col("value") > 1, F.lit(False))
    writers.append_events(events.where(~later), folder)
    writers.append_events(events.where(later), folder)
    logged = t.spark.read.schema("user_id string, event_type string, value double").json(folder)
    return logged.groupBy("event_type").agg(F.count("*").alias("events"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("result_ledger", "SELECT doc_id AS id, 'base' AS config, 'quality' AS mode, quality::BIGINT AS result FROM labels")
def result_ledger(t):
    """Results of all labelled documents in a run that stops after the good ones, a resumed run and a repeated one."""
    folder = _folder(t, "ledger")
    work = t.labels.select(
        F.lit("base").alias("config"), F.col("doc_id").alias("id"), F.lit("quality").alias("mode"), F.col("quality").cast("long").alias("result")
    )
    header = {"questions": "labels"}
    writers.ResultLedger(t.spark, folder, header).append(work.where("result = 1"))
    for _ in range(2):
        writers.ResultLedger(t.spark, folder, header).append(work)
    return t.spark.read.parquet(f"{folder}/rows").select("id", "config", "mode", "result")
