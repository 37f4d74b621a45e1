"""Benchmark passages in documents by a prefix-filtered join on rare shingles (query ``op9_decontaminate``).

Everything on this path is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, ascii_lower, table

#: Words of a window, words of a shingle, entries that are broadcast at once (a few dozen MB).
WINDOW, SHINGLE, ENTRIES = 13, 3, 400_000
SEPARATORS, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if a twentieth of its words or more are hit.
SHARE = 20


def words(text: Column) -> Column:
    """Words in order. A text that begins with a separator has an empty word first, which no window contains."""
    return F.split(ascii_lower(text), SEPARATORS)


def shingle(array: str, place: str, size: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({array}, {place} + {i})' for i in range(size))})")


def _item_texts(items: DataFrame) -> DataFrame:
    """``item, ids, words, size`` of each different text: items with the same words are looked for once."""
    own = F.filter(words(F.col("text")), lambda w: w != "")
    rows = items.where("text is not null").select(F.col("item_id").cast("string").alias("id"), own.alias("words"))
    rows = rows.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("id").alias("ids"))
    return rows.select(F.sha2(F.array_join("words", " "), 256).alias("item"), "ids", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("size"))


def _shingles(texts: DataFrame) -> DataFrame:
    """``item, size, n, place, key``: shingles of each text, as long as its windows if those are shorter."""
    width = F.least(F.lit(SHINGLE), F.size("words"))
    placed = texts.select("item", "size", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("place"))
    key = F.when(F.col("width") == 1, shingle("words", "place", 1)).when(F.col("width") == 2, shingle("words", "place", 2)).otherwise(shingle("words", "place", 3))
    return placed.select("item", "size", "width", "place", key.alias("key"))


def _occurrences(docs: DataFrame, entries: DataFrame, widths: list[int], columns: list) -> DataFrame:
    """Rows of ``columns`` for every place of a document whose shingle is an entry's ``key`` (with ``width``).

    Entries come in blocks of bounded size that each reach every task, so no document word is shuffled and
    a shingle that very many documents share stays where its documents are.
    """
    found = None
    total = entries.count()
    numbered = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-2 * total // ENTRIES)) if total > ENTRIES else 1)))
    split = docs.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    placed = split.select("*", F.posexplode("words").alias("at", "word"))
    for block in range(max(1, -(-2 * total // ENTRIES)) if total > ENTRIES else 1):
        for width in widths:
            own = numbered.where((F.col("block") == block) & (F.col("width") == width)).drop("block", "width")
            rows = placed.withColumn("key", shingle("words", "at", width)).join(F.broadcast(own), "key").select(*columns)
            found = rows if found is None else found.unionByName(rows)
    return found


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, low, high, ids``: stretches of document words (both ends included) equal to windows of items.

    Windows are sets that must be contained whole, so one shingle of each is a necessary prefix: the one that
    fewest places of the corpus have. A window whose rarest shingle occurs nowhere is given up. Each place
    of a prefix shingle is a candidate; there the words on both sides are compared one by one as far as a
    window reaches within the item and the document, and a run as long as a window is a hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    texts = scratch.write(_item_texts(items), "items")
    shingles = scratch.write(_shingles(texts), "shingles")
    widths = [r.width for r in shingles.select("width").distinct().collect()]  # 1, 2 or 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).where("text is not null")
    empty = "doc_id long, text_hash long, low int, high int, ids array<string>"
    if not widths:
        return spark.createDataFrame([], empty)
    keys = shingles.select("key", "width").distinct()
    number = _occurrences(rows, keys, widths, ["key"]).groupBy("key").agg(F.count("*").alias("df"))
    placed = scratch.write(shingles.join(number, "key"), "rarity")
    # windows with all their shingles in the corpus: the rarest of each, by place in the item
    first = F.sequence(F.greatest(F.lit(0), F.col("place") + F.col("width") - F.col("size")), F.col("place"))
    within = placed.select("item", "size", "width", F.explode(first).alias("window"), F.struct("df", "key", "place").alias("token"))
    prefix = within.groupBy("item", "size", "width", "window").agg(F.min("token").alias("token"), F.count("*").alias("n"))
    prefix = prefix.where(F.col("n") == F.col("size") - F.col("width") + 1).select("item", "width", F.col("token.key").alias("key"), F.col("token.place").alias("place")).distinct()
    prefix = scratch.write(prefix, "prefix")

    reach = WINDOW - 1
    start = F.greatest(F.col("at") - reach, F.lit(0))
    near = F.slice("words", start + 1, F.col("at") - start + WINDOW).alias("near")
    columns = ["doc_id", "text_hash", "item", "place", "at", start.alias("start"), near]
    found = _occurrences(rows, prefix, widths, columns).join(texts, "item")
    differs = "NOT coalesce(get(near, at - start {0} k) = get(words, place {0} k), false)"
    before = F.expr(f"coalesce(array_min(filter(sequence(1, {reach}), k -> {differs.format('-')})), {WINDOW}) - 1")
    after = F.expr(f"coalesce(array_min(filter(sequence(0, {reach}), k -> {differs.format('+')})), {WINDOW}) - 1")
    found = found.withColumn("low", F.col("at") - before).withColumn("high", F.col("at") + after)
    return found.where(F.col("high") - F.col("low") + 1 >= F.col("size")).select("doc_id", "text_hash", "low", "high", "ids")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of ``docs`` (``doc_id``, ``text``); ``items`` are item ids as sorted strings.

    A null or empty text has no words. An item without words has no windows; one without id marks words but is not named.
    Rows repeated under one doc_id with the same text have the same result, rows with other texts their own.
    """
    found = hits(docs, items).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items")
    )
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'end', -1), (a, s) -> named_struct('n', a.n + greatest(0, s.high - greatest(a.end, s.low - 1)), "
        "'end', greatest(a.end, s.high)), a -> a.n)"
    )
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), covered.alias("hit"), "items")
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), n_words.cast("long").alias("n_words"))
    both = rows.join(found, rows.doc_id.eqNullSafe(found.id) & (rows.hash == found.hash), "left")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return both.select(
        rows.doc_id, rows.hash.alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    return rows.join(bad, rows.own.eqNullSafe(bad.id) & (rows.hash == bad.text_hash), "left_anti").select("row.*")


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[p:p + least(13, len(words)) - 1], ' ') AS key
  FROM items, unnest(generate_series(1, greatest(len(words) - 12, least(len(words), 1)))) AS t(p) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS p FROM split, sizes WHERE len(words) >= size
), found AS (
  SELECT doc_id, p, w.size, item_id FROM places JOIN windows w ON places.size = w.size AND array_to_string(words[p:p + places.size - 1], ' ') = w.key
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
