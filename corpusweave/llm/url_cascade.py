"""URL lists answered by Bloom filter cascades, exactly and without a join (query ``op6_url_filter``)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, ascii_lower, map_rows, table

RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Hosts blocked where no rule fits, with all their subdomains.
BLOCKED_HOSTS = ("cheap-pills.example.com", "casino-win.example.org", "free-bets.example.com", "spam-farm.example.org")
#: Listed keys a cascade may have: it and its filters are then at most a few dozen MB.
MAX_LISTED, MAX_LEVELS = 10_000_000, 64


class Level(NamedTuple):
    bits: np.ndarray
    size: int
    probes: int

    def has(self, key: np.ndarray, other: np.ndarray, level: int) -> np.ndarray:
        found = np.ones(len(key), bool)
        for at in places(key, other, level, self.size, self.probes):
            found &= self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return found


def places(key: np.ndarray, other: np.ndarray, level: int, size: int, probes: int):
    """Bit numbers of keys, given by two hashes; every level has its own."""
    x = (key ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    step = other | np.uint64(1)
    for i in range(probes):
        yield ((x + np.uint64(i) * step) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)) % np.uint64(size)


class Cascade:
    """Level 0 holds the listed keys, level 1 the other keys that pass it, level 2 the listed ones that pass level 1, ...

    The first level that lacks a key settles it: an odd one says listed, an even one not listed. No key of the
    universe is left unsettled, so for them the answer is exact.
    """

    def __init__(self, levels: Sequence[Level]):
        self.levels = levels

    def listed(self, key: np.ndarray, other: np.ndarray) -> np.ndarray:
        answer, todo = np.zeros(len(key), bool), np.arange(len(key))
        for n, level in enumerate(self.levels):
            stay = level.has(key[todo], other[todo], n)
            answer[todo[~stay]] = n % 2 == 1
            todo = todo[stay]
        answer[todo] = len(self.levels) % 2 == 1
        return answer


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _level(keys: DataFrame, n_keys: int, level: int, error: float) -> Level:
    """A filter of the keys' hashes, its bits put together in the cluster: a 64-bit word of it is one summed row."""
    size = max(64, -(-int(1.45 * n_keys * -np.log2(error)) // 64) * 64)
    probes = max(1, round(-np.log2(error)))

    def words(batch: pa.RecordBatch) -> dict:
        key, other = (c.to_numpy().view(np.uint64) for c in batch.columns)
        at = np.concatenate([*places(key, other, level, size, probes)])
        return {"word": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))}

    found = map_rows(keys.select("h1", "h2"), words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(size // 64, np.uint64)
    for row in found.collect():  # at most size / 64 rows, and size is bounded by MAX_LISTED
        bits[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return Level(bits.view(np.uint8), size, probes)


def build(listed: DataFrame, universe: DataFrame, scratch: Scratch) -> Cascade:
    """The cascade of ``listed`` over the distinct keys ``universe`` (both with ``key``)."""
    marked = universe.join(listed.select("key").distinct().withColumn("in", F.lit(True)), "key", "left")
    marked = scratch.write(marked.select(*hashes(F.col("key")), F.coalesce("in", F.lit(False)).alias("in")), "universe")
    number = dict(marked.groupBy("in").count().collect())
    ours, theirs = number.get(True, 0), number.get(False, 0)
    if ours > MAX_LISTED:
        raise ValueError(f"a cascade has at most {MAX_LISTED} listed keys, not {ours}: split the list by host")
    levels: list[Level] = []
    inside, outside = marked.where("in"), marked.where("not in")
    while ours:
        n = len(levels)
        if n == MAX_LEVELS:
            raise ValueError("a listed and another key have the same hashes")
        error = 0.5 if n else min(0.5, ours * 0.5**0.5 / max(theirs, 1))
        level = _level(inside, ours, n, error)
        levels.append(level)

        def passing(batch: pa.RecordBatch, level=level, n=n) -> dict | None:
            key, other = (c.to_numpy() for c in batch.columns)
            stay = level.has(key.view(np.uint64), other.view(np.uint64), n)
            return {"h1": pa.array(key[stay]), "h2": pa.array(other[stay])}

        left = scratch.write(map_rows(outside.select("h1", "h2"), passing, "h1 long, h2 long"), "passing")
        inside, outside, ours, theirs = left, inside, left.count(), ours
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    take = lambda n: F.coalesce(F.regexp_extract(url, parts, n), F.lit(""))
    return ascii_lower(take(1)), take(2)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``).

    ``rules`` are (verdict, host, path), and a longer host goes before a longer path of the same total length. A URL
    gives one key for each number of host labels and path length that the rules have, so a key is looked up
    and never searched. Keys are probed in two cascades, of what allows and of what blocks, built over the keys of
    all pages. Where no rule fits, a blocked host decides, else the page is allowed. A null URL, one without ``://``
    and an empty host fit nothing and are allowed; repeated rows are judged one by one.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    entries = [(host, path, verdict) for verdict, host, path in rules] + [(host, "", "block") for host in blocked]
    shapes = sorted({(host.count(".") + 1, len(path)) for host, path, _ in entries}, reverse=True)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")

    def key(n: int, length: int) -> Column:
        whole = F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, length))
        return F.when((F.col("host") != "") & (F.size(labels) >= n) & (F.char_length("path") >= length), whole)

    keyed = rows.withColumn("keys", F.array(*[key(*s) for s in shapes]))
    universe = scratch.write(keyed.select(F.explode("keys").alias("key")).where("key is not null").distinct(), "keys")
    # the lists are arguments: as long as what the caller holds
    listed = spark.createDataFrame([(h + p, v) for h, p, v in entries], "key string, verdict string")
    cascades = spark.sparkContext.broadcast([build(listed.where(F.col("verdict") == v), universe, scratch) for v in ("allow", "block")])
    hashed = keyed.withColumn("h1", F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64(k))))
    hashed = hashed.withColumn("h2", F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64(F.lit("second"), k))))
    width = len(shapes)

    def make(batch: pa.RecordBatch) -> dict:
        flat = [batch.column(i).flatten() for i in (4, 5)]
        missing = np.asarray(flat[0].is_null())
        key, other = (f.fill_null(0).to_numpy().view(np.uint64) for f in flat)
        allow, block = (c.listed(key, other) & ~missing for c in cascades.value)
        said = np.where(allow, 1, np.where(block, -1, 0)).reshape(-1, width)
        lengths = np.array([[-1 if k is None else len(k) for k in keys] for keys in batch.column(3).to_pylist()]).reshape(-1, width)
        is_rule = np.array([length > 0 for _, length in shapes])
        # shapes are in falling order of labels and path length: the first of the longest wins
        best = np.argmax(np.where((said != 0) & is_rule, lengths, -1), axis=1)
        at = np.arange(len(best))
        fits = (said[at, best] != 0) & is_rule[best]
        keys = batch.column(3).to_pylist()
        rule = [keys[i][b] if f else None for i, b, f in zip(at.tolist(), best.tolist(), fits.tolist())]
        allowed = np.where(fits, said[at, best] == 1, ~((said == -1) & ~is_rule).any(axis=1))
        return dict(zip(("page_id", "host", "path"), batch.columns[:3])) | {"rule": rule, "verdict": np.where(allowed, "allow", "block").tolist()}

    return map_rows(hashed.select("page_id", "host", "path", "keys", "h1", "h2"), make, "page_id long, host string, path string, rule string, verdict string")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    hosts = ", ".join(f"('{h}')" for h in blocked)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {listed}), hosts(h) AS (VALUES {hosts}), found AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), best AS (
  SELECT n, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM found JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM hosts WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM found LEFT JOIN best USING (n)
"""
