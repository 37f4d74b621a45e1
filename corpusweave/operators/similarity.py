"""Exact vector search: blocked matrix products inside Arrow batches, top-k merged by Spark.

Pairs are never rows. A task multiplies one block of stored vectors with one block of queries and
ships only the best ``k`` per query, so the shuffle carries ``queries x blocks x k`` short rows.
The product is made in tiles of a few queries, so a task's memory does not grow with either side.

Two layouts share that kernel. A query side whose measured size is below ``BROADCAST_BYTES`` is
broadcast as one matrix and the stored vectors are read once without a shuffle. A larger query side
is cut into blocks, and every (query block, vector block) pair becomes one cell of a grid; a hot
partition key spreads over as many cells as it has blocks.

The best of *every* group are ``queries x groups x k`` rows, so there a row must not leave a task for
each block of vectors. The vectors pass by in the order of their groups while the queries stay, and a
task ships what is best in a whole group: of all vectors where these are broadcast, else of a chunk of
them, and only groups that lie in two chunks are shipped twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from corpusweave.operators.ordering import top_k
from corpusweave.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 2048
CHUNK_BYTES = 32 * 1024 * 1024  # vectors that a task holds beside the blocks it multiplies, where they are not broadcast
TILE_CELLS = 1 << 20  # scores that exist at a time in a task: 8 MB, and a few temporaries of that size
DECIMALS = 6

HITS = StructType(
    [
        StructField("query_id", LongType()), StructField("group_id", LongType()),
        StructField("vec_id", LongType()), StructField("score", DoubleType()),
    ]
)
RANKED = StructType([*HITS.fields, StructField("rank", IntegerType())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an ``array<float>`` column as a float64 matrix (no per-row Python objects)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    return m / lengths


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        queries, vectors = _unit(queries), _unit(vectors)
    return np.round(_values(queries, vectors, metric), DECIMALS)


def _values(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Scores before rounding, for the cosine of unit vectors. Larger is nearer; squared distances are negated."""
    if metric in ("cosine", "dot"):
        return queries @ vectors.T
    return -((queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1)[None, :] - 2.0 * (queries @ vectors.T))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the ``k`` best per row; ties go to the lower id."""
    n = scores.shape[1]
    if n > k:
        # Everything not below the k-th value stays, so ties at the edge are decided by id.
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
        keep = scores >= edge[:, None]
    else:
        keep = np.ones_like(scores, dtype=bool)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(first)
    position = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    chosen = position < k
    return rows[chosen], cols[chosen]


class _Leaders:
    """The best ``k`` vectors of one group for each of some queries, while blocks of the group pass by."""

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.qids, self.qmat, self.k, self.metric, self.exclude_self = qids, qmat, k, metric, exclude_self
        self.scores, self.ids = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64)

    def see(self, vids: np.ndarray, vmat: np.ndarray) -> None:
        step = max(1, TILE_CELLS // max(1, len(vids)))
        for start in range(0, len(self.qids), step):
            tile = slice(start, start + step)
            values = _values(self.qmat[tile], vmat, self.metric)
            if self.exclude_self:
                values[self.qids[tile, None] == vids[None, :]] = -np.inf
            edge = self.scores[tile, -1]
            if len(vids) > self.k and np.isneginf(edge).any():
                edge = np.fmax(edge, np.partition(values, -self.k, axis=1)[:, -self.k])
            # Only what can reach the k-th place after rounding is rounded and ordered.
            edge = edge - 10.0**-DECIMALS - 1e-12 * np.abs(edge, where=np.isfinite(edge), out=np.zeros(len(edge)))
            rows, cols = np.nonzero((values >= edge[:, None]) & (values > -np.inf))
            if len(rows):
                self._merge(tile, rows, np.round(values[rows, cols], DECIMALS), vids[cols])

    def _merge(self, tile: slice, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        held = np.nonzero(self.scores[tile] > -np.inf)
        rows, scores, ids = (np.concatenate(x) for x in ((held[0], rows), (self.scores[tile][held], scores), (self.ids[tile][held], ids)))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        at = (rows[best] + tile.start, place[best])
        self.scores[at], self.ids[at] = scores[best], ids[best]

    def rows(self, group: int) -> pa.RecordBatch:
        """Query by query in the order of ranks."""
        at = np.nonzero(self.scores > -np.inf)
        columns = self.qids[at[0]], np.full(len(at[0]), group, np.int64), self.ids[at], self.scores[at], (at[1] + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=RANKED.names)


def _group_leaders(qids, qmat, blocks, k, metric, exclude_self) -> Iterator[pa.RecordBatch]:
    """Best rows of each group, shipped when the next group begins. ``blocks``: ids, groups and matrices of vectors."""
    qmat = _unit(qmat) if metric == "cosine" else qmat
    group = leaders = None
    for vids, vgroups, vmat in blocks:
        order = np.lexsort((vids, vgroups))
        for own in np.split(order, np.flatnonzero(np.diff(vgroups[order])) + 1):
            if not len(own):
                continue
            if leaders is None or vgroups[own[0]] != group:
                if leaders is not None:
                    yield leaders.rows(group)
                group, leaders = vgroups[own[0]], _Leaders(qids, qmat, k, metric, exclude_self)
            for start in range(0, len(own), BLOCK_ROWS):
                part = own[start : start + BLOCK_ROWS]
                leaders.see(vids[part], _unit(vmat[part]) if metric == "cosine" else vmat[part])
    if leaders is not None:
        yield leaders.rows(group)


def _hits(qids, qgroups, vids, vgroups, scores, k, mode) -> pa.RecordBatch:
    """Best rows of one block product: overall, within the query's own group, or one per group."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    if mode == "all":
        parts.append(_best(scores, vids, k))
    else:
        for group in np.unique(vgroups):
            cols = np.flatnonzero(vgroups == group)
            rows = np.flatnonzero(qgroups == group) if mode == "own" else np.arange(len(qids))
            if len(rows):
                r, c = _best(scores[np.ix_(rows, cols)], vids[cols], k)
                parts.append((rows[r], cols[c]))
    rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=int)
    cols = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=int)
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[rows]), pa.array(vgroups[cols]), pa.array(vids[cols]), pa.array(scores[rows, cols])],
        names=HITS.names,
    )


def _products(qids, qgroups, qmat, vids, vgroups, vmat, k, metric, mode, exclude_self) -> Iterator[pa.RecordBatch]:
    """Hits of one block of queries in one block of vectors, a tile of queries at a time."""
    step = max(1, TILE_CELLS // max(1, len(vids)))
    for start in range(0, len(qids), step):
        own = slice(start, start + step)
        scores = _scores(qmat[own], vmat, metric)
        if exclude_self:
            scores[qids[own, None] == vids[None, :]] = -np.inf
        batch = _hits(qids[own], qgroups[own], vids, vgroups, scores, k, mode)
        yield batch.filter(pa.compute.is_finite(batch.column("score"))) if exclude_self else batch


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "cosine",
    mode: str = "all",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact nearest neighbours of every query.

    ``queries`` has ``query_id, group_id, embedding``; ``vectors`` has ``vec_id, group_id, embedding``.
    ``mode``: ``all`` (k overall), ``own`` (k within the query's group, filtered before ranking) or
    ``each`` (k within every group). Returns ``query_id, group_id, vec_id, score, rank``.
    """
    queries = queries.select(F.col("query_id").cast("long"), F.col("group_id").cast("long"), "embedding")
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("group_id").cast("long"), "embedding")
    if mode == "each":
        return _each(queries, vectors, k, metric, exclude_self, broadcast_bytes, block_rows)
    bytes_needed = math.prod(_extent(queries))

    def product(*blocks):
        return _products(*blocks, k, metric, mode, exclude_self)

    if bytes_needed <= broadcast_bytes:
        rows = queries.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(
            (
                rows["query_id"].to_numpy(), rows["group_id"].to_numpy(),
                _matrix(rows["embedding"].combine_chunks()) if rows.num_rows else np.zeros((0, 1)),
            )
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, qgroups, qmat = shared.value
            for batch in batches:
                if batch.num_rows and len(qids):
                    yield from product(
                        qids, qgroups, qmat, batch.column("vec_id").to_numpy(), batch.column("group_id").to_numpy(),
                        _matrix(batch.column("embedding")),
                    )

        found = vectors.mapInArrow(scan, HITS)
    else:
        found = _grid(queries, vectors, product, block_rows, own=mode == "own")
    by = ["query_id"] if mode == "all" else ["query_id", "group_id"]
    return top_k(found, by, [F.desc("score"), F.col("vec_id")], k)


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of a row as numbers of a matrix."""
    rows, components = df.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return rows, components * 8 + 16


def _arrays(batch: pa.RecordBatch, id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(id_col).to_numpy(), batch.column("group_id").to_numpy(), _matrix(batch.column("embedding"))


def _each(queries, vectors, k, metric, exclude_self, broadcast_bytes, block_rows) -> DataFrame:
    """The best ``k`` of every group. Vectors that can be broadcast are seen whole by each query, so their ranks are final
    unless a query comes twice; larger ones pass by in chunks of a few groups, and tasks are pairs of chunks."""
    rows, row_bytes = _extent(vectors)
    if rows * row_bytes <= broadcast_bytes:
        found = vectors.toArrow()
        stored = (
            found["vec_id"].combine_chunks().to_numpy(), found["group_id"].combine_chunks().to_numpy(),
            _matrix(found["embedding"].combine_chunks()) if found.num_rows else np.zeros((0, 1)),
        )
        shared = queries.sparkSession.sparkContext.broadcast(stored)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    qids, _, qmat = _arrays(batch, "query_id")
                    yield from _group_leaders(qids, qmat, [shared.value], k, metric, exclude_self)

        ranked = queries.mapInArrow(scan, RANKED)
        asked, different = queries.agg(F.count("*"), F.count_distinct("query_id")).first()
        if asked == different:
            return ranked
        found = ranked.drop("rank")
    else:
        chunks = math.ceil(rows * row_bytes / max(min(broadcast_bytes, CHUNK_BYTES), block_rows * row_bytes))
        dealt = vectors.repartitionByRange(chunks, "group_id", "vec_id").sortWithinPartitions("group_id", "vec_id")
        passing = materialise(_packed(dealt)).select(F.col("block").alias("v"))
        pairs = _packed(queries).crossJoin(passing.hint("shuffle_replicate_nl"))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Spark pairs a block of queries with all blocks of the chunk before it goes on to the next.
            both = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
            for _, own in groupby(both, key=lambda pair: pair.column("number")[0].as_py()):
                first = next(own)
                qids, _, qmat = _arrays(_unpacked(first, "block"), "query_id")
                passing = (_arrays(_unpacked(pair, "v"), "vec_id") for pair in chain([first], own))
                for hits in _group_leaders(qids, qmat, passing, k, metric, exclude_self):
                    yield hits.select(HITS.names)

        found = pairs.mapInArrow(multiply, HITS)
    return top_k(found, ["query_id", "group_id"], [F.desc("score"), F.col("vec_id")], k)


def _packed(df: DataFrame) -> DataFrame:
    """A row for each batch of rows, with its number in the partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["number", "block"])

    return df.mapInArrow(pack, "number long, block binary")


def _unpacked(row: pa.RecordBatch, column: str) -> pa.RecordBatch:
    return pa.ipc.open_stream(row.column(column)[0].as_buffer()).read_next_batch()


def _blocks(df: DataFrame, id_col: str, count: int, block_rows: int, own: bool) -> DataFrame:
    """Pack rows into blocks of about ``block_rows``: ids are spread by hash, so a block stays small
    even when one group holds most rows."""
    keys = ["_cell_group", "_block"] if own else ["_block"]
    n = max(1, math.ceil(count / block_rows))
    tagged = df.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))
    if own:
        tagged = tagged.withColumn("_cell_group", F.col("group_id"))
    return tagged.groupBy(*keys).agg(F.collect_list(F.struct(id_col, "group_id", "embedding")).alias("_rows"))


def _grid(queries, vectors, product, block_rows, own) -> DataFrame:
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks = _blocks(queries, "query_id", n_queries, block_rows, own)
    v_blocks = _blocks(vectors, "vec_id", n_vectors, block_rows, own)
    v_count = max(1, math.ceil(n_vectors / block_rows))
    # Each query block visits every vector block (of its own group): an equi join on block numbers.
    visits = q_blocks.select(
        *(["_cell_group"] if own else []), F.col("_rows").alias("_q"),
        F.explode(F.sequence(F.lit(0), F.lit(v_count - 1))).alias("_block"),
    )
    cells = visits.join(v_blocks, ["_cell_group", "_block"] if own else ["_block"]).select("_q", "_rows")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column("_q")[i].values, batch.column("_rows")[i].values
                yield from product(
                    q.field("query_id").to_numpy(), q.field("group_id").to_numpy(), _matrix(q.field("embedding")),
                    v.field("vec_id").to_numpy(), v.field("group_id").to_numpy(), _matrix(v.field("embedding")),
                )

    return cells.mapInArrow(multiply, HITS)


def centroids(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per key, rounded to six places so that summation order cannot show."""
    mean = vectors.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(embedding))).alias("_m"))
    return mean.select(key, F.transform(vector_to_array("_m"), lambda x: F.round(x, 6)).alias("centroid"))


def card_ranking(vectors: DataFrame, cards: DataFrame) -> DataFrame:
    """Every vector as a query against all cards: one row per (query, card) with its rank.

    The card side is one row per topic; it is the broadcast side when its measured size allows and
    the grid takes over when it does not.
    """
    stored = cards.select(F.col("label").alias("vec_id"), F.lit(0).alias("group_id"), F.col("centroid").alias("embedding"))
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("group_id"), "embedding")
    n_cards = cards.count()
    # The roles are swapped: the few cards are the broadcast "queries", every scanned vector keeps
    # its score against each of them.
    size = n_cards * 8 * 4096
    if size <= BROADCAST_BYTES:
        rows = cards.toArrow()
        shared = cards.sparkSession.sparkContext.broadcast(
            (rows["label"].to_numpy(), _matrix(rows["centroid"].combine_chunks()))
        )

        def scan(batches):
            labels, mat = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = _scores(_matrix(batch.column("embedding")), mat, "cosine")
                ids = batch.column("query_id").to_numpy()
                # Cards are ranked inside the row: no shuffle is needed to order them.
                order = np.lexsort((np.broadcast_to(labels, scores.shape), -scores), axis=1)
                ranks = np.empty_like(order)
                np.put_along_axis(ranks, order, np.arange(scores.shape[1])[None, :] + 1, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, len(labels))), pa.array(np.tile(labels.astype(np.int64), len(ids))),
                        pa.array(scores.ravel()), pa.array(ranks.ravel().astype(np.int32)),
                    ],
                    names=["query_id", "card", "score", "rank"],
                )

        return asked.mapInArrow(scan, "query_id long, card long, score double, rank int")
    return nearest(asked, stored, n_cards).select("query_id", F.col("vec_id").alias("card"), "score", "rank")


def fuse(card_hits: DataFrame, page_best: DataFrame, weight: float) -> DataFrame:
    """Card score plus ``weight`` times the best page score; a card without pages counts itself twice.

    ``card_hits``: query_id, card, score, rank. ``page_best``: query_id, card, page_score, one row for a query and card.
    Page scores are gathered inside the tasks that found them and travel as one row a query, so card hits are dealt out by
    query only, and whatever ranks them next finds them so.
    """
    pages = page_best.where("card is not null").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("card", "page_score"))).alias("_pages"))
    joined = card_hits.join(pages, "query_id", "left").withColumn("page_score", F.try_element_at("_pages", F.col("card"))).drop("_pages")
    evidence = F.coalesce("page_score", "score")
    return joined.withColumn("page_evidence", evidence).withColumn(
        "fused", F.round(F.col("score") + F.lit(weight) * evidence, DECIMALS + 1)
    )
