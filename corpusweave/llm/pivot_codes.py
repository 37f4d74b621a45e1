"""Product codes of vectors, assigned with distances to fixed pivots (query ``op12_vector_codes``)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, table

#: Parts of a vector, entries of a codebook, rounds that move entries, pivots of a part, components of 1 are this many steps.
PARTS, ENTRIES, ROUNDS, PIVOTS, STEPS = 16, 64, 2, 4, 256
ROWS = 4096
#: Sums travel in limbs of this many bits, so that they stay exact at every number and size of components.
LIMB = 30
MOST = (1 << 63) - 1


def steps(x: float) -> int:
    return math.floor(x * STEPS) if abs(x) < 1e100 else int(x) * STEPS


def safe_limit(width: int) -> int:
    """Components below this (in amount) have squared distances of a part that fit 64 bits."""
    return min(math.isqrt((1 << 62) // width) // 2, (1 << 31) - 1)


def integers(flat: np.ndarray, width: int) -> np.ndarray:
    """Components as integers: 64-bit ones where distances stay exact in these, else Python's."""
    values = np.floor(flat.astype(np.float64) * STEPS) if np.abs(flat).max(initial=0) < 1e100 else None
    if values is not None and np.abs(values).max(initial=0) < safe_limit(width):
        return values.astype(np.int64)
    return np.array([steps(float(x)) for x in flat], object)


class Codebooks:
    """Entries by part, their distances to the fixed pivots of each part, and the exact nearest entry of vectors."""

    def __init__(self, entries: list, pivots: list):
        self.entries, self.pivots = entries, pivots
        width = len(entries[0][0])
        self.wide = max(abs(v) for part in entries for e in part for v in e) >= safe_limit(width)
        if not self.wide:
            self.own = np.array(entries, np.int64)
            self.far = distances(self.own, np.array(pivots, np.int64))

    def assign(self, vectors: np.ndarray, far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part; ``vectors`` (rows, parts, width), ``far`` its distances to the pivots.

        A distance to a pivot cannot differ more between a part and an entry than the two are apart. Entries are met in the order
        of that lower bound and evaluated exactly, until the bound of the next one is above the best distance.
        """
        if self.wide or far is None or vectors.dtype == object:
            return self.assign_wide(vectors)
        codes, best = (np.empty(vectors.shape[:2], np.int64) for _ in range(2))
        for p in range(vectors.shape[1]):
            low = np.zeros((len(vectors), len(self.own[p])))
            for pivot in range(far.shape[2]):
                a, b = far[:, p, pivot, None].astype(np.float64), self.far[p, None, :, pivot]
                np.maximum(low, np.abs(a - b) - 1e-6 * (a + b), out=low)  # stored distances are rounded
            order = np.argsort(low, axis=1)
            low = np.take_along_axis(low, order, 1) ** 2
            code = order[:, 0].copy()
            nearest = ((vectors[:, p] - self.own[p, code]) ** 2).sum(axis=1)
            for turn in range(1, order.shape[1]):
                rows = np.flatnonzero(low[:, turn] <= nearest)
                if not len(rows):
                    break
                entry = order[rows, turn]
                d = ((vectors[rows, p] - self.own[p, entry]) ** 2).sum(axis=1)
                better = (d < nearest[rows]) | ((d == nearest[rows]) & (entry < code[rows]))
                nearest[rows[better]], code[rows[better]] = d[better], entry[better]
            codes[:, p], best[:, p] = code, nearest
        return codes, best

    def assign_wide(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with Python's integers, for components of any size; every entry is evaluated."""
        codes, best = np.empty(vectors.shape[:2], np.int64), np.empty(vectors.shape[:2], object)
        for n, vector in enumerate(vectors.tolist()):
            for p, part in enumerate(vector):
                best[n, p], codes[n, p] = min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(self.entries[p]))
        return codes, best


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows or entries by part and pivot) of ``vectors`` (parts, n, width) to ``pivots`` (parts, pivots, width)."""
    return np.sqrt(((vectors[:, :, None, :] - pivots[:, None, :, :]) ** 2).sum(axis=3).astype(np.float64))


def choose_pivots(part: list) -> list:
    """Entries far from each other: the first, then always the one farthest from those chosen (ties to lower index)."""
    chosen = [part[0]]
    while len(chosen) < min(PIVOTS, len(part)):
        apart = [min(sum((a - b) ** 2 for a, b in zip(e, c)) for c in chosen) for e in part]
        chosen.append(part[apart.index(max(apart))])
    return chosen


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding``: rows whose vector is finite throughout and can be cut into equal parts."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("embedding"))
    return kept.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).where(finite)


def with_pivots(kept: DataFrame, dims: int, pivots: list) -> DataFrame:
    """``vec_id, label, steps, far, wide``: components as integers and their distances to the pivots, computed once."""
    width = dims // PARTS
    narrow = max(abs(v) for part in pivots for e in part for v in e) < safe_limit(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                whole = integers(flat, width).reshape(len(part), PARTS, width)
                if whole.dtype == object:  # one by one: only rows of large components leave 64 bits
                    rows = [integers(flat[k * dims : (k + 1) * dims], width) for k in range(len(part))]
                else:
                    rows = list(whole.reshape(len(part), dims))
                own = [r.astype("<i4").tobytes() if r.dtype != object else None for r in rows]
                wide = [None if r.dtype != object else [str(v) for v in r] for r in rows]
                if narrow and whole.dtype != object:
                    far = distances(whole.transpose(1, 0, 2), np.array(pivots, np.int64)).transpose(1, 0, 2)
                    far = [f.tobytes() for f in far.astype("<f4")]
                else:
                    far = [distances(r.reshape(PARTS, 1, width), np.array(pivots, np.int64)).astype("<f4").tobytes() if narrow and r.dtype != object else None for r in rows]
                columns = [*part.columns[:2], pa.array(own, pa.binary()), pa.array(far, pa.binary()), pa.array(wide, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "steps", "far", "wide"])

    kind = dict(kept.dtypes)["label"]
    return kept.where(F.size("embedding") == dims).mapInArrow(run, f"vec_id long, label {kind}, steps binary, far binary, wide array<string>")


def assigned(batch: pa.RecordBatch, books: Codebooks, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the batch, vectors, codes and squared distances, in groups of rows that are computed alike."""
    steps, far, wide = (batch.column(n) for n in ("steps", "far", "wide"))
    plain = np.flatnonzero(far.is_valid().to_numpy(zero_copy_only=False))
    for a in range(0, len(plain), ROWS):
        rows = plain[a : a + ROWS]
        vectors = np.frombuffer(b"".join(steps.take(pa.array(rows)).to_pylist()), "<i4").astype(np.int64).reshape(len(rows), PARTS, width)
        near = np.frombuffer(b"".join(far.take(pa.array(rows)).to_pylist()), "<f4").reshape(len(rows), PARTS, -1)
        yield rows, vectors, *books.assign(vectors, near)
    for row in np.flatnonzero(~far.is_valid().to_numpy(zero_copy_only=False)).tolist():
        own = steps[row].as_py()
        values = np.frombuffer(own, "<i4").astype(object) if own is not None else np.array([int(v) for v in wide[row].as_py()], object)
        vectors = np.array([int(v) for v in values], object).reshape(1, PARTS, width)
        yield np.array([row]), vectors, *books.assign(vectors, None)


def moved(rows: DataFrame, books: list, pivots: list, width: int) -> list:
    """Codebooks after a round: sums and counts per task, added up in the cluster; only totals of entries reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(books, pivots)
        total = np.zeros((PARTS, len(books[0]), width + 1), object)
        for batch in batches:
            for _, vectors, codes, _ in assigned(batch, own, width):
                for p in range(PARTS):
                    if vectors.dtype == object:
                        total[p, codes[0, p]] += np.array([*vectors[0, p], 1], object)
                        continue
                    # halves of 32 bits: their sums over a batch fit 64 bits
                    part = np.zeros((2, len(books[0]), width + 1), np.int64)
                    np.add.at(part[0], codes[:, p], np.column_stack([vectors[:, p] >> 16, np.zeros(len(codes), np.int64)]))
                    np.add.at(part[1], codes[:, p], np.column_stack([vectors[:, p] & 0xFFFF, np.ones(len(codes), np.int64)]))
                    total[p] += part[0].astype(object) * (1 << 16) + part[1].astype(object)
        out = []
        for (p, e, k), value in np.ndenumerate(total):
            sign, value, limb = (-1, -value, 0) if value < 0 else (1, value, 0)
            while value:
                out.append((p, e, k, limb, sign * (value & ((1 << LIMB) - 1))))
                value, limb = value >> LIMB, limb + 1
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], ["part", "entry", "k", "limb", "total"])

    sums = rows.mapInArrow(run, "part int, entry int, k int, limb int, total long").groupBy("part", "entry", "k", "limb").agg(F.sum("total").alias("total"))
    total = np.zeros((PARTS, len(books[0]), width + 1), object)
    for part, entry, k, limb, value in sums.collect():
        total[part, entry, k] += value << (LIMB * limb)
    return [[[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old for row, old in zip(sums_of, book)] for sums_of, book in zip(total, books)]


def encode(vectors: DataFrame) -> tuple[DataFrame, str]:
    """``vec_id, label, code, error`` of every usable row of ``vectors`` (``vec_id``, ``embedding``, ``label``), and the codebooks' digest.

    Rows without a vector, or with a null or non-finite component, are dropped. The length of the vector with the smallest vec_id
    counts: vectors of other lengths, or of one that is no multiple of the number of parts, have no codes and are dropped too. A
    null vec_id stands last, equal vec_ids stand in the order of their vectors; repeated rows each count. Fewer than 64 vectors
    give smaller codebooks, none an empty result. Components of any finite size are exact; an error above 2^63 - 1 is shown as that.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    kept = usable(vectors)
    kind = dict(kept.dtypes)["label"]
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), hashlib.sha256(b"").hexdigest()
    dims = len(first[0].embedding)
    width = dims // PARTS
    first = kept.where(F.size("embedding") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    start = [[steps(x) for x in r.embedding] for r in first]
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(PARTS)]
    pivots = [choose_pivots(part) for part in books]
    rows = scratch.write(with_pivots(kept, dims, pivots), "pivots")
    for _ in range(ROUNDS):
        books = moved(rows, books, pivots, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(books, pivots)
        for batch in batches:
            code, error = np.empty(len(batch), object), np.zeros(len(batch), np.int64)
            for places, _, codes, best in assigned(batch, own, width):
                text = codes.astype(np.uint8).tobytes().hex()
                code[places] = [text[2 * PARTS * n : 2 * PARTS * (n + 1)] for n in range(len(places))]
                error[places] = [min(int(sum(b)), MOST) for b in best.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    flat = ",".join(str(v) for part in books for entry in part for v in entry)
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), hashlib.sha256(flat.encode()).hexdigest()


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, digest = encode(table(spark, folder, "embeddings"))
    coded = Scratch(spark, "codes").write(coded, "coded")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "of")
    both = coded.join(sums, coded.label.eqNullSafe(sums.of))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    parts = [
        """kept AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """cells AS (SELECT row, part, pos, v[part * (len(v) // 16) + pos + 1] AS x FROM kept, range(16) AS a(part), range((SELECT max(len(v)) // 16 FROM kept)) AS b(pos))""",
        """book0 AS (SELECT part, entry, pos, x FROM cells JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (row) WHERE entry < 64)""",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""near{n} AS (SELECT row, part, entry, d FROM (SELECT row, c.part, entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
  FROM cells c JOIN book{n} b ON c.part = b.part AND c.pos = b.pos GROUP BY row, c.part, entry) QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, entry) = 1)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""book{n + 1} AS (SELECT part, entry, pos, coalesce(mean, x) AS x FROM book{n} LEFT JOIN (SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM
  (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM near{n} JOIN cells USING (row, part) GROUP BY part, entry, pos)) USING (part, entry, pos))"""
            )
    parts.append(f"coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (row)"""


ORACLE = _oracle()
