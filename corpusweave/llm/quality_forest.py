"""Quality rules: statistics of each text, hard limits, and an isolation forest on the statistics (query ``op7_quality_rules``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave.llm.common import map_rows, table
from corpusweave.operators.ordering import top_k
from corpusweave.session import materialise

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: Trees, rows and depth of a tree, and good rows the limit may cost.
TREES, TREE_ROWS, DEPTH, GOOD_LOST = 128, 256, 12, 0.001
#: Scores are multiples of this, so that those of any number of rows are counted exactly in bounded room.
SCORE_STEP = 2.0**-20
SYMBOLS, CAPITALS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of letters: A-Z, a-z and all of characters beyond ASCII.
LETTERS = bytes([*CAPITALS, *CAPITALS.lower(), *range(128, 256)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Square roots of shares (but the repeated one, which the hard limits judge already): small shares, where good and bad
#: texts part, take more room.
FEATURES = ("chars_per_word", "symbols_per_word", "repeat_share", "capital_share", "other_share", "kinds_share")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has twice or more, the first one included.

    Windows of 1, 2, 4, ... words get a number each, the longer ones from the numbers of two shorter, so equal
    numbers mean equal windows and memory is a few numbers a word.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        step = min(size, window - size)
        found, ids = np.unique(ids[:-step] * (len(words) + 1) + ids[step:], return_inverse=True)
        if len(found) == len(ids):  # all windows differ already
            return 0
        size += step
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES``; none of the latter grows with the text."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    joined = b"".join(words)
    n_chars = len(joined.decode("utf-8", "surrogatepass"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    symbols, repeat = len(joined) - len(joined.translate(None, SYMBOLS)), repeated_words(words)
    chars, per_word = max(n_chars, 1), max(n, 1)
    capitals, other = len(joined) - len(joined.translate(None, CAPITALS)), len(joined.translate(None, LETTERS))
    shares = [
        n_chars / per_word / 20, symbols / per_word, (repeat / per_word) ** 2, capitals / chars, other / chars,
        len(set(words)) / per_word**0.8 / 5,
    ]
    return [n, n_chars, symbols, dup, repeat], [float(x) ** 0.5 for x in shares]


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_SHARE * n_words)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and ``features`` of every row."""

    def make(batch: pa.RecordBatch) -> dict:
        found = [statistics(t.as_py()) for t in batch.column(1)]
        counts = zip(*(c for c, _ in found)) if found else [()] * len(COUNTS)
        return {"doc_id": batch.column(0)} | dict(zip(COUNTS, map(list, counts))) | {"features": [f for _, f in found]}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


class IsolationForest:
    """Random splits of small samples; what is isolated after few splits is unusual.

    A tree picks a feature and a place within the box it stands for, again and again, until a row is alone or the
    depth is reached; the first box spans all rows of ``span``, so a value that no row of the sample has can be cut off too.
    ``score`` is 2 to the minus (mean path length over that of a random search tree), near 1 for anomalies.
    """

    def __init__(self, rows: np.ndarray, span: np.ndarray, seed: int = 5, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH):
        rng = np.random.default_rng(seed)
        self.size, self.depth = min(tree_rows, len(rows)), depth
        nodes = 2 ** (depth + 1)
        self.feature, self.cut, self.path = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.float32)
        for tree in range(trees):
            sample = rows[rng.choice(len(rows), self.size, replace=False)]
            stack = [(1, 0, sample, span.min(axis=0), span.max(axis=0))]
            while stack:
                node, depth, own, low, high = stack.pop()
                self.path[tree, node] = depth + usual_path(len(own))
                open_ = np.flatnonzero(high > low)
                if depth == self.depth or len(own) <= 1 or not len(open_):
                    continue
                f = rng.choice(open_)
                cut = rng.uniform(low[f], high[f])
                self.feature[tree, node], self.cut[tree, node] = f, cut
                left, middle = own[:, f] < cut, np.where(np.arange(len(low)) == f, cut, np.nan)
                stack.append((2 * node, depth + 1, own[left], low, np.fmin(high, middle)))
                stack.append((2 * node + 1, depth + 1, own[~left], np.fmax(low, middle), high))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                down = 2 * node + (rows[np.arange(len(rows)), np.maximum(f, 0)] >= cut[node])
                node = np.where(inner, down, node)
            total += path[node]
        return np.round(np.exp2(-total / len(self.feature) / max(usual_path(self.size), 1e-9)) / SCORE_STEP) * SCORE_STEP


def usual_path(n: int) -> float:
    """Mean path length of a failed search in a binary search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """``fit_statistics`` of the texts: the labels meet their few numbers, so no text is shuffled."""
    return fit_statistics(text_statistics(docs), labels)


def fit_statistics(stats: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """(forest, score limit) from every labelled row of ``text_statistics``; None without a good row.

    Trees see good rows only, so a text is unusual if it is unlike good ones. The limit is the one that tells
    the labelled bad rows best from the good, among those that lose at most ``GOOD_LOST`` of the good. Rows the hard
    limits reject are left out. The span, the scores and the limit are those of all labelled rows. A tree's rows are, as the
    method has it, a small draw: from all good rows, or, if trees do not need them all, from a share that their hashes deal it.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    stats = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "n_words", "features")
    found = materialise(stats.join(own.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "n_words", "quality", "features"))
    ends = [f(F.get("features", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(len(FEATURES))]
    edges = found.agg(*ends, F.count_if(F.col("quality") > 0).alias("good")).first()
    if not edges.good:
        return None
    good = found.where("quality > 0")
    if edges.good > TREES * TREE_ROWS:
        deal = F.xxhash64("doc_id", "n_words", "features")
        good = top_k(good.withColumn("tree", F.pmod(deal, F.lit(TREES))), ["tree"], [F.xxhash64(deal), F.col("doc_id")], TREE_ROWS)
    features = np.array([r.features for r in good.orderBy("doc_id", "n_words", "features").select("features").collect()])
    forest = IsolationForest(features, np.array(edges[: 2 * len(FEATURES)]).reshape(2, -1))
    return forest, _limit(*_score_counts(found, forest))


def _score_counts(found: DataFrame, forest: IsolationForest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different scores of all rows in ascending order (at most 1 / ``SCORE_STEP``), good and bad rows of each."""
    model = found.sparkSession.sparkContext.broadcast(forest)

    def make(batch: pa.RecordBatch) -> dict:
        rows = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
        return {"quality": batch.column(0), "score": model.value.score(rows)}

    scored = map_rows(found.select(F.col("quality").cast("long").alias("quality"), "features"), make, "quality long, score double")
    good = F.col("quality") > 0
    counts = scored.groupBy("score").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).orderBy("score").toArrow()
    return tuple(counts[c].to_numpy() for c in ("score", "good", "bad"))


def _limit(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The limit from the different scores, ascending, with their numbers of good and bad rows."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    above = np.cumsum(good[::-1])[::-1]  # good rows of this score or higher
    floor = scores[np.flatnonzero(above > min(int(GOOD_LOST * n_good), n_good - 1))[-1]]
    used = scores >= floor
    places, good, bad = scores[used], good[used], bad[used]
    places = np.append((places[1:] + places[:-1]) / 2, places[-1] + 0.05)
    if not n_bad:
        return float(places[-1])
    higher = [np.append(np.cumsum(x[::-1])[::-1][1:], 0) for x in (bad, good)]
    return float(places[int(np.argmax(higher[0] / n_bad - higher[1] / n_good))])


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` has ``doc_id, quality``; of several labels of a document the lowest counts. Without usable labels only the hard
    limits decide. Null and empty texts have no words and fail; repeated rows are judged one by one.
    """
    stats = materialise(text_statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit_statistics(stats, labels))

    def make(batch: pa.RecordBatch) -> dict:
        features = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
        found = model.value
        usual = np.ones(len(features), bool) if found is None else found[0].score(features) <= found[1]
        out = {c: batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")}
        return out | {"kept": usual & ~np.asarray(batch.column("base_failed"))}

    rows = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return map_rows(rows, make, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make(batch: pa.RecordBatch) -> dict:
        found = [statistics(t.as_py()) for t in batch.column(1)]
        score = model.value[0].score(np.array([f for _, f in found]).reshape(-1, len(FEATURES))) if model.value and found else np.zeros(len(found))
        limit = model.value[1] if model.value else 1.0
        hard = [c[0] < MIN_WORDS or 100 * c[4] > REPEAT_SHARE * c[0] for c, _ in found]
        stay = pa.array([s <= limit and not h for s, h in zip(score, hard)], pa.bool_())
        return {"row": batch.column(0).filter(stay)}

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
