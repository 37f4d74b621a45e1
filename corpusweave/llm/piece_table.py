"""SentencePiece ids of texts through one table of distinct marked words, and texts of ids (query ``op11_sentencepiece``)."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusweave.llm.common import Scratch, release_shuffles, table

MARK = "▁"
#: Words of the table's head, which every task holds, and their greatest length: at most 64 MB of text, about 3 MB of English. The head
#: decides where a word is looked up and nothing else; all other words go through the join.
HEAD, HEAD_CHARS = 1 << 18, 64
#: Characters of a block of texts, different words a task counts at once, times a word must occur among these to be proposed for the head.
BLOCK_CHARS, COUNTED, REPEATED = 12_000_000, 1 << 19, 2
#: Words outside the head a bucket gets on average.
BUCKET_WORDS = 1 << 17
CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(path: str) -> None:
    """Raise unless the model's pieces allow cuts before markers and around line ends, so that words can be segmented alone."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
    if spec.precompiled_charsmap or spec.normalization_rule_tsv or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
        raise ValueError("the model changes its texts beyond marking blanks")
    if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models of merged pairs with markers in front of words are cut into words")
    for piece in model.pieces:
        if piece.type in (kinds.USER_DEFINED, kinds.UNUSED):
            raise ValueError("pieces of the user's own may cross words")
        if piece.type == kinds.NORMAL and (MARK in piece.piece.lstrip(MARK) or ("\n" in piece.piece and len(piece.piece) > 1)):
            raise ValueError(f"piece {piece.piece!r} crosses words")


def cut(text: str | None) -> list[str]:
    """Marked words of a text: cut before every run of blanks and around every line end. A marker counts as a blank, as in the model."""
    if not text:
        return []
    marked = " " + text.replace(MARK, " ")
    if "  " in marked or "\0" in marked:
        return CHUNK.findall(marked)
    return [c for c in marked.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if c]


class Segmenter:
    """Ids of single marked words. A line end in front keeps the library from marking the word anew; its own ids are taken off."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.front = len(self.model.encode("\n"))

    def __call__(self, words: list[str]) -> list[list[int]]:
        return [ids[self.front :] for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]


def packed_words(words: list[str]) -> bytes:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 6)


def unpacked_words(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 * (n + 1), *ends], ends)]


def planes(numbers: np.ndarray) -> bytes:
    """All low bytes, then all second bytes and so on: the upper ones say little and take little room."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed(lists: list[list[int]]) -> bytes:
    """Lists of ids one after another: their number, their lengths, the ids."""
    lengths = list(map(len, lists))
    return planes(np.array([len(lists), *lengths, *(i for ids in lists for i in ids)], np.uint32))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = from_planes(data)
    n = int(raw[0])
    return raw[1 : n + 1], raw[n + 1 :]


def frequent(docs: DataFrame, model: str) -> list[tuple[str, list[int]]]:
    """Words and ids of the head: at most ``HEAD`` words, the most frequent of those that some task met repeatedly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            often = [(w, n) for w, n in seen.items() if n >= REPEATED and len(w) <= HEAD_CHARS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py()))
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model)
        for batch in batches:
            ids = segmenter(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HEAD)
    rows = top.mapInArrow(segment, "word string, n long, ids array<int>").collect()
    return [(r.word, list(r.ids)) for r in sorted(rows, key=lambda r: (-r.n, r.word))]


#: Places of the head's words, kept by a Python worker for the tasks that come after.
_PLACES: dict = {}


def places(head) -> dict[str, int]:
    if head.id not in _PLACES:
        _PLACES.clear()
        _PLACES[head.id] = {w: i for i, w in enumerate(head.value)}
    return _PLACES[head.id]


class Named:
    """A broadcast value and a name that tells it from others in a worker."""

    def __init__(self, spark: SparkSession, value):
        self.shared = spark.sparkContext.broadcast(value)
        self.id = self.shared._jbroadcast.id()

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def blocks(docs: DataFrame, head: Named) -> DataFrame:
    """Texts as numbers of words: ``block, doc_ids, sizes, words, others``, a row for about ``BLOCK_CHARS`` characters of a task's texts.

    ``words`` are the numbers of all words by position: below the head's size a word of the head, from there on a word of ``others``,
    the block's different words outside the head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, base = TaskContext.get(), len(head.value)
        known, number = places(head).get, 0

        def row():
            others = sorted(own)  # like words next to each other pack better
            rank = np.arange(base + len(own), dtype=np.uint32)
            rank[[own[w] for w in others]] = np.arange(base, base + len(own), dtype=np.uint32)
            numbers = rank[np.frombuffer(words, np.uint32)]
            values = (f"{context.partitionId()}-{number}", doc_ids, sizes, planes(numbers), packed_words(others), len(own))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
            names = ("block", "doc_ids", "sizes", "words", "others", "n_others")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        doc_ids, sizes, words, own, chars = [], [], array("I"), {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = cut(text)
                numbers = list(map(known, found))
                if None in numbers:
                    numbers = [own.setdefault(w, base + len(own)) if n is None else n for n, w in zip(numbers, found)]
                words.extend(numbers)
                doc_ids.append(doc_id)
                sizes.append(len(found))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield row()
                    doc_ids, sizes, words, own, chars, number = [], [], array("I"), {}, 0, number + 1
        if doc_ids:
            yield row()

    schema = "block string, doc_ids array<long>, sizes array<long>, words binary, others binary, n_others long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def segmented(dealt: DataFrame, buckets: int, model: str) -> DataFrame:
    """``block, bucket, ids`` of the words the blocks have outside the head: each different word is segmented once, in its bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts: dict[int, list[str]] = {}
                for word in unpacked_words(data.as_py()):
                    parts.setdefault(bucket_of(word, buckets), []).append(word)
                if parts:
                    texts = [packed_words(p) for p in parts.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([block] * len(parts), pa.string()), pa.array(texts, pa.binary())], ["bucket", "block", "words"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, current, seen = Segmenter(model), None, {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if bucket != current:
                    current, seen = bucket, {}
                words = unpacked_words(data.as_py())
                new = [w for w in words if w not in seen]
                seen.update(zip(new, segment(new)))
                out.append(packed([seen[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    asked = dealt.select("block", "others").mapInArrow(ask, "bucket int, block string, words binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(answer, "block string, bucket int, ids binary")


def encode(docs: DataFrame, model: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row of ``docs`` (``doc_id``, ``text``), as the library encodes whole texts.

    With ``decoded`` there is a column ``text`` as well: what the library decodes from the ids, in the same pass.

    No piece of the model crosses a marker or a line end (``check_model`` raises for models where one does), so every text is
    a sequence of marked words that can be segmented alone. The most frequent words are segmented once and sent to all tasks, a
    bounded table; every other different word goes to a bucket, is segmented there once, and its ids come back to the blocks of
    texts it stands in, where they are put in by position. Null and empty texts have no ids; repeated rows stay; other columns are
    not looked at; a null doc_id stays null; no rows give no rows.
    """
    model = model or default_model()
    check_model(model)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pieces")
    top = frequent(docs, model)
    release_shuffles(spark)
    head, head_ids = Named(spark, [w for w, _ in top]), Named(spark, packed([ids for _, ids in top]))
    dealt = scratch.write(blocks(docs, head), "blocks")
    others = dealt.agg(F.sum("n_others")).first()[0] or 0
    buckets = max(1, -(-others // BUCKET_WORDS))
    found = segmented(dealt, buckets, model).groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("answers"))
    both = dealt.select("block", "doc_ids", "sizes", "words", "others").join(found, "block", "left")
    base = len(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_lengths, head_flat = unpacked(head_ids.value)
        decoder = Segmenter(model).model if decoded else None
        for batch in batches:
            for doc_ids, sizes, data, other, answers in zip(*(batch.column(n) for n in ("doc_ids", "sizes", "words", "others", "answers"))):
                order: dict[int, list[int]] = {}
                for place, word in enumerate(unpacked_words(other.as_py())):
                    order.setdefault(bucket_of(word, buckets), []).append(place)
                parts = [(order[a["bucket"]], *unpacked(a["ids"])) for a in answers.as_py() or ()]
                n_other = sum(len(p) for p, _, _ in parts)
                lengths = np.concatenate([head_lengths, np.zeros(n_other, np.uint32)]).astype(np.int64)
                flat = np.concatenate([head_flat, *(f for _, _, f in parts)])
                starts = np.cumsum(lengths) - lengths
                at = len(head_flat)
                for where, size, own in parts:
                    where = np.array(where) + base
                    lengths[where] = size
                    starts[where] = at + np.cumsum(size, dtype=np.int64) - size
                    at += len(own)
                numbers = from_planes(data.as_py()).astype(np.int64)
                ends = np.cumsum(sizes.values.to_numpy())
                for a in range(0, len(ends), 256):
                    b = min(a + 256, len(ends))
                    mine = numbers[ends[a - 1] if a else 0 : ends[b - 1]]
                    size = lengths[mine]
                    total = np.concatenate([[0], np.cumsum(size)])
                    got = flat[np.repeat(starts[mine] - total[:-1], size) + np.arange(total[-1])]
                    offsets = np.concatenate([[0], total[ends[a:b] - (ends[a - 1] if a else 0)]])
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))
                    columns = {"doc_id": doc_ids.values[a:b], "ids": column}
                    if decoder is not None:
                        columns["text"] = pa.array([decoder.decode(got[x:y].tolist()) for x, y in zip(offsets[:-1], offsets[1:])], pa.string())
                    yield pa.RecordBatch.from_pydict(columns)

    return both.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with ``text``: what the library decodes from ``ids``. Null ids give an empty text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        decoder = SentencePieceProcessor(model_file=model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [decoder.decode(i.as_py() or []) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    kept = rows.drop("text")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))


def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    both = encode(table(spark, folder, "documents"), decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
