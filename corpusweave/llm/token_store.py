"""Token ids on disk: shards in document order, compressed by a grammar of id pairs (query ``op5_token_ids``)."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusweave.llm.common import Scratch, table
from corpusweave.session import bound_batches

#: Ids of a shard, the least share of a shard's pairs a rule must stand for, pieces in the newer half of the cache.
SHARD_IDS, RULE_SHARE, CACHED = 1 << 20, 1 / 12_000, 350_000
#: Pairs are sorted out roughly by this many hash slots before those that may be frequent are counted one by one.
SLOTS = 1 << 20
END = 0
MAGIC = b"IDG1"
HEADER = struct.Struct("<4sIIIII")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, the end id last.

    A text is cut before every blank that follows something other than white space. No token spans such a
    place, so a piece's ids do not depend on its neighbours, and pieces seen before are looked up. Texts
    with a special token's string or a zero byte are encoded whole. Single pieces go to the model as it stands, so the
    tokenizer must have no normalizer and cut texts at least where a byte-level one does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.normalizer is not None or type(self.whole.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("only byte-level tokenizers without a normalizer are cut into pieces")
        self.model = self.whole.model
        # pieces as they are, and pieces without the blank in front that nearly all begin with
        self.loose, self.after = Pieces(self.piece, {}), Pieces(lambda rest: self.piece(" " + rest), {})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = self.whole.pre_tokenizer.pre_tokenize_str
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
        self.blank = self.letters[32]
        self.plain = re.compile(r"( ?[^\W\d_]+)([.,;:!?]*)")

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if "\0" in text or any(s in text for s in self.special):
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        elif text:
            if len(self.after) > CACHED:  # what is asked for again comes back from the half before
                self.loose, self.after = self.loose.renewed(), self.after.renewed()
            if any(pair in text for pair in BROKEN):
                ids = b"".join(map(self.loose.__getitem__, joined(text.replace(" ", "\0 ").split("\0"))))
            else:
                parts = iter(text.split(" "))
                ids = self.loose[next(parts)] + b"".join(map(self.after.__getitem__, parts))
        else:
            ids = b""
        return ids + b"\0\0\0\0"

    def mapped(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def piece(self, piece: str) -> bytes:
        """A piece that is not in the cache. A line end between two characters that are no blanks is a token of its own."""
        first, line_end, rest = piece.partition("\n")
        if line_end and first and rest and not first[-1].isspace() and not rest[0].isspace():
            return (self.after[first[1:]] if first[0] == " " else self.loose[first]) + self.loose[line_end] + self.loose[rest]
        plain = self.plain.fullmatch(piece)
        if plain and piece.isprintable():
            word, end = plain.groups()
            if end:
                return (self.after[word[1:]] if word[0] == " " else self.loose[word]) + self.loose[end]
            word = self.blank + self.mapped(word[1:]) if word[0] == " " else self.mapped(word)
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return array("I", [t.id for part, _ in self.split(piece) for t in self.model.tokenize(part)]).tobytes()


#: One encoder for each tokenizer in a Python worker: its pieces are known to the tasks that come after.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pieces(dict):
    """Ids of pieces; one that is asked for first is encoded, unless the half of the cache before knows it."""

    def __init__(self, encode, before: dict):
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        ids = dict.get(self.before, piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def renewed(self) -> Pieces:
        self.before = None
        return Pieces(self.encode, self)


#: White space before a blank: such a blank is part of a run, and no cut is made there.
BROKEN = tuple(chr(c) + " " for c in range(0x3001) if chr(c).isspace())


def joined(parts: list[str]) -> list[str]:
    out = parts[:1]
    for part in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += part
        else:
            out.append(part)
    return out


def frequent_pairs(seq: np.ndarray, at: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that begin at places ``at``: where those begin that occur ``often`` or more times, these pairs, and which is where.

    Hash slots that are not met often cannot hold a frequent pair; the pairs of the others are counted exactly.
    """
    keys = (seq[at] << 32) | seq[at + 1]
    slot = ((keys * -7046029254386353131) >> 44) & (SLOTS - 1)
    maybe = (np.bincount(slot, minlength=SLOTS) >= often).take(slot)
    at, keys = at[maybe], keys[maybe]
    pairs, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    frequent = count >= often
    place = np.cumsum(frequent) - 1
    hit = frequent[number]
    return at[hit], pairs[frequent], place[number[hit]]


def compress(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A shard: rules (left, right, expansion length), where each document begins among the symbols, symbols.

    Round by round, all pairs that occur often are replaced by new symbols from left to right, until no pair is left that does. A pair
    never spans two documents, so each document can be expanded on its own. ``starts`` are the documents' first positions.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    seq, first = ids.astype(np.int64), np.zeros(len(ids) + 1, bool)
    first[starts] = True
    first[-1] = True
    left, right, length = [], [], []
    lengths = np.ones(base, np.int64)
    often, at = max(4, int(len(ids) * RULE_SHARE)), np.arange(max(0, len(seq) - 1))
    while True:
        at, pairs, number = frequent_pairs(seq, at[~first[at + 1]], often)
        if not len(pairs):
            break
        run = np.concatenate([[True], np.diff(at) > 1])  # neighbouring pairs overlap: every other one of a run is replaced
        begin = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        turn = (at - begin) % 2 == 0
        fresh = base + len(left)
        seq[at[turn]] = fresh + number[turn]
        lengths = np.concatenate([lengths, lengths[pairs >> 32] + lengths[pairs & 0xFFFFFFFF]])
        left += (pairs >> 32).tolist()
        right += (pairs & 0xFFFFFFFF).tolist()
        stay = np.ones(len(seq), bool)
        stay[at[turn] + 1] = False
        seq, first = seq[stay], np.concatenate([first[:-1][stay], [True]])
        # every place of a replaced pair is gone, so only pairs with a new symbol can be frequent now
        new = seq >= fresh
        at = np.flatnonzero(new[:-1] | new[1:])
    wide = base + len(left) > 1 << 16
    offsets = np.flatnonzero(first)
    head = HEADER.pack(MAGIC, base, len(left), len(offsets) - 1, len(seq), wide)
    rules = np.array([left, right, lengths[base:]], "<u4")
    return head + rules.tobytes() + offsets.astype("<u4").tobytes() + seq.astype("<u4" if wide else "<u2").tobytes()


class Shard:
    """Reads a shard; documents are expanded alone or together."""

    def __init__(self, data: bytes):
        magic, self.base, rules, docs, symbols, wide = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        self.left, self.right, self.length = np.frombuffer(data, "<u4", 3 * rules, at).reshape(3, rules).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u4", docs + 1, at + 12 * rules).astype(np.int64)
        self.symbols = np.frombuffer(data, "<u4" if wide else "<u2", symbols, at + 12 * rules + 4 * docs + 4)
        self.flat = None

    def lengths(self) -> np.ndarray:
        """Ids of each document, from the rules' expansion lengths alone."""
        size = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.base
        size[rule] = self.length[self.symbols[rule].astype(np.int64) - self.base]
        total = np.concatenate([[0], np.cumsum(size)])
        return np.diff(total[self.offsets])

    def document(self, n: int) -> np.ndarray:
        return self.expanded(self.symbols[self.offsets[n] : self.offsets[n + 1]])

    def ids(self) -> np.ndarray:
        return self.expanded(self.symbols)

    def expanded(self, seq: np.ndarray) -> np.ndarray:
        """Ids of symbols: what a symbol stands for lies in ``flat``, for one without a rule at its own number."""
        if self.flat is None:
            starts, parts, at = [*range(self.base)], [np.arange(self.base, dtype=np.uint32)], self.base
            for rule in zip(self.left.tolist(), self.right.tolist()):
                whole = np.concatenate([self.expansion(parts, s) for s in rule])
                parts.append(whole)
                starts.append(at)
                at += len(whole)
            self.flat, self.starts = np.concatenate(parts), np.array(starts, np.int64)
            self.sizes = np.concatenate([np.ones(self.base, np.int64), self.length])
        size = self.sizes[seq]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[seq] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")

    def expansion(self, parts: list[np.ndarray], symbol: int) -> np.ndarray:
        return parts[0][symbol : symbol + 1] if symbol < self.base else parts[symbol - self.base + 1]


def write_token_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) into shards below ``path``, in ascending doc_id order.

    The table at ``path`` has a row per shard: ``part, shard`` (its place), ``doc_ids``, ``n_ids`` and ``data``. Texts are dealt
    out by ranges of (doc_id, hash), so repeated ids are spread as well; a task holds one shard's ids at a time.
    Rows without doc_id come first, rows of one doc_id in the order of their hashes and texts. Null texts are empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, shard = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        held, doc_ids, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids) // 4
                if size >= SHARD_IDS:
                    yield row(part, shard, doc_ids, held)
                    held, doc_ids, size, shard = [], [], 0, shard + 1
        if held:
            yield row(part, shard, doc_ids, held)

    def row(part, shard, doc_ids, held):
        starts = np.cumsum([0] + [len(x) // 4 for x in held[:-1]])
        ids = np.frombuffer(b"".join(held), "<u4")
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip((part, shard, doc_ids, len(ids), compress(ids, starts)), kinds)],
            ["part", "shard", "doc_ids", "n_ids", "data"],
        )

    rows.select("doc_id", "text").mapInArrow(run, "part int, shard int, doc_ids array<long>, n_ids long, data binary").write.parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards below ``path``.

    Starts are sums over shards, then over a shard's own documents; the sums run over a few numbers a shard.
    """
    bound_batches(spark)
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("inner") + F.col("part_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, no, doc_ids, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                shard = Shard(data.as_py())
                size, ids = shard.lengths(), shard.ids()
                ends = np.cumsum(size)
                begins = ends - size
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [[part] * len(crc), [no] * len(crc), doc_ids, begins, ends - begins, crc]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "doc_ids", "data")
    docs = docs.mapInArrow(run, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and read them back."""
    path = Scratch(docs.sparkSession, "token-ids").path("shards")
    write_token_ids(docs, path, tokenizer or default_tokenizer())
    return read_token_ids(docs.sparkSession, path)


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_documents(table(spark, folder, "documents"))
