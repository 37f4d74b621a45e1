"""Language-model scores from a log-frequency Bloom filter of n-gram counts (query ``op4_lm_score``)."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, as_array, release_shuffles, table, words_of
from corpusweave.session import bound_batches

#: Words whose exact counts every worker holds, and their longest; all other words meet their counts in a join.
FREQUENT, LONGEST = 1 << 18, 64
#: The least number of a filter's parts, the counted events for which there is one more, bits for an entry and probes.
PARTS, PART_EVENTS, BITS, PROBES = 4096, 1 << 18, 8, 4
#: Different words a task counts at once.
COUNTED = 1 << 18
#: Events counted together before they leave a task, words of a stretch of text, words whose n-grams are asked for together.
EVENTS, CHUNK, GROUP = 1 << 22, 1 << 17, 1 << 20
#: The end of a text counts as an empty word; the word before the first is one that no text has.
END, BEGIN = b"", b" "
BEGIN_HASH, END_HASH = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
PAIR, TOTAL, KINDS = np.uint64(0xA4093822299F31D0), np.uint64(0x082EFA98EC4E6C89), np.uint64(0x452821E638D01377)


def in_training(doc_id: Column) -> Column:
    """Nine tenths of the documents, by id; a missing id counts as empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pairs_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + (word ^ PAIR))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    top = np.exp2(levels.astype(float))
    return np.where(levels > 0, (0.5 * top + top - 1) / 2, 0.0)


def halves(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that the places of an entry are made of (``place``)."""
    x = mixed(keys + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def place(one: np.ndarray, two: np.ndarray, i: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The i-th bit of an entry in a part of ``size`` bits: 32 mixed bits scaled to the size."""
    return (((one + np.uint64(i) * two) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def parts_for(events: int) -> int:
    """How many parts a filter has: a power of two that grows with what is counted, so a part's share does not."""
    return max(PARTS, 1 << max(0, -(-events // PART_EVENTS) - 1).bit_length())


def part_of(keys: np.ndarray, number: int) -> np.ndarray:
    """The part of an n-gram: its upper bits, so sorted keys have sorted parts."""
    return (((keys >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)).astype(np.int64)


def apart(keys: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as their part and the distance from the key before in the part, or from where the part begins.

    Parts are a power of two in number and are the keys' upper bits.
    """
    slot = part_of(keys, number)
    step = keys - (slot.astype(np.uint64) << np.uint64(64 - (number.bit_length() - 1)))
    same = np.flatnonzero(slot[1:] == slot[:-1]) + 1
    step[same] = keys[same] - keys[same - 1]
    return slot, step


def row_planes(steps: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of the steps; of each row (from one place of ``first`` to the next) all lowest bytes, then all next ones.

    Few steps need all bytes, so the upper ones are runs of zeros, which take no room in a shuffle.
    """
    size = np.diff(np.append(first, len(steps))).astype(np.int32)
    place = np.arange(len(steps), dtype=np.int32) + np.repeat((width - 1) * first.astype(np.int32), size)
    size, out = np.repeat(size, size), np.empty(len(steps) * width, np.uint8)
    low = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(width):
        out[place] = low[:, byte]
        place += size
    return out.view(f"V{width}")


def together(steps: list[bytes], widths: list[int], part: int, number: int) -> np.ndarray:
    """The keys of several rows of one part."""
    out = np.zeros(sum(len(s) // w for s, w in zip(steps, widths)), np.uint64)
    begins = np.cumsum([0, *(len(s) // w for s, w in zip(steps, widths))])
    for width in set(widths):
        rows = [n for n, w in enumerate(widths) if w == width]
        low = np.concatenate([np.frombuffer(steps[n], np.uint8).reshape(width, -1).T for n in rows])
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :width] = low
        value = full.view("<u8").ravel().astype(np.uint64)
        size = np.array([len(steps[n]) // width for n in rows])
        first = np.cumsum(size) - size
        total = np.cumsum(value)  # sums wrap around and so do differences
        value = total - np.repeat(total[first] - value[first], size)
        out[np.repeat(begins[rows] - first, size) + np.arange(len(value))] = value
    return out + (np.uint64(part) << np.uint64(64 - (number.bit_length() - 1)))


def build_part(keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
    """(lowest level, bits) of a part: an n-gram of level q is entered once for each level up to q, from 1 on."""
    reach = np.cumsum(np.bincount(levels)[::-1])[::-1] if len(levels) else np.zeros(1, np.int64)  # n-grams of at least a level
    size = max(64, -(-int(reach[1:].sum()) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for level in range(1, len(reach)):
        one, two = halves(keys[levels >= level], level)
        for i in range(PROBES):
            bits[place(one, two, i, np.uint64(size)).view(np.int64)] = True
    return 1, np.packbits(bits, bitorder="little").tobytes()


class CountFilter:
    """Parts put together; ``counts`` asks for quantised counts by repeated membership probes."""

    def __init__(self, parts: Iterable[tuple[int, int, bytes]], number: int = PARTS):
        self.number, self.lowest, self.size = number, np.ones(number, np.int64), np.full(number, 64, np.uint64)
        self.begin, found = np.zeros(number, np.uint64), bytearray(8)
        total = 64
        for part, lowest, bits in parts:
            self.lowest[part], self.size[part], self.begin[part] = lowest, 8 * len(bits), total
            found += bits
            total += 8 * len(bits)
        self.bits = np.frombuffer(found, np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        part = part_of(keys, self.number)
        level, size, begin = self.lowest[part], self.size[part], self.begin[part]
        found, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(at):
            one, two = halves(keys, level)
            there = np.arange(len(keys))
            for i in range(PROBES):  # most n-grams that were not entered end at the first probe
                bit = place(one[there], two[there], i, size[there]) + begin[there]
                there = there[(self.bits[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            at, keys, level, size, begin = at[there], keys[there], level[there], size[there], begin[there]
            found[at] = level
            level = level + 1
        return found


def starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def packed(slots: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each of the sorted ``slots``: the slot, and its stretch of each column as bytes."""
    first = starts(slots)
    cut, out = np.append(first, len(slots)), [pa.array(slots[first])]
    for column in columns:
        offsets = (cut * column.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column))]))
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over the given rows, the end of each text (an empty word) included."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield flushed(seen)
        yield flushed(seen)

    def flushed(seen: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _pair_counts(docs: DataFrame, number: int) -> DataFrame:
    """``slot, keys, contexts, n``: pairs of neighbouring tokens, summed inside a task and packed by part."""

    def run(batches):
        before, after, held = np.empty(EVENTS, np.uint64), np.empty(EVENTS, np.uint64), 0
        for batch in batches:
            for text in batch.column(0):
                own = np.concatenate([[BEGIN_HASH], hashes_of(words_of(text.as_py())), [END_HASH]])
                k = 0
                while k < len(own) - 1:
                    n = min(EVENTS - held, len(own) - 1 - k)
                    before[held : held + n], after[held : held + n] = own[k : k + n], own[k + 1 : k + 1 + n]
                    held, k = held + n, k + n
                    if held == EVENTS:
                        yield summed(before, after)
                        held = 0
        if held:
            yield summed(before[:held], after[:held])

    def summed(before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        """Both arrays are used up: the words become the pairs' keys, then both are sorted in place."""
        keys = after
        for k in range(0, len(keys), CHUNK):
            keys[k : k + CHUNK] = pairs_of(before[k : k + CHUNK], after[k : k + CHUNK])
        order = np.argsort(keys)
        keys[:] = keys[order]
        before[:] = before[order]
        del order
        first = starts(keys)
        n = np.diff(np.append(first, len(keys)))
        own = keys[first]
        return pa.RecordBatch.from_arrays(packed(part_of(own, number), own, before[first], n), ["slot", "keys", "contexts", "n"])

    return docs.select("text").mapInArrow(run, "slot long, keys binary, contexts binary, n binary")


def _context_counts(contexts: DataFrame, number: int) -> DataFrame:
    """``slot, keys, contexts, n`` of ``context, kinds, total``: two entries for a word, packed by part."""

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            waiting += batch.num_rows
            if waiting >= EVENTS // 4:
                yield entries(held)
                held, waiting = [], 0
        if waiting:
            yield entries(held)

    def entries(held: list) -> pa.RecordBatch:
        own, kinds, total = map(np.concatenate, zip(*held))
        keys, n = np.concatenate([mixed(own ^ TOTAL), mixed(own ^ KINDS)]), np.concatenate([total, kinds])
        order = np.argsort(keys)
        return pa.RecordBatch.from_arrays(packed(part_of(keys[order], number), keys[order], n[order]), ["slot", "keys", "n"])

    found = contexts.select("context", "kinds", "total").mapInArrow(run, "slot long, keys binary, n binary")
    return found.select("slot", "keys", F.lit(None).cast("binary").alias("contexts"), "n")


def _parts(counts: DataFrame) -> DataFrame:
    """Filter parts of packed counts, and for each context seen how many pairs and how often.

    A part's rows meet in one task, which sums equal keys and enters all of them; the number of parts grows with the
    counted events, so a part does not. Context rows have ``bits`` null.
    """
    names = ["slot", "lowest", "bits", "context", "kinds", "total"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        part, held, sums, waiting = None, [], [], 0
        for batch in batches:
            for slot, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != slot:
                    row, found = finished(part, held)
                    yield row
                    held = []
                    if found is not None:
                        sums.append(found)
                        waiting += len(found[0])
                    if waiting > EVENTS // 4:
                        yield context_rows(sums)
                        sums, waiting = [], 0
                part = slot
                held.append(own)
        if held:
            row, found = finished(part, held)
            yield row
            sums += [found] if found is not None else []
        if sums:
            yield context_rows(sums)

    def finished(part, held):
        keys, n = (np.frombuffer(b"".join(row[k] for row in held), kind) for k, kind in ((0, np.uint64), (2, np.int64)))
        order = np.argsort(keys)
        keys = keys[order]
        first = starts(keys)
        total = np.add.reduceat(n[order], first)
        row = [pa.array([v], t) for v, t in zip((part, *build_part(keys[first], level_of(total)), None, None, None), types)]
        row = pa.RecordBatch.from_arrays(row, names)
        if held[0][1] is None:
            return row, None
        context = np.frombuffer(b"".join(row[1] for row in held), np.uint64)[order[first]]
        return row, (context, total)

    def context_rows(sums):
        context, total = map(np.concatenate, zip(*sums))
        order = np.argsort(context)
        own = context[order]
        first = starts(own)
        kinds, total = np.diff(np.append(first, len(own))), np.add.reduceat(total[order], first)
        empty = [pa.nulls(len(first), t) for t in types[:3]]
        return pa.RecordBatch.from_arrays([*empty, pa.array(own[first].view(np.int64)), pa.array(kinds), pa.array(total)], names)

    rows = counts.repartition("slot").sortWithinPartitions("slot")
    return rows.mapInArrow(run, "slot long, lowest int, bits binary, context long, kinds long, total long")


def train(docs: DataFrame, scratch: Scratch, number: int) -> DataFrame:
    """``slot, lowest, bits``: a filter of pairs in ``number`` parts, then one of how often a word occurs and how many kinds follow it.

    The filters hold every n-gram, so they grow with the corpus and stay a table.
    """
    found = scratch.write(_parts(_pair_counts(docs, number)), "pairs")
    release_shuffles(docs.sparkSession)
    contexts = found.where("bits is null").groupBy("context").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"))
    single = scratch.write(_parts(_context_counts(contexts, number)), "contexts")
    parts = found.select("slot", "lowest", "bits"), single.select(F.col("slot") + number, "lowest", "bits")
    filters = scratch.write(parts[0].unionAll(parts[1]).where("bits is not null").toDF("slot", "lowest", "bits"), "filters")
    scratch.drop(found, single)
    release_shuffles(docs.sparkSession)
    return filters


def answers(filters: DataFrame, asked: DataFrame, number: int) -> DataFrame:
    """``block, slot, levels`` for ``block, slot, keys, width``: keys go to their part and come back as a byte each."""
    names = ["block", "slot", "levels"]

    def run(batches):
        part, own, waiting = None, None, []
        for batch in batches:
            for slot, lowest, bits, block, keys, width in zip(*(c.to_pylist() for c in batch.columns)):
                if slot != part:
                    if waiting:
                        yield probed(part, own, waiting)
                    part, own, waiting = slot, None, []
                if block is None:
                    own = CountFilter([(0, lowest, bits)], 1)
                else:
                    waiting.append((block, keys, width))
        if waiting:
            yield probed(part, own, waiting)

    def probed(part, own, waiting):
        blocks, steps, widths = zip(*waiting)
        every = together(steps, widths, part % number, number)
        levels = (np.zeros(len(every), np.int64) if own is None else own.levels(every)).astype(np.uint8)
        cut = np.cumsum([0, *(len(s) // w for s, w in zip(steps, widths))])
        out = [levels[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array(out, pa.binary())], names)

    none = [F.lit(None).cast(t).alias(n) for n, t in (("block", "long"), ("keys", "binary"), ("width", "int"))]
    rows = filters.select("slot", "lowest", "bits", *none)
    rows = rows.unionAll(asked.select("slot", F.lit(None).cast("int"), F.lit(None).cast("binary"), "block", "keys", "width"))
    return rows.repartition("slot").sortWithinPartitions("slot", F.col("block").asc_nulls_first()).mapInArrow(run, "block long, slot long, levels binary")


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """At most ``most`` words with the highest counts, none longer than ``LONGEST`` bytes."""
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("step", F.floor(8 * F.log2("c")).cast("int"))
    room, least = most, None
    for row in sorted(short.groupBy("step").count().collect(), key=lambda r: -r.step):  # a few hundred rows
        room -= row["count"]
        if room < 0:
            break
        least = row.step
    return {} if least is None else {bytes(r.word): r.c for r in short.where(F.col("step") >= least).select("word", "c").collect()}


def words_in(ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) of stretches whose ids begin with that of the word before."""
    head = np.cumsum(length + 1) - length - 1
    place = np.ones(len(ids), bool)
    place[head] = False
    at = np.flatnonzero(place)
    return ids[at - 1], ids[at]


class Stretches:
    """Words of several stretches of text as numbers, each stretch after the word before it."""

    def __init__(self):
        self.number_of, self.ids, self.lengths, self.rows = {}, array("I"), [], []

    def add(self, row: int, before: bytes, words: list[bytes]) -> None:
        number = self.number_of
        self.ids.append(number.setdefault(before, len(number)))
        self.ids.extend([number.setdefault(w, len(number)) for w in words])
        self.lengths.append(len(words))
        self.rows.append(row)


def ngrams_of(hashed: np.ndarray, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs, place by place, and of the words' two counts."""
    old, new = words_in(ids, length)
    pairs = np.empty(len(old), np.uint64)
    for k in range(0, len(old), CHUNK):
        pairs[k : k + CHUNK] = pairs_of(hashed[old[k : k + CHUNK]], hashed[new[k : k + CHUNK]])
    return pairs, np.concatenate([mixed(hashed ^ TOTAL), mixed(hashed ^ KINDS)])


def different(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; the keys are used up."""
    keys.sort()
    return keys[starts(keys)]


def by_plane(ids: np.ndarray) -> bytes:
    """All low bytes, then all next ones and so on: the upper ones are nearly all 0 and take no room on disk."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def read_block(hashed: bytes, ids: bytes, length: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(hashed, np.uint64), from_planes(ids), np.frombuffer(length, np.int64)


def questions(blocks: DataFrame, number: int) -> DataFrame:
    """``block, slot, keys, width``: the different n-grams of each block by part, as steps of ``width`` bytes from one to the next."""
    names = ["block", "slot", "keys", "width"]

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block, *text = (c[n] for c in batch.columns)
                yield asked(block.as_py(), *read_block(*(t.as_buffer() for t in text)))
                pa.default_memory_pool().release_unused()

    def asked(block, *text):
        (pair_slot, pair_step), (word_slot, word_step) = (apart(different(keys), number) for keys in ngrams_of(*text))
        word_slot += number
        steps, slots = np.concatenate([pair_step, word_step]), np.concatenate([pair_slot, word_slot])
        del pair_slot, pair_step
        width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
        slot, keys = packed(slots, row_planes(steps, starts(slots), width))
        columns = [pa.array(np.full(len(slot), block, np.int64)), slot, keys, pa.array(np.full(len(slot), width, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("block", "hashed", "ids", "length").mapInArrow(run, "block long, slot long, keys binary, width int")


def pair_scores(found: DataFrame, blocks: DataFrame, room: float, ends: int) -> DataFrame:
    """``row_id, score`` of stretches of text, from what the filters answered for their block (``found``)."""

    def run(batches):
        block, levels = None, []
        for batch in batches:
            for own, _, answer, *text in zip(*(c.to_pylist() for c in batch.columns)):
                if own != block:
                    block, levels = own, []
                if answer is None:
                    yield judged(np.frombuffer(b"".join(levels), np.uint8).astype(np.int64), *text)
                else:
                    levels.append(answer)

    def judged(levels, hashed, ids, length, rows):
        hashed, ids, length = read_block(hashed, ids, length)
        rows = np.frombuffer(rows, np.int64)
        old, new = words_in(ids, length)
        asked = ngrams_of(hashed, ids, length)
        pairs, first, back = np.unique(asked[0], return_index=True, return_inverse=True)
        words, word_back = np.unique(asked[1], return_inverse=True)
        if len(levels) != len(pairs) + len(words):
            raise RuntimeError(f"{len(levels)} answers to {len(pairs) + len(words)} questions")
        often, kinds = np.split(count_of(levels[len(pairs) :])[word_back], 2)
        often = np.where((hashed == END_HASH) | (hashed == BEGIN_HASH), ends, often)
        old, new = old[first], new[first]
        plain, total_before, kinds_before = (often[new] + 0.1) / room, often[old], kinds[old]
        both = np.minimum(count_of(levels[: len(pairs)]), total_before)
        mixed_share = (both + kinds_before * plain) / np.maximum(total_before + kinds_before, 1e-9)
        share = np.where((total_before > 0) & (kinds_before > 0), mixed_share, plain)
        score = np.add.reduceat(np.log10(np.minimum(share, 1.0))[back], np.cumsum(length) - length)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score)], ["row_id", "score"])

    text = ["hashed", "ids", "length", "rows"]
    rows = found.select("block", "slot", "levels", *(F.lit(None).cast("binary").alias(c) for c in text))
    rows = rows.unionAll(blocks.select("block", F.lit(None).cast("long"), F.lit(None).cast("binary"), *text))
    return rows.repartition("block").sortWithinPartitions("block", F.col("slot").asc_nulls_last()).mapInArrow(run, "row_id long, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``base_score`` is exact: frequent words are looked up in a table of bounded size, the others are joined
    with their counts. ``score`` is that of a pair model whose counts come from the filters: the share of a word
    after its predecessor, filled up by the number of kinds seen after it times the word's own smoothed share
    (Witten-Bell). Counts are halves of powers of two, now and then too high where probes hit by chance. The filters
    hold all n-grams and stay in parts: the different n-grams of a block of texts go to their parts and the counts
    come back. Null and empty texts have the end token only; rows that repeat a doc_id are scored one by one, and
    in training each counts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learn = rows.where(in_training(F.col("doc_id")))
    counts = scratch.write(token_counts(learn), "counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, room = size.n, size.n + 0.1 * (size.v + 1)
    release_shuffles(spark)
    known = spark.sparkContext.broadcast(frequent_words(counts))
    ends = next((r.c for r in counts.where(F.col("word") == F.lit(END)).select("c").collect()), 0)
    number = parts_for(total)
    filters = train(learn, scratch, number)
    limit = float(np.log10(room))

    schema = "row_id long, doc_id long, n_tokens long, n_known long, logs double, rare array<struct<word: binary, n: int>>"
    schema += ", block long, hashed binary, ids binary, length binary, rows binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        """Rows with their exact part of the score, and blocks of text as word numbers."""
        block = TaskContext.get().partitionId() << 32

        def filled(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        # A block goes on over batches, and rows leave with their last block, so a task holds no more than a block's rows.
        out, held = empty(), Stretches()
        for batch in batches:
            for row_id, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                words.append(END)
                row = len(out["row_id"])
                for name, value in zip(out, (row_id, doc_id, len(words), 0, 0.0, [])):
                    out[name].append(value)
                for k in range(0, len(words), CHUNK):
                    held.add(row, words[k - 1] if k else BEGIN, words[k : k + CHUNK] if len(words) > CHUNK else words)
                    if len(held.ids) > GROUP:
                        yield filled(judge(held, out, block))
                        held, block = Stretches(), block + 1
                if not held.rows:
                    yield filled(out)
                    out = empty()
                    pa.default_memory_pool().release_unused()
        if held.rows:
            yield filled(judge(held, out, block))
        yield filled(out)

    def empty() -> dict:
        return {name: [] for name in ("row_id", "doc_id", "n_tokens", "n_known", "logs", "rare")}

    def judge(held: Stretches, out: dict, block: int) -> dict:
        """Add what stretches of words give exactly, every different word looked up once; returns their block."""
        exact, number_of, kinds_of_words = known.value, held.number_of, list(held.number_of)
        ids, length, row = np.array(held.ids, np.uint32), np.array(held.lengths), np.array(held.rows)
        _, new = words_in(ids, length)
        start = np.cumsum(length) - length

        count = np.fromiter((exact.get(w, -1) for w in kinds_of_words), np.int64, len(kinds_of_words))
        there = count >= 0
        log = np.where(there, np.log10(np.maximum(count, 0) + 0.1), 0.0)
        for own, logs, known_words in zip(held.rows, np.add.reduceat(log[new], start).tolist(), np.add.reduceat(there[new].astype(np.int64), start).tolist()):
            out["logs"][own] += logs
            out["n_known"][own] += known_words
        seldom = np.flatnonzero(~there[new])
        owner = np.repeat(row, length)[seldom]
        found, n = np.unique(owner * len(kinds_of_words) + new[seldom].astype(np.int64), return_counts=True)
        for key, times in zip(found.tolist(), n.tolist()):
            out["rare"][key // len(kinds_of_words)].append((kinds_of_words[key % len(kinds_of_words)], times))

        hashed = hashes_of(kinds_of_words)
        for edge, value in ((number_of.get(END), END_HASH), (number_of.get(BEGIN), BEGIN_HASH)):
            if edge is not None:
                hashed[edge] = value
        return {"block": [block], "hashed": [hashed.tobytes()], "ids": [by_plane(ids)], "length": [length.astype(np.int64).tobytes()], "rows": [np.array(out["row_id"], np.int64)[row].tobytes()]}

    split = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(run, schema)
    split = scratch.write(split, "split")
    blocks = split.where("block is not null")
    found = scratch.write(answers(filters, questions(blocks, number), number), "answers")
    scratch.drop(filters)
    release_shuffles(spark)
    scores = scratch.write(pair_scores(found, blocks, room, ends), "scores")
    scratch.drop(found)
    release_shuffles(spark)
    rare = split.where("row_id is not null").select("row_id", F.inline("rare")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.select("row_id", (F.col("n") * F.log10(c + 0.1)).alias("logs"), F.when(c > 0, F.col("n")).otherwise(0).cast("long").alias("known"), F.lit(0.0).alias("score"))
    parts = rare.unionAll(scores.select("row_id", F.lit(0.0), F.lit(0).cast("long"), "score"))
    parts = parts.groupBy("row_id").agg(F.sum("logs").alias("rare_logs"), F.sum("known").alias("rare_known"), F.sum("score").alias("score"))
    return split.where("row_id is not null").select("row_id", "doc_id", "n_tokens", "n_known", "logs").join(parts, "row_id").select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * limit).alias("base_score"), "score",
    )


def lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))
