"""Word tables, vector codes and ranked search against plain versions of the same rules."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from corpusweave.llm import max_sketch, piece_table, pivot_codes
from corpusweave.llm.queries import QUERIES


def given(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


# sentencepiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_table.default_model())


def test_pieces_of_a_table(spark, sf, library):
    expected = []
    for r in given(spark, sf, "documents"):
        ids = library.encode(r.text or "")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids))]
        expected.append((r.doc_id, len(ids), *digests))
    assert Counter(map(tuple, QUERIES["op11_sentencepiece"](spark, sf).collect())) == Counter(expected)


def test_pieces_of_odd_texts(spark, library, odd_docs, odd_rows, no_docs, monkeypatch):
    expected = Counter((r[0], tuple(library.encode(r[1] or ""))) for r in odd_rows)
    for head, chars in ((1 << 17, 8_000_000), (0, 50), (7, 1)):  # everything in the head, nothing in it, a block for each text
        monkeypatch.setattr(piece_table, "HEAD", head)
        monkeypatch.setattr(piece_table, "BLOCK_CHARS", chars)
        monkeypatch.setattr(piece_table, "BUCKET_WORDS", 16)
        assert Counter((r.doc_id, tuple(r.ids)) for r in piece_table.encode(odd_docs).collect()) == expected
    assert piece_table.encode(no_docs).count() == 0 and piece_table.decode(piece_table.encode(no_docs)).columns == ["doc_id", "ids", "text"]


def test_pieces_of_random_texts(spark, library):
    dice = random.Random(5)
    texts = ["", " ", "\n", " \n ", "a  b", "▁", "▁ ▁a", "a▁b", "\0", "x\0y  z", "<s> </s><unk><0x0A>", "é́ 日本 👍🏽  x", "\t tab\r\n x", "long" * 20_000, " " * 5000]
    texts += ["".join(dice.choice(" ab▁\n\0é1.,") for _ in range(dice.randint(0, 30))) for _ in range(1000)]
    rows = piece_table.decode(piece_table.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (list(r.ids), r.text) == (ids, library.decode(ids)), repr(texts[r.doc_id])


def test_each_word_is_segmented_once(spark, monkeypatch):
    """Words outside the head reach the library once in all, however many blocks hold them."""
    asked = []

    class Counting(piece_table.Segmenter):
        def __call__(self, words):
            asked.extend(words)
            return super().__call__(words)

    monkeypatch.setattr(piece_table, "Segmenter", Counting)
    words = [f"word{i % 40}" for i in range(400)]
    dealt = spark.createDataFrame([(f"b{n}", bytearray(piece_table.packed_words(sorted(set(words[n : n + 90]))))) for n in range(0, 360, 30)], "block string, others binary")
    rows = piece_table.segmented(dealt, 4, piece_table.default_model()).collect()
    assert len({(r.block, r.bucket) for r in rows}) == len(rows) > 12
    total = sum(len(piece_table.unpacked(bytes(r.ids))[0]) for r in rows)
    assert total == 12 * 40


# vector codes


def plain_codes(rows):
    """Codes, errors and codebooks of (vec_id, vector, label), every distance computed."""
    kept = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % 16 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 16
    ints = [[[math.floor(x * 256) if abs(x) < 1e100 else int(x) * 256 for x in v[p * width : (p + 1) * width]] for p in range(16)] for _, v, _ in kept]
    books = [[v[p] for v in ints[:64]] for p in range(16)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        members = [[[] for _ in books[p]] for p in range(16)]
        for v in ints:
            for p in range(16):
                members[p][nearest(v, p)[1]].append(v[p])
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members[p], books[p])] for p in range(16)]
    out = []
    for (vec_id, _, label), v in zip(kept, ints):
        found = [nearest(v, p) for p in range(16)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), (1 << 63) - 1)))
    return out, hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def check_codes(spark, rows, schema="vec_id long, embedding array<double>, label int, code string, far int"):
    coded, digest = pivot_codes.encode(spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3))
    expected, books = plain_codes(rows)
    assert Counter(map(tuple, coded.collect())) == Counter(expected) and digest == books


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, 0.2, 64).round(3).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(200)]
    odd = [
        (3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[1][1], None), (500, None, 1), (501, [0.0] * 63 + [float("nan")], 1), (502, [0.0] * 63 + [None], 1),
        (503, [float("inf")] + [0.0] * 63, 1), (504, [], 1), (505, [1.0] * 32, 1), (506, [1.0] * 63, 1), (507, [0.0] * 64, 2), (508, [0.0] * 64, 2),
    ]
    check_codes(spark, rows + odd)
    check_codes(spark, [(i, [float(i % 4)] * 16, 1) for i in range(30)])  # ties throughout
    check_codes(spark, odd[3:8])
    check_codes(spark, [])


def test_vector_codes_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 16) * 10.0 ** (i % 12)).tolist(), 0) for i in range(100)]
    check_codes(spark, rows)
    check_codes(spark, rows + [(100, [1e300] * 16, 0), (101, [-1e18] * 16, 0), (7, [3e38] * 16, 0)])


def test_pivots_prune_and_never_lose(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-500, 500, (400, 16, 4))
    books = rng.integers(-500, 500, (16, 64, 4)).tolist()
    pivots = [pivot_codes.choose_pivots(p) for p in books]
    far = pivot_codes.distances(vectors.transpose(1, 0, 2), np.array(pivots)).transpose(1, 0, 2).astype("<f4")
    own = pivot_codes.Codebooks(books, pivots)
    codes, best = own.assign(vectors, far)
    every = ((vectors[:, :, None, :] - np.array(books)[None]) ** 2).sum(axis=3)
    assert (codes == every.argmin(axis=2)).all() and (best == every.min(axis=2)).all()


def test_label_errors(spark, sf):
    rows = QUERIES["op12_vector_codes"](spark, sf).collect()
    labels = {r.vec_id: r.label for r in given(spark, sf, "embeddings")}
    sums = Counter()
    for r in rows:
        sums[labels[r.vec_id]] += r.error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in rows)


# ranked search


def plain_search(docs, items):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    terms = [split(t) for _, t in docs]
    n, total, df = sum(map(bool, terms)), sum(map(len, terms)), Counter(t for own in terms for t in set(own))
    out = []
    for item, text in items:
        ranked = []
        for (doc_id, _), own in zip(docs, terms):
            counts, m = Counter(own), 25 + 75 * len(own) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in split(text) if t in counts)
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(ranked)[:10], 1)]
    return out


def test_search_of_odd_rows(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    docs = [r[:2] for r in odd_rows]
    asks = [odd_rows[4][1][:300], "ONE two", "one one one", "", None, "zzz unknown", "é \u0085x", odd_rows[16][1], odd_rows[16][1], "A line that several", "once\x00the.OF"]
    items = [(i if i != 8 else None, t) for i, t in enumerate(asks)] + [(1, "ONE two")]
    table = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, rank string, ask int")
    expected = Counter(plain_search(docs, items))
    assert Counter(map(tuple, max_sketch.search(max_sketch.build_index(odd_docs), table).collect())) == expected
    monkeypatch.setattr(max_sketch, "BLOCK_ITEMS", 2)  # several blocks
    monkeypatch.setattr(max_sketch, "TOGETHER", 1)  # a look for each document
    assert Counter(map(tuple, max_sketch.search(max_sketch.build_index(odd_docs), table).collect())) == expected
    assert max_sketch.search(max_sketch.build_index(no_docs), table).count() == 0
    assert max_sketch.search(max_sketch.build_index(odd_docs), table.limit(0)).count() == 0


def test_bounds_are_never_below_scores():
    dice = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs = [Counter(dice.choices(words, k=dice.randint(1, 900))) for _ in range(60)]
    items = [[(w, dice.randint(0, 9000)) for w in dice.sample(words, 30)] for _ in range(20)]
    asked = max_sketch.Asked(items)
    for doc in docs:
        own = {w.encode(): n for w, n in doc.items()}
        m = max_sketch.length_factor(sum(doc.values()), 60, 27_000)
        (_, bounds), = asked.bounds([max_sketch.sketch(Counter(own), m)])
        for item, bound in zip(asked.exact, bounds[0]):
            assert bound >= sum(w * max_sketch.impact(own[t], m) for t, w in item.items() if t in own)


def test_copies_fill_places_by_doc_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (99, "same words here too many others")]
    found = max_sketch.search(max_sketch.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), spark.createDataFrame([(1, "words here")], "item_id long, text string"))
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 11)]


# token shards


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_frequent_pair_is_left(seed):
    from corpusweave.llm import token_store

    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 300, rng.integers(2, 9)) for _ in range(40)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 40, rng.integers(1, 60))]) for _ in range(200)]
    docs += [np.full(int(n), 7) for n in rng.integers(1, 50, 20)]  # runs of one id
    ids, starts = np.concatenate(docs).astype("<u4"), np.cumsum([0] + [len(d) for d in docs[:-1]])
    shard = token_store.Shard(token_store.compress(ids, starts))
    assert (shard.ids() == ids).all() and all((shard.document(n) == d).all() for n, d in enumerate(docs))
    left = Counter(pair for a, b in zip(shard.offsets[:-1], shard.offsets[1:]) for pair in zip(shard.symbols[a : b - 1].tolist(), shard.symbols[a + 1 : b].tolist()))
    assert max(left.values()) < 2 * max(4, int(len(ids) * token_store.RULE_SHARE)) and len(shard.symbols) < len(ids) / 3
    apart = Counter()  # occurrences that do not overlap, as rules replace them
    for a, b in zip(shard.offsets[:-1], shard.offsets[1:]):
        own, last = shard.symbols[a:b].tolist(), {}
        for at, pair in enumerate(zip(own, own[1:])):
            if last.get(pair) != at - 1:
                apart[pair] += 1
                last[pair] = at
    assert max(apart.values()) < max(4, int(len(ids) * token_store.RULE_SHARE))
