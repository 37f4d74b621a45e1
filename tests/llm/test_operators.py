"""Every operator against a plain version of the same rules, on given tables and on odd rows."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusweave.llm import chat_template, decontaminate, line_runs, lm_score, mixing, quality_forest, simhash, style_tree, token_store, url_cascade
from corpusweave.llm.common import Scratch
from corpusweave.llm.queries import ORACLE, QUERIES
from tests.harness import compare, connect


def given(spark, sf, name):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(name, spark, sf):
    ok, message = compare(QUERIES[name], ORACLE[name], spark, connect(sf), sf)
    assert ok, message


# near copies


def plain_fingerprint(text):
    words = split(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64)) if hashes else 0


def plain_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def check_simhash(rows, found):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    roots = plain_components({f for _, f in fps})
    smallest = {}
    for d, f in fps:
        if d is not None:
            smallest[roots[f]] = min(d, smallest.get(roots[f], d))
    assert Counter(found) == Counter((d, f"{f:016x}", smallest.get(roots[f])) for d, f in fps)


def test_simhash(spark, sf, odd_docs, odd_rows, no_docs):
    rows = [r[:2] for r in given(spark, sf, "documents")]
    check_simhash(rows, [tuple(r) for r in QUERIES["op1_simhash"](spark, sf).collect()])
    check_simhash([r[:2] for r in odd_rows], [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 700:  # a walk of one to five flips: some within two bits, some not
        f = int(rng.choice(list(fps)))
        for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
            f ^= 1 << bit
        fps.add(f)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for limit in (4, 48, 10**6):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        scratch = Scratch(spark, "test")
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, scratch).distinct().collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        merged = {f: f for f in fps}

        def find(f):
            while merged[f] != f:
                f = merged[f]
            return f

        for a, b in edges:
            merged[find(a)] = find(b)
        groups = lambda of: sorted(sorted(g) for g in _grouped(of))
        assert groups({f: find(f) for f in fps}) == groups(plain_components(fps))


def _grouped(of):
    out = defaultdict(list)
    for member, root in of.items():
        out[root].append(member)
    return out.values()


def test_one_of_each(spark, odd_docs, odd_rows, no_docs):
    stay = simhash.one_of_each(odd_docs)
    assert stay.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in stay.collect()), key=lambda d: (d is None, d))
    fps = [(r[0], plain_fingerprint(r[1])) for r in odd_rows]
    roots = plain_components({f for _, f in fps})
    first = {}
    for d, f in sorted(fps, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(roots[f], d)
    assert ids == sorted(first.values(), key=lambda d: (d is None, d)) and simhash.one_of_each(no_docs).count() == 0


# lines


def test_lines(spark, odd_docs, odd_rows, no_docs):
    holders, key_of = defaultdict(set), lambda line: line.encode().strip().lower()
    for d, t, *_ in odd_rows:
        for line in (t or "").split("\n"):
            if len(key_of(line).decode()) >= 20:
                holders[key_of(line)].add(d)
    expected = Counter()
    for d, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        gone = lambda k: len(holders[k]) >= 3 and d != max(x for x in holders[k] if x is not None)
        kept = [x for x in lines if not gone(key_of(x))]
        expected[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    found = line_runs.without_repeated_lines(odd_docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == expected and sum(r.n_dropped for r in found) == 3
    assert line_runs.without_repeated_lines(no_docs).count() == 0


def test_line_runs_are_compacted_and_know_new_lines(spark):
    runs = line_runs.LineRuns(spark, Scratch(spark, "line-runs"))
    sizes = []
    for batch in range(5):
        rows = [(batch * 10 + d, bytes([line]) * 16) for d in range(3) for line in (batch, 7)]
        fresh = {bytes(r.line)[0] for r in runs.add(spark.createDataFrame(rows, "doc_id long, line binary")).collect()}
        assert fresh == ({0, 7} if batch == 0 else {batch})
        sizes.append(sum(map(len, runs.levels)))
    assert sizes == [1, 1, 2, 1, 2]
    found = runs.known().collect()
    merged = {bytes(r.line)[0]: (r.docs, r.last) for r in found}
    assert len(found) == len(merged)  # one entry for each line: without the anti-join a line would have one for each batch
    assert merged[7] == (15, 42) and merged[3] == (3, 32)
    runs.close()


# mixing


def test_targets():
    assert mixing.target_words([10, 10, 10], [5, 2, 1]).tolist() == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.target_words([100, 1, 0], [1, 5, 2]).tolist() == pytest.approx([149.5, 2, 0])


def test_shards_share_out_all_slots():
    quotas = np.array([1000, 0, 37, 3, 5000])
    parts = [mixing.shard_quotas(quotas, 7, k) for k in range(7)]
    end = np.zeros(5, np.int64)
    for first, own in parts:
        assert (first == end).all()
        end = end + own
    assert (end == quotas).all() and {int(own.sum()) for _, own in parts} <= {862, 863, 864}
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def check_mix(rows, found, slack):
    sizes = [(d, s, len(split(t))) for d, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, o, n in sizes if o == s) for s in names}
    target = dict(zip(names, mixing.target_words([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in found) == Counter((d, n, total[s], round(float(target[s]), 6)) for d, s, n in sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by_target = defaultdict(int)
    for r in found:
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    for (size, goal), taken in by_target.items():
        same = sum(total[s] == size and round(float(target[s]), 6) == goal for s in names)
        assert abs(taken - same * goal) <= slack * same, (size, goal, taken)


def test_mixing(spark, sf, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1], r[3]) for r in given(spark, sf, "documents")]
    found = QUERIES["op3_mix_sources"](spark, sf).collect()
    check_mix(rows, found, 2 * mixing.BLOCK)
    assert Counter(found) == Counter(QUERIES["op3_mix_sources"](spark, sf).collect())
    check_mix([(r[0], r[1], r[3]) for r in odd_rows], mixing.mix_counts(odd_docs).collect(), 2 * mixing.BLOCK)
    assert mixing.mix_counts(no_docs).count() == 0
    texts = mixing.mixed_documents(odd_docs)
    assert texts.columns == odd_docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(odd_docs).collect() if r.doc_id in (4, 6, 16)}
    words, own = defaultdict(int), defaultdict(set)
    for r in odd_rows:
        own[r[0]] |= set(split(r[1]))
    for r in texts.collect():
        words[r.doc_id] += len(split(r.text))
        assert r.n_chars == len(r.text) and set(split(r.text)) <= own[r.doc_id]
    assert {d: words[d] for d in taken} == taken and mixing.mixed_documents(no_docs).count() == 0


# scores


def check_scores(rows, found):
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    counts = Counter(w for d, t in rows if crc(d) for w in [*split(t), b""])
    total, kinds = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t in rows:
        own = [*split(t), b""]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        expected[(d, crc(d) == 0, len(own), sum(w in counts for w in own), total, round(float(base), 5))] += 1
    assert Counter((*r[:5], round(r.base_score, 5)) for r in found) == expected
    assert all(np.isfinite(r.score) and r.score <= 0 for r in found)


def test_scores(spark, sf, odd_docs, odd_rows, no_docs, monkeypatch):
    rows = [r[:2] for r in given(spark, sf, "documents")]
    found = QUERIES["op4_lm_score"](spark, sf).collect()
    check_scores(rows, found)
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)  # better on texts it has not seen
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    parts = lm_score.lm_scores(odd_docs).collect()
    monkeypatch.setattr(lm_score, "CHUNK", 1 << 18)
    whole = lm_score.lm_scores(odd_docs).collect()
    check_scores([r[:2] for r in odd_rows], whole)
    assert sorted(round(r.score, 6) for r in parts) == sorted(round(r.score, 6) for r in whole)
    assert lm_score.lm_scores(no_docs).count() == 0


def test_rare_words_are_joined(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lm_score, "frequent_words", lambda counts: {b"the": counts.where(F.col("word") == F.lit(b"the")).first().c})
    check_scores([r[:2] for r in odd_rows], lm_score.lm_scores(odd_docs).collect())


def test_count_filter_never_forgets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    counts = rng.integers(1, 3000, len(keys))
    parts = (keys >> np.uint64(52)).astype(int)
    found = []
    for p in np.unique(parts):
        own = parts == p
        found.append((int(p), *lm_score.build_part(keys[own], lm_score.level_of(counts[own]))))
    table = lm_score.CountFilter(found)
    assert (table.counts(keys) >= lm_score.count_of(lm_score.level_of(counts)) - 1e-9).all()
    assert (table.counts(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.06


def test_full_parts_keep_every_level():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 52, 60000).astype(np.uint64))  # one part, far more than fit one before
    counts = rng.choice([1, 1, 1, 2, 5, 40], len(keys))
    levels = lm_score.level_of(counts)
    found = lm_score.CountFilter([(0, *lm_score.build_part(keys, levels))]).counts(keys)
    assert (found >= lm_score.count_of(levels) - 1e-9).all()
    assert (found == lm_score.count_of(levels)).mean() > 0.9
    assert lm_score.parts_for(0) == lm_score.PARTS and lm_score.parts_for(lm_score.PARTS * lm_score.PART_EVENTS * 3) == 4 * lm_score.PARTS


def test_parts_that_come_in_several_batches_keep_all(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 52, 50000).astype(np.uint64))  # one part, all of them seen once
    split_keys = [keys[k : k + 1000] for k in range(0, len(keys), 1000)]
    rows = [(0, k.tobytes(), None, np.ones(len(k), np.int64).tobytes()) for k in split_keys]
    rows += [(0, split_keys[0].tobytes(), None, np.full(len(split_keys[0]), 4, np.int64).tobytes())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        counts = spark.createDataFrame(rows, "slot long, keys binary, contexts binary, n binary")
        found = lm_score._parts(counts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = lm_score.CountFilter([(r.slot, r.lowest, r.bits) for r in found])
    assert len(found) == 1 and (table.counts(keys) >= 1).all() and (table.counts(split_keys[0]) >= lm_score.count_of(np.array([3]))).all()


# token ids


def check_ids(rows, found):
    whole = token_store.Encoder(token_store.default_tokenizer()).whole
    ids = {}
    expected = Counter()
    for d, t in rows:
        own = array("I", [*whole.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
        expected[(d, len(own) // 4, zlib.crc32(own))] += 1
        ids.setdefault(d, []).append(len(own) // 4)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_token_ids(spark, sf, odd_docs, odd_rows, no_docs):
    check_ids([r[:2] for r in given(spark, sf, "documents")], QUERIES["op5_token_ids"](spark, sf).collect())
    check_ids([r[:2] for r in odd_rows], token_store.encoded_documents(odd_docs).collect())
    assert token_store.encoded_documents(no_docs).count() == 0


def test_pieces_are_whole_tokens():
    encode = token_store.Encoder(token_store.default_tokenizer())
    texts = ["", " ", "  a  b \n c", "a\u0085 b", "x\x1f y", "it's don't I'LL", "<|endoftext|> a", "a\0b", "é è  x", "1 2 33, 4;;; a_b __ c"]
    texts += ["A.B,c ..., . ,", "ª º ²x 中文 字", "a\n b\n\n c \t d", "\u200b x \ufeff y", "naïve, \u0301x é o", "x\u3000 y \u2028z", "…, “q” ‘s", "a" * 5000]
    for text in texts:
        assert encode(text) == array("I", [*encode.whole.encode(text, add_special_tokens=False).ids, 0]).tobytes(), repr(text)


@pytest.mark.parametrize("top", [3, 50, 200_000])
def test_shards_expand(top):
    rng = np.random.default_rng(top)
    ids = np.concatenate([rng.integers(0, top, 3000), np.tile(rng.integers(0, top, 7), 900), np.zeros(2000, int)]).astype("<u4")
    starts = np.array([0, 1, 2, 3000, 7000, len(ids) - 1])
    data = token_store.compress(ids, starts)
    shard = token_store.Shard(data)
    assert (shard.ids() == ids).all() and len(shard.left) and len(shard.symbols) < len(ids)
    assert np.concatenate([[0], np.cumsum(shard.lengths())]).tolist() == [*starts.tolist(), len(ids)]
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
        assert (shard.document(n) == ids[a:b]).all()


# URLs


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http:///p", "HTTP://X.ORG/a?b#c", "http://a.b.example.org/es/1", "http://example.org/en/1x", "http://example.org/en/2",
        "http://xexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://a.com/", "http://www.cheap-pills.example.com/en/", "http://x.org", "a://b://c.org/?", "http://a..org/",
        "http://free-bets.example.com/fr/1\nx", "http://É.ORG/é",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string, host string, rule string")

    def plain(url):
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = host.encode().lower().decode()
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[2], max(fits)[3]
        return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in url_cascade.BLOCKED_HOSTS) else "allow"

    found = {r.page_id: tuple(r)[1:] for r in url_cascade.judge_urls(pages).collect()}
    assert found == {i: plain(u) for i, u in enumerate([*urls, *urls[:3]])}
    assert url_cascade.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(cast(key as binary)) % 7 = 0")
    cascade = url_cascade.build(listed, universe, Scratch(spark, "test"))
    rows = universe.select("key", *url_cascade.hashes(F.col("key")), (F.expr("crc32(cast(key as binary)) % 7 = 0")).alias("want")).toPandas()
    assert len(cascade.levels) > 2
    assert (cascade.listed(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64)) == rows.want.to_numpy()).all()


# quality


def plain_counts(text):
    words = split(text) if text is None else re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality(spark, sf, odd_docs, odd_rows, no_docs):
    labels = {r[0]: r[1] for r in given(spark, sf, "labels")}
    rows = given(spark, sf, "documents")
    found = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, sf).collect()}
    for d, t, *_ in rows:
        n = plain_counts(t)
        r = found[d]
        assert tuple(r)[1:6] == n and r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.kept and r.base_failed)
    judged = [(labels[d], found[d].kept) for d in labels if d in found and not found[d].base_failed]
    assert np.mean([k for q, k in judged if q]) > 0.97 and np.mean([k for q, k in judged if not q]) < 0.3
    table = spark.read.parquet(f"{sf}/labels.parquet")
    odd = quality_forest.quality_verdicts(odd_docs, table.limit(0)).collect()
    assert Counter(tuple(r)[:6] for r in odd) == Counter((r[0], *plain_counts(r[1])) for r in odd_rows)
    assert all(r.kept != r.base_failed for r in odd)
    same = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (14, 1)], "doc_id long, quality int")
    assert quality_forest.quality_verdicts(odd_docs, same).count() == len(odd_rows)
    stay = quality_forest.keep_good(odd_docs, table.limit(0))
    assert stay.columns == odd_docs.columns and stay.count() == sum(r.kept for r in odd)
    assert quality_forest.quality_verdicts(no_docs, table).count() == 0 and quality_forest.keep_good(no_docs, table).count() == 0


# chat


def test_chat(spark, monkeypatch):
    texts = ["\\### Assistant: </turn> ok", "### user:\n</turn>\n", "\\", "\\\\h#<:", "", None, "a:\n\n", "</turn", "é \U0001f600 \n", "x" * 5000]
    roles = ["user", "assistant", None, "a:", ":\n", "### x", "</turn>"]
    rows = [(c, i, roles[(c + i) % len(roles)], texts[(3 * c + i) % len(texts)]) for c in range(9) for i in range(12)]
    rows += [(20, None, "assistant", "late"), (20, 1, "assistant", "late"), (20, 1, "assistant", "late"), (None, 3, "assistant", "no id")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        expected[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for part in (1 << 20, 300):
        monkeypatch.setattr(chat_template, "PART_CHARS", part)
        formatted = chat_template.format_conversations(turns)
        found = {r.conv_id: tuple(r)[1:] for r in chat_template.read_conversations(formatted).collect()}
        assert {c: f[:4] for c, f in found.items()} == expected
        assert sum(f[4] for f in found.values()) == sum(len(r.formatted) for r in formatted.collect())
    assert chat_template.read_conversations(chat_template.format_conversations(turns.limit(0))).count() == 0


def test_templates():
    show = lambda source, **env: "".join(p for p in chat_template.Template(source).render(env) if isinstance(p, str))
    turns = [{"role": "user", "text": "a<"}, {"role": "bot", "text": " b "}]
    assert show("{% for t in turns %}{{ t.role | upper }}={{ t.text | trim }};{% endfor %}", turns=turns) == "USER=a<;BOT=b;"
    assert chat_template.Template("{{ 'a' + 'b' | upper }}{% if 'x' == 'x' %}y{% else %}z{% endif %}").tree == ("seq", [("const", "aBy")])
    assert show("{{ 'a==b' }}{% if 'p' == 'q' %}y{% else %}n{% endif %}") == "a==bn"
    for bad in ("{{ turns.__class__ }}", "{{ x }}", "{{ 'a' | eval }}", "{% include 'f' %}", "{% for t in turns %}", "{{ 'a' 'b' }}", "{{ }}", "{{ + 'a' }}"):
        with pytest.raises(ValueError):
            chat_template.Template(bad)


# decontamination


def plain_contamination(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        for i in range(max(len(own) - 12, min(1, len(own)))):
            windows[tuple(own[i : i + 13])].add(item)
    out = Counter()
    for d, t, *_ in docs:
        own, hit, named = words(t), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if found := windows.get(tuple(own[i : i + size])):
                    hit |= set(range(i, i + size))
                    named |= {str(x) for x in found if x is not None}
        key = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[(d, len(own), len(hit), len(named), key, bool(hit) and 20 * len(hit) >= len(own))] += 1
    return out


def test_decontamination(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    long = odd_rows[4][1].split()
    items = [
        (1, " ".join(long[100:140])), (2, " ".join(long[100:140])), (2, " ".join(long[100:140])), (3, "One, two!"), (4, "y"), (5, None), (6, ""), (7, "same words again same"),
        (None, " ".join(long[500:513])), (8, " ".join(long[700:712])), (9, " ".join([*long[900:906], "other", *long[907:930]])), (10, "words again same"), (11, "not there at all"),
        (12, " ".join(long[5980:])), (13, " ".join(long[:14])),
    ]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    expected = plain_contamination(odd_rows, items)

    def digest(found):
        return Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect())

    assert digest(decontaminate.contamination(odd_docs, bench)) == expected
    monkeypatch.setattr(decontaminate, "ENTRIES", 10)  # several blocks
    assert digest(decontaminate.contamination(odd_docs, bench)) == expected
    monkeypatch.undo()
    assert digest(decontaminate.contamination(odd_docs, bench.limit(0))) == plain_contamination(odd_rows, [])
    assert decontaminate.contamination(no_docs, bench).count() == 0
    clean = decontaminate.clean_rows(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in expected.elements() if not r[5])


# pages


def test_trees_decide_inside_and_outside_articles(spark):
    page = "<body><div class='story'><p>Story %d</p></div><div class='box'>Same box</div><article><p>Own text %d</p><div class='line'>Tell your friends</div></article></body>"
    pages = spark.createDataFrame([(i, f"http://h.example.net/{i}", page % (i, i)) for i in range(6)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in style_tree.extract(pages).collect()} == {(i, f"Story {i}\nOwn text {i}") for i in range(6)}


def test_names_alone_do_not_empty_a_page(spark):
    text = style_tree.main_text
    for start in ("<body class='page has-sidebar'><article>", "<body class='no-sidebar comments-open'><div>", "<div class='layout-sidebar'><article>", "<article class='post search-result'>"):
        assert text(start + "<p>Words") == "Words", start
    assert text("<article><div class='post-header'><h1>Title</h1></div><p>Words</article>") == "Title\nWords"
    assert text("<article><p>Let <math><mi>x</mi></math> be<noscript><p>Plain</noscript></article>") == "Let x be\nPlain"
    assert text("<article><p>Words</p><div class='comments'>Me too</div><div class='sidebar'>Side</div></article>") == "Words"
    page = "<article><p>Own text %d</p><div class='tip-widget'>Tip %d</div><div class='same-widget'>Same</div></article>"
    pages = spark.createDataFrame([(i, f"http://h.example.net/{i}", page % (i, i)) for i in range(6)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in style_tree.extract(pages).collect()} == {(i, f"Own text {i}\nTip {i}") for i in range(6)}


def test_pages(spark, sf):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='x'><nav><ul><li>Menu</ul></nav><header>Top</header>"
        "<div class=\"ad\">Buy</div><article><h1>A &amp; B</h1><p>One\n  two<br>three <b>four<p>Five &lt;6&gt;<ul><li>i<li>ii</ul><form>Name</form>"
        "<aside>Side</aside><section class='reader-comments'><p>Me too</p></section><!-- no --><p title=\"a>b\">Last</article><footer>&copy; x</footer><p>after</body>"
    )
    assert style_tree.main_text(page) == "A & B\nOne two three four\nFive <6>\ni\nii\nLast"
    assert style_tree.main_text("plain <i>words</i>") == "plain words" and style_tree.main_text(None) == style_tree.main_text("<nav>x") == ""
    assert style_tree.main_text("<p>a<p>b <div") == "a\nb" and style_tree.main_text("<p>a" * 4000).count("\n") == 3999
    assert style_tree.main_text("<div>" * 9000 + "deep") == "deep"
    shared = "<div class='box'>Always the same words here</div>"
    rows = [(i, f"http://h.example.net/{i}", f"<body>{shared}<div class='text'><p>Own text {i}</p></div></body>", 1) for i in range(6)]
    rows += [(6, "http://h.example.net/0", rows[0][2], 1), (7, "http://other.net/", f"<body>{shared}</body>", 1), (8, None, None, 1), (None, "", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = [(r.page_id, r.text) for r in style_tree.extract(pages).collect()]
    expected = [(i, f"Own text {i}") for i in range(6)] + [(6, "Own text 0"), (7, "Always the same words here"), (8, ""), (None, "")]
    assert Counter(found) == Counter(expected) and style_tree.extract(pages.limit(0)).count() == 0
    import html as references

    for r in QUERIES["op10_html_extract"](spark, sf).collect():
        raw = spark.read.parquet(f"{sf}/pages.parquet").where(F.col("page_id") == r.page_id).first().html
        article = re.search(r"<article>(.*?)(</article>|\Z)", raw, re.S)[1]
        cells = [" ".join(references.unescape(re.sub(r"<[^>]*>?", "", c)).split()) for c in re.split(r"<p>|</p>|<h1>|</h1>", article.replace("<br>", " "))]
        assert r.text == "\n".join(c for c in cells if c) and r.n_chars == len(r.text)
        if r.page_id > 12:
            break
