"""Operator tests against brute force, invariants and hot groups."""

import json
import random
import tracemalloc
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.operators import (
    chunk_audit as A, citations as Ci, concepts as Co, context as X, corpus as C, hierarchy as H, html as Hm, identity as I, lexical as L, logs as Lg, metrics as M, ordering as O,
    phrases as P, segment as G, similarity as V,
)
from corpusweave.operators.questions import resolve_followups
from corpusweave.sources import readers, writers
from corpusweave.streaming import ingest


# ---------------------------------------------------------------- ordering
def test_value_ranks_agree_across_range_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.5, rng.random()]), rng.random() < 0.4) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, p boolean")
    many = O.value_ranks(df, "v", {"n": F.lit(1), "pos": F.col("p").cast("int")}, ["g"], rows_per_range=100)
    one = O.value_ranks(df, "v", {"n": F.lit(1), "pos": F.col("p").cast("int")}, ["g"])
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(many) == key(one)
    for g in "ab":
        values = sorted(v for x, v, _ in rows if x == g)
        got = {r.value: (r.n_before, r.n_total, r.next_value) for r in many.filter(F.col("g") == g).collect()}
        distinct = sorted(set(values))
        for v, after in zip(distinct, distinct[1:] + [None]):
            assert got[v] == (sum(x < v for x in values), len(values), after)


def test_percentile_definitions(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    ranks = O.value_ranks(df, "v")
    wanted = {"l": ("linear", 0.9), "near": ("nearest", 0.9), "p": ("floor_prev", 0.9), "f": ("floor", 0.5)}
    row = O.percentiles(ranks, wanted).first()
    assert (round(row.l, 6), row.near, row.p, row.f) == (7.6, 10.0, 4.0, 3.0)


def test_carry_and_running_total_over_a_hot_key(spark):
    """One key with most rows is cut into segments and still scans in order."""
    rows = [("hot", i, i if i % 7 == 0 else None) for i in range(2000)] + [("cold", 5, None)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.last for r in O.carry_forward(df, ["k"], F.col("o"), 64, F.col("v"), "last").collect()}
    for k, o, _ in rows:
        assert got[(k, o)] == (None if k == "cold" or o == 0 else (o - 1) // 7 * 7)
    sums = {(r.k, r.o): r.s for r in O.running_total(df, ["k"], F.col("o"), 64, F.lit(1), "s").collect()}
    assert all(sums[("hot", o)] == o + 1 for o in range(2000))


def test_auroc_and_threshold_against_pairs(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    ranks = M.class_ranks(df, "s", F.col("y"))
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    expected = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert M.auroc(ranks).first().auroc == pytest.approx(expected, abs=1e-6)
    for r in M.thresholds(ranks).collect():
        assert r.refused == sum(s < r.t for s in pos) and r.accepted == sum(s >= r.t for s in neg)


def test_intervals_and_sign_test_edges(spark):
    df = spark.createDataFrame([(0, 0), (3, 10)], "k long, n long")
    low, high = M.wilson(F.col("k"), F.col("n"))
    rows = df.select("n", low.alias("l"), high.alias("h"), M.sign_test(F.col("k"), F.col("n")).alias("p")).orderBy("n").collect()
    assert rows[0].l is None and rows[0].p == 1.0
    assert (rows[1].l, rows[1].h) == (0.1078, 0.6032) and rows[1].p == 0.0923


# ---------------------------------------------------------------- vectors
@pytest.mark.parametrize("mode", ["all", "own", "each"])
def test_grid_and_broadcast_layouts_agree(spark, sf, mode):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    skew = F.when(F.col("vec_id") < 300, 0).otherwise(F.col("label"))  # one group holds most rows
    q = e.select(F.col("vec_id").alias("query_id"), skew.alias("group_id"), "embedding")
    v = e.select("vec_id", skew.alias("group_id"), "embedding")
    a = V.nearest(q, v, 3, mode=mode, exclude_self=True)
    b = V.nearest(q, v, 3, mode=mode, exclude_self=True, broadcast_bytes=0, block_rows=64)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("mode", ["all", "own", "each"])
def test_products_hold_no_whole_score_matrix(mode):
    rng = np.random.default_rng(3)
    n = 4000  # all scores at once would be 128 MB
    ids, groups, vectors = np.arange(n), rng.integers(0, 5, n), rng.standard_normal((n, 8))
    tracemalloc.start()
    hits = sum(b.num_rows for b in V._products(ids, groups, vectors, ids, groups, vectors, 3, "cosine", mode, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits == n * 3 * (5 if mode == "each" else 1) and peak < 64e6


# ---------------------------------------------------------------- concepts
@pytest.mark.parametrize("shortlist", [1, 3, 1000])
def test_topics_of_concepts_are_those_of_all_pairs(shortlist, spark):
    dice = random.Random(9)
    words = ["meter", "meters", "reading", "gas", "bill", "billing", "overview", "north", "plant", "lamp"]
    concepts = [(i, 0, " ".join(dice.sample(words, dice.randint(1, 2))), " ".join(dice.sample(words, 1))) for i in range(40)]
    titles = [(i, " ".join(dice.choices(words, k=dice.randint(1, 9)))) for i in range(120)]
    asked = spark.createDataFrame(concepts, "q int, concept_no int, concept string, others string")
    cards = spark.createDataFrame(titles, "topic_id long, title string")
    found = Co.topics_for_concepts(asked, cards, ["q"], shortlist=shortlist).collect()

    plain = {w: r.s for w, r in zip(words, spark.createDataFrame([(w,) for w in words], "w string").select(T.term_set(F.col("w"))[0].alias("s")).collect())}
    terms = lambda text: {plain[w] for w in text.split()}
    first = {}
    for i, title in titles:
        first.setdefault(title, i)
    want = {}
    for q, _, concept, others in concepts:
        cw, ow, ct, rows = set(concept.split()), set(others.split()), terms(concept), []
        for title, i in first.items():
            tw, tt = set(title.split()), terms(title)
            own, shared = len((cw - ow) & tw), len(ct & tt)
            if own or shared:
                score = 10 * own + 8 * (concept in title) + 3 * shared - 15 * bool((ow - cw) & tw) - 10 * ("overview" in title) - len(tt - ct)
                rows.append((-score, i))
        if rows:
            want[q] = (min(rows)[1], -min(rows)[0])
    assert {r.q: (r.topic_id, r.score) for r in found} == want


# ---------------------------------------------------------------- lexical
def test_bm25_fill_and_minmax(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["meter reading", "meter billing", "gas", "water", "wind"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "reading meter meter"), (2, "unknown")], "query_id long, text string")
    scores = L.bm25_scores(docs, queries)
    top = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in L.bm25_topk(scores, docs, queries, 3).collect()}
    assert top[(1, 1)][0] == 0 and top[(1, 2)][0] == 1 and top[(1, 3)] == (2, 0.0)
    assert [top[(2, k)][0] for k in (1, 2, 3)] == [0, 1, 2]
    norm = {r.doc_id: r.norm for r in L.minmax(scores, 5).collect()}
    assert norm[0] == 1.0 and 0 < norm[1] < 1


def test_hybrid_blocks_agree(spark, sf):
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lex = L.minmax(L.bm25_scores(d, q), d.count())
    args = (lex, L.text_vectors(q, "query_id"), L.text_vectors(d, "doc_id"), (0.5,), 4)
    assert sorted(map(tuple, L.hybrid_topk(*args).collect())) == sorted(map(tuple, L.hybrid_topk(*args, query_block=15).collect()))


def test_phrases_match_substrings_inside_words(spark):
    docs = spark.createDataFrame([(1, "xopen meter readings now"), (2, "open\nmeter reading"), (3, "open meter")], "doc_id long, text string")
    phrases = spark.createDataFrame([(9, p) for p in ("open meter", "meter reading", "open meter read")], "query_id long, phrase string")
    got = {tuple(r) for r in P.phrase_pages(phrases, docs).collect()}
    assert got == {("open meter", 1), ("open meter", 3), ("meter reading", 1), ("meter reading", 2), ("open meter read", 1)}


@pytest.mark.parametrize("pool_size,extra", [(5, 3), (3, 1), (3, 4), (4, 0)])
def test_injection_follows_the_sequential_rule(spark, pool_size, extra, size=5):
    pool = [100 + i for i in range(pool_size)]
    new = [200 + i for i in range(extra)]
    expected = list(pool)
    for x in new:
        if len(expected) >= size:
            expected.pop()
        expected.append(x)
    p = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(pool)], "query_id long, doc_id long, rank int")
    m = spark.createDataFrame([(1, d) for d in new], "query_id long, doc_id long").withColumn(
        "ord", F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("no"), F.col("doc_id").alias("id"))
    )
    got = [r.doc_id for r in P.inject(p, m, size).orderBy("rank").collect()]
    assert got == expected


def test_verbatim_inside_words_and_short_quotes(spark):
    docs = spark.createDataFrame([(1, "pre alphaxx one two three four five sixyy end"), (2, "gas bill")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "xx one two three four five six"), (2, "as bil")], "query_id long, text string")
    assert {tuple(r) for r in P.verbatim_pages(q, docs).collect()} == {(1, 1), (2, 2)}


# ---------------------------------------------------------------- segmentation and html
def test_bounded_chunks_are_slices_and_cover_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = G.section_chunks(docs, "bounded")
    bad = chunks.filter((F.length("chunk_text") > rules.BOUNDED_CHUNK_CHARS) & ~F.col("exceeds_max"))
    assert bad.count() == 0
    audit = A.offset_audit(chunks, docs, "doc_id", "text").agg(*[F.sum(c).alias(c) for c in ("lost_chars", "gap_characters", "offset_overlaps", "slice_mismatches")]).first()
    assert tuple(audit) == (0, 0, 0, 0)


def test_structured_chunks(spark):
    text = "Title\nPurpose\n" + "A sentence here. " * 30 + "\nThe following:\n- item one\n- item two\n" + "word " * 400
    chunks = G.structured_chunks(text.strip(), "Title", limit=300)
    assert all(len(c["text"]) <= 341 for c in chunks)
    assert chunks[0]["text"].startswith("Title\nPurpose\n")
    assert any("The following:\n- item one" in c["text"] for c in chunks)
    assert chunks[1]["heading_prefixed"] and chunks[1]["text"].startswith("Purpose\n")


def test_heading_chunks_stay_in_budget(spark):
    blocks = [{"block_index": i, "kind": "paragraph", "text": f"Sentence {i} " * 20 + "end.", "heading_path": ["T", "S" + str(i // 6)]} for i in range(18)]
    chunks = G.heading_chunks("T", blocks)
    assert all(G._n(c["header"]) + G._n(c["text"]) + 2 <= rules.PAGE_CHUNK_MAX for c in chunks)
    assert {tuple(c["heading_path"]) for c in chunks} == {("T", "S0"), ("T", "S1"), ("T", "S2")}


def test_html_blocks_tables_lists_notes():
    page = (
        "<html><head><title>Doc</title></head><body><nav>skip</nav><h1>Top</h1><p>Intro <b>bold</b></p><h2>Part</h2>"
        "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul><table><caption>Cap</caption><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td></tr></table>"
        "<aside class='warning'>hot</aside><pre>code\nline</pre><dl><dt>t</dt><dd>d</dd></dl><div class='footer'>x</div></body></html>"
    )
    title, html_title, blocks, headings, text, dropped = Hm.extract(page)
    assert (title, html_title, headings, dropped) == ("Top", "Doc", ["Top", "Part"], 2)
    kinds = [(b["kind"], b["text"]) for b in blocks]
    assert kinds == [
        ("paragraph", "Intro bold"), ("list", "- a\n  1. b\n- c"), ("caption", "Cap"), ("table", "H1: 1; H2: 2\nx"), ("note", "Warning: hot"),
        ("code", "code\nline"), ("definitions", "t: d"),
    ]
    assert text.splitlines()[:3] == ["Top", "Intro bold", "Part"]


def test_clean_joins_and_drops(spark):
    long_line = "This is a line of more than thirty characters."
    raw = f"Title\nTitle\n{long_line}\n{long_line}\nThe value of\nthe meter\n(see\nbelow)\nNote\nend"
    row = C.clean_documents(spark.createDataFrame([(raw,)], "text string")).first()
    assert row.clean_text == f"Title\n{long_line}\nThe value of the meter\n(see below)\nNote\nend"
    assert (row.title_duplicates_removed, row.duplicate_lines_removed) == (1, 1)


def test_dedup_with_one_hot_hash(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", i % 5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, content_hash string, role_rank int")
    marked = C.mark_duplicates(docs, "doc_id", "content_hash", F.lit(False), [F.col("role_rank")]).collect()
    best = min((r, i) for i, h, r in rows if h == "same")[1]
    assert {m.canonical_id for m in marked if m.content_hash == "same"} == {best}
    assert sum(m.status == "OK" for m in marked) == 201


# ---------------------------------------------------------------- context and citations
def test_context_budget_skips_and_continues(spark):
    big, small = "w " * 690, "s " * 5
    rows = [(1, 1, 11, 1, 0, "a", "x " * 30), (1, 2, 12, 1, 1, "a", big), (1, 3, 13, 2, 0, "b", small), (1, 4, 14, 2, 1, "b", small)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, page long, chunk_index int, title string, text string")
    got = {r.chunk_id: r.decision for r in X.select_chunks(hits).collect()}
    assert got == {11: "selected", 12: "budget", 13: "selected", 14: "duplicate"}


def test_overlap_strip_and_promotion(spark):
    df = spark.createDataFrame([("b. end\nnew", "a. b. end", ), ("only", None)], "t string, p string")
    assert [r.o for r in df.select(X.strip_overlap(F.col("t"), F.col("p")).alias("o")).collect()] == ["new", "only"]
    hits = spark.createDataFrame([(1, 1, "n"), (1, 2, "n"), (1, 3, "y"), (1, 4, "n")], "query_id long, rank int, t string")
    assert [r.promoted_rank for r in X.promote(hits, F.col("t") == "y").orderBy("rank").collect()] == [2, 3, 1, 4]


def test_citation_repair_rules(spark):
    context = spark.createDataFrame([(1, "S1", "Meters are read monthly."), (1, "S2", "Bills are created from meter readings each month.")], "id long, marker string, text string")
    answers = spark.createDataFrame(
        [(1, "Meters are read monthly. [S2]\nBills created from meter readings. [S1]\nBills are created from meter readings each month. [S2]")], "id long, answer string")
    lines = Ci.answer_lines(answers, ["id"], "answer")
    got = {r.line_no: (r.rule, r.to_markers) for r in Ci.repair(lines, context, ["id"]).collect()}
    assert got == {0: ("A_verbatim", "S1"), 1: ("B_support", "S1/S2"), 2: ("none", "S2")}
    bad = {r.line_no: r.violations for r in Ci.grounding(lines, context, ["id"]).collect()}
    assert bad[0] == [] and bad[2] == []
    chain = {r.line_no: r.errors for r in Ci.support_chain(lines, context, ["id"]).collect()}
    assert chain == {0: "NO_VERBATIM_SOURCE_MATCH", 1: "NO_VERBATIM_SOURCE_MATCH", 2: ""}


def test_followups_over_a_long_conversation(spark):
    rows = [(1, 0, "user", "What is billing?")] + [(1, i, "user", "tell me more") for i in range(2, 40, 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = resolve_followups(turns, width=5).filter("turn > 0").select("anchor", "query").distinct().collect()
    assert [tuple(r) for r in got] == [("What is billing?", "What is billing? explain this more")]


# ---------------------------------------------------------------- logs
@pytest.mark.parametrize("limit,seconds,spread", [(3, 10, 60), (1, 5, 40), (5, 30, 100)])
def test_rate_limit_equals_the_sequential_rule(spark, limit, seconds, spread):
    rng = random.Random(limit)
    rows = [(u, rng.randrange(spread * (1 if i % 3 else 20))) for u in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = {(r.user_id, r.us // 1_000_000): r.accepted for r in Lg.rate_limit(df, "user_id", "ts", limit, seconds).collect()}
    for u in (1, 2):
        recent, expected = deque(), Counter()
        for s in sorted(s for x, s in rows if x == u):
            while recent and recent[0] <= s - seconds:
                recent.popleft()
            if len(recent) < limit:
                recent.append(s)
                expected[s] += 1
            else:
                expected[s] += 0
        assert {s: a for (x, s), a in got.items() if x == u} == dict(expected)


def test_log_summary_of_nothing_and_of_errors(spark):
    schema = "route string, status string, http_status int, error string, latency_ms double"
    empty = Lg.log_summary(spark.createDataFrame([], schema)).first()
    assert empty.requests == 0 and empty.p50_latency_ms == 0.0
    rows = [("a", "answered", 200, None, 10.0), ("a", "out_of_scope", None, None, 20.0), ("b", "answered", 500, None, None), ("b", "answered", 200, "x", 30.0)]
    r = Lg.log_summary(spark.createDataFrame(rows, schema)).first()
    assert (r.requests, r.errors, r.abstention_rate, r.p50_latency_ms) == (4, 2, 0.5, 20.0)


# ---------------------------------------------------------------- hierarchy, sources, sinks
def test_toc_nodes(spark):
    toc = {"g": "G", "toc": [{"t": "A", "u": "a.html", "c": [{"t": "Group", "u": "", "c": [{"t": "B", "u": "b-12.html", "c": []}]}]}]}
    schema = "g string, toc array<struct<t:string,u:string,c:array<struct<t:string,u:string,c:array<struct<t:string,u:string>>>>>>"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(toc)]))
    rows = {r.page_id: (r.parent, r.path, r.depth, r.alias) for r in H.toc_nodes(df, "g", "toc").collect()}
    assert rows == {"a": (None, ["A"], 0, ""), "b": ("a.html", ["A", "Group", "B"], 2, "-12")}


def test_readers(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿https://a.example/x\n# note\n\n\"https://b.example/y\"".encode("utf-16"))
    assert [r.url for r in readers.read_url_lines(spark, str(tmp_path / "u.txt")).orderBy("line_no").collect()] == ["https://a.example/x", "https://b.example/y"]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    assert sorted(r.k for r in readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()) == [1, 2]
    card = spark.createDataFrame([("Title: Meter Reading\nCategory: Devices\n",)], "t string")
    row = readers.card_fields(card, "t", {"title": "Title:", "category": "Category:", "url": "URL:"}).first()
    assert (row.title, row.category, row.missing_fields) == ("Meter Reading", "Devices", ["url"])


def test_ledger_and_idempotent_append(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    work = spark.createDataFrame([("c", "q1", "real", 1), ("c", "q2", "real", 2)], "config string, id string, mode string, v int")
    ledger = writers.ResultLedger(spark, folder, {"set": "x"})
    ledger.append(work.filter("id = 'q1'"))
    resumed = writers.ResultLedger(spark, folder, {"set": "x"})
    assert [r.id for r in resumed.pending(work).collect()] == ["q2"]
    resumed.append(work)
    resumed.append(work)
    assert spark.read.parquet(f"{folder}/rows").count() == 2
    with pytest.raises(ValueError):
        writers.ResultLedger(spark, folder, {"set": "y"})
    store = str(tmp_path / "store")
    for _ in range(2):
        ingest.append_new(work, store, ["id"])
    assert spark.read.parquet(store).count() == 2


def test_embedding_records_and_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([Row(chunk_id="g/p#0000", text="x", topic_ids=[1, 2], toc_path=["A", "B"], guide_id="g")])
    rec = writers.embedding_records(chunks, "chunk_id", F.col("text"), ["guide_id"], {"topic_ids": ",", "toc_path": " > "})
    assert rec.first().metadata.asDict() == {"guide_id": "g", "topic_ids": "1,2", "toc_path": "A > B"}
    writers.write_json_lines(rec, str(tmp_path / "j"), ["id"])
    writers.write_pages(chunks, str(tmp_path / "p"))
    writers.append_events(chunks, str(tmp_path / "e"))
    writers.write_inventory(chunks.select("chunk_id"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        writers.write_vectors(chunks, str(tmp_path / "v"), expected=2)


def test_group_limit_is_pushed_below_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    plan = O.top_k(df, ["user_id"], [F.desc("value")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_rate_limit_takes_client_addresses(spark):
    rows = [("10.0.0.12", f"2024-01-01 00:00:{s:02d}") for s in range(0, 40)] + [("fe80::1", "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "client string, ts string").withColumn("ts", F.to_timestamp("ts"))
    admitted = Lg.rate_limit(events, "client", "ts", limit=30, seconds=60)
    totals = {r.client: (r.a, r.r) for r in admitted.groupBy("client").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()}
    assert totals == {"10.0.0.12": (30, 10), "fe80::1": (1, 0)}


def test_identity_ladder_keeps_one_row_a_card(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    cards = make([(1, "g", "p")], "source_id int, guide_id string, page_id string")
    toc, verified = make([], "guide_id string, page_id string"), make([], "guide_id string")
    moved = make([], "source_id int, resolved_guide_id string")
    seen = make([("p", "g"), ("p", "h"), ("p", "i")], "page_id string, other_guide string")
    found = I.identity_ladder(cards, toc, verified, moved, seen).collect()
    assert [(r.source_id, r.status) for r in found] == [(1, "conflicting_identity")]


def test_written_turns_and_all_lines(spark):
    from types import SimpleNamespace

    from corpusweave.plans import question_plans as plans

    said = [(1, 1, "user", "How do I create a purchase order?"), (1, 2, "assistant", "So."), (1, 3, "user", "Tell me more"), (2, 1, "user", "Tell me more")]
    t = SimpleNamespace(
        conversations=spark.createDataFrame(said, "conv_id long, turn long, role string, text string"),
        benchmark=spark.createDataFrame([(2, "What is a ledger?")], "item_id long, text string"),
        documents=spark.createDataFrame([(1, "red green blue stones\nnothing here\nred green blue stones again"), (2, "one line")], "doc_id long, text string"),
    )
    found = {(r.conv_id, r.turn): r for r in plans.written_followup_resolution(t).collect()}
    assert found[1, 3].category == "elaborate" and found[1, 3].anchor == said[0][3] and found[2, 1].anchor is None
    assert {(r.conv_id, r.turn) for r in plans.written_followup_categories(t).collect() if r.category} == {(1, 3), (2, 1)}
    assert {(r.doc_id, r.line, r.matches) for r in plans.title_subsequence(t).collect()} == {(1, 2, False), (1, 3, True), (2, None, False)}
