"""Rate limits and conversation stores: streams and distributed counts against plain replays."""

import datetime as dt
import random
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import reuse
from corpusweave.plans import load_all
from corpusweave.plans.registry import CATALOG
from corpusweave.streaming import ingest, rate_limit

load_all()


# rate limit


def replay(instants, limit, width):
    recent, out = [], []
    for us, n in instants:
        recent = [r for r in recent if r > us - width]
        taken = min(n, max(0, limit - len(recent)))
        recent += [us] * taken
        out.append((us, n, taken))
    return out


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_decisions(limit):
    dice = random.Random(limit)
    instants = sorted({dice.randint(0, 500): dice.randint(1, 7) for _ in range(80)}.items())
    for cut in (0, 13, 80):  # whatever was decided before, the rest follows
        recent = []
        first = rate_limit.decide(recent, instants[:cut], limit, 50)
        assert len(recent) <= limit
        assert first + rate_limit.decide(recent, instants[cut:], limit, 50) == replay(instants, limit, 50)


def test_stream_in_batches(spark, tmp_path):
    """Files that arrive one by one, out of order within the lateness and one of them twice, give the decisions of the whole table."""
    dice, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, dice.choice([1, 2, 3, None]), start + dt.timedelta(seconds=dice.randint(0, 600))) for i in range(300)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=dice.randint(0, 60)))
    schema = "event_id long, user_id long, ts timestamp"
    source = str(tmp_path / "source")
    parts = [rows[k : k + 60] for k in range(0, 300, 60)]
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    limited = rate_limit.stream_rate_limit(stream, 3, 30, "2 minutes")
    closing = [(-1, -1, start + dt.timedelta(days=3))]
    for part in (*parts[:3], parts[2], *parts[3:], closing):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        found = ingest.drain(limited, str(tmp_path / "out"), "limited")
    got = {}
    for r in found.where("user_id is null or user_id >= 0").collect():
        got.setdefault(r.user_id, []).append((r.us, r.requests, r.accepted))
    for user in (1, 2, 3, None):
        counts = {}
        for _, own, ts in rows:
            if own == user:
                us = int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
                counts[us] = counts.get(us, 0) + 1
        assert sorted(got[user]) == replay(sorted(counts.items()), 3, 30_000_000)
    again = ingest.drain(limited, str(tmp_path / "out"), "limited")  # nothing new: nothing changes
    assert again.count() == found.count()


# conversation store


@pytest.mark.parametrize("top", [2, 30, 10**6])
def test_smaller_before(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 3, 17, 200):
        values = rng.integers(0, top, n)
        assert reuse.smaller_before(values).tolist() == [int((values[:i] < values[i]).sum()) for i in range(n)]


def store_of(touches, capacity, ttl):
    """A plain store: least recently touched conversations leave first, idle ones when they are next asked for."""
    last, order, out = {}, OrderedDict(), []
    for us, user in touches:
        held = user in order
        if user not in last:
            outcome = "new"
        elif us - last[user] > ttl * 1_000_000:
            outcome = "expired"
        else:
            outcome = "kept" if held else "evicted"
        order.pop(user, None)
        order[user] = last[user] = us
        if len(order) > capacity:
            order.popitem(last=False)
        out.append((user, us, outcome))
    return out


@pytest.mark.parametrize(("users", "capacity", "range_rows"), [(5, 1, 7), (40, 12, 16), (40, 12, 1 << 16), (3, 5, 10)])
def test_evictions(spark, users, capacity, range_rows):
    dice = random.Random(users)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    touches = set()
    for _ in range(400):
        user = 0 if dice.random() < 0.3 else dice.randint(0, users) if dice.random() < 0.97 else None  # one user has a third of all touches
        touches.add((start + dt.timedelta(seconds=dice.randint(0, 300)), user))
    table = spark.createDataFrame([(u, t) for t, u in touches] * 2, "user_id long, ts timestamp")  # repeated rows are one touch
    expected = store_of(sorted(((int(t.timestamp()) * 1_000_000, u) for t, u in touches), key=lambda x: (x[0], x[1] is None, x[1] or 0)), capacity, 25)
    found = reuse.evictions(table, "user_id", "ts", capacity, 25, range_rows).select("user_id", "us", "outcome")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_no_touches(spark):
    empty = spark.createDataFrame([], "user_id long, ts timestamp")
    assert reuse.evictions(empty, "user_id", "ts", 3).count() == 0
    assert reuse.reuse_distances(empty.select(F.col("user_id"), F.col("ts")), "user_id", "ts").columns == ["user_id", "us", "pos", "before_us", "distance"]


# tables as streams


@pytest.mark.parametrize("files", [1, 3])
def test_ingest_of_a_table_in_one_file_or_a_folder(files, spark, tmp_path):
    """A large table is a folder of files; a small one may be a single file of the same name."""
    docs = spark.range(30).selectExpr("id as doc_id", "'en' as lang", "'s1' as source", "concat('Text ', id, '.') as text")
    if files > 1:
        docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    docs.limit(1).write.parquet(f"{tmp_path}/documents.parquet.old")
    assert [tuple(r) for r in CATALOG["stream_ingest"](spark, str(tmp_path)).collect()] == [(30, 30)]


def test_batches_for_python_are_bounded_in_bytes(spark, tmp_path):
    """A session that says nothing gives Python ten thousand texts at a time, however long."""
    own = spark.newSession()
    own.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    own.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('x ', 2000) as text").write.parquet(f"{tmp_path}/documents.parquet")
    assert CATALOG["clean_documents"](own, str(tmp_path)).count() == 3000

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = own.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1).mapInArrow(sizes, "n long")
    assert max(r.n for r in rows.collect()) < 8 << 20
