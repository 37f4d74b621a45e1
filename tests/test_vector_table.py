"""Upserts rewrite only the files whose key ranges they touch."""

import pytest

from corpusweave.sources.vector_table import VectorTable


def rows(spark, items, key="long"):
    return spark.createDataFrame(list(items), f"vec_id {key}, value int")


def content(store, version=None):
    return dict(map(tuple, store.read(version).select("vec_id", "value").collect()))


def test_insert_update_replay(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path), rows_per_file=10)
    state = {i * 10: i for i in range(100)}
    assert store.upsert(rows(spark, state.items()), "a") == 1
    before = store.files()
    assert len(before) >= 8 and sum(f.rows for f in before) == 100 and content(store) == state
    change = {100: -1, 101: -2, 990: -3}  # an update and an insert in one range, an update in the last one
    assert store.upsert(rows(spark, change.items()), "b") == 2
    assert content(store) == state | change and content(store, 1) == state
    after = store.files()
    touched = [f for f in before if any(f.low <= k <= f.high for k in change)]
    assert {f.file for f in before} - {f.file for f in after} == {f.file for f in touched} and len(touched) <= 2
    assert all(a.high < b.low for a, b in zip(after, after[1:]))  # ranges stay disjoint
    assert store.upsert(rows(spark, [(100, 77)]), "b") == 2 and content(store) == state | change  # a batch that is in stays as it is
    assert [h.rows for h in store.heads()] == [100, 101]


def test_gaps_edges_and_repeats(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path), rows_per_file=4)
    state = {}
    for n, keys in enumerate(([50, 60, 70, 80, 90, 100, 110, 120], [1, 2, 3], [200, 65, 66, 67, 68, 69], [], [55, 115])):
        change = {k: n for k in keys}
        state |= change
        store.upsert(rows(spark, change.items()))
        assert content(store) == state
        files = store.files()
        assert all(a.high < b.low for a, b in zip(files, files[1:]))
    version = store.upsert(spark.createDataFrame([(1, 5), (1, 9), (1, 7)], "vec_id long, value int"), newest="value")
    assert content(store) == state | {1: 9} and version == len(store.heads()) == 5
    with pytest.raises(ValueError):
        store.upsert(rows(spark, [(None, 1)]))


def test_string_keys_and_first_read(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path), rows_per_file=3)
    with pytest.raises(ValueError):
        store.read()
    names = ["chunk_1", "chunk_10", "chunk_2", "é", "z", "", "Ω", "\U0001f600", "￮"]
    store.upsert(rows(spark, [(n, 1) for n in names], "string"))
    store.upsert(rows(spark, [("é", 2), ("y", 3), ("￯", 4)], "string"))
    assert content(store) == dict.fromkeys(names, 1) | {"é": 2, "y": 3, "￯": 4}


def test_what_a_broken_writer_leaves_is_not_read(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path), rows_per_file=5)
    store.upsert(rows(spark, [(1, 1), (2, 2)]))
    rows(spark, [(9, 9)]).write.parquet(f"{tmp_path}/data/0000000002-half")  # data without a head
    assert content(store) == {1: 1, 2: 2} and len(store.heads()) == 1
