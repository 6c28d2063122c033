from collections import Counter

import pytest

from knotwork.operators import keycounts as k


def _counts(df):
    return {tuple(r)[:-1]: r["n"] for r in df.collect()}


def test_counts_equal_plain_counting(spark):
    rows = [("a", f"k{i % 7}") for i in range(500)] + [("a", "hot")] * 3000 + [("b", "hot")] * 5 + [("b", None)] * 3
    df = spark.createDataFrame(rows, "kind string, key string").repartition(7)
    assert _counts(k.dense_key_counts(df, "kind", "key")) == dict(Counter(rows))


def test_more_keys_than_a_block(spark):
    df = spark.range(3 * k.BLOCK + 5).selectExpr("id % 9000 AS key")
    got = _counts(k.dense_key_counts(df, "key"))
    assert len(got) == 9000 and sum(got.values()) == 3 * k.BLOCK + 5
    assert set(got.values()) == {1, 2}


@pytest.mark.parametrize("held", [2, 30, 200_000])
def test_the_number_of_keys_held_makes_no_difference(spark, monkeypatch, held):
    monkeypatch.setattr(k, "HELD_KEYS", held)
    rows = [("x",)] * 900 + [(f"y{i}",) for i in range(50)] + [(None,)] * 4
    df = spark.createDataFrame(rows, "key string").repartition(5)
    assert _counts(k.dense_key_counts(df, "key")) == dict(Counter(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "key string")
    assert k.dense_key_counts(df, "key").collect() == []


def test_heavy_keys_at_the_edge(spark):
    counts = spark.createDataFrame([("t", "a", 4), ("t", "b", 96), ("t", "c", 0), ("u", "z", 1)], "kind string, key string, n bigint")
    got = {(r["kind"], r["key"]) for r in k.heavy_keys(counts, "kind", 0.04).collect()}
    assert got == {("t", "a"), ("t", "b"), ("u", "z")}


def test_vault_rows_drop_nulls_blanks_and_replays(spark):
    links = spark.createDataFrame([(1, "x", 9), (1, "x", 9), (2, "", 9), (3, None, 9), (4, "  ", 9), (None, "x", 9), (5, "x", 9)], "link_id bigint, target_path string, n int")
    tags = spark.createDataFrame([("p", "t"), ("p", "t"), ("q", "t"), ("p", None), (None, "t")], "note_path string, tag string")
    got = Counter(tuple(r) for r in k.vault_key_rows(links, tags).collect())
    assert got == {("target", "x"): 2, ("tag", "t"): 3}


@pytest.mark.parametrize("n", [1, 2, 50])
def test_any_number_of_splits(spark, n):
    df = spark.range(1000).selectExpr("id % 10 AS key").repartition(n)
    assert set(_counts(k.dense_key_counts(df, "key")).values()) == {100}


def test_few_batches_of_many_keys_in_a_split():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": [f"k{(i * 7 + j) % 50}" for j in range(20)]}) for i in range(9)]
    got = Counter()
    for b in k._count_rows(iter(batches)):
        for key, n in zip(b.column("key").to_pylist(), b.column("w").to_pylist()):
            got[key] += n
    assert got == Counter(x for b in batches for x in b.column("key").to_pylist())


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4)], "key string, n int, __id int")
    assert _counts(k.dense_key_counts(df, "key")) == {("a",): 2}
