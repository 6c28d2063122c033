import random
from datetime import datetime, timedelta

import pytest

from knotwork.operators import orphans as o

T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def brute(refs, lives):
    out = set()
    for table, key, p, t in refs:
        own = [x for x in lives if x[0] == p]
        real = [x for x in own if x[1]]
        if any(b <= t and (e is None or t < e) for _, _, b, e in real):
            continue
        out.add((table, key, "missing" if not own else "ghost" if not real else "late" if all(b > t for _, _, b, _ in real) else "deleted"))
    return out


def test_same_path():
    assert o.same_path("./A\\B.md") == o.same_path("/a/b.MD") == "a/b.md"
    assert o.same_path("Café.md") == o.same_path("CAFÉ.md")
    assert o.same_path("././x") == "./x" and o.same_path(None) is None and o.same_path("") == ""


def _inputs(spark, refs, lives):
    r = spark.createDataFrame([(*x, x[3] + timedelta(days=random.Random(x[1]).randrange(40))) for x in refs], "ref_table string, ref_key string, p string, t timestamp_ntz, arrived timestamp_ntz")
    l_ = spark.createDataFrame([(p, hash((p, real, b, e)) % 10**12, real, b, e) for p, real, b, e in lives], o.LIFE)
    return r, l_.select("p", "real", "b", "e", "life")


@pytest.mark.parametrize("batches", [1, 4])
def test_replay_equals_brute_force(spark, batches):
    rng = random.Random(3)
    lives = []
    for k in range(30):
        at = rng.randrange(100)
        for _ in range(rng.randrange(3)):
            end = at + rng.randrange(1, 60)
            open_ = rng.random() < 0.3
            lives.append((f"n{k}", rng.random() < 0.8, day(at), None if open_ else day(end)))
            at = end + rng.randrange(1, 30)
    refs = [("t", str(i), "n1" if i % 3 == 0 else f"n{rng.randrange(35)}", day(rng.randrange(200))) for i in range(300)]
    r, l_ = _inputs(spark, refs, lives)
    state = o.replay(spark, r, l_, batches)
    assert {(x["ref_table"], x["ref_key"], x["reason"]) for x in state.pending().collect()} == brute(refs, set(lives))
    counted = {(x["ref_table"], x["ref_month"], x["reason"]): x["n"] for x in state.snapshot().collect()}
    assert counted == {tuple(x)[:3]: x["count"] for x in o.orphans(state).groupBy("ref_table", "ref_month", "reason").count().collect()}
    assert {x["batch"] for x in state.snapshots().collect()} == set(range(batches))
    before = sorted(map(tuple, state.refs().collect()), key=str)
    state.compact()
    again = o.OrphanState(spark, state.folder)
    assert sorted(map(tuple, again.refs().collect()), key=str) == before and again.batch == batches - 1


def test_waiting_is_resolved_and_reopened(spark):
    life = lambda *x: spark.createDataFrame([x], o.LIFE)
    refs = spark.createDataFrame([("t", "1", "a", day(10)), ("t", "2", "a", day(30))], "ref_table string, ref_key string, p string, t timestamp_ntz")
    none_l, none_r = spark.createDataFrame([], o.LIFE), refs.where("false")
    reasons = lambda s: {x["ref_key"]: x["reason"] for x in s.refs().collect()}
    s = o.apply_batch(o.OrphanState.empty(spark), refs, none_l)
    assert reasons(s) == {"1": "missing", "2": "missing"}
    s = o.apply_batch(s, none_r, life("a", 7, True, day(5), None))
    assert reasons(s) == {"1": None, "2": None}
    s = o.apply_batch(s, refs, life("a", 7, True, day(5), day(20)))  # redelivered references change nothing
    assert reasons(s) == {"1": None, "2": "deleted"}


def test_dirty_references(spark):
    links = spark.createDataFrame([(1, "x", day(1), day(2)), (1, "x", day(1), day(9)), (2, "", day(1), None), (3, None, day(1), None), (4, " ", day(1), None), (5, "y", None, None)], "link_id bigint, target_path string, extracted_at timestamp_ntz, loaded_at timestamp_ntz")
    chunks = spark.createDataFrame([("c", "./X", day(3)), (None, "x", day(3))], "chunk_id string, note_path string, indexed_at timestamp_ntz")
    got = {(r["ref_table"], r["ref_key"], r["p"], r["arrived"]) for r in o.vault_references(links, chunks).collect()}
    assert got == {("resolved_links", "1", "x", day(2)), ("chunks", "c", "x", day(3))}


def test_empty_tables(spark):
    r, l_ = _inputs(spark, [], [])
    assert o.orphans(o.replay(spark, r, l_)).collect() == []


def test_lookup_join_salts_hot_keys(spark):
    from knotwork.operators.joins import lookup_join

    left = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE concat('k', id) END AS key", "id")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "key string, v int")
    small, big = (lookup_join(left, right, "key", size=s) for s in ((3, 10), (1 << 40, 1 << 40)))
    assert sorted(map(tuple, small.select("id", "v").collect()), key=str) == sorted(map(tuple, big.select("id", "v").collect()), key=str)
    assert big.where("v = 1").count() == 667


def test_a_batch_that_failed_is_repeated(spark, monkeypatch):
    refs = spark.createDataFrame([("t", "1", "a", day(10))], "ref_table string, ref_key string, p string, t timestamp_ntz")
    lives = spark.createDataFrame([("a", 7, True, day(5), None)], o.LIFE)
    s = o.apply_batch(o.OrphanState.empty(spark), refs, lives.where("false"))
    with monkeypatch.context() as m:
        m.setattr(o, "probe", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            o.apply_batch(s, refs.where("false"), lives)
    s = o.OrphanState(spark, s.folder)
    assert s.batch == 0 and s.pending().count() == 1
    s = o.apply_batch(s, refs.where("false"), lives, 1)
    assert s.pending().count() == 0 and s.snapshot().collect() == []


def test_only_what_changes_is_written(spark):
    refs = spark.createDataFrame([("t", str(i), f"n{i}", day(10)) for i in range(200)], "ref_table string, ref_key string, p string, t timestamp_ntz")
    lives = spark.createDataFrame([("n3", 7, True, day(5), None)], o.LIFE)
    s = o.apply_batch(o.OrphanState.empty(spark), refs, lives.where("false"))
    s = o.apply_batch(s, refs, lives)
    assert {(r["batch"], r["count"]) for r in s.log("refs", o.REF).groupBy("batch").count().collect()} == {(0, 200), (1, 1)}


def test_two_writers(spark):
    refs = spark.createDataFrame([("t", "1", "a", day(10))], "ref_table string, ref_key string, p string, t timestamp_ntz")
    none = spark.createDataFrame([], o.LIFE)
    one = o.OrphanState.empty(spark)
    two = o.OrphanState(spark, one.folder)
    o.apply_batch(one, refs, none)
    with pytest.raises(RuntimeError):
        o.apply_batch(two, refs, none)
