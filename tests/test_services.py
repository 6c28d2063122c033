import json
import os
from datetime import datetime, timedelta

import pytest

from knotwork.config import Settings
from knotwork.operators import cache, evalir, limiter
from knotwork.streaming import sync

T0 = datetime(2024, 1, 1)


def test_cache_rules():
    now = [0.0]
    c = cache.QueryCache(settings=Settings(cache_max_entries=5, cache_ttl_s=10), clock=lambda: now[0])
    for i in range(8):
        now[0] += 0.1
        c.put(f"k{i}", "q", [{"x": i}], [f"n{i}", "all"])
    assert c.stats()["entries"] <= 5 and c.get("k7") == [{"x": 7}] and c.get("k0") is None
    c.put("empty", "q", [], ["n"])
    assert c.get("empty") is None
    assert c.evict_for(["n7"]) == 1 and c.get("k7") is None
    now[0] += 20
    assert c.get("k6") is None
    assert c.stats()["hits"] == 1 and c.clear() >= 0 and c.stats()["misses"] == 0


def test_lru_victims(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i)) for i in range(13)], "cache_key string, last_accessed_at double")
    assert sorted(r[0] for r in cache.lru_victims(rows, 10).collect()) == ["k0", "k1", "k2", "k3"]
    assert cache.lru_victims(rows, 13).count() == 0 and cache.surplus(13, 10) == 4


def test_dependents(spark):
    needs = spark.createDataFrame([("a", "n"), ("a", "m"), ("b", "m")], "cache_key string, note_path string")
    assert [r[0] for r in cache.dependents(needs, spark.createDataFrame([("n",), ("n",)], "note_path string")).collect()] == ["a"]


def test_limiter_waits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    by_calls = limiter.Limiter(2, 10**6, lambda: now[0], sleep)
    for _ in range(3):
        by_calls.acquire(1)
    assert len(slept) == 1 and 60 < slept[0] < 60.2
    now[0], by_tokens = 0.0, limiter.Limiter(100, 500, lambda: now[0], sleep)
    by_tokens.acquire(400)
    by_tokens.acquire(200)
    assert len(slept) == 2


def test_retry_after():
    assert limiter.retry_after({"Retry-After": "3"}) == 3 and limiter.retry_after({"retry-after-ms": "1500"}) == 1.5
    assert limiter.retry_after({}, "Please try again in 2.5s.") == 2.5 and limiter.retry_after({}, "no") is None
    assert limiter.backoff(9) == 60 and limiter.backoff(0, 3.0) == 3.2


def test_audit(spark):
    calls = spark.createDataFrame([(1, i, T0 + timedelta(seconds=s), 300) for i, s in enumerate((0, 30, 61, 200))], "user_id int, call_id int, ts timestamp_ntz, tokens int")
    got = {r["call_id"]: (r["in_minute"], r["kept"]) for r in limiter.audit(calls, 5, 500).collect()}
    assert got == {0: (1, True), 1: (2, False), 2: (2, False), 3: (1, True)}


def test_measures(spark):
    res = [("q1", "x", 1), ("q1", "A", 2), ("q2", "a", 1), ("q2", "x", 2), ("q2", "b", 3), ("q3", "x", 1)]
    exp = [("q1", "/a"), ("q2", "a"), ("q2", "B"), ("q3", "z"), ("q3", "y"), ("q4", "a")]
    m = evalir.per_query(spark.createDataFrame(res, "query_id string, note string, rank int"), spark.createDataFrame(exp, "query_id string, note string"))
    got = {r["query_id"]: r for r in m.collect()}
    assert (got["q1"]["rr"], got["q1"]["precision"], got["q1"]["recall"]) == (0.5, 0.5, 1.0)
    assert got["q2"]["ap"] == 0.8333 and got["q3"]["first_hit_rank"] == 0 and got["q4"]["precision"] == 0.0
    a = evalir.aggregate(m).first()
    assert (a["n_queries"], a["mrr"], a["hits_at_1"], a["hits_at_3"], a["multi_hop_queries"], a["multi_hop_completeness"]) == (4, 0.375, 0.25, 0.5, 2, 0.5)
    assert evalir.passes({"mrr": 0.8, "recall": 0.9}) and not evalir.passes({"mrr": 0.79, "recall": 1})
    d = evalir.dedupe(spark.createDataFrame([("q", "A", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, note string, rank int"))
    assert [(r["note"], r["rank"]) for r in d.orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_debounce_batch(spark):
    ms = lambda *xs: [("n", T0 + timedelta(milliseconds=x)) for x in xs]
    got = sync.debounce(spark.createDataFrame(ms(0, 1000, 2400, 4000), "path string, ts timestamp")).orderBy("first_at").collect()
    assert [r["n_saves"] for r in got] == [3, 1]


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, at in enumerate((0, 1, 60, 200)):
        (src / f"{k}.json").write_text(json.dumps({"path": "n", "ts": (T0 + timedelta(seconds=at)).isoformat()}))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of their times
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    q = sync.debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n_saves"] for r in spark.table("bursts").collect()) == [1, 2]


def test_manifests(spark, tmp_path):
    folder, stored, seen = tmp_path / "m", {"rows": []}, []
    folder.mkdir()

    def current():
        return spark.createDataFrame(stored["rows"], "path string, hash string, is_unresolved boolean")

    def apply(status, number):
        rows = {r["path"]: r["status"] for r in status.collect()}
        seen.append(rows)
        stored["rows"] = [(p, "h2" if s == "modified" else "h1", False) for p, s in rows.items() if s != "deleted"]

    def poll(k, files):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"path": p, "mtime": 1.0, "hash": h}) for p, h in files))
        sync.follow_manifests(spark, str(folder), str(tmp_path / "c"), current, apply).awaitTermination(60)

    poll(1, [("a", "h1"), ("b", "h1")])
    poll(2, [("a", "h2")])
    assert seen == [{"a": "added", "b": "added"}, {"a": "modified", "b": "deleted"}]


def test_orphan_stream(spark):
    day = lambda n: T0 + timedelta(days=n)
    o = sync.OrphanStream(spark)
    row = lambda **k: tuple(k.get(c.split()[0]) for c in sync.OrphanStream.SCHEMA.split(", "))
    batch = lambda *rows: spark.createDataFrame(list(rows), sync.OrphanStream.SCHEMA)
    o(batch(row(kind="ref", ref_table="t", ref_key="1", p="a", t=day(2))), 0)
    assert o.state.pending().first()["reason"] == "missing"
    later = batch(row(kind="parent", p="a", life=1, real=True, b=day(5)))
    o(later, 1)
    o(later, 1)
    assert o.state.pending().first()["reason"] == "late"


def test_orphan_stream_goes_on_after_a_restart(spark, tmp_path):
    def arrive(name, *rows):
        names = [c.split()[0] for c in sync.OrphanStream.SCHEMA.split(", ")]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({k: r[k] for k in names if k in r}) for r in rows))

    def run():
        stream = spark.readStream.schema(sync.OrphanStream.SCHEMA).json(str(tmp_path / "in"))
        made = sync.OrphanStream(spark, f"file://{tmp_path}/state")
        made.start(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
        return made.state

    arrive("1.json", {"kind": "ref", "ref_table": "t", "ref_key": "1", "p": "a", "t": "2024-01-11T00:00:00"}, {"kind": "ref", "ref_table": "t", "ref_key": "2", "p": "b", "t": "2024-01-11T00:00:00"})
    assert run().pending().count() == 2
    arrive("2.json", {"kind": "parent", "p": "a", "life": 1, "real": True, "b": "2024-01-01T00:00:00"})
    after = run()
    assert after.batch == 1 and [r["ref_key"] for r in after.pending().collect()] == ["2"]
    assert run().batch == 1


@pytest.mark.parametrize("name", ["graph_stats", "p1_found", "p5_found"])
def test_entry_has_sql(name):
    import __spark_entry__ as e

    assert name in e.queries() and name in e.oracle_sql()
    assert set(e.oracle_sql()) <= set(e.queries())
