import math
import random
from collections import Counter

import numpy as np
import pytest

from knotwork.operators import relatedness as rel
from knotwork.operators import retrieval as r
from knotwork.operators.graph import Graph
from knotwork.plans import discover
from knotwork.plans.search import Library, query_vault, search


def test_fusion_values(spark):
    dense = spark.createDataFrame([(0, "c1", 1, 0.1), (0, "c2", 2, 0.2)], "query_id int, id string, rank int, distance double")
    sparse = spark.createDataFrame([(0, "c2", 1, 5.0), (0, "c3", 2, 3.0)], "query_id int, id string, rank int, score double")
    got = [(x["id"], x["score"], x["rank"]) for x in r.fuse(dense, sparse).orderBy("rank").collect()]
    assert got == [("c2", 0.032522, 1), ("c1", 0.016393, 2), ("c3", 0.016129, 3)]
    one = r.single_mode(spark.createDataFrame([(0, "a", 1, 0.0), (0, "b", 2, 1.0)], "query_id int, id string, rank int, distance double"), "dense")
    assert [x["score"] for x in one.orderBy("rank").collect()] == [1.0, 0.5]
    with pytest.raises(ValueError):
        r.single_mode(one, "other")


def test_boost(spark):
    res = spark.createDataFrame([(0, "1", "far", 0.030, 1), (0, "2", "near", 0.026, 2), (0, "3", "focus", 0.001, 3)], "query_id int, id string, note_path string, score double, rank int")
    hops = spark.createDataFrame([("focus", 0), ("near", 1)], "path string, hop int")
    got = [(x["note_path"], x["score"], x["hop_distance"]) for x in r.boost(res, hops).orderBy("rank").collect()]
    assert got == [("near", 0.0325, 1), ("far", 0.03, None), ("focus", 0.0014, 0)]


def test_bm25_equals_plain(spark):
    rng = random.Random(1)
    docs = [(f"d{i}", " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(12)))) for i in range(40)] + [("null", None)]
    index = r.lexical_index(spark.createDataFrame(docs, "id string, text string"))
    q = spark.createDataFrame([("q", "Beta, zeta! beta"), ("blank", "  ")], "query_id string, text string")
    got = {x["id"]: x["score"] for x in r.bm25(index, q, None).collect()}
    toks = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for i, ts in toks.items():
        c, s = Counter(ts), 0.0
        for term in ("beta", "zeta"):
            df = sum(term in x for x in toks.values())
            if c[term]:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize(("k", "floor", "block"), [(5, None, 16), (None, 0.2, 16), (3, 0.1, 1000)])
def test_knn_join_equals_brute_force(spark, k, floor, block):
    x = np.random.default_rng(2).standard_normal((70, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3] = x[4]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0])], "id int, vector array<float>")
    got = {(g["a"], g["b"]) for g in r.knn_join(df, k, floor, block, dim=8).collect()}
    s = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 9)
    want = set()
    for i in range(70):
        order = sorted(range(70), key=lambda j: (-s[i, j], j))
        order = [j for j in order if floor is None or s[i, j] >= floor]
        want |= {(i, j) for j in (order[:k] if k else order)}
    assert got == want


def test_distances(spark):
    from pyspark.sql import functions as F

    v = lambda *x: F.lit(list(map(float, x)))
    row = spark.range(1).select(r.distance(v(3, 4), v(0, 0)).alias("a"), r.distance(v(3, 4), v(0, 0), "l2sq").alias("b"), r.distance(v(2, 0), v(0, 1), "cosine").alias("c")).first()
    assert tuple(row) == (5.0, 25.0, 1.0)


def test_embedders():
    e = r.HashingEmbedder(32)
    v = e.embed(["one two three", "Three one two", " "])
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[2].any()
    assert r.PrecomputedEmbedder({"a": [1.0, 0.0]}, 2).embed(["a", "b"]).tolist() == [[1, 0], [0, 0]]


@pytest.fixture
def library(spark):
    rows = [("p/a.md", "alpha beta"), ("p/b.md", "beta gamma"), ("q/c.md", "gamma delta"), ("q/d.md", None)]
    chunks = spark.createDataFrame([(f"{p}#0", p, p, "# H", t, 0.0) for p, t in rows], "chunk_id string, note_path string, note_title string, heading string, text string, mtime double")
    chunks = r.embed_column(chunks, "text", r.HashingEmbedder(16))
    notes = spark.createDataFrame([(p, p, "h", 1.0, False) for p, _ in rows], "path string, title string, hash string, mtime double, is_unresolved boolean")
    links = spark.createDataFrame([("q/c.md", "p/b.md", "", "", False)], "src string, dst string, anchor string, alias string, is_embed boolean")
    tags = spark.createDataFrame([("p/b.md", "Tag")], "path string, tag string")
    return Library(chunks.cache(), r.lexical_index(chunks, "chunk_id"), r.HashingEmbedder(16), Graph(notes, links, tags))


def test_search(library):
    paths = lambda **k: [x["note_path"] for x in search(library, k.pop("query", "gamma"), **k).collect()]
    assert set(paths(mode="sparse")) == {"p/b.md", "q/c.md"}
    assert paths(mode="sparse", near="c")[0] == "q/c.md"
    assert paths(folder="P/") and set(paths(folder="P/")) <= {"p/a.md", "p/b.md"}
    assert paths(tags=["#tag"]) == ["p/b.md"] and paths(tags=["tag"], filters="pre") == ["p/b.md"]
    assert paths(query="  ") == [] and len(paths(mode="dense")) >= 3
    with pytest.raises(ValueError):
        paths(mode="x")
    bare = Library(library.chunks, library.index, library.embedder)
    with pytest.raises(ValueError):
        search(bare, "gamma", near="c")
    assert search(bare, "gamma", near="c", lenient=True).count() >= 2


def test_query_vault_caches(library):
    from knotwork.operators.cache import QueryCache

    c = QueryCache()
    a = query_vault(library, "gamma", 99, c, near="c")
    assert a == query_vault(library, " GAMMA ", 20, c, near="C") and c.stats()["hits"] == 1
    assert c.evict_for(["q/c.md"]) == 1 and c.stats()["entries"] == 0


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plain_score(a, b, wa, wb):
    s = a @ b.T
    best = s.max()
    if best < 0.65:
        return 0.0, 0.0, 0.0

    def cover(m, w):
        m = np.where(m >= 0.65, m, 0)
        top, at = m.max(1), m.argmax(1)
        claims, out = Counter(), np.zeros(len(m))
        for i in sorted(range(len(m)), key=lambda i: (-top[i], -i)):
            if top[i] > 0:
                out[i] = top[i] * 0.5 ** claims[at[i]]
                claims[at[i]] += 1
        return (w * out).sum() / w.sum()

    ca, cb = cover(s, wa), cover(s.T, wb)
    return ca, cb, min(0.99, best * (0.3 + 0.7 * min(ca, cb)))


def make(rng, m, n, shared, dim=64):
    a, b = unit(rng.standard_normal((m, dim))), unit(rng.standard_normal((n, dim)))
    b[:shared] = a[:shared]
    return a, b


@pytest.mark.parametrize(("m", "n", "shared", "kind", "matches"), [(40, 30, 10, "DEEP_OVERLAP", 10), (1, 35, 1, "CONTAINMENT", 1), (12, 15, 1, "SHARED_CONCEPT", 1)])
def test_relatedness(spark, m, n, shared, kind, matches):
    a, b = make(np.random.default_rng(m), m, n, shared)
    # ids sort as numbers do
    rows = [(f"{i:03}", "A", "w " * 20, v.tolist()) for i, v in enumerate(a)] + [(f"{i:03}", "B", "w " * 20, v.tolist()) for i, v in enumerate(b)]
    chunks = spark.createDataFrame(rows, "id string, note string, text string, vector array<double>")
    pairs = rel.candidate_notes(chunks)
    assert [tuple(x) for x in pairs.collect()] == [("A", "B")]
    s = rel.score_pairs(pairs, chunks).first()
    assert rel.score_pairs(pairs, chunks, near=rel.near_chunks(chunks)).first() == s
    ca, cb, final = plain_score(a, b, np.full(m, 20**0.5), np.full(n, 20**0.5))
    assert (s["kind"], s["n_matches"]) == (kind, matches)
    assert abs(s["cover_a"] - ca) < 1e-4 and abs(s["cover_b"] - cb) < 1e-4 and abs(s["final_score"] - final) < 1e-4


def brute_related(notes, ids, x, k, floor):
    """Chunk pairs of the floor of all related notes, one by one."""
    s = x @ x.T
    pairs = set()
    for p in range(len(x)):
        near = sorted((-round(s[p, q], 6), notes[q], ids[q], q) for q in range(len(x)) if q != p and s[p, q] >= floor)
        pairs |= {tuple(sorted((notes[p], notes[q]))) for *_, q in near[: k - 1] if notes[p] != notes[q]}
    return pairs, {(notes[p], notes[q], ids[p], ids[q]) for p in range(len(x)) for q in range(len(x)) if notes[p] < notes[q] and s[p, q] >= floor and (notes[p], notes[q]) in pairs}


def test_related_is_whole(spark, monkeypatch):
    monkeypatch.setattr(rel, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(3)
    # one note of many near chunks and copies, so that most lists of nearest chunks are full
    x = unit(np.eye(64)[rng.integers(0, 3, 60)] + 0.09 * rng.standard_normal((60, 64)))
    x[40:45] = x[40]
    notes = ["N%d" % (0 if i < 25 else i // 6) for i in range(60)]
    ids = [f"{i:02}" for i in range(60)]
    chunks = spark.createDataFrame([(i, n, "text", v.tolist()) for i, n, v in zip(ids, notes, x)], "id string, note string, text string, vector array<double>")
    pairs, strong = brute_related(notes, ids, x, 4, 0.65)
    near, weights = rel.related(chunks, 0.65, 4)
    got = near.collect()
    assert {(r["a"], r["b"], r["i"], r["j"]) for r in got} == strong and len(got) == len(strong) and weights.count() == 60
    for focus in ("N7", "none"):
        rows = rel.near_chunks(chunks, 0.65, 4, focus).collect()
        assert {(r["a"], r["b"], r["i"], r["j"]) for r in rows} == {r for r in strong if focus in r[:2]}
    best = {(r["a"], r["b"]): (r["best_i"], r["best_j"]) for r in discover.best_evidence(near.select("a", "b").distinct(), None, near=near).collect()}
    s = x @ x.T
    assert best == {(a, b): min((-round(s[int(i), int(j)], 5), i, j) for m, n, i, j in strong if (m, n) == (a, b))[1:] for a, b in pairs}
    alone = rel.score_pairs(near, chunks).drop("summary").orderBy("a", "b").collect()
    assert alone == rel.score_pairs(near, chunks, near=near, weights=weights).drop("summary").orderBy("a", "b").collect()


def test_pairs_are_kept_by_numbers_and_copies_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(rel, "MANY_COPIES", 3)
    monkeypatch.setattr(rel, "BLOCK_ROWS", 4)
    made, write = [], rel.written
    monkeypatch.setattr(rel, "written", lambda df, tag: made.append((tag, {t for _, t in df.dtypes})) or write(df, tag))
    x = unit(np.random.default_rng(7).standard_normal((10, 64)))[[i // 4 for i in range(40)]]
    notes, ids = ["N%d" % (i % 4) for i in range(40)], [f"{i:02}" for i in range(40)]
    chunks = spark.createDataFrame([(i, n, "text", v.tolist()) for i, n, v in zip(ids, notes, x)], "id string, note string, text string, vector array<double>")
    near, weights, names = rel.related(chunks, 0.65, 4, coded=True)
    assert [t for t, _ in made].count("once") == 1 and [t for t, _ in made].count("floor-pairs") >= 3
    assert all("string" not in types for tag, types in made if tag in ("placed-pairs", "strong"))
    scored = rel.score_pairs(near, chunks, near=near, weights=weights)
    note = {r["n"]: r["note"] for r in names.collect()}
    assert {(note[r["a"]], note[r["b"]]) for r in near.collect()} == brute_related(notes, ids, x, 4, 0.65)[0]
    spelled, w = rel.related(chunks, 0.65, 4)
    assert {(r["a"], r["b"], r["i"], r["j"]) for r in spelled.collect()} == brute_related(notes, ids, x, 4, 0.65)[1]
    alone = {tuple(r) for r in rel.score_pairs(spelled, chunks, near=spelled, weights=w).collect()}
    assert {(note[r["a"]], note[r["b"]], *r[2:]) for r in scored.collect()} == alone and len(alone) == 6


def test_ways_through_a_hub(spark):
    # a hub with most links, two shortest ways of which the smaller counts, and a pair out of reach; more than 64 notes ask
    notes = [f"n{i:03}" for i in range(150)]
    links = [("hub", x) for x in notes] + [("n000", "aim"), ("n001", "aim"), ("x1", "x2"), ("n149", "tail")]
    made = spark.createDataFrame([(p, q, "", "", False) for p, q in links], "src string, dst string, anchor string, alias string, is_embed boolean")
    pairs = spark.createDataFrame([*[("aim", n) for n in notes[2:5]], *[(n, "tail") for n in notes[:100]], ("aim", "x1"), ("aim", "none")], "a string, b string")
    got = {(r["a"], r["b"]): (r["hops"], r["bridge_path"]) for r in discover.enrich(pairs, made).collect()}
    assert got["aim", "n003"] == (3, ["aim", "n000", "hub", "n003"]) and got["n099", "tail"] == (3, ["n099", "hub", "n149", "tail"])
    assert got["aim", "x1"] == got["aim", "none"] == (-1, []) and len(got) == 105
    assert {r["hops"] for r in discover.enrich(pairs, made, 2, ways=False).collect()} == {-1}
    near = {(r["a"], r["b"]) for r in discover.near_pairs(made, spark.createDataFrame([("aim", "hub"), ("hub", "n001"), ("aim", "n002"), ("n003", "n004")], "a string, b string"), 2).collect()}
    assert near == {("aim", "hub"), ("hub", "n001"), ("n003", "n004")}


def test_gaps(spark):
    base = np.zeros((4, 64))
    base[0, 0] = 1
    base[1, :2] = [0.9, (1 - 0.81) ** 0.5]
    base[2, :3] = [0.8, -0.45, (1 - 0.64 - 0.2025) ** 0.5]
    base[3, 5] = 1
    chunks = spark.createDataFrame([(f"{n}0", n, "text", v.tolist()) for n, v in zip("ABCD", base)], "id string, note string, text string, vector array<double>")
    links = spark.createDataFrame([("A", "C", "", "", False)], "src string, dst string, anchor string, alias string, is_embed boolean")
    graph = Graph(None, links, None)
    pairs = lambda **k: {(x["a"], x["b"]) for x in discover.gaps(chunks, graph, **k).collect()}
    assert pairs() == {("A", "B")} == pairs(focus="A") == pairs(focus="B") and pairs(focus="D") == set() == pairs(focus="none")
    inferred = spark.createDataFrame([("B", "A", "EXTENDS")], "src string, dst string, rel_type string")
    assert pairs(inferred=inferred) == set()
    assert pairs(dismissed=spark.createDataFrame([("A::B",)], "key string")) == set()
    found = discover.gaps(chunks, graph)
    notes = spark.createDataFrame([(n, n, "t") for n in "ABCD"], "path string, title string, text string")
    provider = discover.MockProvider({("B", "A"): {"rel_type": "extends", "confidence": 0.91, "reason": "x", "direction": "target_to_source"}})
    row = discover.classify(found, notes, provider, 5).first()
    assert (row["src"], row["dst"], row["rel_type"], row["confidence"], row["model"]) == ("B", "A", "EXTENDS", 0.91, "mock")
    assert discover.classify(found, notes, discover.MockProvider(), 5).count() == 0
    assert discover.enrich(found, links, 3).first()["hops"] == -1
    more = links.union(spark.createDataFrame([("C", "B", "", "", False)], links.schema))
    assert discover.enrich(found, more, 3).first()["bridge_path"] == ["A", "C", "B"]
    flags = discover.note_flags(found, spark.createDataFrame([("A", "D", "CONTRADICTS")], inferred.schema))
    assert {x["path"]: (x["n_gaps"], x["has_contradiction"]) for x in flags.collect()} == {"A": (1, True), "B": (1, False), "D": (0, True)}
