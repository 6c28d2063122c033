import itertools
import random

import numpy as np
import pytest

from knotwork.llm import neardup as n

SCHEMA = "chunk_id string, heading string, text string, a int"


def brute(rows, least=0.5):
    make = n.Shingler()
    sets = {}
    for cid, h, t, *_ in rows:
        w = make.words_of(h, t) if t is not None and cid is not None else []
        if len(w) >= n.LEAST_WORDS:
            sets[cid] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def corpus(seed, bases=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 120))]
        for v in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(v * len(base) // 60):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((f"c{k:02}{v}", "# H" if v % 2 else None, ("# H\n\n" if v % 2 else "") + " ".join(words).capitalize() + ".", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [("x1", None, rows[0][2].replace("# H\n\n", ""), 1), ("x2", None, rows[0][2].replace("# H\n\n", ""), 1), ("s", None, "short text", 1), ("n", None, None, 1), ("e", None, "", 1), (None, None, rows[0][2], 1)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in n.similar_pairs(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block, grid, hot", [(4, 1024, 0.001), (4, 5, 0.9), (64, 1024, 0.001)])
def test_large_bands_lose_nothing(spark, monkeypatch, block, grid, hot):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "GRID_ROWS", grid)
    monkeypatch.setattr(n, "HOT_SHARE", hot)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"c{k:02}", None, " ".join([*base[:58], f"end{k}", "z"]), 1) for k in range(30)]
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in n.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(itertools.combinations([r[0] for r in rows], 2))


def test_a_band_of_boilerplate_makes_no_square(spark):
    k = 3000
    df = spark.range(k).selectExpr("id AS class", "transform(sequence(1, 72), x -> IF(x = 1, 7L, xxhash64(id, x))) AS bands", "cast(repeat('a', 64) AS binary) AS counts", "50 AS n")
    assert n.candidate_pairs(df).collect() == []
    # the same with some pairs that share more
    df = df.withColumn("bands", n.F.expr("transform(bands, (x, i) -> IF(i = 5, xxhash64(class div 2), x))"))
    assert sorted(map(tuple, n.candidate_pairs(df).collect())) == [(i, i + 1) for i in range(0, k, 2)]


def test_pairs_of_one_large_band_are_found(spark, monkeypatch):
    # each two texts share the first band and no other
    sketch, calls = n.sketches, []

    def one_band(chunks):
        calls.append(1)
        return sketch(chunks).withColumn("bands", n.F.expr("transform(bands, (x, i) -> IF(i = 0, 7L, xxhash64(class, i)))"))

    monkeypatch.setattr(n, "sketches", one_band)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"c{k:03}", None, " ".join([*base[:58], f"end{k}", "z"]), 1) for k in range(n.BLOCK + 6)]
    rows += [(f"d{k}", None, " ".join(f"v{k}x{i}" for i in range(60)), 1) for k in range(5)]
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in n.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(itertools.combinations([r[0] for r in rows if r[0][0] == "c"], 2)) and calls


def test_grid_join_equals_the_bound_on_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(n, "GRID_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(90):
        counts = rng.poisson(rng.choice([0.3, 1, 2, 5]), n.SEGMENTS).astype(np.uint8)
        rows.append((1 + c % 2, c, bytearray(counts.tobytes()), int(max(1, counts.sum()))))
    df = spark.createDataFrame(rows, "band bigint, class bigint, counts binary, n int")
    got = set(map(tuple, n.grid_join(df.select("band", "class"), df.drop("band"), 0.5).collect()))
    at = {c: (np.frombuffer(bytes(x), np.uint8)[None], np.array([m]), b) for b, c, x, m in rows}
    want = {(a, b) for a, b in itertools.combinations(at, 2) if at[a][2] == at[b][2] and n.may_be_similar(at[a][0], at[b][0], at[a][1], at[b][1], 0.5)[0]}
    assert got == want and len(want) > 50


def test_many_copies_keep_their_group(spark, monkeypatch):
    monkeypatch.setattr(n, "COPIES", 3)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(f"c{k}", None, text, 1) for k in range(6)] + [("d", None, text + " more", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in n.similar_pairs(df).collect()}
    assert got == {("c0", f"c{k}") for k in range(1, 6)} | {("c0", "d")}
    groups = {r["chunk_id"]: (r["group_id"], r["n_copies"], r["n_links"]) for r in n.version_groups(df).collect()}
    assert groups == {f"c{k}": ("c0", 6, 1) for k in range(6)} | {"d": ("c0", 1, 1)}


def test_bound_is_never_above_the_truth():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 90)), np.unique(rng.choice(pool, 120))
        sim = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ca, cb = (n.segment_counts(x)[None] for x in (a, b))
        assert n.may_be_similar(ca, cb, np.array([len(a)]), np.array([len(b)]), sim)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 300)]
    got = {r["class"]: r["root"] for r in n.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in [*range(41), 300]} == {0} and got[105] == 100 and len(got) == 45


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert n.similar_pairs(df).collect() == [] and n.version_groups(df).collect() == []
