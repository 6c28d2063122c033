import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from knotwork.operators import delta
from knotwork.operators import graph as g
from knotwork.plans.discover import near_pairs

NOTES = "path string, title string, hash string, mtime double, is_unresolved boolean"
LINKS = "src string, dst string, anchor string, alias string, is_embed boolean"


def links(spark, pairs):
    return spark.createDataFrame([(a, b, "", "", False) for a, b in pairs], LINKS)


def notes(spark, names, ghosts=()):
    return spark.createDataFrame([(n, n.removesuffix(".md"), "h" + n, 1.0, False) for n in names] + [(n, n, "", 0.0, True) for n in ghosts], NOTES)


@pytest.fixture
def small(spark):
    return g.Graph(notes(spark, ["A", "B", "C", "Isolated"]), links(spark, [("A", "B"), ("B", "C")]), spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "path string, tag string"))


@pytest.mark.parametrize(("a", "b", "hops", "path"), [("A", "B", 1, ["A", "B"]), ("A", "C", 2, ["A", "B", "C"]), ("a", "A", 0, ["A"]), ("A", "Isolated", -1, []), ("A", "nothing", -1, [])])
def test_bridge(small, a, b, hops, path):
    r = g.bridge(small.links, small.notes, a, b).first()
    assert (r["source"], r["target"], r["found"], r["hops"], r["path"]) == (a, b, hops >= 0, hops, path)


def test_overview_and_context(small):
    assert g.stats(small).first().asDict() == {"notes": 4, "unresolved": 0, "tags": 2, "tagged_with": 3, "folders": 0, "links": 2, "contained_in": 0}
    assert {r["path"]: r["backlinks_count"] for r in g.hubs(small).collect()} == {"B": 1, "C": 1}
    r = g.context(small, "b").first()
    assert (r["backlinks"], r["outgoing"], r["tags"], r["neighbours_2hop"], r["n_tags"]) == (["A"], ["C"], ["x", "y"], [], 2)
    assert {tuple(x) for x in g.context_rows(small, "C").collect()} == {("backlink", "B"), ("two_hops", "A")}
    one = g.context(small, "B", 1).first()
    assert (one["tags"], one["n_tags"]) == (["x"], 2)
    assert [tuple(x) for x in g.tag_counts(small.note_tags, 5).collect()] == [("x", 2), ("y", 1)]
    assert [x["path"] for x in g.tagged(small, "x").collect()] == ["A", "B"] and g.tagged(small, "X").count() == 0


def bfs(pairs, start, most):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    dist, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        if dist[u] < most:
            for v in near.get(u, ()):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
    return dist


@pytest.mark.parametrize("eager", [False, True])
def test_hops_equal_plain_search(spark, eager):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)]
    start = spark.createDataFrame([("n1",)], "path string")
    got = {r["path"]: r["hop"] for r in g.hops(links(spark, pairs), start, 4, eager).collect()}
    assert got == bfs(pairs, "n1", 4)


def test_near_pairs_equal_plain_search(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    asked = [(f"n{a}", f"n{b}") for a in range(40) for b in range(a + 1, 40)]
    for most in (1, 2, 3):
        got = {tuple(r) for r in near_pairs(links(spark, pairs), spark.createDataFrame(asked, "a string, b string"), most).select("a", "b").collect()}
        assert got == {(a, b) for a, b in asked if bfs(pairs, a, most).get(b, 99) <= most}


def test_find_note_prefers_the_path(spark):
    n = spark.createDataFrame([("x/one.md", "Two", "", 0.0, False), ("two.md", "Other", "", 0.0, False), ("a/two.md", "Z", "", 0.0, False)], NOTES)
    find = lambda i: [r["path"] for r in g.find_note(n, i).collect()]
    assert find("two.md") == ["two.md"] and find("TWO") == ["a/two.md"] and find("nope") == []


def test_folders(spark):
    got = {r["path"]: (r["name"], r["parent"]) for r in g.folders(spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("e.md",)], "path string")).collect()}
    assert got == {"a": ("a", None), "a/b": ("b", "a")}


def test_ghosts_delete_and_reconcile(spark):
    graph = g.with_links(g.Graph(notes(spark, ["a.md", "b.md"]), links(spark, []), spark.createDataFrame([("b.md", "t")], "path string, tag string")), links(spark, [("a.md", "b.md"), ("a.md", "x/New.md"), ("b.md", "a.md")]))
    assert [r["path"] for r in graph.notes.where("is_unresolved").collect()] == ["x/New.md"]
    after = g.delete_notes(graph, spark.createDataFrame([("b.md",)], "path string"))
    b = after.notes.where("path = 'b.md'").first()
    assert b["is_unresolved"] and b["hash"] == "" and after.note_tags.count() == 0 and after.links.count() == 2
    gone = g.delete_notes(graph, spark.createDataFrame([("a.md",), ("b.md",)], "path string"))
    assert [r["path"] for r in gone.notes.collect()] == ["x/New.md"]
    real = g.reconcile(graph, spark.createDataFrame([("y/new.md",)], "path string"))
    assert {r["dst"] for r in real.links.where("src = 'a.md'").collect()} == {"b.md", "y/new.md"} and real.notes.where("is_unresolved").count() == 0


def test_reconcile_counts_links_once(spark):
    graph = g.Graph(notes(spark, ["a.md", "n.md"], ["g/n.md"]), links(spark, [("a.md", "n.md"), ("a.md", "g/n.md")]), spark.createDataFrame([], "path string, tag string"))
    assert g.reconcile(graph, spark.createDataFrame([("n.md",)], "path string")).links.count() == 1


def test_inferred(spark):
    inf = spark.createDataFrame([("A", "B", "EXTENDS", 0.9)], "src string, dst string, rel_type string, confidence double")
    new = spark.createDataFrame([("A", "B", "EXTENDS", 0.1), ("B", "A", "EXTENDS", 0.5), ("B", "A", "EXTENDS", 0.7)], inf.schema)
    got = sorted(map(tuple, g.add_inferred(inf, new).collect()))
    assert got == [("A", "B", "EXTENDS", 0.9), ("B", "A", "EXTENDS", 0.7)]
    assert [r["path"] for r in g.inferred_neighbours(inf, "B").collect()] == ["A"]
    assert g.inferred_pairs(g.add_inferred(inf, new)).count() == 1


def test_delta_is_stable(spark):
    old = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("g", "", True), ("d", "1", False), ("h", "", True)], "path string, hash string, is_unresolved boolean")
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("g", "3"), ("n", "4")], "path string, hash string")
    got = {r["path"]: r["status"] for r in delta.classify(old, cur).collect()}
    assert got == {"a": "unchanged", "b": "modified", "g": "added", "n": "added", "d": "deleted"}
    again = delta.classify(cur.withColumn("is_unresolved", F.lit(False)), cur)
    assert {r["status"] for r in again.collect()} == {"unchanged"}


def test_vector_changes(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("d", 1.0)], "path string, mtime double")
    b = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "path string, mtime double")
    assert {r["path"]: r["status"] for r in delta.vector_changes(a, b).collect()} == {"a": "keep", "b": "embed", "c": "embed", "d": "delete"}
