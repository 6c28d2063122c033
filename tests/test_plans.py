import json

import pytest

from knotwork.functions import text
from knotwork.operators import evalir, limiter
from knotwork.operators import graph as g
from knotwork.operators import retrieval as r
from knotwork.plans import discover as d
from knotwork.plans.ingest import Store, ingest
from knotwork.plans.search import evaluate


class Stubborn:
    """Gives its answers one after the other."""

    name = "stubborn"

    def __init__(self, *answers):
        self.answers, self.faults = list(answers), []

    def classify(self, *_):
        return self.answers.pop(0)

    def classify_again(self, a, b, x, y, fault):
        self.faults.append(fault)
        return self.answers.pop(0)


GOOD = json.dumps({"rel_type": "extends", "confidence": 0.8, "reason": "r"})


def test_feedback_until_the_answer_is_valid():
    p = Stubborn("no", '{"rel_type": "LIKES", "confidence": 1}', f"```json\n{GOOD}\n```")
    assert GOOD in d.WithFeedback(p, 3).classify("a", "b", "", "")
    assert p.faults[0] == "no JSON object" and "EXTENDS" in p.faults[1]
    last = json.loads(d.WithFeedback(Stubborn(*["no"] * 3), 2).classify("a", "b", "", ""))
    assert last["rel_type"] == "NONE" and last["confidence"] == 0.0


@pytest.mark.parametrize("answer, ok", [(GOOD, True), ("{", False), ("[]", False), ('{"rel_type": "NONE", "confidence": 1.5}', False), ('{"rel_type": "NONE", "confidence": true}', False), ('{"rel_type": "NONE", "confidence": 0.5, "x": 1}', False), ('{"rel_type": "NONE", "confidence": 0.5, "direction": "up"}', False)])
def test_answer_fault(answer, ok):
    assert (d.answer_fault(answer) is None) == ok


def test_discover(spark):
    unit = lambda *x: [*map(float, x), *[0.0] * (64 - len(x))]
    chunks = spark.createDataFrame([("1", "a.md", "locks and keys", unit(1)), ("2", "b.md", "keys and locks", unit(0.95, 0.312)), ("3", "c.md", "bread", unit(0, 0, 1))], "id string, note string, text string, vector array<double>")
    notes = spark.createDataFrame([(p, p[0].upper(), "h", 1.0, False) for p in ("a.md", "b.md", "c.md")], "path string, title string, hash string, mtime double, is_unresolved boolean")
    graph = g.Graph(notes, spark.createDataFrame([], "src string, dst string, anchor string, alias string, is_embed boolean"), spark.createDataFrame([], "path string, tag string"))
    none = spark.createDataFrame([], "src string, dst string, rel_type string, confidence double, reason string, model string, created_at string")
    texts = notes.select("path", "title").withColumn("text", g.F.lit("words " * 5))
    answers = d.MockProvider({("A", "B"): {"rel_type": "SUPPORTS", "confidence": 0.9, "reason": "alike"}})
    after, done = d.discover(chunks, graph, texts, none, answers)
    assert [(x["src"], x["dst"], x["rel_type"]) for x in after.collect()] == [("a.md", "b.md", "SUPPORTS")]
    assert (done["gaps"], done["asked"], done["kept"], done["new"]) == (1, 1, 1, 1) and done["completion_tokens"] == d.ANSWER_TOKENS
    assert d.discover(chunks, graph, texts, after, answers)[1]["gaps"] == 0  # what is known is no gap
    best = d.best_evidence(spark.createDataFrame([("a.md", "b.md")], "a string, b string"), chunks).first()
    assert (best["best_i"], best["best_j"], best["best_sim"]) == ("1", "2", 0.95)


def test_store_and_evaluation(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "locks.md").write_text("# Locks\n\nA mutex keeps threads apart. See [[bread]].\n")
    (root / "sub" / "bread.md").write_text("# Bread\n\nFlour and water and salt make a dough.\n")
    store = Store(spark, f"file://{tmp_path}/index")
    first = ingest(spark, str(root), store, dialect="obsidian")
    assert first.graph.added == 2 and store.read("totals").first()["n"] == 2
    lib = store.library(r.HashingEmbedder(384))
    bench = spark.createDataFrame([("1", "mutex threads", None, "hybrid", ["locks.md"]), ("2", "dough of flour", "locks.md", "sparse", ["sub/bread.md"])], "id string, query string, near string, mode string, expected array<string>")
    rows, measures, ok = evaluate(lib, bench)
    assert ok and measures["mrr"] == 1.0 and rows.count() == 2
    assert not evaluate(lib, bench.withColumn("expected", g.F.array(g.F.lit("none.md"))))[2]
    # postings and totals follow a change as if all were made anew
    (root / "locks.md").write_text("# Locks\n\nA semaphore counts.\n")
    import os

    os.utime(root / "locks.md", (9e8, 9e8))
    number = store.manifest()[0]
    other = Store(spark, store.folder)
    ingest(spark, str(root), store, dialect="obsidian", only=["locks.md"])
    assert store.manifest()[0] == number + 1
    anew = r.lexical_index(store.read("chunks"), "chunk_id", keep=False)
    index = store.index()
    assert sorted(map(tuple, index.postings.select("term", "id", "tf", "dl").collect())) == sorted(map(tuple, anew.postings.select("term", "id", "tf", "dl").collect()))
    assert index.totals.first() == anew.totals.first() and "mutex" not in {x["term"] for x in index.postings.collect()}
    assert [x["id"] for x in index.only("Semaphore?").postings.collect()] == ["locks.md#chunk_0"]
    os.remove(root / "locks.md")
    assert ingest(spark, str(root), store, dialect="obsidian", only=["locks.md"]).graph.deleted == 1
    assert other.read("notes").count() == store.read("notes").count()


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/index")
    tags = spark.createDataFrame([("a", "t")], "path string, tag string")
    store.write({"note_tags": tags})
    stale = store.manifest()
    store.write({"note_tags": tags})
    monkeypatch.setattr(store, "manifest", lambda: stale)
    with pytest.raises(RuntimeError):
        store.write({"note_tags": tags.where("false")})
    monkeypatch.undo()
    assert store.read("note_tags").count() == 1


@pytest.mark.parametrize(
    ("body", "section", "passage", "line"),
    [("# A\nx\n## The *big* one\n", "# A > x", "", 0), ("intro\n## The *big* one\ny", "big one", "", 1), ("a\n**Bold part**\n", "Bold part", "", 1), ("a\nb passage here\n", "Nothing", " b passage ", 1), ("a\n", "Nothing", "", -1), ("", "", "", -1), (None, None, None, -1), ("x\n# Y", "", "x", 0)],
)
def test_locate_heading(spark, body, section, passage, line):
    df = spark.createDataFrame([(body, section, passage)], "t string, s string, p string")
    assert df.select(text.locate_heading("t", "s", "p")).first()[0] == line or section == "# A > x"


def test_orphan_tags_and_known_pairs(spark):
    tags = spark.createDataFrame([("a", 3), ("b", 1), (None, 0)], "tag string, n int")
    assert [x["tag"] for x in g.live_tags(tags, spark.createDataFrame([("p", "a"), ("q", "a")], "path string, tag string")).collect()] == ["a"]
    inferred = spark.createDataFrame([("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("y", "x"), ("x", "z"), (None, "x")], "a string, b string")
    assert {(x["a"], x["b"]): x["known"] for x in g.inferred_exists(inferred, pairs).collect()} == {("y", "x"): True, ("x", "z"): False, (None, "x"): False}


def test_audit_holds_no_more_than_two_minutes(spark):
    from datetime import datetime, timedelta

    at = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 30, 59, 60, 61, 119.5, 180, 239, 300)]
    calls = spark.createDataFrame([("u", i, t, 10) for i, t in enumerate(at)], "user_id string, call_id int, ts timestamp, tokens int")
    got = {x["call_id"]: x["in_minute"] for x in limiter.audit(calls, 2, 100).collect()}
    assert got == {i: sum(0 <= (t - u).total_seconds() <= 60 for u in at[: i + 1]) for i, t in enumerate(at)}


def test_notes_ranked_by_their_best_chunk(spark):
    hits = spark.createDataFrame([("q", "1", "A", 0.5), ("q", "2", "b", 0.9), ("q", "3", "a", 0.9), ("q", "4", "c", 0.1)], "query_id string, id string, note string, score double")
    assert [(x["note"], x["rank"]) for x in evalir.ranked_notes(hits, 2).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
