import pytest
from pyspark.sql import functions as F

from knotwork.config import Settings, clamp, load_settings, save_settings
from knotwork.operators.chunking import chunk_notes, chunks_of
from knotwork.operators.resolve import LinkIndex, normal_path, resolve_by_name, resolve_by_path
from knotwork.plans import dialects
from knotwork.plans.ingest import Store, ingest, reindex
from knotwork.sources import vault


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")


def test_chunks_keep_the_stack_of_headings():
    text = "# A\n" + "one " * 50 + "\n## B\n" + "two " * 50 + "\n### C\n" + "three " * 50
    got = list(chunks_of("n.md", "Title", text, 5, 100))
    assert [c[4] for c in got] == ["# A", "# A > ## B", "# A > ## B > ### C"]
    assert got[0][3] == "n.md#chunk_0" and got[0][5].startswith("# A\n\none")


def test_small_sections_merge_and_large_ones_split():
    small = "".join(f"## S{i}\nfew words here\n" for i in range(6))
    assert len(list(chunks_of("n", "T", small, 20, 300))) < 4
    two = "# H\n" + "a " * 45 + "\n\n" + "b " * 45
    parts = list(chunks_of("n", "T", two, 5, 50))
    assert len(parts) == 2 and {p[4] for p in parts} == {"# H"}
    tail = "# H\n" + "a " * 280 + "\n\nshort end here\n\n" + "b " * 300
    parts = list(chunks_of("n", "T", tail))
    assert len(parts) == 2 and "short end here" in parts[0][5] and "short end here" in parts[1][5]
    giant = list(chunks_of("n", "T", "word " * 900))
    assert len(giant) == 1 and giant[0][4] == "# T" and giant[0][6] == 902


def test_no_text_no_chunks(spark):
    df = spark.createDataFrame([("a", "A", ""), ("b", "B", "---\nx: 1\n---\n"), ("c", None, "text"), ("d", "D", None), (None, "E", "x")], "path string, title string, content string")
    assert [r["chunk_id"] for r in chunk_notes(df).collect()] == ["c#chunk_0"]


@pytest.fixture
def index(spark):
    rows = [("work/api.md", []), ("personal/api.md", []), ("caching.md", ["FastCache"]), ("a/deep/one.md", []), ("b/one.md", []), ("Root.md", None), (None, ["x"])]
    return LinkIndex.of(spark.createDataFrame(rows, "path string, aliases array<string>"))


@pytest.mark.parametrize(
    ("source", "target", "want", "step"),
    [
        ("work/dashboard.md", "api", "work/api.md", "folder"),
        ("personal/notes.md", "api", "personal/api.md", "folder"),
        ("x.md", "API", "personal/api.md", "name"),
        ("x.md", "work/API", "work/api.md", "root"),
        ("x.md", "fastcache", "caching.md", "alias"),
        ("x.md", "CACHING", "caching.md", "root"),
        ("c/x.md", "caching", "caching.md", "root"),
        ("c/x.md", "one", "b/one.md", "name"),
        ("work/x.md", "Future Roadmap", "work/Future Roadmap.md", "ghost"),
        ("x.md", "Root Ghost", "Root Ghost.md", "ghost"),
        ("work/x.md", "pic.PNG", "work/pic.PNG", "ghost"),
        ("work/x.md", "other/New", "other/New.md", "ghost"),
        ("work/x.md", "./api.md", "work/api.md", "folder"),
        ("work/x.md", "", "work/x.md", "self"),
        ("work/x.md", None, "work/x.md", "self"),
    ],
)
def test_cascade(spark, index, source, target, want, step):
    df = spark.createDataFrame([(source, target, 1)], "source_path string, target string, extra int")
    r = resolve_by_name(df, index).first()
    assert (r["target_path"], r["step"], r["is_unresolved"], r["extra"]) == (want, step, step == "ghost", 1)


@pytest.mark.parametrize(
    ("source", "target", "want", "lost"),
    [("work/x.md", "api", "work/api.md", False), ("a/deep/x.md", "../../caching.md", "caching.md", False), ("a/x.md", "/Work/API", "work/api.md", False), ("docs/x.md", "missing/spec", "docs/missing/spec.md", True), ("a/x.md", "", "a/x.md", False)],
)
def test_strict_paths(spark, index, source, target, want, lost):
    r = resolve_by_path(spark.createDataFrame([(source, target)], "source_path string, target string"), index).first()
    assert (r["target_path"], r["is_unresolved"]) == (want, lost)


@pytest.mark.parametrize(("p", "want"), [("a/../b", "b"), ("a/./b//c", "a/b/c"), ("../a", "../a"), ("a/../../b", "../b"), ("", "."), ("a/..", ".")])
def test_normal_path(spark, p, want):
    assert spark.range(1).select(normal_path(F.lit(p))).first()[0] == want


def test_dialects(tmp_path):
    assert dialects.detect(str(tmp_path)).name == "commonmark"
    (tmp_path / ".obsidian").mkdir()
    assert dialects.detect(str(tmp_path)).name == "obsidian"
    assert dialects.detect(str(tmp_path), "commonmark").name == "commonmark"
    with pytest.raises(ValueError, match="commonmark, obsidian"):
        dialects.get("other")
    assert all(isinstance(dialects.get(n), dialects.Dialect) for n in dialects.names())


def test_settings(tmp_path):
    f = tmp_path / "x" / "c.json"
    assert load_settings(str(f)) == Settings()
    save_settings(str(f), Settings(similarity_threshold=0.3))
    assert load_settings(str(f)).similarity_threshold == 0.3 and f.stat().st_mode & 0o777 == 0o600
    f.write_text('{"similarity_threshold": 3}')
    with pytest.raises(ValueError):
        load_settings(str(f))
    assert clamp(99, 1, 5) == 5


VAULT = {
    "Alpha.md": "---\ntags: [t1]\n---\n# Alpha\nsee [[Beta]] and [[Missing]] " + "words " * 50,
    "sub/Beta.md": "#t1 #t2 text about beta " + "words " * 50,
    "Gamma.md": "---\ntitle: The Gamma\naliases: G, Gam\n---\n#t3 alone " + "words " * 50,
    ".hidden/x.md": "no",
    "node_modules/y.md": "no",
    "Z.MD": "no",
    "data.txt": "no",
}


def test_scan_and_parse(spark, tmp_path):
    write(tmp_path, VAULT)
    files = vault.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["Alpha.md", "Gamma.md", "sub/Beta.md"]
    parsed = vault.parse(files)
    notes = {r["path"]: r for r in parsed.notes.collect()}
    assert notes["Gamma.md"]["title"] == "The Gamma" and notes["Gamma.md"]["aliases"] == ["G", "Gam"]
    assert notes["Alpha.md"]["title"] == "Alpha" and notes["Alpha.md"]["tags"] == ["t1"] and notes["sub/Beta.md"]["tags"] == ["t1", "t2"]
    assert [r["target"] for r in parsed.raw_links.orderBy("place").collect()] == ["Beta", "Missing"]
    listed = vault.list_notes(notes_df := parsed.notes, "", "*a.md")
    assert [r["path"] for r in listed.collect()] == ["Alpha.md", "Gamma.md", "sub/Beta.md"]
    page = vault.read_note(notes_df, "sub/Beta", 100, 5).first()
    assert page["text"] == VAULT["sub/Beta.md"][5:105] and page["total_chars"] == len(VAULT["sub/Beta.md"])
    with pytest.raises(ValueError):
        vault.read_note(notes_df, "../x")


def test_glob():
    import re

    for pattern, yes, no in (("*.md", "a.md", "a.mdx"), ("a?[!x].md", "abc.md", "abx.md"), ("[ab]*", "bc", "cc"), ("x+y", "x+y", "xxy")):
        assert re.match(vault.glob_regex(pattern), yes) and not re.match(vault.glob_regex(pattern), no)


def test_ingest_counts_and_steps(spark, tmp_path):
    root, home = tmp_path / "v", tmp_path / "store"
    write(root, {"a.md": "[[b]] [[c]] text", "b.md": "b text"})
    store = Store(spark, str(home))
    run = lambda **k: ingest(spark, str(root), store, dialect="obsidian", **k)

    def state(s):
        g = s.graph
        ghosts = s.counts["unresolved"]
        return (g.added, g.modified, g.unchanged, g.deleted, ghosts, s.counts["notes"], s.counts["links"])

    assert state(run()) == (2, 0, 0, 0, 1, 3, 2)
    assert state(run()) == (0, 0, 2, 0, 1, 3, 2)
    write(root, {"c.md": "now real"})
    assert state(run()) == (1, 0, 2, 0, 0, 3, 2)
    write(root, {"a.md": "[[c]] only"})
    assert state(reindex(spark, str(root), store, "a.md", dialect="obsidian")) == (0, 1, 0, 0, 0, 3, 1)
    (root / "c.md").unlink()
    last = run()
    assert state(last) == (0, 0, 2, 1, 1, 3, 1)
    assert sorted(r["note_path"] for r in store.read("chunks").collect()) == ["a.md", "b.md"]
    assert len(store.read("chunks").first()["vector"]) == 384
    with pytest.raises(ValueError):
        run(target="some")
    with pytest.raises(ValueError):
        reindex(spark, str(root), store, "../x.md")
