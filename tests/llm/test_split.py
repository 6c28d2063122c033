import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import split as s


def check(text, start, limit, overlap):
    out = s.pieces(text, start, limit, overlap)
    rebuilt = ""
    for k, p in enumerate(out):
        words = [m.start() for m in re.finditer(r"[^ \t\r\n]+", text[p.start : p.end])]
        assert len(words) == p.words <= limit and p.overlap <= overlap and (k or not p.overlap)
        at = p.start + words[p.overlap] if p.overlap else p.start
        rebuilt += text[at : p.end]
    assert rebuilt.split() == text[start:].split()
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "go!", "\n\n", "\r\n \r\n", "\n", "# H", "“so?”", "  ", "x"]), max_size=80), st.integers(2, 12))
def test_pieces_make_up_the_text(parts, limit):
    check(" ".join(parts), 0, limit, limit // 3)


def test_cuts_are_natural():
    para = lambda n: " ".join(["w"] * n)
    text = "\n\n".join([para(200), para(200), para(100)])
    assert [p.words - p.overlap for p in check(text, 0, 320, 30)] == [200, 200, 100] or [p.words - p.overlap for p in check(text, 0, 320, 30)] == [200, 300]
    sent = ". ".join([para(100)] * 5) + "."
    assert all(sent[p.end - 2] == "." or p.end == len(sent) for p in check(sent, 0, 320, 30))
    assert max(p.words for p in check(para(1000), 0, 320, 30)) == 320


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("a " * 300 + "\n\n" + "b " * 300, "paragraph"),
        ("a " * 300 + "\n \t\r\n" + "b " * 300, "paragraph"),
        ("a " * 300 + "end. " + "b " * 300, "sentence"),
        ("a " * 300 + "end.”) " + "b " * 300, "sentence"),
        ("a " * 300 + "end." + "b " * 300, "word"),
        ("a " * 300 + "\n" + "b " * 300, "word"),
        ("a " * 300 + "\r\n" + "b " * 300, "word"),
        ("a " * 300 + "\r\n\r\n" + "b " * 300, "paragraph"),
        ("a " * 700, "word"),
    ],
)
def test_cut_kind(text, kind):
    assert s.cut_kind(text, (0, len(text)), 320) == kind


def test_characters():
    assert [(p.start, p.end) for p in s.pieces("x" * 95, 0, 30, 0, by_words=False)] == [(0, 30), (30, 60), (60, 90), (90, 95)]
    out = s.pieces("long words in a row and more of them here", 0, 20, 6, by_words=False)
    assert all(p.end - p.start <= 20 for p in out) and len(out) > 2
    with pytest.raises(ValueError):
        s.pieces("x", 0, 5, 5)


def test_body():
    assert s.body_start("# H", "# H\n\n body") == 6 and s.body_start("# H", "other") == 0 and s.body_start(None, "x") == 0 and s.body_start("# H", "# H") == 3


def test_table(spark):
    long = "# H\n\n" + "word " * 321
    rows = [("a", "# H", long, 1), ("a", "# H", long, 1), ("b", "# H", "# H\n\n" + "word " * 320, 1), ("c", None, None, 1), ("d", None, "", 1), ("e", None, "x" * 5000, 1), (None, "# H", long, 1), ("f", None, "# H\n\n" + "w " * 319, 1), ("g", "# X", "word " * 400, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, heading string, text string, piece_no int")
    got = s.split_chunks(df).collect()
    assert {(r["chunk_id"], r["cut_kind"]) for r in got} == {("a", "word"), ("f", "paragraph"), ("g", "word")}
    assert [r["n_words"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["chunk_id"] == "a"] == [320, 31]
    assert all(r["text"].startswith(r["heading"] or "") for r in got)
    assert s.split_chunks(df.where("false")).collect() == []


def test_random_documents():
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "end. ", "\n\n", "\n", "“q!” "]) for _ in range(rng.randrange(2000)))
        check(text, 0, 320, 30)
