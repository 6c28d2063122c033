import hashlib

import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as x
from knotwork.functions.frontmatter import names, split_frontmatter
from knotwork.functions.relations import parsed_relation
from knotwork.operators.cache import key_of


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def links(spark, body):
    return [(r["target"], r["anchor"], r["alias"], r["is_embed"]) for r in one(spark, body, x.all_links)]


def test_links_in_order(spark):
    body = "[[Plain]] then [[A#Part]] [[B|shown]] [[C#Part|shown]] ![[pic.png]] [text](my%20note.md#Sec%20tion) [[#Here]] [out](https://x.y) [m](mailto:a)"
    assert links(spark, body) == [("Plain", "", "", False), ("A", "Part", "", False), ("B", "", "shown", False), ("C", "Part", "shown", False), ("pic.png", "", "", True), ("my note.md", "Sec tion", "text", False), ("", "Here", "", False)]


def test_links_keep_a_plus(spark):
    assert links(spark, "[a](b+c%2Bd.md)") == [("b+c+d.md", "", "a", False)]
    assert links(spark, "[a](100%.md)") == [("100%.md", "", "a", False)]


def test_tags(spark):
    body = "#first and (#nested/tag) [#b] x#no #123 #v2. [[Note#anchor]] http://a/#frag `#code`"
    assert one(spark, body, lambda c: x.inline_tags(x.mask_code(c))) == ["b", "first", "nested/tag", "v2"]
    assert one(spark, "a", lambda c: x.inline_tags(c, F.array(F.lit("z"), F.lit("y")))) == ["y", "z"]


def test_code_is_masked(spark):
    assert one(spark, "a ```x\n[[L]]``` b ~~~[[M]]~~~ c `d` e", x.mask_code) == "a  b  c  e"


def test_names_and_paths(spark):
    assert one(spark, "a/b/c.tar.md", x.stem) == "c.tar"
    assert one(spark, ".hidden", x.stem) == ".hidden"
    assert one(spark, "c.md", x.parent) == "" and one(spark, "a/b/c.md", x.parent) == "a/b"
    assert one(spark, " /A/b.MD ", x.eval_path) == "a/b.md"
    assert one(spark, ["#b", "a ", "", None, "a"], lambda c: x.clean_names(c, True), "array<string>") == ["a", "b"]


def test_titles(spark):
    body = "```\n# not this\n```\n# The Title\n# Other"
    assert one(spark, body, lambda c: x.note_title(F.lit(" "), F.lit("a/b.md"), c)) == "The Title"
    assert one(spark, body, lambda c: x.note_title(F.lit(None).cast("string"), F.lit("a/b.md"))) == "b"
    assert one(spark, body, lambda c: x.note_title(F.lit("Given"), F.lit("a/b.md"), c)) == "Given"


def test_estimates(spark):
    assert one(spark, "", x.word_estimate) == 1 and one(spark, "a b c\n d", x.word_estimate) == 4
    assert one(spark, "x" * 38, x.token_estimate) == 20 and one(spark, "", x.token_estimate) == 10


def test_outline(spark):
    got = one(spark, "# A\r\ntext\n  ## B \n####### no\n#no", x.outline)
    assert [(r["line"], r["level"], r["title"]) for r in got] == [(1, 1, "A"), (3, 2, "B")]


def test_headings(spark):
    assert one(spark, "# A > ## **B** c", x.leaf_heading) == "**B** c"
    assert one(spark, "## **Bold** [[x|Shown]] [t](u)  `c`", x.plain_heading) == "bold shown t c"
    r = one(spark, "\n# H\nbody\n", x.heading_and_body)
    assert (r["heading"], r["body"]) == ("# H", "body")
    assert one(spark, "abc def", lambda c: x.excerpt(c, 4)) == "abc…"


def test_pair_key(spark):
    assert spark.range(1).select(x.pair_key(F.lit("b"), F.lit("a"))).first()[0] == "a::b"


@pytest.mark.parametrize("args", [("  Hello   World ", "Hybrid", None, 5, "/Docs/", ["#B", "a"]), ("hello world", "hybrid", "", 5, "docs", ["A", "b"])])
def test_cache_key_is_canonical(spark, args):
    q, mode, near, limit, folder, tags = args
    got = spark.createDataFrame([(q, mode, near, limit, folder, tags)], "q string, m string, n string, l int, f string, t array<string>").select(x.cache_key(*map(F.col, "qmnlft"))).first()[0]
    assert got == key_of(q, mode, near, limit, folder, tags) == hashlib.sha256(b"hello world|hybrid||5|docs|a,b").hexdigest()


def test_frontmatter():
    assert split_frontmatter("---\ntitle: T\n---\nbody") == ({"title": "T"}, "\ntitle: T\n", "\nbody")
    assert split_frontmatter("---\n: [bad\n---\nbody")[0] == {} and split_frontmatter("no") == ({}, "", "no")
    assert split_frontmatter("﻿---\na: 1\n--- \nx")[2] == "\nx"
    assert names(["#b", None, " a "], True) == ["a", "b"] and names("x,#y ,,", True) == ["x", "y"] and names(3) == []


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('{"rel_type": "extends", "confidence": 0.9, "reason": "r"}', ("EXTENDS", 0.9, "r", "source_to_target")),
        ('Sure: ```{"rel_type": "NONE", "confidence": 0, "reason": "", "direction": "target_to_source"}```', ("NONE", 0.0, "", "target_to_source")),
        ('{"rel_type": "LIKES", "confidence": 0.9}', None),
        ('{"rel_type": "EXTENDS", "confidence": 1.5}', None),
        ('{"rel_type": "EXTENDS", "confidence": 1, "more": 1}', None),
        ("nothing", None),
        (None, None),
    ],
)
def test_relations(spark, said, want):
    got = one(spark, said, parsed_relation)
    assert (tuple(got) if got else None) == want


