import functools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import encode as e

FILE = f"{e.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")

TEXTS = ["", "Hello world", "a", " a", "a ", "  two  spaces ", "line\nbreak\n\nblank\r\nend\n", "tab\tand　wide x y", "don't I'll we've 'tis", "1234567890 ½ ⅓", "aaaaaaaaaaaaaaaa", "日本語テキスト😀😀", "<|endoftext|> stays text", "zz" * 300, "\x1c\x1d\x85 \x00\x01", "    indented\n        more", "ſo ﬁne — “quoted”", "é" * 50]


@pytest.fixture(scope="module")
def encoder():
    return _own()


@pytest.fixture(scope="module")
def library():
    return _lib()


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    enc, lib = _own(), _lib()
    text = text.encode("utf-8", "ignore").decode()
    ids = enc.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids and enc.decode(ids) == text


@functools.cache
def _own():
    return e.Encoder.from_file(FILE)


@functools.cache
def _lib():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def plain_bpe(word, merges):
    parts = [bytes([b]) for b in word]
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if parts[k] == a and parts[k + 1] == b:
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text("abc", max_size=12))
def test_automaton_equals_merging_in_order(pairs, word):
    tokens = [b"a", b"b", b"c"]
    merges = []
    for i, j in pairs:
        a, b = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    ids = {t: k for k, t in enumerate(tokens)}
    m = e.MergeAutomaton({k: t for t, k in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
    assert [tokens[i] for i in m.walk(word.encode())] == plain_bpe(word.encode(), merges)


def test_tokens_made_of_tokens_that_never_come_out():
    names = [b"c", b"a", b"cc", b"ccc", b"ccca"]
    m = e.MergeAutomaton(dict(enumerate(names)), [(0, 0, 2), (0, 2, 3), (3, 1, 4)])
    assert [names[i] for i in m.walk(b"ccca")] == [b"cc", b"c", b"a"]


def test_cache_starts_anew(encoder):
    small = e.Encoder(encoder.automaton, keep=3)
    for t in TEXTS:
        assert small.encode(t) == encoder.encode(t)
    assert len(small.words) <= 3


def test_tables(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "Hello world", "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a column with a clashing name
    out = e.encode_documents(docs)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[1] == got[4] == [15496, 995] and got[2] == got[3] == [] and len(got) == 5
    assert {r["doc_id"]: r["text"] for r in e.decode_documents(out).collect()}[1] == "Hello world"
    assert e.encode_documents(docs.where("false")).collect() == []
