import random

import pytest

from knotwork.llm import leak as k

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()
ITEM = "The stubborn orchard opened a wooden bakery, and another shallow pasture welcomed the public drainage beside modest timber."


def test_automaton_equals_plain_matching():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(20)]
    items[5] = (5, " ".join(items[4][1].split()[:15] + items[5][1].split()[:15]))
    index = k.LeakIndex.of(items, 6)
    for _ in range(40):
        doc = [rng.choice(WORDS) for _ in range(40)]
        i = rng.randrange(20)
        a = rng.randrange(20)
        doc[10:10] = items[i][1].split()[a : a + rng.randrange(4, 10)]
        want = {j for j, t in items for p in range(len(doc) - 5) if " ".join(doc[p : p + 6]) in t}
        got = index.runs(doc)
        assert set(got) == want
        for j, spans in got.items():
            assert all(e - b >= 6 and any(" ".join(doc[x : x + 6]) in items[j][1] for x in (b, e - 6)) for b, e in spans)


@pytest.mark.parametrize("misread", ["wooclen", "w0oden", "wo0den", "woodcn", "woodeu"])
def test_misread_words_count(misread):
    index = k.LeakIndex.of([(1, ITEM)])
    assert index.runs(k.words_of(ITEM.replace("wooden", misread))) == {1: [(0, 18)]}


def test_another_word_does_not_count():
    index = k.LeakIndex.of([(1, ITEM)])
    assert index.runs(k.words_of(ITEM.replace("another", "every"))) == {}


BOX = "array<struct<x0 int, y0 int, x1 int, y1 int, conf float>>"
BEAR = "the old bear sat down by the gate and he ate a fan of dry leaves in peace"
OTHERS = {"bear": "hear", "sat": "fat", "he": "be", "by": "hy", "fan": "san"}


def test_another_word_of_the_same_form_does_not_count():
    index = k.LeakIndex.of([(1, BEAR)], known={"hear", "fat"})
    assert index.runs(k.words_of(BEAR)) == {1: [(0, 18)]}
    assert index.runs(k.words_of(BEAR.replace("bear", "hear"))) == {1: [(3, 18)]}
    # between the two known words and the end stand 12 words or more only after the second
    assert index.runs(k.words_of(BEAR.replace("bear", "hear").replace("sat", "fat"))) == {1: [(4, 18)]}
    assert k.LeakIndex.of([(1, " ".join(BEAR.split()[:14]))], known={"hear"}).runs(k.words_of(BEAR.replace("bear", "hear").split(" in ")[0])) == {}


def test_words_swapped_in_a_row_do_not_count(monkeypatch):
    swapped = " ".join(OTHERS.get(w, w) for w in BEAR.split())
    assert k.LeakIndex.of([(1, BEAR)], known={"hear", "fat", "be", "san"}).runs(k.words_of(swapped)) == {}
    monkeypatch.setattr(k, "MOST_MISREAD", 1)  # also where the corpus knows none of them
    assert k.LeakIndex.of([(1, BEAR)]).runs(k.words_of(swapped)) == {}


def test_a_misread_word_may_be_a_word_of_another_item():
    passage = " ".join(BEAR.split()[:13])
    index = k.LeakIndex.of([(1, passage), (2, "they hear the distant choir and the four brass bands that play on the wide green every sunday")])
    assert index.runs(k.words_of(passage.replace("bear", "hear"))) == {1: [(0, 13)]}


def test_no_more_misread_words_in_a_row_than_allowed():
    w = [f"word{c}{d}" for c in "aeiou" for d in "mnp"]
    index = k.LeakIndex.of([(1, " ".join(w))])
    for n in range(12):
        text = ["w0rd" + x[4:] for x in w[:n]] + w[n:]
        assert bool(index.runs(text)) == (min(n, 15) <= k.MOST_MISREAD or 15 - n + k.MOST_MISREAD >= 12), n


def test_words_the_corpus_knows(spark):
    docs = spark.createDataFrame([("bear " * 20 + "hear " * 12 + "beor " * 2 + "Tbe the the the the the tbe tbe tbe tbe tbe",), (None,)], "text string")
    known = k.known_words(k.word_counts(docs), [(1, "the bear")])
    assert known == {"bear", "hear", "the", "tbe"} and "beor" not in known


def test_words_known_by_count_or_given_are_not_misread(spark):
    items = spark.createDataFrame([(1, " ".join(BEAR.split()[:13]))], "item_id bigint, text string")
    swapped = " ".join(BEAR.split()[:13]).replace("bear", "hear")
    plain = spark.createDataFrame([(1, swapped, None)], f"doc_id bigint, text string, boxes {BOX}")
    assert k.find_leaks(plain, items).count() == 1  # nothing tells that it is another word
    assert k.find_leaks(plain, items, common=spark.createDataFrame([("Hear",), (None,)], "word string")).count() == 0
    assert k.find_leaks(plain.unionByName(spark.createDataFrame([(2, "we hear " * 9, None)], plain.schema)), items).count() == 0


def test_letters_apart():
    assert k.letters_apart("rnagistrate", "magistrate") == 2 and k.letters_apart("", "ab") == 2 and k.letters_apart("x", "x") == 0
    assert k.may_be_misread("torenbroolc", "tarenbrook") and not k.may_be_misread("fonr5tn9ht", "tanrsinqht"[:3])


@pytest.mark.parametrize("mark", ["-", "¬", "=", "‑", "­", "-  "])
def test_broken_words(mark):
    text = ITEM.replace("welcomed", f"wel{mark}\ncomed").replace("shallow ", "shallow\n")
    assert set(k.LeakIndex.of([(1, ITEM)]).runs(k.words_of(text))) == {1}


def test_columns():
    w = ITEM.split()
    left, right = [" ".join(w[i : i + 3]) for i in (0, 3, 6)], [" ".join(w[i : i + 3]) for i in (9, 12, 15)]
    across = [x for p in zip(left, right) for x in p]
    text = "\n".join(across)
    index = k.LeakIndex.of([(1, ITEM)])
    assert index.runs(k.words_of(text)) == {}
    assert set(index.runs(k.words_of(k.reading_order(text, [70, 700, 74, 702, 69, 698])))) == {1}
    assert k.reading_order(text, [1, 2]) == text and k.reading_order(text, None) == text and k.reading_order(text, [70, None] * 3) == text


@pytest.mark.parametrize("block, at_once", [(10**6, 8), (20, 8), (20, 1)])
def test_table(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(k, "BLOCK_WORDS", block)
    monkeypatch.setattr(k, "PASS_BLOCKS", at_once)
    other = " ".join(WORDS[:14])
    items = spark.createDataFrame([(1, ITEM, "en"), (1, ITEM, "en"), (2, other, None), (3, "too short", None), (4, None, None), (None, ITEM, None)], "item_id bigint, text string, lang string")
    docs = spark.createDataFrame([(10, f"before {ITEM.upper()} after", None, 1), (11, " ".join(WORDS[:11]), [], 1), (12, None, None, 1), (13, "", None, 1), (14, f"{other}\nx\n{ITEM}", None, 1), (None, ITEM, None, 1)], f"doc_id bigint, text string, boxes {BOX}, item_id int")
    leaks = k.find_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["begin"], r["n_words"], r["share_of_item"]) for r in leaks.collect()}
    assert got == {(10, 1): (1, 18, 1.0), (14, 2): (0, 14, 1.0), (14, 1): (15, 18, 1.0)}
    clean = {r["doc_id"]: (r["text"], r["n_removed"]) for r in k.scrub(docs, leaks).collect()}
    assert k.scrub(docs, leaks, 19, 1.1).collect() == []
    assert {r["doc_id"] for r in k.scrub(docs, leaks, 18, 1.1).collect()} == {10, 14}
    assert clean[10][1] == 18 and clean[10][0].startswith("before") and "orchard" not in clean[10][0].lower() and clean[14][1] == 32
    assert k.find_leaks(docs, items.where("false")).collect() == [] and k.find_leaks(docs.where("false"), items).collect() == []
