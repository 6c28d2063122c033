import random

import pytest

from knotwork.llm import canon as c

LIST = [("almanach apéritif", 1), ("sandstone survey", 2), ("sandstone workflow", 1), ("kingfisher handbook", 1), ("kaleidoscope", 3), ("quicksilver mañana", 1), ("übersicht", 1)]


@pytest.fixture(scope="module")
def index():
    return c.CanonIndex(LIST)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Sandstone Survey", "sandstone survey"),
        ("SandstoneSurvey", "sandstone survey"),
        ("survey, sandstone", "sandstone survey"),
        ("the sandstone_survey (draft)", "sandstone survey"),
        ("meetings/weekly/sandstone%20srvey.md", "sandstone survey"),
        ("sandstonne suvrey", "sandstone survey"),
        ("SАNDSTОNE SURVEY", "sandstone survey"),  # letters of another script
        ("k1ngf1sher hadnb00k", "kingfisher handbook"),
        ("kingf. handbook", "kingfisher handbook"),
        ("Almanach Aperitif", "almanach apéritif"),
        ("ALMANACH APÉRITIFS", "almanach apéritif"),
        ("quick. manana", "quicksilver mañana"),
        ("kalaidoscope", "kaleidoscope"),
        ("sandstone", ""),
        ("survey", ""),
        ("kingfisher survey", ""),
        ("sandstone trombone", ""),
        ("sandstone survey trombone", ""),
        ("203175462427", ""),
        ("2024-01-01", ""),
        ("note-ab12cd", ""),
        ("", ""),
        (None, ""),
        ("???", ""),
        ("x" * 5000, ""),
    ],
)
def test_match(index, value, want):
    assert index.match(value)[0] == want


PLACES = [("new york", 1), ("old mill", 1), ("mill", 1), ("new harbour", 2), ("old harbour", 1), ("mercury (planet)", 1), ("the end", 1), ("york minster", 1)]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("york", ""), ("New York", "new york"), ("york, new", "new york"), ("the new york (draft)", "new york"), ("NewYork", "new york"), ("old york", ""),
        ("mill", "mill"), ("the mill", "mill"), ("old mill", "old mill"), ("the old mill", "old mill"), ("new mill", "mill"),
        ("harbour", ""), ("the new harbour", "new harbour"), ("old harbour copy", "old harbour"), ("mercury", ""), ("mercury (element)", ""), ("Mercury (Planet)", "mercury (planet)"),
        ("mercury planet", "mercury (planet)"), ("end", ""), ("the", ""), ("the new old", ""), ("the york minster final", "york minster"),
    ],
)
def test_entries_keep_all_their_words(value, want):
    assert c.CanonIndex(PLACES).match(value)[0] == want


def test_many_words_with_a_common_beginning():
    import time

    index = c.CanonIndex([(f"stone{a}{b} stone{b}{a} stone{a}{a}", 1) for a in "abcdefgh" for b in "ijklmnop"])
    began = time.time()
    assert index.match("stone stone stone stone stone stone")[0] == ""
    assert index.match("stone stone stone")[0] != ""
    assert index.match("stoneai stoneia stonea")[0] == "stoneai stoneia stoneaa"
    assert index.match(" ".join(f"stone{x}" for x in "abcdefgh" * 40))[0] == ""
    assert time.time() - began < 3


def test_equal_words_in_an_entry():
    index = c.CanonIndex([(" ".join(["bongo"] * 12), 1), ("bongo bongo", 1)])
    assert index.match("Bongo, BONGO!")[0] == "bongo bongo" and index.match("bongo bongo bongo")[0] == "" and index.match("bongo " * 12)[0].count("bongo") == 12


@pytest.mark.parametrize("block", [20_000, 1])
def test_frequency_decides_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_ENTRIES", block)
    ref = spark.createDataFrame([("brian", ["a"]), ("bryan", ["a", "b", "c"]), ("brxxn", [])], "basename string, paths array<string>")
    links = spark.createDataFrame([(1, "brzan", None), (2, "BRIAN", None)], "link_id bigint, target string, alias string")
    assert {r["link_id"]: r["basename"] for r in c.map_values(links, ref).collect()} == {1: "bryan", 2: "brian"}


@pytest.mark.parametrize("word", ["a", "ab", "abc", "aabb", "zonder"])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_deletes(word, most):
    from itertools import combinations

    assert c.deletes(word, most) == {"".join(x) for n in range(min(most, len(word) - 1) + 1) for x in combinations(word, len(word) - n)}


def test_distance_weights():
    assert c.distance("abc", "abc") == 0 and c.distance("abcd", "abdc") == 0.8 and c.distance("book", "bok") == 0.8
    assert c.distance("abc", "xbc") == 1 and c.distance("abcdef", "uvwxyz") == float("inf")


def plain(a, b):
    d = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_deletes_find_what_brute_force_finds():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(6, 10))) for _ in range(150)}
    index = c.Deletes(words)
    for _ in range(150):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 10)))
        if w not in words:
            near = {x for x in words if plain(x, w) <= 2}
            assert {x for x in near if c.distance(x, w) <= 2} == set(index.near(w)) and near <= set(index.near(w))


@pytest.mark.parametrize("block", [20_000, 2])
def test_table(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_ENTRIES", block)
    ref = spark.createDataFrame([(n, ["p"] * k) for n, k in LIST] + [(None, None), ("", [])], "basename string, paths array<string>")
    links = spark.createDataFrame(
        [(1, "Sandstone Survey", None, 0), (1, "Sandstone Survey", None, 0), (2, "sandstne survey", "kaleidoscope", 0), (3, "note-1a2b3c", "kaleidoscope", 0), (4, " ", None, 0), (5, None, None, 0), (6, "trombone", "pumpkin", 0), (None, "kaleidoscope", "", 0), (7, "", "KALEIDOSCOPES", 0)],
        "link_id bigint, target string, alias string, basename int",
    )
    got = {r["link_id"]: (r["exact"], r["by"], r["basename"]) for r in c.map_values(links, ref).collect()}
    assert got == {1: (True, "target", "sandstone survey"), 2: (False, "target", "sandstone survey"), 3: (False, "alias", "kaleidoscope"), 6: (False, "", ""), 7: (False, "alias", "kaleidoscope")}
    none = c.map_values(links, ref.where("false")).collect()
    assert {r["basename"] for r in none} == {""} and len(none) == 5
