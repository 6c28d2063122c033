"""Problem 8: passages of held-out test items in a corpus of scanned pages.

Method: the normalised items make up generalised suffix automata over words. Each page's words
are streamed through them in reading order, keeping the length of the longest match that ends at each
word; matches of at least the least length name the items that hold those words, and spans beyond
limits of length or coverage can be removed.

A page's words are brought into reading order (column by column, from the boxes) and broken words are joined. A word
stands for itself; and, if it is no word that the corpus knows, also for every item word of which it may be a
misread copy: one that is equal once letters that scans confuse are one, few letters away. A match may follow
several readings at once, and holds at most MOST_MISREAD such words among any LEAST_WORDS in a row.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.store import written

#: Bounds: words of all items in one automaton (about 30 bytes each once it is built), and automata in one pass over the documents.
#: More items are taken in further blocks and passes.
BLOCK_WORDS, PASS_BLOCKS = 250_000, 8
LEAST_WORDS, MOST_MISREAD = 12, 6
#: A word is known to the corpus if it stands there so often, and at least this share as often as the most frequent of its form.
KNOWN_COUNT, KNOWN_SHARE = 5, 0.2
MOST_COMMON = 20_000
#: Spans that are removed: so long, or that share of their item.
SCRUB_WORDS, SCRUB_SHARE = 20, 0.5
#: Two columns lie at least this far apart (pixels); lines of one column differ by a few.
COLUMN_GAP = 100

_BREAK = re.compile(r"(?<=\w)[-‐‑¬=­][ \t\r]*\n\s*")
_INNER = re.compile(r"(?<=\w)[-‐‑¬­](?=\w)")
_RUN = re.compile(r"[^\W_]+")

#: Letters and groups that scans confuse, and what stands for each class.
CONFUSED_GROUPS = {"rn": "m", "cl": "d", "lc": "k", "vv": "w"}
CONFUSED_LETTERS = {"c": "e", "u": "n", "f": "s", "5": "s", "r": "t", "o": "a", "0": "a", "l": "i", "1": "i", "b": "h", "8": "h", "q": "g", "9": "g", "y": "v"}
_GROUP = re.compile("|".join(CONFUSED_GROUPS))
_LETTERS = str.maketrans(CONFUSED_LETTERS)


def plain(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def scan_form(word: str) -> str:
    """The form in which a word equals its misread copies.

    What a misread letter group stands for is put back first (the result is the same for the printed
    word, which may hold such a group itself). Then accents go and single letters fall together.
    """
    word = _GROUP.sub(lambda m: CONFUSED_GROUPS[m[0]], word)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return word.translate(_LETTERS)


def letters_apart(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def may_be_misread(word: str, printed: str) -> bool:
    """Of two words of one form: whether few enough letters differ, a third or two in short words."""
    return letters_apart(word, printed) <= max(2, (len(printed) + 2) // 3)


def reading_order(text: str, x0: list[int] | None, gap: int = COLUMN_GAP) -> str:
    """The lines column by column, if each has its box and the boxes stand in several columns."""
    if not x0:
        return text
    lines = text.split("\n")
    if len(lines) != len(x0):
        filled = [s for s in lines if s.strip()]
        if len(filled) != len(x0):
            return text
        lines = filled
    if any(x is None for x in x0):
        return text
    left = sorted(set(x0))
    edges = [b for a, b in zip(left, left[1:]) if b - a > gap]
    if not edges:
        return text
    column = [sum(x >= e for e in edges) for x in x0]
    return "\n".join(lines[i] for i in sorted(range(len(lines)), key=lambda i: (column[i], i)))


def joined(text: str) -> str:
    """Without the marks that break words at line ends, and without hyphens inside words."""
    return _INNER.sub("", _BREAK.sub("", text.replace("\r\n", "\n")))


def words_of(text: str) -> list[str]:
    return _RUN.findall(joined(plain(text)))


class SuffixAutomaton:
    """Of several sequences: every state stands for runs that end at the same places of the sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owners: list[set[int]] = [set()]

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        there = self.next[last].get(symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][symbol]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        return new

    def _split(self, at: int, symbol: int, there: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(symbol) == there:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, symbols: Iterable[int]) -> None:
        last = 0
        for s in symbols:
            last = self._extend(last, s)

    def own(self, item: int, symbols: Iterable[int]) -> None:
        """Marks the states of all runs of the item; call it after all items are added."""
        at = 0
        for s in symbols:
            at = self.next[at][s]
            up = at
            while up > 0 and item not in self.owners[up]:
                self.owners[up].add(item)
                up = self.link[up]


@dataclass
class LeakIndex:
    """An automaton as arrays: the arcs of state s are symbols[first[s]:first[s + 1]], sorted, and lead to targets; the
    items that hold the last `least` words of a state are owners[held[s]:held[s + 1]]."""

    words: list[str]
    root: array
    first: array
    symbols: array
    targets: array
    link: array
    length: array
    held: array
    owners: array
    sizes: dict[int, int]
    least: int
    known: frozenset[str] = frozenset()
    cache: dict[str, tuple[tuple[int, bool], ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {w: k for k, w in enumerate(self.words)}
        self.forms: dict[str, list[str]] = {}
        for w in self.words:
            self.forms.setdefault(scan_form(w), []).append(w)

    @classmethod
    def of(cls, items: list[tuple[int, str]], least: int = LEAST_WORDS, known: Iterable[str] = ()) -> LeakIndex:
        ids: dict[str, int] = {}
        coded = []
        for item, text in items:
            coded.append((item, [ids.setdefault(w, len(ids)) for w in words_of(text)]))
        a = SuffixAutomaton()
        for _, symbols in coded:
            a.add(symbols)
        for item, symbols in coded:
            a.own(item, symbols)
        n = len(a.length)
        #: The state of the last `least` words of each longer run.
        base = list(range(n))
        for s in sorted(range(n), key=a.length.__getitem__):
            if s and a.length[a.link[s]] >= least:
                base[s] = base[a.link[s]]
        arcs = [sorted(x.items()) for x in a.next]
        owners = [sorted(a.owners[base[s]]) if a.length[s] >= least else [] for s in range(n)]
        root = array("i", [-1]) * len(ids)
        for symbol, to in arcs[0]:
            root[symbol] = to
        ints = lambda xs: array("i", xs)
        return cls(
            list(ids), root, ints(np.cumsum([0, *map(len, arcs)]).tolist()), ints([s for x in arcs for s, _ in x]), ints([t for x in arcs for _, t in x]),
            ints(a.link), ints(a.length), ints(np.cumsum([0, *map(len, owners)]).tolist()), array("q", [o for x in owners for o in x]), {i: len(s) for i, s in coded}, least, frozenset(known),
        )

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "forms", "cache")}

    def __setstate__(self, state):
        self.__dict__.update(state, cache={})
        self.__post_init__()

    def _readings(self, word: str) -> tuple[tuple[int, bool], ...]:
        exact = self.ids.get(word)
        out = [] if exact is None else [(exact, False)]
        if word not in self.known:
            out += [(self.ids[x], True) for x in self.forms.get(scan_form(word), ()) if x != word and may_be_misread(word, x)]
        return tuple(out)

    def readings(self, word: str) -> tuple[tuple[int, bool], ...]:
        """What the word may stand for: itself, and item words of which it may be a misread copy."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[word] = self._readings(word)
        return got

    def _step(self, state: int, size: int, misread: tuple[int, ...], symbol: int, wrong: bool, at: int):
        """The longest match that ends with the symbol, or None: state, number of words and places of misread ones."""
        first, symbols, link = self.first, self.symbols, self.link
        while state:
            k = bisect_left(symbols, symbol, first[state], first[state + 1])
            if k < first[state + 1] and symbols[k] == symbol:
                state = self.targets[k]
                break
            state = link[state]
            size = self.length[state]
        else:
            state = self.root[symbol]
            if state < 0:
                return None
            size = 0
        size += 1
        if wrong:
            misread = (*misread, at)
        if misread:
            misread = tuple(q for q in misread if q > at - size)
            if wrong and len(misread) > MOST_MISREAD and misread[-MOST_MISREAD - 1] > at - self.least:
                size = at - misread[-MOST_MISREAD - 1]
                misread = misread[-MOST_MISREAD:]
                while self.length[link[state]] >= size:
                    state = link[state]
        return state, size, misread

    def runs(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> maximal spans [begin, end) of the words that stand in the item, each at least `least` long."""
        least, held = self.least, self.held
        found: dict[int, list[tuple[int, int]]] = {}
        threads: list[tuple[int, int, tuple[int, ...]]] = []
        for at, w in enumerate(words, 1):
            readings = self.readings(w)
            if not readings:
                threads = []
                continue
            after: dict[int, tuple[int, int, tuple[int, ...]]] = {}
            for symbol, wrong in readings:
                for state, size, misread in threads or ((0, 0, ()),):
                    new = self._step(state, size, misread, symbol, wrong, at)
                    # of several ways to one state the longest is kept, then the one with fewest misread words
                    if new and (new[0] not in after or (new[1], -len(new[2])) > (after[new[0]][1], -len(after[new[0]][2]))):
                        after[new[0]] = new
            threads = list(after.values())
            for state, size, _ in threads:
                if size >= least:
                    for item in self.owners[held[state] : held[state + 1]]:
                        spans = found.setdefault(item, [])
                        if spans and spans[-1][1] >= at - 1:
                            spans[-1] = (spans[-1][0], at)
                        else:
                            spans.append((at - least, at))
        return found


def _item_blocks(items: DataFrame, least: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks whose words stay under the bound; the test set is read block by block."""
    block: list[tuple[int, str]] = []
    words = 0
    rows = items.where("text IS NOT NULL AND item_id IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id")
    for r in rows.toLocalIterator():
        n = len(words_of(r["text"]))
        if n < least:
            continue
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((r["item_id"], r["text"]))
        words += n
    if block:
        yield block


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all runs of letters and digits in docs(text): counted in each task before anything is shuffled."""
    runs = docs.where("text IS NOT NULL").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
    return runs.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def known_words(counts: DataFrame, items: list[tuple[int, str]]) -> set[str]:
    """Words of the corpus that have the form of an item word and stand there too often to be its misread copies.

    At most 1 / KNOWN_SHARE words of each form are, so the list is bounded by the words of the items.
    """
    forms = frozenset(scan_form(w) for _, text in items for w in words_of(text))
    shared = counts.sparkSession.sparkContext.broadcast(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [scan_form(w) for w in b.column(0).to_pylist()]
            keep = pa.array([f in shared.value for f in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *b.columns], ["form", "word", "n"]).filter(keep)

    rows = counts.mapInArrow(run, "form string, word string, n bigint").where(F.col("n") >= KNOWN_COUNT)
    most = rows.groupBy("form").agg(F.max("n").alias("most"))
    return {r["word"] for r in rows.join(most, "form").where(F.col("n") >= KNOWN_SHARE * F.col("most")).select("word").toLocalIterator()}


LEAKS = "doc_id bigint, item_id bigint, begin int, n_words int, share_of_item double"


def find_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, known: Iterable[str] | None = None, common: DataFrame | None = None) -> DataFrame:
    """A row for each span of a document that holds at least `least` consecutive words of an item.

    docs(doc_id, text, boxes) and items(item_id, text) -> doc_id, item_id, begin (word of the document, in
    reading order), n_words, share_of_item. Null and empty texts and items of fewer words hold nothing;
    null boxes leave the order of the lines. An item_id delivered again counts once. known are words that are
    never taken as misread; without it they come from counts over all documents and from common(word), a table of at
    most MOST_COMMON words of the languages. One pass over the
    documents for each PASS_BLOCKS blocks of items, no shuffle; a block has at most BLOCK_WORDS words.
    """
    sc = docs.sparkSession.sparkContext
    few = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", F.transform("boxes", lambda b: b["x0"]).alias("x0"))
    counts = None
    given = set() if common is None else {r[0].lower() for r in common.where("trim(word) <> ''").select("word").distinct().limit(MOST_COMMON + 1).collect()}
    if len(given) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    out = None
    made: list[LeakIndex] = []

    def close() -> None:
        nonlocal out
        part = few.mapInArrow(_scan(sc.broadcast(list(made))), LEAKS)
        out = part if out is None else out.unionByName(part)
        made.clear()

    for block in _item_blocks(items, least):
        if known is None and counts is None:
            counts = written(word_counts(docs), "word-counts")
        made.append(LeakIndex.of(block, least, known_words(counts, block) | given if known is None else known))
        if len(made) == PASS_BLOCKS:
            close()
    if made:
        close()
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def _scan(indexes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, x0 in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(reading_order(text, x0))
                for index in indexes.value:
                    for item, spans in index.runs(words).items():
                        rows += [(doc, item, a, e - a, (e - a) / index.sizes[item]) for a, e in spans]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "begin", "n_words", "share_of_item"])

    return run


def scrub(docs: DataFrame, leaks: DataFrame, least_words: int = SCRUB_WORDS, least_share: float = SCRUB_SHARE) -> DataFrame:
    """doc_id, kept text and number of words removed, for documents with leaked spans beyond the limits.

    Spans of find_leaks() of at least least_words words, and those that cover at least least_share of their item, are cut
    out of the words in reading order.
    """
    spans = leaks.where((F.col("n_words") >= least_words) | (F.col("share_of_item") >= least_share)).groupBy("doc_id").agg(F.collect_set(F.struct("begin", "n_words")).alias("spans"))
    few = docs.select("doc_id", "text", F.transform("boxes", lambda b: b["x0"]).alias("x0")).join(spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, removed = [], [], []
            for doc, text, x0, cut in zip(*(c.to_pylist() for c in b.columns)):
                clean = joined(unicodedata.normalize("NFKC", reading_order(text, x0)))
                at = [m.span() for m in _RUN.finditer(clean)]
                gone = {k for s in cut for k in range(s["begin"], s["begin"] + s["n_words"])}
                keep, last = [], 0
                for k, (a, e) in enumerate(at):
                    if k in gone:
                        keep.append(clean[last:a])
                        last = e
                keep.append(clean[last:])
                ids.append(doc)
                texts.append(" ".join("".join(keep).split()))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "n_removed"])

    return few.select("doc_id", "text", "x0", "spans").mapInArrow(run, "doc_id bigint, text string, n_removed int")
