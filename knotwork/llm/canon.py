"""Problem 4: values typed freely, mapped to a reference list.

Method: a symmetric-delete dictionary of the list, broadcast; candidates within a bounded edit
distance are ranked by weighted Damerau-Levenshtein distance and then by the frequency of the entry;
values that mean none are reported with an empty entry.

The dictionary is kept at two levels: of the single words of the entries, which also serves reordered,
shortened and decorated values, and of whole entries without blanks, in either order of their words, which
serves values written together or cut at the wrong place. Entries keep all their words, and a value must stand for all
of them; only what a value has beyond an entry's words may be decoration.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.store import written

#: Entries in one broadcast dictionary; a longer list is taken in blocks of this size.
BLOCK_ENTRIES = 20_000
MOST_EDITS = 2
SHORTEST_PREFIX = 4

#: Letters of other scripts that look like Latin ones, after lower-casing.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Digits typed for letters. l and 1 both become i, on both sides.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
#: Words that decorate a name.
DECORATION = frozenset("the a an draft copy final wip old new".split())
#: Rows of the keyboard.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_LOOKALIKES = str.maketrans(LOOKALIKES)
_DIGITS = str.maketrans(DIGITS)
_APART = re.compile(r"[^\W_]+")
_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}")


def _near_keys() -> frozenset[tuple[str, str]]:
    at = {c: (r, k + r / 2) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
    return frozenset((a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1)


NEAR_KEYS = _near_keys()


def _latin(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LOOKALIKES)


def folded(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    return [w if w.isdigit() else w.translate(_DIGITS) for w in _APART.findall(_latin(unicodedata.normalize("NFKC", text)))]


def named(value: str) -> str:
    """What a value names: of a path its last part, without escapes and extension."""
    value = unicodedata.normalize("NFKC", unquote(value))
    value = re.split(r"[/\\]", value.strip().rstrip("/\\"))[-1]
    return re.sub(r"\.(md|markdown|mdx)\s*$", "", value, flags=re.IGNORECASE)


def readings(value: str) -> list[list[str]]:
    """The words of a value, and those of it without its brackets, if it has some and words beside."""
    name = named(value)
    out = [folded(name)]
    bare = folded(_BRACKETS.sub(" ", name))
    if bare and bare != out[0]:
        out.append(bare)
    return [x for x in out if x]


def deletes(word: str, most: int = MOST_EDITS) -> set[str]:
    """The word and what is left of it after up to `most` (at most 2) deletions, but never nothing."""
    n = len(word)
    out = {word}
    if most >= 1 and n > 1:
        out.update([word[:i] + word[i + 1 :] for i in range(n)])
    if most >= 2 and n > 2:
        for i in range(n - 1):
            head, rest = word[:i], word[i + 1 :]
            out.update([head + rest[:j] + rest[j + 1 :] for j in range(n - 1 - i)])
    return out


def distance(a: str, b: str, most: float = MOST_EDITS) -> float:
    """Weighted Damerau-Levenshtein distance, or infinity if above most.

    Slips of the hand weigh less: 0.8 for swapped neighbours, for a neighbouring key and for a doubled letter.
    """
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most / 0.8:
        return float("inf")
    before: list[float] = []
    row = [0.0]
    for j in range(1, len(b) + 1):
        row.append(row[-1] + (0.8 if j > 1 and b[j - 1] == b[j - 2] else 1))
    for i, x in enumerate(a, 1):
        last, row = row, [row[0] + (0.8 if i > 1 and a[i - 2] == x else 1)]
        for j, y in enumerate(b, 1):
            drop = last[j] + (0.8 if i > 1 and a[i - 2] == x else 1)
            add = row[-1] + (0.8 if j > 1 and b[j - 2] == y else 1)
            put = last[j - 1] + (0 if x == y else 0.8 if (x, y) in NEAR_KEYS else 1)
            best = min(drop, add, put)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        before = last
        if min(row) > most and min(before) > most:
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else MOST_EDITS


class Deletes:
    """Strings by what is left of them after up to MOST_EDITS deletions."""

    def __init__(self, strings: Iterable[str]):
        self.by: dict[str, list[str]] = {}
        self.all = set(strings)
        self.longest = max(map(len, self.all), default=0)
        for s in self.all:
            for d in deletes(s):
                self.by.setdefault(d, []).append(s)

    def near(self, s: str) -> dict[str, float]:
        """Strings within the edits allowed for this length, with their distance; only s itself if it is one."""
        if s in self.all:
            return {s: 0.0}
        most = edits_allowed(len(s))
        if len(s) > self.longest + most:  # nothing is near, and very long values cost nothing
            return {}
        found: set[str] = set()
        for d in self.by.keys() & deletes(s, most):
            found.update(self.by[d])
        scored = ((x, distance(x, s, most)) for x in found)
        return {x: v for x, v in scored if v <= most}


_DECORATION = frozenset(w.translate(_DIGITS) for w in DECORATION)


class CanonIndex:
    def __init__(self, entries: list[tuple[str, int]]):
        """entries: (name, frequency)."""
        self.frequency = dict(entries)
        self.parts: list[tuple[str, tuple[str, ...]]] = []
        self.holding: dict[str, list[int]] = {}
        self.by_joined: dict[str, list[str]] = {}
        for name, _ in entries:
            parts = tuple(sorted(folded(name)))
            if not parts:
                continue
            for w in set(parts):
                self.holding.setdefault(w, []).append(len(self.parts))
            self.parts.append((name, parts))
            for order in {tuple(folded(name)), tuple(folded(name)[::-1])}:
                self.by_joined.setdefault("".join(order), []).append(name)
        self.words, self.joined = Deletes(self.holding), Deletes(self.by_joined)
        self.prefixes: dict[str, list[str]] = {}
        for w in self.holding:
            for n in range(SHORTEST_PREFIX, len(w)):
                self.prefixes.setdefault(w[:n], []).append(w)
        self.cache: dict[str, tuple[str, float]] = {}
        self.near: dict[str, dict[str, float]] = {}

    def _word(self, token: str) -> dict[str, float]:
        near = self.near.get(token)
        if near is None:
            near = dict(self.words.near(token))
            if 0.0 not in near.values():
                for w in self.prefixes.get(token, ()):
                    near[w] = min(near.get(w, 9), 0.5)
            if len(self.near) > 200_000:
                self.near.clear()
            self.near[token] = near
        return near

    def match(self, value: str | None) -> tuple[str, float]:
        """The entry meant and its distance; ('', infinity) if none is.

        Every word of the entry must be there, and no other word but decoration. Ties go to the more frequent, then the
        smaller entry.
        """
        if value is None or not value.strip():
            return "", float("inf")
        known = self.cache.get(value)
        if known is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            known = self.cache[value] = self._match(value)
        return known

    def _match(self, value: str) -> tuple[str, float]:
        for typed in readings(value):
            if all(t.isdigit() for t in typed):
                continue
            bare = [t for t in typed if t not in _DECORATION]
            best = self._by_words(typed, len(typed))
            if not best or min(best)[0] > 0:
                best += self._by_whole(typed)
            if not best and bare and len(bare) < len(typed):
                best = self._by_words(typed, len(bare)) + self._by_whole(bare)
            if best:
                cost, _, name = min(best)
                return name, cost
        return "", float("inf")

    def _by_whole(self, typed: list[str]) -> list[tuple[float, int, str]]:
        whole = "".join(typed)
        if len(whole) < 6:
            return []
        return [(d + 0.1, -self.frequency[n], n) for s, d in self.joined.near(whole).items() for n in self.by_joined[s]]

    def _by_words(self, typed: list[str], least: int) -> list[tuple[float, int, str]]:
        """Entries of at least `least` words whose words the typed ones stand for, one each; what is left over is decoration.

        Candidates are the entries that hold a word near the rarest typed one, so the work grows with their number only.
        """
        must = typed if least == len(typed) else [t for t in typed if t not in _DECORATION]
        near = {t: self._word(t) for t in typed}
        sizes = {t: sum(len(self.holding[w]) for w in near[t]) for t in must}
        rare = min(must, key=sizes.__getitem__)
        out = []
        for k in {k for w in near[rare] for k in self.holding[w]}:
            name, parts = self.parts[k]
            if least <= len(parts) <= len(typed):
                cost = self._cost(typed, parts, near)
                if cost is not None:  # of entries equally near, the one with more of the typed words
                    out.append((cost + 0.01 * (len(typed) - len(parts)), -self.frequency[name], name))
        return out

    @staticmethod
    def _cost(typed: list[str], parts: tuple[str, ...], near: dict[str, dict[str, float]]) -> float | None:
        """The least sum of distances when each part is taken by one typed word, and only decoration is left over."""
        states = {0: 0.0}
        for t in typed:
            after: dict[int, float] = {}
            for taken, cost in states.items():
                if t in _DECORATION and len(typed) > len(parts):
                    after[taken] = min(after.get(taken, 9e9), cost)
                last = None
                for j, w in enumerate(parts):
                    # of equal parts the first that is free is taken
                    if taken >> j & 1 or w == last:
                        continue
                    last = w
                    d = near[t].get(w)
                    if d is not None:
                        now = taken | 1 << j
                        after[now] = min(after.get(now, 9e9), cost + d)
            states = after
        return states.get((1 << len(parts)) - 1)


def _reference_blocks(reference: DataFrame) -> Iterator[list[tuple[str, int]]]:
    rows = reference.where("trim(basename) <> ''").groupBy("basename").agg(F.max(F.coalesce(F.size("paths"), F.lit(0))).alias("n")).orderBy("basename")
    block: list[tuple[str, int]] = []
    for r in rows.toLocalIterator():
        block.append((r["basename"], r["n"]))
        if len(block) == BLOCK_ENTRIES:
            yield block
            block = []
    if block:
        yield block


MATCHED = "link_id bigint, exact boolean, by string, basename string, distance double, frequency bigint"


def map_values(links: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry meant by each link's target, or else by its alias.

    links(link_id, target, alias), reference(basename, paths) -> link_id, exact (the target lower-cased is an
    entry), by ('target', 'alias' or '' if neither means an entry), basename ('' then) and distance. A link_id
    delivered again counts once (the smallest target and alias). Links whose target and alias are both
    null or blank, and null link_ids, give no row. An empty reference list gives every link ''.
    """
    once = links.where("link_id IS NOT NULL").groupBy("link_id").agg(F.min(F.struct(F.coalesce("target", F.lit("")).alias("target"), F.coalesce("alias", F.lit("")).alias("alias"))).alias("x"))
    once = once.select("link_id", "x.target", "x.alias")
    sc = links.sparkSession.sparkContext
    out, rest = None, None
    for entries in _reference_blocks(reference):
        if out is not None:  # several blocks: each pass is a table of its own, and its dictionary is given up before the next
            rest = [written(once, "values")] if rest is None else rest
            out = [out] if isinstance(out, DataFrame) else out
        shared = sc.broadcast(entries)
        part = (once if rest is None else rest[0]).mapInArrow(_scan(shared), MATCHED)
        if out is None:
            out = part
        else:
            out.append(written(part, "matches"))
            shared.unpersist()
    if out is None:
        out = once.mapInArrow(_scan(sc.broadcast([])), MATCHED)
    if isinstance(out, DataFrame):
        return out.drop("frequency")
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    rank = F.struct(~F.col("exact"), F.when(F.col("by") == "target", 0).when(F.col("by") == "alias", 1).otherwise(2).alias("k"), F.col("distance"), (-F.col("frequency")).alias("f"), F.col("basename"))
    return every.groupBy("link_id").agg(F.min_by(F.struct("exact", "by", "basename", "distance"), rank).alias("x")).select("link_id", "x.*")


_kept: dict[int, CanonIndex] = {}


def _scan(block):
    key = hash(tuple(block.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _kept.get(key)
        if index is None:
            _kept.clear()
            index = _kept[key] = CanonIndex(block.value)
        for b in batches:
            rows = []
            for link, target, alias in zip(*(c.to_pylist() for c in b.columns)):
                if not target.strip() and not alias.strip():
                    continue
                lower = target.lower()
                if lower in index.frequency:
                    rows.append((link, True, "target", lower, 0.0, index.frequency[lower]))
                    continue
                for by, value in (("target", target), ("alias", alias)):
                    name, d = index.match(value)
                    if name:
                        rows.append((link, False, by, name, d, index.frequency[name]))
                        break
                else:
                    rows.append((link, False, "", "", None, 0))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in MATCHED.split(", ")])

    return run
