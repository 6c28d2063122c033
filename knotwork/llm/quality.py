"""Problem 9: statistics of a text's quality, and its kind: prose, list, table or junk.

Method: gradient-boosted trees on document statistics. They are trained on weak labels: documents of a bounded sample whose
structure is plainly prose, a list, a table or junk; rules leave the rest (about two in five) unlabelled, and the trees decide
there. Their scores are calibrated, by a temperature and an offset for each kind, on texts judged by hand (holdout.py)
that take no part in training; the calibrated probabilities decide.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
#: Bound: documents the trees are fitted on.
FIT_ROWS = 6_000
#: Prose of the sample that junk is made of, and its greatest length; it is made only of samples with less plain junk.
SPOILED, SPOIL_CHARS, LEAST_JUNK = 150, 5_000, 30

_WORD = re.compile(r"[^\W\d_]+(?:['’\-‑][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?](?=\s|$|[\"”])")
_NUMBER = re.compile(r"\d(?<![^\W\d_]\d)[\d.,:½¼¾/]*")
_VOWEL = re.compile(r"[aeiouyäöüàâáéèêíîïóôúûœæAEIOUYÄÖÜÁÉÍÓÚ]")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxzßñ]{5,}", re.IGNORECASE)
_ENTRY = re.compile(r"^\s*(?:[-–—•*·]|\(?\d{1,4}[.)]|[A-Za-z][.)])\s+\S")
_END = re.compile(r"[.!?][\"'”’»)\]]*$")
_LEAD = re.compile(r"\s[,.;:!?]+[^\W\d_]")
_MIXED = re.compile(r"[^\w\s'’\-‑\xad.,/:](?<=[^\W\d_].)(?=[^\W\d_])")

FEATURES = (
    "words_per_line", "end_share", "letter_share", "digit_share", "symbol_share", "word_length", "common_share", "digit_line_share", "lower_start_share", "distinct_share",
    "number_fields", "leader_share", "flow_share", "capital_share", "top_share", "vowel_share", "hard_share", "entry_share", "pause_share", "same_shape_share",
    "line_spread", "word_char_share", "repeat_share", "common_run_share", "sentence_words", "short_line_share", "single_share", "lead_mark_share", "inner_capital_share", "mixed_share",
)


class _Known(dict):
    """Answers by word, worked out once; starts anew when there are too many."""

    def __init__(self, answer, most: int = 300_000):
        self.answer, self.most = answer, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        self[key] = x = self.answer(key)
        return x


def _field_kind(f: str) -> str:
    if any(map(str.isdigit, f)):
        return "x" if any(map(str.isalpha, f)) else "9"
    if any(map(str.isalpha, f)):
        return ("A" if f[:1].isupper() else "a") + ("," if f[-1] in ",;:" else "")
    return f[:1]


_COMMON, _LONG, _SOUND, _RUN, _UPPER, _SINGLE, _INNER = (1 << k for k in range(7))


def _word_flags(common: frozenset[str]):
    def flags(w: str) -> int:
        low = w.lower()
        out = _COMMON * (low in common) | _UPPER * w[0].isupper() | _SINGLE * (len(w) == 1)
        if len(w) >= 4:
            out |= _LONG | _SOUND * bool(_VOWEL.search(low)) | _RUN * bool(_HARD.search(low))
        return out | _INNER * (len(w) > 1 and not w.isupper() and not w[1:].islower() and "-" not in w)

    return flags


class Measurer:
    """The numbers named in FEATURES, of texts that are not blank. The whole text counts."""

    def __init__(self, common: frozenset[str]):
        self.flags, self.kinds = _Known(_word_flags(common)), _Known(_field_kind)

    def __call__(self, text: str) -> list[float]:
        lines = [s for s in map(str.strip, text.split("\n")) if s]
        n = len(lines)
        words = _WORD.findall(text)
        nw, per = len(words), max(len(words), 1)
        low = list(map(str.lower, words))
        counts = Counter(low)
        flags = list(map(self.flags.__getitem__, words))
        by_flags = Counter(flags)

        def having(bit: int) -> int:
            return sum(c for f, c in by_flags.items() if f & bit)

        known = [f & _COMMON for f in flags]
        fields = [s.split() for s in lines]
        n_fields = sum(map(len, fields))
        solid = sum(len(f) for fs in fields for f in fs) or 1
        letters = sum(map(len, words))
        digits = len(_DIGIT.findall(text))
        shapes = [(len(fs) if len(fs) < 8 else 8, *map(self.kinds.__getitem__, fs[:8])) for fs in fields]
        ended = [bool(_END.search(s[-4:])) for s in lines]
        flow = sum(1 for a, e, b in zip(lines, ended, lines[1:]) if not e and b[0].islower() and a[-1] not in ";:")
        numbers = len(_NUMBER.findall(text)) if digits else 0
        numbered = sum(1 for s in lines if _NUMBER.search(s)) if numbers else 0
        sizes = list(map(len, lines))
        mean = sum(sizes) / n
        long = max(1, having(_LONG))
        return [
            nw / n,
            sum(ended) / n,
            letters / solid,
            digits / solid,
            max(0, solid - letters - digits) / solid,
            letters / per,
            sum(known) / per,
            numbered / n,
            sum(1 for s in lines if s[0].islower()) / n,
            len(counts) / per,
            numbers / n,
            sum(1 for s in lines if "..." in s or "\t" in s or "   " in s or " | " in s) / n,
            flow / max(1, n - 1),
            having(_UPPER) / per,
            max(counts.values(), default=0) / per,
            having(_SOUND) / long,
            having(_RUN) / long,
            sum(1 for s in lines if _ENTRY.match(s)) / n,
            sum(1 for s in lines if s[-1] in ",;:") / n,
            sum(map(eq, shapes, shapes[1:])) / max(1, n - 1),
            (sum((s - mean) ** 2 for s in sizes) / n) ** 0.5 / mean,
            nw / max(1, n_fields),
            sum(map(eq, low, low[1:])) / per,
            sum(map(and_, known, known[1:])) / per,
            min(60.0, nw / (1 + len(_STOP.findall(text)))),
            sum(1 for fs in fields if len(fs) <= 2) / n,
            having(_SINGLE) / per,
            len(_LEAD.findall(text)) / per,
            having(_INNER) / per,
            len(_MIXED.findall(text)) / per,
        ]


def features(text: str, common: frozenset[str]) -> list[float]:
    return Measurer(common)(text)


def rule(x: np.ndarray) -> np.ndarray:
    """The kind that structure is sure about, by rows of features; -1 where it is not: only plain cases are labelled."""
    f = {k: x[:, j] for j, k in enumerate(FEATURES)}
    junk = (f["single_share"] > 0.7) & (f["number_fields"] < 0.5) | (f["letter_share"] < 0.25) & (f["number_fields"] < 0.5) | (f["mixed_share"] > 0.25) | (f["common_share"] > 0.75)
    words = (f["common_share"] < 0.04) & (f["number_fields"] < 0.3)
    junk |= words & ((f["hard_share"] > 0.2) | (f["vowel_share"] < 0.75) | (f["lead_mark_share"] > 0.03) & (f["inner_capital_share"] > 0.05))
    table = ~junk & (f["number_fields"] >= 2) & (f["digit_line_share"] > 0.9) & (f["common_share"] < 0.02)
    entries = (f["entry_share"] > 0.9) | (f["same_shape_share"] > 0.8)
    tidy = (f["vowel_share"] > 0.97) & (f["lead_mark_share"] < 0.01) & (f["inner_capital_share"] < 0.02)
    lists = ~junk & (f["common_share"] < 0.02) & (f["number_fields"] < 1.1) & (f["words_per_line"] < 6) & entries & tidy
    prose = ~junk & (f["flow_share"] > 0.75) & (f["common_share"] > 0.15) & (f["common_share"] < 0.3) & (f["distinct_share"] > 0.5) & (f["number_fields"] < 0.15) & (f["sentence_words"] < 15) & (f["entry_share"] < 0.05)
    sure = np.stack([prose, lists, table, junk], axis=1)
    return np.where(sure.sum(axis=1) == 1, sure.argmax(axis=1), -1)


def spoiled(text: str, how: int, seed: int = 0) -> str:
    """Junk made of prose, so that the kind is known where a sample has none: letters in any order, signs for letters, one word again and again."""
    rng = random.Random(f"{seed} {how} {len(text)}")
    if how == 0:
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        return "".join(letters.pop() if c.isalpha() else c for c in text)
    if how == 1:
        return "".join(rng.choice("#%&*+/<=>^_|~") if c.isalpha() and rng.random() < 0.6 else c for c in text)
    words = text.split()
    few = [rng.choice(words) for _ in range(2)]
    return "\n".join(" ".join(rng.choice(few) for _ in s.split()) for s in text.split("\n"))


@dataclass
class BoostedTrees:
    """Softmax gradient boosting over binned features; trees of equal depth, as arrays.

    Each tree sees a random share of the features: many statistics tell plain cases apart, and a document that
    is unusual in one of them is then judged by all others too.
    """

    n_kinds: int
    rounds: int = 60
    share: float = 0.3
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    temperature: float = 1.0
    offsets: np.ndarray | None = None
    edges: np.ndarray | None = None
    base: np.ndarray | None = None
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        b = self._binned(x)
        n, nf = b.shape
        share = np.bincount(y, minlength=self.n_kinds) / n
        self.base = np.log(np.maximum(share, 1e-6))
        weight = (1 / np.maximum(share * (share > 0).sum(), 1e-9))[y]
        score = np.tile(self.base, (n, 1))
        onehot = np.eye(self.n_kinds)[y]
        flat = np.arange(nf) * self.bins + b
        rng = np.random.default_rng(7)
        for _ in range(self.rounds):
            p = _softmax(score)
            for k in range(self.n_kinds):
                if not share[k]:
                    continue
                g, h = (p[:, k] - onehot[:, k]) * weight, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * weight
                seen = np.zeros(nf, bool)
                seen[rng.permutation(nf)[: max(1, round(self.share * nf))]] = True
                tree = self._grow(flat, b, g, h, nf, seen)
                self.trees.append((k, *tree))
                score[:, k] += _follow(b, *tree, self.depth)
        return self

    def _grow(self, flat, b, g, h, nf, seen):
        size = 2**self.depth
        feature, cut, value = np.zeros(size - 1, int), np.full(size - 1, self.bins), np.zeros(size)
        node = np.zeros(len(b), int)
        for d in range(self.depth):
            width = nf * self.bins
            at = (node[:, None] * width + flat).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, nf), minlength=2**d * width).reshape(2**d, nf, self.bins) for v in (g, h))
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = -1
            gain[:, ~seen] = -1
            best = gain.reshape(2**d, -1).argmax(axis=1)
            for i in range(2**d):
                f, c = divmod(int(best[i]), self.bins)
                if gain[i, f, c] > 1e-6:
                    feature[2**d - 1 + i], cut[2**d - 1 + i] = f, c
            at_node = 2**d - 1 + node
            node = node * 2 + (b[np.arange(len(b)), feature[at_node]] > cut[at_node])
        value = -self.rate * np.bincount(node, g, minlength=size) / (np.bincount(node, h, minlength=size) + 1)
        return feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.tile(self.base, (len(x), 1))
        for k, *tree in self.trees:
            out[:, k] += _follow(b, *tree, self.depth)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x) / self.temperature
        return _softmax(s if self.offsets is None else s + self.offsets)

    def calibrate(self, x: np.ndarray, y: np.ndarray, pull: float = 0.02) -> BoostedTrees:
        """The temperature and the offset of each kind with the least log loss on texts judged by hand.

        Offsets are pulled towards 0; they move the border between two kinds, and so what is decided.
        """
        s = self.scores(x)
        rows = np.arange(len(y))
        onehot = np.eye(self.n_kinds)[y]
        best = np.inf
        for t in np.geomspace(1, 8, 16):
            offsets = np.zeros(self.n_kinds)
            for _ in range(300):
                p = _softmax(s / t + offsets)
                offsets -= 0.5 * ((p - onehot).mean(axis=0) + 2 * pull * offsets)
            loss = -np.log(np.maximum(_softmax(s / t + offsets)[rows, y], 1e-9)).mean() + pull * (offsets**2).sum()
            if loss < best:
                best, self.temperature, self.offsets = loss, float(t), offsets
        return self


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _follow(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    node, rows = np.zeros(len(b), int), np.arange(len(b))
    for d in range(depth):
        at = 2**d - 1 + node
        node = node * 2 + (b[rows, feature[at]] > cut[at])
    return value[node]


def train(x: np.ndarray, texts: list[str], common: frozenset[str]) -> BoostedTrees:
    """Trees from the features x of the documents that the rules are sure about, and where hardly any of them is junk, of junk
    made of the prose among texts.

    Texts judged by hand set the calibration and nothing else.
    """
    from knotwork.llm.holdout import CHECKED

    measure = Measurer(common)
    x = x.reshape(-1, len(FEATURES))
    y = rule(x)
    own = [t for t in texts if t.strip()]
    kinds = rule(np.array([measure(t) for t in own]).reshape(-1, len(FEATURES)))
    prose = [t for t, k in zip(own, kinds) if k == 0][:SPOILED]
    made = [measure(spoiled(t, i % 3, i)) for i, t in enumerate(prose)] if (y == 3).sum() < LEAST_JUNK else []
    made = np.array(made).reshape(-1, len(FEATURES))
    x, y = np.concatenate([x[y >= 0], made]), np.concatenate([y[y >= 0], np.full(len(made), 3)])
    held = np.array([measure(t) for t, _ in CHECKED])
    judged = np.array([KINDS.index(k) for _, k in CHECKED])
    if not len(y):  # nothing to learn from: the texts judged by hand are all there is
        return BoostedTrees(len(KINDS)).fit(held, judged)
    return BoostedTrees(len(KINDS)).fit(x, y).calibrate(held, judged)


def measured(docs: DataFrame, common: frozenset[str]) -> DataFrame:
    """The features of every text that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measurer(common)
        for b in batches:
            rows = [measure(t) for t in b.column(0).to_pylist() if t and t.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    return docs.select("text").mapInArrow(run, "x array<double>")


def common_words(words: DataFrame) -> frozenset[str]:
    """The list on the driver; it is a table of fixed size, and a longer one is refused."""
    got = [r[0].lower() for r in words.where("trim(word) <> ''").select("word").distinct().limit(20_001).collect()]
    if len(got) > 20_000:
        raise ValueError("common_words has more than 20,000 words")
    return frozenset(got)


def classify(docs: DataFrame, words: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, kind and its probability for each document with a text that is not blank.

    docs(doc_id, text), words(word). Every document is judged on its whole text; a repeated row is
    repeated. The trees are fitted on the driver from a sample of at most about fit_rows documents, chosen by
    a hash of doc_id.
    """
    sc = docs.sparkSession.sparkContext
    common = common_words(words)
    usable = docs.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    total = docs.count()
    part = min(1.0, fit_rows / max(1, total))
    some = usable.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(9)), F.lit(1_000_000)) < int(part * 1_000_000))
    # to the driver come numbers, made where the texts are, and short texts to make junk of: both of bounded size, however long texts are
    x = np.array([r[0] for r in measured(some, common).limit(2 * fit_rows).collect()])
    short = [r[0] for r in some.where(F.length("text") <= SPOIL_CHARS).select("text").limit(3 * SPOILED).collect()]
    model = sc.broadcast((train(x, short, common), common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, common = model.value
        measure = Measurer(common)
        for b in batches:
            if not len(b):
                continue
            b = b.filter(pa.array([bool(t.strip()) for t in b.column(1).to_pylist()]))
            x = np.array([measure(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            p = trees.probabilities(x)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([KINDS[k] for k in best]), pa.array(p[np.arange(len(p)), best])], ["doc_id", "kind", "probability"])

    return usable.mapInArrow(run, "doc_id bigint, kind string, probability double")


def statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, word_count, mean_word_length, symbol_ratio, punct_line_share and common_word_share of every document.

    Words are runs without space; symbols are characters other than letters, digits and space, of all but
    space; lines that hold more than space count as ending in punctuation with . ! or ? and optional closing marks;
    common words are counted among the runs of letters. Null, empty and blank texts have 0 words and null ratios.
    """
    text = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(text, r"[ \t\r\n]+", "")
    n = F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r]+|[ \t\r]+$", "")), lambda s: s != "")
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    common = sorted(common_words(words)) or [""]

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6))

    return docs.select(
        "doc_id",
        n.cast("bigint").alias("word_count"),
        ratio(F.length(solid), n).alias("mean_word_length"),
        ratio(F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]+", "")), F.length(solid)).alias("symbol_ratio"),
        ratio(F.size(F.filter(lines, lambda s: s.rlike("[.!?][\"'”)\\]]*$"))), F.size(lines)).alias("punct_line_share"),
        ratio(F.size(F.filter(runs, lambda w: w.isin(common))), F.size(runs)).alias("common_word_share"),
    )
