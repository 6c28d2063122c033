"""Problem 7: encoding of a corpus with a byte-level BPE vocabulary.

Method: the merges are compiled into a deterministic automaton over tokens by adding one gadget
for each merge, in their order; words cut out by the vocabulary's pattern are encoded by transitions read from
tables, and ids are decoded by emitting the arcs' labels.

The automaton. At first there is one state with an arc for each byte. The gadget of a merge
a b -> c does two things: arcs labelled a now lead to a copy of their target that lacks the arc b,
and a new arc c leads, from wherever a could be read before b, to where b led. What it accepts is
exactly the token sequences that BPE makes. The state after a token depends on that token alone, so
states are named by tokens. The copies share all they have in common, which keeps the tables as small as the
vocabulary: row a of the table of lost arcs lists, sorted, the arcs b that its copies lack and since when; `tail` and `head`
lead from a token's state and arc to those they were made of, and `born` says when. An arc leaves a state unless one of the
rows along the tails lists one of the arcs along the heads.

Reading. The labels of all arcs make up a second table, over bytes: its states are the beginnings of labels, its transitions
lead on or fall back, and each state names the longest label that ends there, each label the next shorter one. Every beginning of
a word has one path through the automaton, so one step for each byte gives the arc that this path ends with: the
longest label that may follow the path to where it begins. Nothing is tried twice, and nothing is kept but the tables
and a bounded number of words.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabulary files are; a parameter, as the files are never copied.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: Fixed value: the pattern that cuts texts into words, part of the vocabulary's definition.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """first, lost, since: for the state of token a, lost[first[a]:first[a + 1]] are the arcs its copies lack, since when."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token. merges: (a, b, c) in order of their rank."""
        self.labels = labels
        size = max(labels, default=-1) + 1
        none = array("q", [-1]) * size
        self.head, self.tail, self.born = array("q", none), array("q", none), array("q", [_NEVER]) * size
        # the rows as they will be; what a row lists counts from its rank on, so gadgets that come later do not disturb earlier ones
        rows: dict[int, dict[int, int]] = {}
        for rank, (a, b, _) in enumerate(merges):
            rows.setdefault(a, {}).setdefault(b, rank)
        self.first, self.lost, self.since = array("q", [0]), array("q"), array("q")
        for a in range(size):
            for b, rank in sorted(rows.get(a, {}).items()):
                self.lost.append(b)
                self.since.append(rank)
            self.first.append(len(self.lost))
        made = {c for _, _, c in merges}
        for rank, (a, b, c) in enumerate(merges):
            # a merge of a token that never comes out makes none
            if all(x not in made or self.born[x] < rank for x in (a, b)):
                self._gadget(rank, a, b, c)
        #: Tokens that no arc is labelled with never come out, whatever the text.
        self._read_labels({x: i for i, x in labels.items() if i not in made or self.born[i] != _NEVER})

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        """The merge's new arc, if its parts can still be read one after the other when its turn comes."""
        if self.born[c] == _NEVER and self.arc(a, b, rank):
            self.born[c], self.head[c], self.tail[c] = rank, a, b

    def arc(self, state: int, token: int, before: int = _NEVER) -> bool:
        """Whether an arc with this token leaves the state (before that rank): no row along the tails may list an arc along the heads."""
        first, lost, since, head, tail, born = self.first, self.lost, self.since, self.head, self.tail, self.born
        x, x_until = state, _NEVER
        while x >= 0:
            begin, end = first[x], first[x + 1]
            if begin < end:
                y, y_until = token, _NEVER
                while y >= 0:
                    k = bisect_left(lost, y, begin, end)
                    if k < end and lost[k] == y:
                        rank = since[k]
                        # of equal neighbours the left ones merge first
                        if rank < before and rank < x_until and (rank < y_until or rank == y_until != _NEVER):
                            return False
                    y, y_until = head[y], born[y]
            x, x_until = tail[x], born[x]
        return True

    def _read_labels(self, ids: dict[bytes, int]) -> None:
        """step: state and byte to the next state; back: where to fall back; ends: the longest label that ends in a state."""
        self.step: dict[int, int] = {}
        self.whole = ids
        self.back, self.ends = array("q", [0]), array("q", [-1])
        for label in sorted(ids, key=len):
            at = 0
            for byte in label:
                to = self.step.get(at << 8 | byte)
                if to is None:
                    to = self.step[at << 8 | byte] = len(self.back)
                    self.back.append(0)
                    self.ends.append(-1)
                at = to
            self.ends[at] = ids[label]
        self.shorter = array("q", [-1]) * len(self.head)
        # states in order of depth: those a state falls back to are done before it
        depth = array("q", [0]) * len(self.back)
        for key, to in self.step.items():
            depth[to] = depth[key >> 8] + 1
        for key in sorted(self.step, key=lambda k: depth[self.step[k]]):
            at, byte, to = key >> 8, key & 255, self.step[key]
            back = self.back[at]
            while at and back and back << 8 | byte not in self.step:
                back = self.back[back]
            self.back[to] = self.step.get(back << 8 | byte, 0) if at else 0
            under = self.ends[self.back[to]]
            if self.ends[to] < 0:
                self.ends[to] = under
            else:
                self.shorter[self.ends[to]] = under
        self.size = array("q", [len(self.labels.get(i, b"")) for i in range(len(self.head))])

    def walk(self, word: bytes) -> list[int]:
        """The one path through the automaton whose labels make up the word; one step for each byte."""
        whole = self.whole.get(word)
        if whole is not None:  # from the first state every arc leads on
            return [whole]
        step, back, ends, shorter, size, arc = self.step, self.back, self.ends, self.shorter, self.size, self.arc
        last = [-1] * (len(word) + 1)
        state = 0
        for at, byte in enumerate(word, 1):
            to = step.get(state << 8 | byte)
            while to is None:
                state = back[state]
                to = step.get(state << 8 | byte)
            state = to
            token = ends[state]
            while token >= 0:
                begin = at - size[token]
                if not begin or arc(last[begin], token):
                    last[at] = token
                    break
                token = shorter[token]
        path: list[int] = []
        at = len(word)
        while at:
            path.append(last[at])
            at -= size[last[at]]
        return path[::-1]

    def emit(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Texts to ids and back. Keeps at most `keep` words with their ids; then it starts anew."""

    #: Texts with only single blanks and line feeds between words fall apart before each of them.
    _uneven = re.compile(r"[^\S \n]|[ \n](?=[ \n])|[\x01\x85]")

    def __init__(self, automaton: MergeAutomaton, keep: int = 400_000):
        self.automaton, self.keep = automaton, keep
        self.pattern = regex.compile(WORDS)
        self.words: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        return cls(compiled(*read_vocabulary(path)))

    def _make(self, unit: str) -> bytes:
        ids: list[int] = []
        for w in self.pattern.findall(unit):
            ids += self.automaton.walk(w.encode())
        out = np.array(ids, np.int32).tobytes()
        if len(self.words) >= self.keep:
            self.words.clear()
        if len(unit) <= 64:
            self.words[unit] = out
        return out

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers; none for null and empty texts."""
        if not text:
            return b""
        if self._uneven.search(text):
            units = self.pattern.findall(text)
        else:
            units = text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
        get, make = self.words.get, self._make
        return b"".join([x if (x := get(u)) is not None else make(u) for u in units])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return self.automaton.emit(ids).decode("utf-8", "replace")


def read_vocabulary(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int]]]:
    """Labels and merges of a byte-level BPE file; special tokens have no part in it."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, vocab = byte_letters(), file["model"]["vocab"]
    special = {t["content"] for t in file["added_tokens"]}
    labels = {i: bytes(letters[c] for c in x) for x, i in vocab.items() if x not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
    return labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


def compiled(labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> MergeAutomaton:
    return MergeAutomaton(labels, merges)


_kept: dict[str, Encoder] = {}


def _worker_encoder(path: str, automaton) -> Encoder:
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(automaton.value)
    return _kept[path]


def _automaton(docs: DataFrame, path: str):
    """Compiled on the driver and sent to the workers as tables: their size is the vocabulary's, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(compiled(*read_vocabulary(path)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs(doc_id, text); an empty list for null and empty texts.

    Rows stay where they are: no shuffle, one pass over the text. Rows repeated in docs are repeated.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    automaton = _automaton(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path, automaton)
        for b in batches:
            parts = [encoder.packed(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); the empty list gives the empty text, null gives null."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    automaton = _automaton(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path, automaton)
        for b in batches:
            texts = [None if x is None else encoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
