"""Problem 3: pieces of oversized texts, cut at natural boundaries.

Method: a hierarchy of separators, each tried where the one before leaves too much: section,
paragraph, sentence, word, and at last character for a word that is itself too long (only where
sizes are counted in characters). Units of the level reached are packed greedily up to the limit,
and each piece after the first begins with the tail of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\r\n"
_WORD = re.compile(r"[^ \t\r\n]+")
_LINE_END = r"(?:\r\n|\r(?!\n)|\n)"
_SECTION = re.compile(_LINE_END + r"(?=#{1,6}[ \t])")
_PARAGRAPH = re.compile(_LINE_END + r"(?:[ \t]*" + _LINE_END + ")+")
_SENTENCE = re.compile(r"[.!?][\"')\]”]*[ \t\r\n]+")

Span = tuple[int, int]


def body_start(heading: str | None, text: str) -> int:
    """Where the body begins: after the heading and the space that follows, if the text begins with it."""
    if not heading or not text.startswith(heading):
        return 0
    at = len(heading)
    while at < len(text) and text[at] in SPACE:
        at += 1
    return at


def count_words(text: str, span: Span | None = None) -> int:
    a, b = span or (0, len(text))
    return sum(1 for _ in _WORD.finditer(text, a, b))


def count_chars(text: str, span: Span | None = None) -> int:
    a, b = span or (0, len(text))
    return b - a


def _cut(pattern: re.Pattern, text: str, span: Span) -> list[Span]:
    """Spans between the matches; what separates stays at the end of the span before."""
    out, at = [], span[0]
    for m in pattern.finditer(text, *span):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < span[1]:
        out.append((at, span[1]))
    return out


def _characters(text: str, span: Span, size: int) -> list[Span]:
    return [(a, min(a + size, span[1])) for a in range(span[0], span[1], size)]


_WORDS_APART = re.compile(r"[ \t\r\n]+")
LEVELS: list[tuple[str, re.Pattern]] = [("section", _SECTION), ("paragraph", _PARAGRAPH), ("sentence", _SENTENCE), ("word", _WORDS_APART)]


def paragraphs(text: str, span: Span) -> list[Span]:
    return [s for s in _cut(_PARAGRAPH, text, span) if _WORD.search(text, *s)]


def sentences(text: str, span: Span) -> list[Span]:
    """A paragraph's end ends a sentence too."""
    return [s for p in paragraphs(text, span) for s in _cut(_SENTENCE, text, p) if _WORD.search(text, *s)]


def cut_kind(text: str, span: Span, limit: int) -> str:
    """The coarsest level that suffices if every unit of it must keep the limit."""
    if all(count_words(text, s) <= limit for s in paragraphs(text, span)):
        return "paragraph"
    if all(count_words(text, s) <= limit for s in sentences(text, span)):
        return "sentence"
    return "word"


@dataclass
class Piece:
    start: int
    end: int
    overlap: int
    words: int


def _units(text: str, span: Span, size: Callable, limit: int, overlap: int, level: int = 0) -> Iterator[tuple[Span, int]]:
    """Units in order, each as coarse as the limit allows, with their sizes."""
    n = size(text, span)
    if n <= limit:
        yield span, n
    elif level < len(LEVELS):
        for s in _cut(LEVELS[level][1], text, span):
            yield from _units(text, s, size, limit, overlap, level + 1)
    else:
        for s in _characters(text, span, limit - overlap):
            yield s, size(text, s)


def _tail(text: str, span: Span, most: int, by_words: bool) -> int:
    """Where the last `most` words (or characters, from a word's begin) of the span begin."""
    if most <= 0:
        return span[1]
    if not by_words:
        at = max(span[0], span[1] - most)
        while span[0] < at < span[1] and text[at - 1] not in SPACE:
            at += 1
        return at
    starts = [m.start() for m in _WORD.finditer(text, max(span[0], span[1] - 80 * most), span[1])]
    if len(starts) < most:
        starts = [m.start() for m in _WORD.finditer(text, *span)]
    return starts[-most] if len(starts) > most else (starts[0] if starts else span[1])


def pieces(text: str, start: int = 0, limit: int = 320, overlap: int = 30, by_words: bool = True) -> list[Piece]:
    """Pieces of text[start:] of at most limit words (or characters).

    The text of a piece is text[p.start:p.end]; its first p.overlap words (characters) repeat the
    piece before. Without the overlaps, the pieces make up the text again. Text without a word
    has one piece if there is any, else none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    size = count_words if by_words else count_chars
    span = (start, len(text))
    if start >= len(text):
        return []
    whole = size(text, span)
    if whole <= limit:
        return [Piece(start, len(text), 0, whole)]
    out: list[Piece] = []
    a, used, fresh = start, 0, 0
    ov_at, ov_n = start, 0
    for (b, e), n in _units(text, span, size, limit, overlap):
        if used + n > limit and fresh:
            out.append(Piece(ov_at, b, ov_n, used))
            ov_at = _tail(text, (a, b), min(overlap, limit - n), by_words)
            ov_n = size(text, (ov_at, b))
            a, used, fresh = b, ov_n, 0
        used += n
        fresh += n
    out.append(Piece(ov_at, len(text), ov_n, used))
    return out


def split_chunks(chunks: DataFrame, limit: int = 320, overlap: int = 30) -> DataFrame:
    """The pieces of every chunk whose body has more than limit words.

    chunks(chunk_id, heading, text) -> chunk_id, cut_kind, piece_no from 0, heading, text (heading, blank line,
    piece), n_words and overlap_words of the piece. Bodies of at most limit words, null and
    blank texts give no rows; a null heading leaves the whole text as body. A chunk_id delivered
    again counts once: the row with the greatest text, then heading, is taken. Texts that
    cannot have so many words (a word and a space are two characters) are dropped in the scan.
    """
    long = chunks.where(F.length("text") > 2 * limit).select("chunk_id", "heading", "text").where("chunk_id IS NOT NULL")
    once = long.groupBy("chunk_id").agg(F.max(F.struct("text", "heading")).alias("x")).select("chunk_id", "x.heading", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, heading, text in zip(*(c.to_pylist() for c in b.columns)):
                at = body_start(heading, text)
                if count_words(text, (at, len(text))) <= limit:
                    continue
                kind = cut_kind(text, (at, len(text)), limit)
                for k, p in enumerate(pieces(text, at, limit, overlap)):
                    piece = text[p.start : p.end].strip(SPACE)
                    rows.append((cid, kind, k, heading, f"{heading}\n\n{piece}" if heading else piece, p.words, p.overlap))
            if rows:
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["chunk_id", "cut_kind", "piece_no", "heading", "text", "n_words", "overlap_words"])

    return once.mapInArrow(run, "chunk_id string, cut_kind string, piece_no int, heading string, text string, n_words int, overlap_words int")
