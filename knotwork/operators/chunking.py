"""Chunks of notes by headings (C01-C05). Sequential within a note, so each note is one step of a map over notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_FRONT = re.compile(r"---\s*\n.*?\n---\s*\n?", re.DOTALL)
_BLANK = re.compile(r"\n\s*\n")
CHUNKS = "note_path string, note_title string, chunk_index int, chunk_id string, heading string, text string, token_count int, start_char int, end_char int"


def words(text: str) -> int:
    return max(1, len(text.split()))


def sections(content: str, title: str, offset: int) -> list[dict]:
    """Runs of text under one stack of headings, which begins with the note's title at the first level.

    Headings count inside code too. A heading closes all of its level and below. Runs without text are dropped.
    """
    stack: dict[int, str] = {1: title}
    out: list[dict] = []
    body: list[str] = []
    begin = at = offset

    def close() -> None:
        text = "".join(body).strip()
        if text:
            out.append({"heading": " > ".join(f"{'#' * n} {t}" for n, t in sorted(stack.items())), "body": text, "start": begin, "end": at})
        body.clear()

    for line in content.splitlines(keepends=True):
        found = _HEADING.fullmatch(line.strip())
        if found:
            close()
            level = len(found[1])
            stack = {n: t for n, t in stack.items() if n < level} | {level: found[2].strip()}
            begin = at
        else:
            body.append(line)
        at += len(line)
    close()
    return out


def merged(parts: list[dict], least: int) -> list[dict]:
    """A section below the least size goes into the next one, whose heading holds; the last stays as it is."""
    out: list[dict] = []
    for part in parts:
        if out and words(out[-1]["body"]) < least:
            small = out.pop()
            part = part | {"heading": part["heading"] or small["heading"], "body": f"{small['body']}\n\n{part['body']}".strip(), "start": small["start"]}
        out.append(part)
    return out


def cut(part: dict, most: int, overlap: int) -> Iterator[dict]:
    """The section, or blocks of its paragraphs up to the size; a short last paragraph is repeated in the next block."""
    if words(part["body"]) <= most:
        yield part
        return
    paragraphs = [p.strip() for p in _BLANK.split(part["body"]) if p.strip()]
    block: list[str] = []
    size = 0
    for k, p in enumerate([*paragraphs, None]):
        if p is None or block and size + words(p) > most:
            text = "\n\n".join(block)
            yield part | {"body": text, "end": part["start"] + len(text)}
            if p is None:
                return
            last = paragraphs[k - 1]
            block = [last] if 0 < words(last) <= overlap else []
            size = sum(map(words, block))
        block.append(p)
        size += words(p)


def chunks_of(path: str, title: str, content: str, least: int = 40, most: int = 320, overlap: int = 30) -> Iterator[tuple]:
    front = _FRONT.match(content)
    begin = front.end() if front else 0
    if not content[begin:].strip():
        return
    parts = (c for s in merged(sections(content[begin:], title, begin), least) for c in cut(s, most, overlap))
    for k, c in enumerate(parts):
        text = f"{c['heading']}\n\n{c['body']}".strip() if c["heading"] else c["body"]
        yield path, title, k, f"{path}#chunk_{k}", c["heading"], text, words(text), c["start"], c["end"]


def chunk_notes(notes: DataFrame, least: int = 40, most: int = 320, overlap: int = 30) -> DataFrame:
    """Chunks of notes(path, title, content). Notes without text have none; null titles count as empty.

    One pass without a shuffle; a note is the unit of work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            rows = [r for p, t, c in zip(*(c.to_pylist() for c in b.columns)) for r in chunks_of(p, t or "", c, least, most, overlap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return notes.where("path IS NOT NULL AND content IS NOT NULL").select("path", "title", "content").mapInArrow(run, CHUNKS)
