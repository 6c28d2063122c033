"""Folders of notes as tables (S01-S06, S15, S17, S18)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.config import clamp
from knotwork.functions.frontmatter import frontmatter
from knotwork.functions.text import all_links, clean_names, file_name, inline_tags, mask_code
from knotwork.operators.resolve import LinkIndex
from knotwork.plans.dialects import Dialect, NameLinks
from knotwork.store import Files


def scan(spark: SparkSession, root: str, dialect: Dialect | None = None, only: list[str] | None = None) -> DataFrame:
    """path (from the root), mtime (seconds) and content of the vault's notes; files are read where they are.

    With only, no other files than those are looked at; one that is not there gives no row.
    """
    dialect = dialect or NameLinks()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,mdx}")
    if only is not None:
        there = Files(spark)
        full = [f"{root.rstrip('/')}/{p}" for p in only if there.exists(f"{root.rstrip('/')}/{p}")]
        if not full:
            return spark.createDataFrame([], "path string, mtime double, content string")
        files = reader.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", x) for x in full])
    else:
        files = reader.load(root)
    inner = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = F.substr(inner, F.lit(len(root.rstrip("/").split("://")[-1]) + 2))
    kept = files.select(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("p"), path.alias("raw"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    kept = kept.withColumn("path", F.coalesce("p", "raw"))
    return kept.where(dialect.keeps(F.col("path"))).select("path", "mtime", F.decode("content", "UTF-8").alias("content"))


@dataclass
class Parsed:
    """notes(path, title, hash, mtime, aliases, tags, content), raw_links(source_path, target, anchor, alias, is_embed, raw_text, place)."""

    notes: DataFrame
    raw_links: DataFrame


def parse(files: DataFrame, dialect: Dialect | None = None) -> Parsed:
    """Frontmatter, title, aliases, tags and links of files(path, mtime, content).

    Only contents that begin with --- go through the YAML reader in Python; all else is expressions. Links
    in the frontmatter come first, unmasked; in the body, code is masked.
    """
    dialect = dialect or NameLinks()
    bom = F.regexp_replace("content", "^﻿+", "")
    has = F.startswith(bom, F.lit("---"))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("raw"), F.col("bom").alias("body"))
    marked = files.withColumn("bom", bom).withColumn("has", has)
    fm = marked.where("has").withColumn("fm", frontmatter(F.col("bom"))).unionByName(marked.where("NOT has").withColumn("fm", none))
    body = mask_code("fm.body")
    notes = fm.select(
        "path",
        dialect.title(F.col("fm.title"), F.col("path"), F.col("fm.body")).alias("title"),
        F.sha2("content", 256).alias("hash"),
        "mtime",
        clean_names(F.col("fm.aliases")).alias("aliases"),
        inline_tags(body, clean_names(F.col("fm.tags"), True)).alias("tags"),
        "content",
        F.concat(all_links(F.col("fm.raw")), all_links(body)).alias("links"),
    )
    raw = notes.select(F.col("path").alias("source_path"), F.posexplode("links").alias("place", "x")).select("source_path", "x.*", "place")
    return Parsed(notes.drop("links"), raw)


def link_index(notes: DataFrame) -> LinkIndex:
    return LinkIndex.of(notes.select("path", "aliases"))


def list_notes(notes: DataFrame, folder: str = "", pattern: str = "*", limit: int = 100) -> DataFrame:
    """path and size_kb of notes(path, content) under a folder, whose lower-cased file name fits the pattern (* ? [..])."""
    where = F.lit(True)
    f = folder.strip().strip("/")
    if f:
        where = F.startswith("path", F.lit(f + "/"))
    hidden = F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit(".")))
    rows = notes.where(where & ~hidden & F.lower(file_name("path")).rlike(glob_regex(pattern.lower())))
    return rows.select("path", F.round(F.octet_length("content") / 1024, 1).alias("size_kb")).orderBy("path").limit(clamp(limit, 1, 200))


def glob_regex(pattern: str) -> str:
    """The regular expression of a file name pattern, in the dialect of the JVM."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            inner = pattern[k:end].replace("\\", "\\\\").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = end + 1
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
    return f"^(?s:{out})$"


def read_note(notes: DataFrame, path: str, most: int = 15_000, offset: int = 0) -> DataFrame:
    """path, text, offset, total_chars of one page of a note. A path that leads out of the vault is refused."""
    steps = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in steps or path.startswith("/"):
        raise ValueError("the path leads out of the vault")
    clean = "/".join(steps)
    named = [clean] if clean.endswith((".md", ".markdown", ".mdx")) else [clean + e for e in (".md", ".markdown", ".mdx")]
    hit = notes.where(F.col("path").isin(named)).orderBy("path").limit(1)
    return hit.select("path", F.substring("content", max(0, offset) + 1, clamp(most, 100, 50_000)).alias("text"), F.lit(max(0, offset)).alias("offset"), F.length("content").alias("total_chars"))


def tracked_notes(chunks: DataFrame) -> DataFrame:
    """note_path and mtime of the notes with chunks; of several times the latest."""
    return chunks.where("note_path IS NOT NULL").groupBy("note_path").agg(F.max("mtime").alias("mtime"))


def chunk_count(chunks: DataFrame) -> DataFrame:
    """n: the number of different chunks."""
    return chunks.where("chunk_id IS NOT NULL").agg(F.countDistinct("chunk_id").alias("n"))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """id, query, near, mode, category, expected of a benchmark file (one JSON array, or an object with queries)."""
    raw = spark.read.option("multiLine", True).json(path)
    if "queries" in raw.columns:
        raw = raw.select(F.explode("queries").alias("q")).select("q.*")
    extra = {"near": F.lit(None).cast("string"), "mode": F.lit("hybrid"), "category": F.lit(None).cast("string")}
    for name, default in extra.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, default)
    return raw.select("id", "query", "near", F.coalesce("mode", F.lit("hybrid")).alias("mode"), "category", F.col("expected_notes").alias("expected"))


