"""Ingestion (I02-I08): a folder of notes into graph and chunks, as one set-oriented delta for any number of notes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.config import Settings
from knotwork.functions.text import stem
from knotwork.operators import delta
from knotwork.operators.cache import QueryCache
from knotwork.operators.chunking import chunk_notes
from knotwork.operators.graph import LINK, Graph
from knotwork.operators.graph import stats as graph_stats
from knotwork.operators.resolve import LinkIndex
from knotwork.operators.retrieval import Embedder, HashingEmbedder, LexicalIndex, embed_column, postings
from knotwork.plans.dialects import Dialect, detect
from knotwork.plans.search import Library
from knotwork.sources import vault
from knotwork.store import Files

TABLES = {
    "notes": "path string, title string, hash string, mtime double, is_unresolved boolean",
    "links": "src string, dst string, anchor string, alias string, is_embed boolean",
    "note_tags": "path string, tag string",
    "names": "path string, aliases array<string>",
    "chunks": "chunk_id string, note_path string, note_title string, heading string, text string, vector array<float>, chunk_index int, mtime double",
    "postings": "term string, id string, dl int, note_path string, tf bigint",
    "totals": "n bigint, length bigint",
    "tracked": "path string, mtime double",
}


class Store:
    """Tables as Parquet, and manifests that say where the current files of each are; so readers see whole versions only.

    A version writes the tables it changes, all others stay where they are. Everything goes through the file system that Spark
    writes to. Two writers at once: the one that comes second is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The number of the current version (0 if none) and the folder of each table."""
        done = [x for x in self.files.names(self.folder) if x.startswith("manifest-") and x.endswith(".json")]
        return (int(done[-1][9:-5]), json.loads(self.files.read(f"{self.folder}/{done[-1]}"))) if done else (0, {})

    def read(self, name: str) -> DataFrame:
        at = self.manifest()[1].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], TABLES[name])

    def graph(self) -> Graph:
        return Graph(self.read("notes"), self.read("links"), self.read("note_tags"))

    def index(self) -> LexicalIndex:
        """The kept lexical index: nothing is split again for a search."""
        return LexicalIndex.of(self.read("postings").drop("note_path"), self.read("totals").select("n", (F.col("length") / F.col("n")).alias("avgdl")))

    def library(self, embedder: Embedder) -> Library:
        return Library(self.read("chunks"), self.index(), embedder, self.graph())

    def write(self, tables: dict[str, DataFrame]) -> None:
        """A version with these tables; those not given are the ones of the version before."""
        number, places = self.manifest()
        new = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
        with ThreadPoolExecutor(len(TABLES)) as pool:  # the jobs of one version share the cluster
            list(pool.map(lambda name: tables[name].write.parquet(f"{self.folder}/{new[name]}"), new))
        if not self.files.create(f"{self.folder}/manifest-{number + 1:010d}.json", json.dumps(places | new)):
            for path in new.values():
                self.files.delete(f"{self.folder}/{path}")
            raise RuntimeError("another writer has changed the store")
        for name in new:
            if name in places:
                self.files.delete(f"{self.folder}/{places[name]}")

    def clear(self) -> None:
        self.files.delete(self.folder)


@dataclass
class IngestStats:
    graph: delta.Counts = field(default_factory=delta.Counts)
    notes_embedded: int = 0
    notes_dropped: int = 0
    counts: dict = field(default_factory=dict)
    seconds: float = 0.0


def ingest(spark: SparkSession, root: str, store: Store, target: str = "all", dialect: str | Dialect | None = None, embedder: Embedder | None = None, cache: QueryCache | None = None, progress: Callable[[str, float], None] | None = None, only: list[str] | None = None, settings: Settings | None = None) -> IngestStats:
    """Brings the store up to date with the folder; the same for the first time, for changes and for single notes (only).

    target: all, graph or vector. Cached results that depend on changed notes are dropped; after a new note, all are.
    """
    if target not in ("all", "graph", "vector"):
        raise ValueError("target must be all, graph or vector")
    began = time.time()
    say = progress or (lambda stage, share: None)
    s = settings or Settings()
    d = detect(root, dialect) if not hasattr(dialect, "keeps") else dialect
    say("scan", 0.0)
    files = vault.scan(spark, root, d, only).persist()
    out = IngestStats()
    tables: dict[str, DataFrame] = {}
    old = store.graph()
    in_scope = F.col("path").isin(only) if only is not None else F.lit(True)
    try:
        parsed = vault.parse(files, d)
        notes = parsed.notes.persist()
        status = delta.classify(old.notes.where(in_scope), notes).persist()
        names = notes.select("path", "aliases")
        if only is not None:  # the other notes' names are kept, so that no other file is read
            names = store.read("names").where(~in_scope).unionByName(names)
        say("graph", 0.3)
        if target != "vector":
            out.graph = delta.counts(status)
            links = d.resolve(parsed.raw_links, LinkIndex.of(names)).select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"), "anchor", "alias", "is_embed").distinct()
            tags = notes.select("path", F.explode("tags").alias("tag")).distinct()
            after = delta.apply(old, status, notes, links, tags)
            tables |= {"notes": after.notes, "links": after.links.select(*LINK), "note_tags": after.note_tags, "names": names}
        if target != "graph":
            say("vector", 0.6)
            changes = delta.vector_changes(store.read("tracked").where(in_scope), files).persist()
            got = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
            out.notes_embedded, out.notes_dropped = got.get("embed", 0), got.get("delete", 0)
            fresh = files.join(changes.where("status = 'embed'"), "path", "left_semi")
            made = chunk_notes(fresh.select("path", stem("path").alias("title"), "content"), s.chunk_min_words, s.chunk_max_words, s.chunk_overlap_words)
            made = embed_column(made, "text", embedder or HashingEmbedder(s.embedding_dim)).join(files.select(F.col("path").alias("note_path"), "mtime"), "note_path")
            changed = changes.where("status <> 'keep'").select(F.col("path").alias("note_path"))
            made = made.persist()
            tables["chunks"] = delta.replace_chunks(store.read("chunks"), changed, made)
            before, added = store.read("postings"), postings(made, "chunk_id", "text", "note_path")
            now = before.join(changed, "note_path", "left_anti").select(*before.columns).unionByName(added.select(*before.columns))
            tables["postings"] = now.repartitionByRange("term").sortWithinPartitions("term", "id")
            tables["totals"] = _totals(store, changed, made, before, added)
            kept = store.read("tracked").join(changed.withColumnRenamed("note_path", "path"), "path", "left_anti")
            tables["tracked"] = kept.unionByName(fresh.select("path", "mtime"))
        if cache is not None:
            if status.where("status = 'added'").head(1):
                cache.clear()
            else:
                cache.evict_for(r["path"] for r in status.where("status IN ('modified', 'deleted')").select("path").toLocalIterator())
        store.write(tables)
        out.counts = graph_stats(store.graph()).first().asDict()
    finally:
        spark.catalog.clearCache()
    say("done", 1.0)
    out.seconds = time.time() - began
    return out


def _totals(store: Store, changed: DataFrame, made: DataFrame, before: DataFrame, added: DataFrame) -> DataFrame:
    """Number and length of all chunks, from what it was and what goes and comes."""

    def of(chunks: DataFrame, terms: DataFrame, sign: int) -> DataFrame:
        one, two = chunks.agg(F.count(F.lit(1)).alias("n")), terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
        return one.crossJoin(two).select((F.col("n") * sign).alias("n"), (F.col("length") * sign).alias("length"))

    gone = of(store.read("chunks").join(changed, "note_path", "left_semi"), before.join(changed, "note_path", "left_semi"), -1)
    return store.read("totals").unionByName(gone).unionByName(of(made, added, 1)).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def reindex(spark: SparkSession, root: str, store: Store, path: str, **kw) -> IngestStats:
    """One note: the same delta, restricted to its path; no other file is read."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError("the path leads out of the vault")
    return ingest(spark, root, store, only=[path], **kw)
