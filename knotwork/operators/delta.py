"""Changes between a stored state and what is there now (I01-I03, S08, S09), as joins of two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import graph as g
from knotwork.operators.graph import Graph


def classify(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and status of stored(path, hash, is_unresolved) against current(path, hash).

    added: not stored, or only as a ghost. modified: another hash. unchanged. deleted: stored, no ghost and not there.
    Ghosts that are still not there are none of these.
    """
    old = stored.select("path", F.col("hash").alias("old"), F.col("is_unresolved").alias("ghost"))
    new = current.select("path", F.col("hash").alias("new"), F.lit(True).alias("there"))
    both = old.join(new, "path", "full")
    known = F.col("ghost").isNotNull() & ~F.col("ghost")
    status = F.when(F.col("there").isNull(), F.when(known, "deleted")).when(~known, "added").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def apply(stored: Graph, status: DataFrame, notes: DataFrame, links: DataFrame, note_tags: DataFrame) -> Graph:
    """The graph after the changes, as if notes were taken one after another: deletions, then added and modified ones.

    notes(path, title, hash, mtime), links (src, dst, ...) and note_tags (path, tag) are those of the current
    files; only the ones of added and modified notes are used, links of unchanged notes keep their stored targets.
    """
    of = lambda *s: status.where(F.col("status").isin(*s)).select("path")
    gone, added, fresh = of("deleted"), of("added"), of("added", "modified")
    state = g.delete_notes(stored, gone)
    state = g.without_outgoing(state, of("modified"))
    new_notes = notes.join(fresh, "path", "left_semi").select("path", "title", "hash", "mtime", F.lit(False).alias("is_unresolved"))
    state = Graph(g.merge(state.notes.select(*new_notes.columns), new_notes, "path"), state.links, state.note_tags)
    state = g.reconcile(state, added)
    tags = state.note_tags.select("path", "tag").unionByName(note_tags.join(fresh, "path", "left_semi").select("path", "tag")).distinct()
    fresh_links = links.join(fresh.withColumnRenamed("path", "src"), "src", "left_semi")
    return g.with_links(Graph(state.notes, state.links, tags), fresh_links)


def vector_changes(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """path and status (embed, keep, delete) of tracked(path, mtime) against current(path, mtime): by time only."""
    both = tracked.select("path", F.col("mtime").alias("old"), F.lit(True).alias("was")).join(current.select("path", F.col("mtime").alias("new"), F.lit(True).alias("is")), "path", "full")
    return both.select("path", F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull() | (F.col("old") != F.col("new")), "embed").otherwise("keep").alias("status"))


def replace_chunks(chunks: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks without those of the notes in changed(note_path), and with new ones."""
    return chunks.join(changed.select("note_path").distinct(), "note_path", "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


@dataclass
class Counts:
    added: int = 0
    modified: int = 0
    unchanged: int = 0
    deleted: int = 0


def counts(status: DataFrame) -> Counts:
    return Counts(**{r["status"]: r["count"] for r in status.groupBy("status").count().collect()})
