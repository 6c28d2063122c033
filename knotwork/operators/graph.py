"""The link graph as tables (G01-G23): notes(path, title, hash, mtime, is_unresolved), links(src, dst, anchor, alias,
is_embed), note_tags(path, tag), inferred(src, dst, rel_type, ...). Every function gives a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.config import clamp
from knotwork.functions.text import file_name, note_folder, parent, stem
from knotwork.operators.joins import lookup_join
from knotwork.store import drop_written, written

LINK = ("src", "dst", "anchor", "alias", "is_embed")


@dataclass
class Graph:
    notes: DataFrame
    links: DataFrame
    note_tags: DataFrame


def neighbours(links: DataFrame) -> DataFrame:
    """Distinct undirected edges u, v without loops, both ways."""
    return links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct()


def find_note(notes: DataFrame, identifier: str) -> DataFrame:
    """path of the note meant: its exact path, else the smallest path whose stem or title is the identifier.

    At most one row. Stem and title are compared without case and without the ending .md.
    """
    low = identifier.strip().lower()
    bare = low[:-3] if low.endswith(".md") else low
    fits = F.when(F.col("path") == identifier, 0).when((F.lower(stem("path")) == bare) | (F.lower("title") == bare), 1)
    return notes.select(fits.alias("how"), "path").where("how IS NOT NULL").agg(F.min(F.struct("how", "path")).alias("x")).where("x IS NOT NULL").select("x.path")


def hops(links: DataFrame, focus: DataFrame, most: int = 2, eager: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """path and hop: shortest undirected distances over links from the paths of focus, up to most (1 to 5).

    One join a level, of the last frontier only; paths seen before are taken out by an anti-join. With eager, each
    level is a written table, and the search stops when a frontier is empty. edges are neighbours(links), if they are kept.
    """
    most = clamp(most, 1, 5) if not eager else clamp(most, 1, 10)
    if edges is None:
        edges = written(neighbours(links), "edges") if eager else neighbours(links)
    seen = focus.select("path").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, most + 1):
        near = edges.join(frontier.select(F.col("path").alias("u")), "u").select(F.col("v").alias("path")).distinct()
        frontier = near.join(seen, "path", "left_anti").withColumn("hop", F.lit(h))
        if eager:
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def bridge(links: DataFrame, notes: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """One row source, target, found, hops (-1 if none), path: the shortest undirected path of at most most hops.

    Of several shortest paths, the smallest in order of its notes. source and target are given back as given.
    Each frontier keeps one predecessor a note (the smallest prefix), so it never grows beyond the notes.
    """
    spark = links.sparkSession
    most = clamp(most, 1, 10)
    ends = [r["path"] for x in (source, target) for r in find_note(notes, x).collect()]
    schema = "source string, target string, found boolean, hops int, path array<string>"
    if len(ends) < 2:
        return spark.createDataFrame([(source, target, False, -1, [])], schema)
    a, b = ends
    if a == b:
        return spark.createDataFrame([(source, target, True, 0, [a])], schema)
    edges = written(neighbours(links), "edges")
    seen = spark.createDataFrame([(a, [a])], "path string, way array<string>")
    frontier = seen
    result = None
    for h in range(1, most + 1):
        step = edges.join(frontier.withColumnRenamed("path", "u"), "u").groupBy(F.col("v").alias("path")).agg(F.min("way").alias("before"))
        step = step.join(seen.select("path"), "path", "left_anti").select("path", F.concat("before", F.array("path")).alias("way"))
        frontier = written(step, "frontier")
        hit = frontier.where(F.col("path") == b).first()
        if hit:
            result = (source, target, True, h, hit["way"])
            break
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    drop_written(edges)
    return spark.createDataFrame([result or (source, target, False, -1, [])], schema)


def context_rows(graph: Graph, identifier: str) -> DataFrame:
    """kind (tag, outgoing, backlink, two_hops) and value: what stands around a note, each once, as rows.

    Stays distributed also for a hub with a third of all links.
    """
    focus = find_note(graph.notes, identifier)
    out = graph.links.join(focus.withColumnRenamed("path", "src"), "src", "left_semi").select(F.lit("outgoing").alias("kind"), F.col("dst").alias("value"))
    back = graph.links.join(focus.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.lit("backlink").alias("kind"), F.col("src").alias("value"))
    tags = graph.note_tags.join(focus, "path", "left_semi").select(F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    far = hops(graph.links, focus, 2).where("hop = 2").select(F.lit("two_hops").alias("kind"), F.col("path").alias("value"))
    return out.unionByName(back).unionByName(tags).distinct().unionByName(far)


def context(graph: Graph, identifier: str, most: int = 1000) -> DataFrame:
    """One row about a note for display: path and sorted lists of context_rows(), each of at most its first `most` values.

    n_backlinks and the like give the full counts. Lists are for reading; use context_rows() for all of them.
    """
    focus = find_note(graph.notes, identifier)
    rows = context_rows(graph, identifier)
    # the first values of each kind come from partial limits, so that no list is made of more than those
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).where(F.col("n") <= most)
    names = {"tag": "tags", "outgoing": "outgoing", "backlink": "backlinks", "two_hops": "neighbours_2hop"}
    lists = first.agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in names.items()])
    counts = rows.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in names.items()])
    return focus.crossJoin(F.broadcast(lists)).crossJoin(F.broadcast(counts))


def hubs(graph: Graph, limit: int = 10) -> DataFrame:
    """path, title, backlinks_count: real notes by incoming links; several links of one pair and loops all count."""
    real = graph.notes.where("NOT is_unresolved").select("path", "title")
    counts = graph.links.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("backlinks_count"))
    return counts.join(real, "path").select("path", "title", "backlinks_count").orderBy(F.desc("backlinks_count"), "path").limit(limit)


def tag_counts(note_tags: DataFrame, limit: int | None = None) -> DataFrame:
    """tag and notes_count, most frequent first."""
    out = note_tags.select("path", "tag").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("notes_count"))
    return out if limit is None else out.orderBy(F.desc("notes_count"), "tag").limit(clamp(limit, 1, 200))


def tagged(graph: Graph, tag: str, limit: int = 50) -> DataFrame:
    """path and title of the notes with exactly this tag."""
    own = graph.note_tags.where(F.col("tag") == tag).select("path").distinct()
    return graph.notes.join(own, "path", "left_semi").select("path", "title").orderBy("path").limit(clamp(limit, 1, 500))


def folders(paths: DataFrame) -> DataFrame:
    """path, name and parent (null at the top) of all folders above the notes of paths(path)."""
    own = paths.select(note_folder("path").alias("path")).where("path <> ''").distinct().withColumn("steps", F.split("path", "/"))
    up = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda n: F.array_join(F.slice("steps", 1, n), "/"))).alias("path")).distinct()
    return up.select("path", file_name("path").alias("name"), F.nullif(parent("path"), F.lit("")).alias("parent"))


def contained(paths: DataFrame) -> DataFrame:
    """path and folder of the notes that are in one."""
    return paths.select("path", note_folder("path").alias("folder")).where("folder <> ''").distinct()


def stats(graph: Graph) -> DataFrame:
    """One row of counts: notes, unresolved, tags, folders, links, tagged_with, contained_in."""
    one = graph.notes.agg(F.count(F.lit(1)).alias("notes"), F.count_if("is_unresolved").alias("unresolved"))
    two = graph.note_tags.agg(F.countDistinct("tag").alias("tags"), F.countDistinct("path", "tag").alias("tagged_with"))
    three = folders(graph.notes).agg(F.count(F.lit(1)).alias("folders"))
    four = graph.links.agg(F.count(F.lit(1)).alias("links"))
    five = contained(graph.notes).agg(F.count(F.lit(1)).alias("contained_in"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four).crossJoin(five)


def overview(graph: Graph, limit: int = 10) -> DataFrame:
    """Rows section (stat, hub, tag), name, n and place."""
    s = stats(graph)
    stat = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in s.columns])).alias("x")).select(F.lit("stat").alias("section"), "x.name", "x.n", F.lit(0).alias("place"))

    def ranked(df: DataFrame, section: str, name: str, n: str) -> DataFrame:
        one = df.agg(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(name).alias("name")))).alias("xs")).select(F.posexplode("xs").alias("p", "x"))
        return one.select(F.lit(section).alias("section"), "x.name", (-F.col("x.n")).alias("n"), (F.col("p") + 1).alias("place"))

    return stat.unionByName(ranked(hubs(graph, limit), "hub", "path", "backlinks_count")).unionByName(ranked(tag_counts(graph.note_tags, limit), "tag", "tag", "notes_count"))


# --- changes -------------------------------------------------------------------------------------------------


def ghosts(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Targets of links that are no note, as unresolved notes with their stem as title."""
    missing = links.select(F.col("dst").alias("path")).distinct().join(notes.select("path"), "path", "left_anti")
    return missing.select("path", stem("path").alias("title"), F.lit("").alias("hash"), F.lit(0.0).alias("mtime"), F.lit(True).alias("is_unresolved"))


def merge(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new, and those of old whose key is not in new."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def with_links(graph: Graph, new: DataFrame) -> Graph:
    """New links, once each, and ghosts for their missing targets."""
    links = graph.links.select(*LINK).unionByName(new.select(*LINK)).distinct()
    return Graph(graph.notes.unionByName(ghosts(links, graph.notes)), links, graph.note_tags)


def without_outgoing(graph: Graph, paths: DataFrame) -> Graph:
    gone = paths.select("path").distinct()
    return Graph(graph.notes, graph.links.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").select(*LINK), graph.note_tags.join(gone, "path", "left_anti"))


def delete_notes(graph: Graph, paths: DataFrame) -> Graph:
    """Outgoing links of all deleted notes go first; then a note that is still linked to stays as a ghost."""
    bare = without_outgoing(graph, paths)
    gone = paths.select("path").distinct().withColumn("gone", F.lit(True))
    linked = bare.links.select(F.col("dst").alias("path")).distinct().withColumn("linked", F.lit(True))
    marked = bare.notes.join(gone, "path", "left").join(linked, "path", "left").where("gone IS NULL OR linked")
    ghost = F.col("gone").isNotNull()
    notes = marked.select("path", "title", F.when(ghost, F.lit("")).otherwise(F.col("hash")).alias("hash"), F.when(ghost, F.lit(0.0)).otherwise(F.col("mtime")).alias("mtime"), (ghost | F.col("is_unresolved")).alias("is_unresolved"))
    return Graph(notes, bare.links, bare.note_tags)


def reconcile(graph: Graph, added: DataFrame) -> Graph:
    """Ghosts whose stem is that of an added note become it: links to them lead to it, once each.

    Of several added notes of one stem, the smallest path takes the ghosts.
    """
    real = added.select(F.lower(stem("path")).alias("key"), "path").groupBy("key").agg(F.min("path").alias("real"))
    merged = graph.notes.where("is_unresolved").select(F.lower(stem("path")).alias("key"), "path").join(real, "key").where("path <> real").select(F.col("path").alias("dst"), "real")
    moved = lookup_join(graph.links, merged, "dst").select("src", F.coalesce("real", "dst").alias("dst"), "anchor", "alias", "is_embed").distinct()
    return Graph(graph.notes.join(merged.select(F.col("dst").alias("path")), "path", "left_anti"), moved, graph.note_tags)


# --- inferred relations --------------------------------------------------------------------------------------


def inferred_of(inferred: DataFrame, path: str) -> DataFrame:
    """Relations that touch the note, in their true direction, with the other note."""
    return inferred.where((F.col("src") == path) | (F.col("dst") == path)).withColumn("other_path", F.when(F.col("src") == path, F.col("dst")).otherwise(F.col("src")))


def inferred_neighbours(inferred: DataFrame, path: str) -> DataFrame:
    return inferred_of(inferred, path).select(F.col("other_path").alias("path")).distinct()


def inferred_pairs(inferred: DataFrame) -> DataFrame:
    """Undirected pairs a < b that have a relation."""
    return inferred.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def add_inferred(inferred: DataFrame, new: DataFrame) -> DataFrame:
    """New relations, unless the same pair has one of that kind; of equal new ones, that of the highest confidence."""
    rest = [c for c in new.columns if c not in ("src", "dst", "rel_type")]
    once = new.groupBy("src", "dst", "rel_type").agg(F.max_by(F.struct(*rest), F.struct("confidence", *[c for c in rest if c != "confidence"])).alias("x")).select("src", "dst", "rel_type", "x.*")
    return inferred.unionByName(once.join(inferred, ["src", "dst", "rel_type"], "left_anti").select(*inferred.columns))


def inferred_exists(inferred: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with known: whether the two have a relation, in either direction."""
    both = inferred_pairs(inferred).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("__known"))
    rows = pairs.withColumn("__a", F.least("a", "b")).withColumn("__b", F.greatest("a", "b")).join(both, ["__a", "__b"], "left")
    return rows.select(*pairs.columns, F.coalesce("__known", F.lit(False)).alias("known"))


def live_tags(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    """The rows of tags(tag, ...) that a note still has; the others are orphans and go."""
    return tags.join(note_tags.select("tag").distinct(), "tag", "left_semi").select(*tags.columns)
