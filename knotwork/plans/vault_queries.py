"""Queries over the driver's tables for every operator that is not a problem of its own, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import relations, text
from knotwork.operators import cache, delta, evalir, limiter
from knotwork.operators import graph as g
from knotwork.operators import relatedness as rel
from knotwork.operators import retrieval as r
from knotwork.operators.resolve import LinkIndex, normal_path, resolve_by_name, resolve_by_path
from knotwork.plans import discover
from knotwork.plans.search import Library, search
from knotwork.sources import vault
from knotwork.sources.tables import table
from knotwork.store import Files, kept, written
from knotwork.streaming.sync import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The state that deltas start from.
BEFORE = "2025-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- the tables as a vault -----------------------------------------------------------------------------------


def notes_now(spark: SparkSession, d: str) -> DataFrame:
    """The last life of every path, if it has no end."""
    rows = table(spark, d, "notes", "path", "title", "hash", "mtime", "is_unresolved", "ingested_at", "deleted_at").where("trim(path) <> ''")
    last = rows.groupBy("path").agg(F.max(F.struct("ingested_at", F.coalesce("deleted_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("gone"), F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.coalesce("is_unresolved", F.lit(False)).alias("is_unresolved"))).alias("x"))
    return last.where("x.gone = TIMESTAMP_NTZ '9999-12-31'").select("path", "x.title", "x.hash", "x.mtime", "x.is_unresolved")


def links_now(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "resolved_links", "source_path", "target_path", "anchor", "alias", "is_embed").where("trim(source_path) <> '' AND trim(target_path) <> ''")
    return rows.select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("is_embed", F.lit(False)).alias("is_embed")).distinct()


def tags_now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_tags", "note_path", "tag").where("trim(tag) <> '' AND trim(note_path) <> ''").select(F.col("note_path").alias("path"), "tag").distinct()


def graph_now(spark: SparkSession, d: str) -> g.Graph:
    notes, links = notes_now(spark, d), links_now(spark, d)
    return g.Graph(notes.unionByName(g.ghosts(links, notes)), links, tags_now(spark, d))


def notes_at(spark: SparkSession, d: str, at: str | None) -> DataFrame:
    """path, hash, is_unresolved of the real notes alive at a time, or (None) at the end."""
    rows = table(spark, d, "notes", "path", "hash", "is_unresolved", "ingested_at", "deleted_at").where("trim(path) <> '' AND NOT is_unresolved")
    alive = rows.where("deleted_at IS NULL") if at is None else rows.where(f"ingested_at <= TIMESTAMP_NTZ '{at}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP_NTZ '{at}')")
    return alive.groupBy("path").agg(F.max("hash").alias("hash")).withColumn("is_unresolved", F.lit(False))


def chunks_now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each chunk once, only with the columns named: duplicates are dropped after the scan is narrowed."""
    names = columns or ("note_path", "note_title", "heading", "text", "vector", "mtime")
    return table(spark, d, "chunks", "chunk_id", *names).where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])


def unit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """id, note, text and unit vector of the chunks with a usable vector."""
    rows = table(spark, d, "chunks", "chunk_id", "note_path", "text", "vector").where("chunk_id IS NOT NULL AND trim(note_path) <> ''").where(r.usable("vector", 64)).dropDuplicates(["chunk_id"])
    return rows.select(F.col("chunk_id").alias("id"), F.col("note_path").alias("note"), "text", r.scaled("vector").alias("vector"))


def library(spark: SparkSession, d: str) -> Library:
    """The tables as an index that is kept: postings by term, unit vectors, graph and its edges. Made once, and again after a change."""
    files = Files(spark)
    stamp = tuple(files.changed(f"{d}/{n}.parquet") for n in ("chunks", "notes", "resolved_links", "note_tags"))

    def build() -> dict[str, DataFrame]:
        unit, graph = written(unit_chunks(spark, d), "unit"), graph_now(spark, d)
        # the search takes stored vectors as they are, so it is given unit vectors
        chunks = chunks_now(spark, d).drop("vector").join(unit.select(F.col("id").alias("chunk_id"), "vector"), "chunk_id", "left")
        chunks = written(chunks.select("chunk_id", "note_path", "note_title", "heading", "text", "vector"), "library")
        index = r.lexical_index(chunks, "chunk_id")
        notes, links, tags = written(graph.notes, "notes"), written(graph.links, "links"), written(graph.note_tags, "tags")
        return {"unit": unit, "chunks": chunks, "postings": index.postings, "totals": index.totals, "notes": notes, "links": links, "tags": tags, "edges": written(g.neighbours(links), "edges")}

    t = kept(spark, ("library", d, stamp), build)
    lib = Library(t["chunks"], r.LexicalIndex.of(t["postings"], t["totals"]), r.HashingEmbedder(64), g.Graph(t["notes"], t["links"], t["tags"]), t["edges"])
    lib.unit = t["unit"]
    return lib


def top_hub(spark: SparkSession, d: str) -> tuple[str, str]:
    row = table(spark, d, "hub_notes", "path", "title", "backlinks_count").orderBy(F.desc("backlinks_count"), "path").first()
    return (row["path"], row["title"] or "") if row else ("", "")


def last_hub(spark: SparkSession, d: str) -> str:
    row = table(spark, d, "hub_notes", "path", "backlinks_count").orderBy("backlinks_count", F.desc("path")).first()
    return row["path"] if row else ""


_NOTES = """
last AS (SELECT path, max(struct_pack(a := ingested_at, gone := coalesce(deleted_at, TIMESTAMP '9999-12-31'), hash := coalesce(hash, ''), title := coalesce(title, ''), mtime := coalesce(mtime, 0), is_unresolved := coalesce(is_unresolved, false))) AS x FROM notes WHERE trim(path) <> '' GROUP BY path),
cur AS (SELECT path, x.title AS title, x.hash AS hash, x.mtime AS mtime, x.is_unresolved AS is_unresolved FROM last WHERE x.gone = TIMESTAMP '9999-12-31'),
links AS (SELECT DISTINCT source_path AS src, target_path AS dst, coalesce(anchor, '') AS anchor, coalesce(alias, '') AS alias, coalesce(is_embed, false) AS is_embed FROM resolved_links WHERE trim(source_path) <> '' AND trim(target_path) <> ''),
tags AS (SELECT DISTINCT note_path AS path, tag FROM note_tags WHERE trim(tag) <> '' AND trim(note_path) <> ''),
ghosts AS (SELECT DISTINCT dst AS path, regexp_replace(string_split(dst, '/')[-1], '(.)\\.[^./]*$', '\\1') AS title FROM links WHERE dst NOT IN (SELECT path FROM cur)),
alln AS (SELECT path, title, hash, mtime, is_unresolved FROM cur UNION ALL SELECT path, title, '', 0, true FROM ghosts),
held AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.')[:-2] AS ps FROM alln),
folders0 AS (SELECT DISTINCT array_to_string(ps[1:n], '/') AS path FROM (SELECT ps, unnest(range(1, len(ps) + 1)) AS n FROM held)),
counts AS (SELECT dst AS path, count(*) AS n FROM links GROUP BY dst),
hub AS (SELECT c.path, a.title, c.n AS backlinks_count FROM counts c JOIN alln a ON a.path = c.path WHERE NOT a.is_unresolved ORDER BY c.n DESC, c.path),
tagn AS (SELECT tag, count(*) AS notes_count FROM tags GROUP BY tag),
top_hub AS (SELECT path, coalesce(title, '') AS title FROM hub_notes ORDER BY backlinks_count DESC, path LIMIT 1),
last_hub AS (SELECT path FROM hub_notes ORDER BY backlinks_count, path DESC LIMIT 1),
edges AS (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM links UNION ALL SELECT dst, src FROM links) WHERE u <> v)
"""
_G = "WITH " + _NOTES
_HOPS = (
    _G
    + """,
focus AS (SELECT path FROM alln WHERE path = (SELECT path FROM top_hub)),
h1 AS (SELECT DISTINCT v AS path FROM edges WHERE u IN (FROM focus) AND v NOT IN (FROM focus)),
h2 AS (SELECT DISTINCT v AS path FROM edges WHERE u IN (FROM h1) AND v NOT IN (FROM focus) AND v NOT IN (FROM h1)),
h3 AS (SELECT DISTINCT v AS path FROM edges WHERE u IN (FROM h2) AND v NOT IN (FROM focus) AND v NOT IN (FROM h1) AND v NOT IN (FROM h2)),
hops AS (SELECT path, 0 AS hop FROM focus UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2)
"""
)

# --- graph ---------------------------------------------------------------------------------------------------

_STATS = "SELECT (SELECT count(*) FROM alln) AS notes, (SELECT count(*) FROM alln WHERE is_unresolved) AS unresolved, (SELECT count(DISTINCT tag) FROM tags) AS tags, (SELECT count(*) FROM tags) AS tagged_with, (SELECT count(*) FROM folders0) AS folders, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM held WHERE len(ps) > 0) AS contained_in"


@query(_G + _STATS)
def graph_stats(spark, d):
    return g.stats(graph_now(spark, d))


@query(_G + "SELECT path, title, backlinks_count FROM hub ORDER BY backlinks_count DESC, path LIMIT 24")
def hubs(spark, d):
    return g.hubs(graph_now(spark, d), 24)


@query(_G + "SELECT path, n AS backlinks_count FROM counts")
def backlink_counts(spark, d):
    return links_now(spark, d).groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("backlinks_count"))


@query(_G + "SELECT tag, notes_count FROM tagn ORDER BY notes_count DESC, tag LIMIT 50")
def top_tags(spark, d):
    return g.tag_counts(tags_now(spark, d), 50)


@query(_G + "SELECT tag, notes_count FROM tagn")
def tag_counts(spark, d):
    return g.tag_counts(tags_now(spark, d))


@query(_G + ", s AS (" + _STATS + """)
SELECT 'stat' AS section, name, n::BIGINT AS n, 0 AS place FROM s UNPIVOT (n FOR name IN (notes, unresolved, tags, tagged_with, folders, links, contained_in))
UNION ALL SELECT 'hub', path, backlinks_count, row_number() OVER (ORDER BY backlinks_count DESC, path) FROM (FROM hub ORDER BY backlinks_count DESC, path LIMIT 10)
UNION ALL SELECT 'tag', tag, notes_count, row_number() OVER (ORDER BY notes_count DESC, tag) FROM (FROM tagn ORDER BY notes_count DESC, tag LIMIT 10)""")
def vault_overview(spark, d):
    return g.overview(graph_now(spark, d), 10)


@query(_G + "SELECT path, title FROM ghosts")
def ghost_notes(spark, d):
    return g.ghosts(links_now(spark, d), notes_now(spark, d)).select("path", "title")


@query(_G + ", t AS (SELECT tag FROM tagn ORDER BY notes_count DESC, tag LIMIT 1) SELECT path, title FROM alln WHERE path IN (SELECT path FROM tags WHERE tag = (SELECT tag FROM t)) ORDER BY path LIMIT 500")
def notes_by_tag(spark, d):
    graph = graph_now(spark, d)
    row = g.tag_counts(graph.note_tags, 1).first()
    return g.tagged(graph, row["tag"] if row else "", 500)


@query(_HOPS + "SELECT path, hop FROM hops")
def kh_neighbors(spark, d):
    graph = graph_now(spark, d)
    return g.hops(graph.links, graph.notes.where(F.col("path") == top_hub(spark, d)[0]), 2)


@query(_HOPS + "SELECT hop, count(*) AS n FROM (FROM hops UNION ALL SELECT path, 3 FROM h3) GROUP BY hop")
def hop_histogram(spark, d):
    graph = graph_now(spark, d)
    return g.hops(graph.links, graph.notes.where(F.col("path") == top_hub(spark, d)[0]), 3, eager=True).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


@query(_HOPS.replace("WITH", "WITH RECURSIVE", 1) + """, goal AS (SELECT path FROM last_hub),
d1 AS (SELECT path, 0 AS h FROM focus), dist AS (SELECT path, h FROM d1 UNION SELECT e.v, h + 1 FROM dist JOIN edges e ON e.u = dist.path WHERE h < 5),
low AS (SELECT path, min(h) AS h FROM dist GROUP BY path),
ways AS (SELECT path, 0 AS h, [path] AS p FROM focus
  UNION ALL SELECT v, h, min(p) FROM (SELECT e.v, w.h + 1 AS h, list_append(w.p, e.v) AS p FROM ways w JOIN edges e ON e.u = w.path JOIN low l ON l.path = e.v AND l.h = w.h + 1) GROUP BY v, h)
SELECT (SELECT path FROM top_hub) AS source, (SELECT path FROM goal) AS target, hops >= 0 AS found, hops, path FROM (SELECT h AS hops, array_to_string(p, ' > ') AS path, h AS k FROM ways WHERE path = (SELECT path FROM goal) UNION ALL SELECT -1, '', 99) ORDER BY k LIMIT 1""")
def shortest_path(spark, d):
    graph = graph_now(spark, d)
    return g.bridge(graph.links, graph.notes, top_hub(spark, d)[0], last_hub(spark, d)).withColumn("path", F.array_join("path", " > "))


@query(_HOPS + """SELECT 'outgoing' AS kind, dst AS value FROM links WHERE src IN (FROM focus) UNION SELECT 'backlink', src FROM links WHERE dst IN (FROM focus)
UNION SELECT 'tag', tag FROM tags WHERE path IN (FROM focus) UNION SELECT 'two_hops', path FROM h2""")
def note_context(spark, d):
    return g.context_rows(graph_now(spark, d), top_hub(spark, d)[0])


@query(_G + ", f AS (SELECT path, CASE WHEN lower(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^./]*$', '\\1')) = lower((SELECT title FROM top_hub)) OR lower(title) = lower((SELECT title FROM top_hub)) THEN 1 END AS how FROM alln) SELECT min(path) AS path FROM f WHERE how = 1 HAVING min(path) IS NOT NULL")
def resolve_identifier(spark, d):
    return g.find_note(graph_now(spark, d).notes, top_hub(spark, d)[1])


@query(_G + "SELECT path, string_split(path, '/')[-1] AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM folders0")
def folder_hierarchy(spark, d):
    return g.folders(graph_now(spark, d).notes)


@query(_G + "SELECT path, array_to_string(ps, '/') AS folder FROM held WHERE len(ps) > 0")
def note_folders(spark, d):
    return g.contained(graph_now(spark, d).notes)


@query(_G + "SELECT path FROM cur WHERE starts_with(path, 'projects/') AND regexp_matches(lower(string_split(path, '/')[-1]), '^.*a.*\\.md$') ORDER BY path LIMIT 200")
def list_notes_glob(spark, d):
    return vault.list_notes(notes_now(spark, d).withColumn("content", F.col("title")), "projects", "*a*.md", 200).select("path")


_INF = ", inferred AS (SELECT DISTINCT src, dst, CASE WHEN is_embed THEN 'EXTENDS' WHEN anchor <> '' THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS rel_type FROM links WHERE src <> dst)"


def _inferred(spark, d) -> DataFrame:
    kind = F.when(F.col("is_embed"), "EXTENDS").when(F.col("anchor") != "", "CONTRADICTS").otherwise("SUPPORTS")
    return links_now(spark, d).where("src <> dst").select("src", "dst", kind.alias("rel_type")).distinct()


@query(_G + _INF + " SELECT src, dst, rel_type, CASE WHEN src = (SELECT path FROM top_hub) THEN dst ELSE src END AS other_path FROM inferred WHERE src = (SELECT path FROM top_hub) OR dst = (SELECT path FROM top_hub)")
def inferred_undirected(spark, d):
    return g.inferred_of(_inferred(spark, d), top_hub(spark, d)[0])


@query(_G + _INF + " SELECT src, dst, rel_type, max(n) AS confidence FROM (SELECT src, dst, rel_type, 0 AS n FROM inferred WHERE rel_type = 'EXTENDS' UNION ALL SELECT src, dst, rel_type, 1 FROM inferred WHERE rel_type <> 'EXTENDS') GROUP BY ALL")
def inferred_insert(spark, d):
    every = _inferred(spark, d)
    old = every.where("rel_type = 'EXTENDS'").withColumn("confidence", F.lit(0))
    return g.add_inferred(old, every.withColumn("confidence", F.lit(1)))


# --- text ----------------------------------------------------------------------------------------------------

_CH = "ch AS (SELECT chunk_id, any_value(note_path) AS note_path, any_value(note_title) AS note_title, any_value(heading) AS heading, any_value(text) AS text, any_value(vector) AS vector FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"


@query("WITH " + _CH + r""", ls AS (SELECT chunk_id, trim(replace(unnest(string_split_regex(text, '\r\n|\r|\n')), chr(9), ' ')) AS s, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS line FROM ch WHERE text IS NOT NULL)
SELECT chunk_id, line::INT AS line, length(regexp_extract(s, '^(#{1,6})\s+(.*)$', 1))::INT AS level, trim(regexp_extract(s, '^(#{1,6})\s+(.*)$', 2)) AS title FROM ls WHERE regexp_matches(s, '^(#{1,6})\s+(.*)$')""")
def outline_lines(spark, d):
    return chunks_now(spark, d, "text").select("chunk_id", F.explode(text.outline("text")).alias("x")).select("chunk_id", "x.*")


_LINK = r"(!)?\[\[([^\[\]|\n#]+)?(?:#([^\[\]|\n]+))?(?:\|([^\[\]|\n]+))?\]\]"


@query("SELECT DISTINCT link_id, trim(coalesce(regexp_extract(raw, p, 2), '')) AS target, trim(coalesce(regexp_extract(raw, p, 3), '')) AS anchor, trim(coalesce(regexp_extract(raw, p, 4), '')) AS alias, starts_with(raw, '!') AS is_embed FROM (SELECT link_id, regexp_extract(raw_text, '" + _LINK + "') AS raw, '" + _LINK + "' AS p FROM wikilinks) WHERE raw <> ''".replace(", p, 2", ", '" + _LINK + "', 2").replace(", p, 3", ", '" + _LINK + "', 3").replace(", p, 4", ", '" + _LINK + "', 4"))
def link_extract(spark, d):
    rows = table(spark, d, "wikilinks", "link_id", "raw_text").distinct()
    return rows.select("link_id", F.explode(text.note_links("raw_text")).alias("x")).select("link_id", "x.target", "x.anchor", "x.alias", "x.is_embed").distinct()


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '""" + _LINK + r"""', '', 'g'), '(!)?\[([^\]\n]+)\]\(([^)\n]+)\)', '', 'g'), '(?:^|[\s(\[{])#([a-zA-Z0-9_\-/]*[a-zA-Z_\-/][a-zA-Z0-9_\-/]*)', 1), lambda t: regexp_replace(t, '[.,;!?:]+$', '')), lambda t: t <> ''))), ' ') AS tags FROM documents WHERE text IS NOT NULL""")
def tag_extract(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.array_join(text.inline_tags("text"), " ").alias("tags"))


@query("WITH " + _CH + r""" SELECT chunk_id, md5(regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', '', 'g'), '`[^`\n]+`', '', 'g')) AS masked FROM ch WHERE text IS NOT NULL""")
def code_mask(spark, d):
    return chunks_now(spark, d, "text").where("text IS NOT NULL").select("chunk_id", F.md5(text.mask_code("text")).alias("masked"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def sha256_index(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query(r"SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\s\v\x{85}\p{Z}]+')))::BIGINT AS words, greatest(1, floor(length(coalesce(text, '')) / 3.8)::INT + 10)::BIGINT AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.word_estimate(F.coalesce("text", F.lit(""))).cast("bigint").alias("words"), text.token_estimate(F.coalesce("text", F.lit(""))).cast("bigint").alias("tokens"))


@query("WITH " + _CH + r""" SELECT chunk_id, trim(regexp_replace(string_split_regex(heading, '\s+>\s+')[-1], '^#+\s*', '')) AS leaf, lower(trim(regexp_replace(regexp_replace(regexp_replace(heading, '^#+\s*', ''), '[*_~`]', '', 'g'), '\s+', ' ', 'g'))) AS plain FROM ch WHERE heading IS NOT NULL""")
def heading_forms(spark, d):
    return chunks_now(spark, d, "heading").where("heading IS NOT NULL").select("chunk_id", text.leaf_heading("heading").alias("leaf"), text.plain_heading("heading").alias("plain"))


@query("WITH " + _CH + r""" SELECT chunk_id, CASE WHEN length(c) > 80 THEN rtrim(left(c, 80)) || '…' ELSE c END AS excerpt FROM (SELECT chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM ch WHERE text IS NOT NULL)""")
def excerpts(spark, d):
    return chunks_now(spark, d, "text").where("text IS NOT NULL").select("chunk_id", text.excerpt("text", 80).alias("excerpt"))


# --- links ---------------------------------------------------------------------------------------------------


def _index(spark, d) -> LinkIndex:
    rows = table(spark, d, "notes", "path", "aliases", "is_unresolved", "deleted_at").where("trim(path) <> '' AND NOT is_unresolved AND deleted_at IS NULL")
    return LinkIndex.of(rows.select("path", "aliases"))


def _wikilinks(spark, d) -> DataFrame:
    return table(spark, d, "wikilinks", "link_id", "source_path", "target").where("link_id IS NOT NULL AND trim(source_path) <> ''").groupBy("link_id").agg(F.min(F.struct("source_path", F.coalesce("target", F.lit("")).alias("target"))).alias("x")).select("link_id", "x.*")


_RES = r"""WITH real AS (SELECT DISTINCT path, aliases FROM notes WHERE trim(path) <> '' AND NOT is_unresolved AND deleted_at IS NULL),
paths AS (SELECT lower(path) AS key, min(path) AS path FROM real GROUP BY 1),
names AS (SELECT DISTINCT lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^./]*$', '\1')) AS key, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, path, len(string_split(path, '/')) AS depth FROM real),
als AS (SELECT lower(trim(a)) AS key, min(path) AS path FROM (SELECT path, unnest(aliases) AS a FROM real) WHERE trim(a) <> '' GROUP BY 1),
w0 AS (SELECT link_id, min(struct_pack(s := source_path, t := coalesce(target, ''))) AS x FROM wikilinks WHERE link_id IS NOT NULL AND trim(source_path) <> '' GROUP BY link_id),
w AS (SELECT link_id, x.s AS source_path, x.t AS target, CASE WHEN contains(x.s, '/') THEN regexp_replace(x.s, '/[^/]*$', '') ELSE '' END AS folder, replace(trim(url_decode(trim(x.t))), '\', '/') AS u FROM w0),
"""


@query(_RES + r"""n AS (SELECT *, regexp_replace(regexp_replace(u, '^/+', ''), '^\./', '') AS norm FROM w),
m AS (SELECT *, CASE WHEN ends_with(norm, '.md') THEN norm ELSE norm || '.md' END AS md, lower(regexp_replace(string_split(norm, '/')[-1], '\.md$', '', 'i')) AS base FROM n),
j AS (SELECT m.*, a.path AS p1, b.path AS p2, c.path AS p3, (SELECT min(path) FROM names x WHERE x.key = m.base AND x.folder = m.folder) AS p4, s.path AS p5, l.path AS p6 FROM m
  LEFT JOIN paths a ON a.key = lower(md) LEFT JOIN paths b ON b.key = lower(norm) LEFT JOIN paths c ON folder <> '' AND c.key = lower(folder || '/' || md)
  LEFT JOIN (SELECT key, (min(struct_pack(d := depth, p := path))).p AS path FROM names GROUP BY key) s ON s.key = base LEFT JOIN als l ON l.key = lower(norm)),
f AS (SELECT *, CASE WHEN norm = '' THEN source_path ELSE coalesce(p1, p2, p3, p4, p5, p6) END AS found, CASE WHEN regexp_matches(lower(norm), '\.(png|jpg|jpeg|gif|svg|pdf|mp3|webp)$') THEN norm ELSE md END AS named FROM j)
SELECT link_id, coalesce(found, CASE WHEN NOT contains(norm, '/') AND folder <> '' THEN folder || '/' || named ELSE named END) AS target_path, found IS NULL AS is_unresolved,
  CASE WHEN norm = '' THEN 'self' WHEN coalesce(p1, p2) IS NOT NULL THEN 'root' WHEN p3 IS NOT NULL THEN 'folder' WHEN p5 IS NOT NULL THEN 'name' WHEN p6 IS NOT NULL THEN 'alias' ELSE 'ghost' END AS step FROM f""")
def link_resolution_cascade(spark, d):
    return resolve_by_name(_wikilinks(spark, d), _index(spark, d)).select("link_id", "target_path", "is_unresolved", "step")


@query("SELECT DISTINCT target_path, CASE WHEN p = '' THEN '.' ELSE p END AS normal FROM (SELECT target_path, array_to_string(list_filter(string_split(target_path, '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM resolved_links WHERE target_path IS NOT NULL AND NOT contains(target_path, '..'))")
def path_normalised(spark, d):
    rows = table(spark, d, "resolved_links", "target_path").where("target_path IS NOT NULL AND NOT contains(target_path, '..')").distinct()
    return rows.select("target_path", normal_path(F.col("target_path")).alias("normal"))


# --- retrieval -----------------------------------------------------------------------------------------------

_BM = "WITH " + _CH + r""",
ts AS (SELECT chunk_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '') AS ts FROM ch),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM ts),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM ts) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT path AS query_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM hub_notes WHERE title IS NOT NULL),
bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 20),
unit AS (SELECT chunk_id AS id, note_path, text, list_transform(vector, lambda x: x::DOUBLE / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[]))) AS v FROM ch WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
qv AS (SELECT query_id, v FROM (SELECT h.path AS query_id, u.v, row_number() OVER (PARTITION BY h.path ORDER BY u.id) AS k FROM hub_notes h JOIN unit u ON u.note_path = h.path) WHERE k = 1),
dense AS (SELECT * FROM (SELECT query_id, id, 1 - s AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM (SELECT q.query_id, u.id, list_dot_product(q.v, u.v) AS s FROM qv q, unit u)) WHERE rank <= 20),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS rank FROM (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, round(coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + s.rank), 0), 6) AS score, d.rank AS dense_rank, s.rank AS sparse_rank FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id))
"""


def _hub_queries(spark, d) -> DataFrame:
    return table(spark, d, "hub_notes", "path", "title").where("title IS NOT NULL").select(F.col("path").alias("query_id"), F.col("title").alias("text")).distinct()


def _sparse(spark, d, k: int | None = 20) -> DataFrame:
    return r.bm25(library(spark, d).index, _hub_queries(spark, d), k)


def _dense(spark, d, k: int = 20) -> DataFrame:
    unit = library(spark, d).unit
    own = table(spark, d, "hub_notes", "path").distinct().join(unit, F.col("path") == F.col("note")).groupBy("path").agg(F.min_by("vector", "id").alias("vector"))
    near = r.knn_join(unit, k, queries=own.withColumnRenamed("path", "id"))
    return near.select(F.col("a").alias("query_id"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("distance"), "rank")


@query(_BM + "SELECT query_id, id, round(score, 4) AS score, rank FROM sparse")
def bm25_topk(spark, d):
    return _sparse(spark, d).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(_BM + "SELECT query_id, id, round(distance, 6) + 0.0::DOUBLE AS distance, rank FROM dense")
def dense_topk_cosine(spark, d):
    return _dense(spark, d).withColumn("distance", F.round("distance", 6) + 0.0)


@query("WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], v::DOUBLE[]), 6) AS distance FROM embeddings, q ORDER BY round(list_distance(embedding::DOUBLE[], v::DOUBLE[]), 9), vec_id LIMIT 10")
def dense_topk_l2(spark, d):
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    first = rows.orderBy("vec_id").first()
    return r.dense_top(rows, list(first["embedding"]) if first else [0.0], 10, "l2", "vec_id", "embedding").select("id", F.round("distance", 6).alias("distance"))


@query("SELECT a, b, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x, embeddings y)) WHERE rank <= 20")
def knn_join_top20(spark, d):
    return r.knn_join(table(spark, d, "embeddings", "vec_id", "embedding"), 20, id_column="vec_id", vector="embedding").withColumn("similarity", F.round("similarity", 6))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id < y.vec_id AND list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35")
def cosine_pairs_floor(spark, d):
    near = r.knn_join(table(spark, d, "embeddings", "vec_id", "embedding"), None, 0.35, id_column="vec_id", vector="embedding")
    return near.where("a < b").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_BM + "SELECT query_id, id, score, dense_rank, sparse_rank, rank FROM fused")
def rrf_fuse(spark, d):
    return r.fuse(_dense(spark, d), _sparse(spark, d)).select("query_id", "id", "score", "dense_rank", "sparse_rank", "rank")


@query(_BM + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k, id) AS rank FROM (SELECT query_id, id, round(1 / (1 + distance), 6) AS score, rank AS k FROM dense)")
def single_mode_dense(spark, d):
    return r.single_mode(_dense(spark, d), "dense").select("query_id", "id", "score", "rank")


@query(_BM + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k, id) AS rank FROM (SELECT query_id, id, round(score, 4) AS score, rank AS k FROM sparse)")
def single_mode_sparse(spark, d):
    s = _sparse(spark, d).withColumn("score", F.round("score", 4))
    return r.single_mode(s, "sparse").select("query_id", "id", "score", "rank")


_BOOST = _BM + "," + _HOPS.replace("WITH", "", 1) + """,
boosted AS (SELECT f.query_id, f.id, c.note_path, hop, round(score * CASE hop WHEN 0 THEN 1.4 WHEN 1 THEN 1.25 WHEN 2 THEN 1.1 ELSE 1.0 END, 6) AS score, f.rank AS k FROM fused f JOIN ch c ON c.chunk_id = f.id LEFT JOIN hops h ON h.path = c.note_path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k, id) AS rank FROM boosted)
"""


def _boosted(spark, d) -> DataFrame:
    lib = library(spark, d)
    fused = r.fuse(_dense(spark, d), _sparse(spark, d)).join(lib.chunks.select(F.col("chunk_id").alias("id"), "note_path"), "id")
    return r.boost(fused, g.hops(lib.graph.links, lib.graph.notes.where(F.col("path") == top_hub(spark, d)[0]), 2, edges=lib.edges))


@query(_BOOST + "SELECT query_id, id, score, hop AS hop_distance, rank FROM ranked")
def graph_boost(spark, d):
    return _boosted(spark, d).select("query_id", "id", "score", "hop_distance", "rank")


@query(_BOOST + "SELECT query_id, id, score, rank FROM ranked WHERE lower(note_path) = 'projects' OR starts_with(lower(note_path), 'projects/')")
def folder_filter(spark, d):
    return _boosted(spark, d).where(r.in_folder(F.col("note_path"), "Projects/")).select("query_id", "id", "score", "rank")


@query(_BOOST + ", wanted AS (SELECT lower(tag) AS tag FROM (FROM tagn ORDER BY notes_count DESC, tag LIMIT 2)) SELECT query_id, id, score, rank FROM ranked WHERE lower(note_path) IN (SELECT lower(path) FROM tags WHERE lower(tag) IN (FROM wanted))")
def tag_filter_any(spark, d):
    names = [x["tag"] for x in g.tag_counts(tags_now(spark, d), 2).collect()]
    return r.with_any_tag(_boosted(spark, d), tags_now(spark, d).withColumnRenamed("path", "note_path"), names).select("query_id", "id", "score", "rank")


@query(_BOOST.replace("rank <= 20", "rank <= 50") + " SELECT id AS chunk_id, note_path, score, hop AS hop_distance FROM ranked WHERE query_id = (SELECT path FROM hub_notes WHERE path IN (SELECT query_id FROM qv) AND title IS NOT NULL ORDER BY backlinks_count DESC, path LIMIT 1) AND starts_with(lower(note_path), 'projects/') ORDER BY rank LIMIT 10")
def hybrid_search_near(spark, d):
    """Title and first vector of the best-linked hub that has one, near the best-linked hub of all."""
    lib = library(spark, d)
    hub = table(spark, d, "hub_notes", "path", "title", "backlinks_count").where("title IS NOT NULL")
    own = hub.join(lib.unit, F.col("path") == F.col("note")).orderBy(F.desc("backlinks_count"), "path", "id").first()
    asked, v = (own["title"], list(own["vector"])) if own else ("", None)
    return search(lib, asked, near=top_hub(spark, d)[0], limit=10, folder="projects", vector=v).select("chunk_id", "note_path", "score", "hop_distance")


# --- relatedness and gaps ------------------------------------------------------------------------------------

_PAIR = "WITH " + _CH + r""",
unit AS (SELECT chunk_id AS id, note_path AS note, text, list_transform(vector, lambda x: x::DOUBLE / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[]))) AS v FROM ch WHERE trim(note_path) <> '' AND len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
near AS (SELECT x, y, m, n FROM (SELECT x.id AS x, y.id AS y, x.note AS m, y.note AS n, row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.v, y.v), 6) DESC, y.note, y.id) AS k FROM unit x, unit y WHERE x.id <> y.id AND list_dot_product(x.v, y.v) >= 0.65) WHERE k < 20),
pairs AS (SELECT DISTINCT least(m, n) AS a, greatest(m, n) AS b FROM near WHERE m <> n)
"""
_SCORE = _PAIR + r""",
w AS (SELECT *, sqrt(least(greatest(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\s\v\x{85}\p{Z}]+'))), 15), 400)) AS w FROM unit),
m AS (SELECT p.a, p.b, x.id AS i, y.id AS j, x.w AS wa, y.w AS wb, list_dot_product(x.v, y.v) AS sim FROM pairs p JOIN w x ON x.note = p.a JOIN w y ON y.note = p.b),
bi AS (SELECT a, b, i, any_value(wa) AS w, max(sim) AS top, arg_min(j, struct_pack(s := -sim, j := j)) AS claim FROM m GROUP BY ALL),
bj AS (SELECT a, b, j, any_value(wb) AS w, max(sim) AS top, arg_min(i, struct_pack(s := -sim, i := i)) AS claim FROM m GROUP BY ALL),
gi AS (SELECT *, CASE WHEN top >= 0.65 THEN top ELSE 0 END AS g FROM bi), gj AS (SELECT *, CASE WHEN top >= 0.65 THEN top ELSE 0 END AS g FROM bj),
ai AS (SELECT a, b, w, g * pow(0.5, row_number() OVER (PARTITION BY a, b, claim ORDER BY g DESC, i DESC) - 1) AS x FROM gi),
aj AS (SELECT a, b, w, g * pow(0.5, row_number() OVER (PARTITION BY a, b, claim ORDER BY g DESC, j DESC) - 1) AS x FROM gj),
ca AS (SELECT a, b, sum(w * x) / sum(w) AS ca, count(*) AS n_i FROM ai GROUP BY ALL), cb AS (SELECT a, b, sum(w * x) / sum(w) AS cb, count(*) AS n_j FROM aj GROUP BY ALL),
s AS (SELECT *, CASE WHEN ca + cb > 0 THEN 2 * ca * cb / (ca + cb) ELSE 0 END AS res, greatest(ca, cb) AS cont, least(ca, cb) AS low FROM (SELECT a, b, max(sim) AS best FROM m GROUP BY ALL) JOIN ca USING (a, b) JOIN cb USING (a, b)),
scored AS (SELECT a, b, round(ca, 4) AS cover_a, round(cb, 4) AS cover_b, round(res, 4) AS resemblance, round(cont, 4) AS containment, round(best, 4) AS best, round(least(0.99, best * (0.3 + 0.7 * low)), 4) AS final_score,
  CASE WHEN cont >= 0.5 AND (least(n_i, n_j) <= 2 OR cont >= 1.8 * greatest(res, 1e-4)) THEN 'CONTAINMENT' WHEN res >= 0.18 AND low >= 0.12 THEN 'DEEP_OVERLAP' WHEN best >= 0.72 THEN 'SHARED_CONCEPT' ELSE 'WEAK_OVERLAP' END AS kind FROM s)
"""


@query(_PAIR + "SELECT a, b FROM pairs")
def related_candidates(spark, d):
    return rel.candidate_notes(unit_chunks(spark, d))


def _scored(spark, d, with_evidence: bool) -> DataFrame:
    # texts are only counted, before copies of rows are dropped; notes are numbers until the pairs are scored
    rows = table(spark, d, "chunks", "chunk_id", "note_path", "text", "vector").where("chunk_id IS NOT NULL AND trim(note_path) <> ''").where(r.usable("vector", 64))
    unit = rows.select("chunk_id", "note_path", "vector", text.word_estimate(F.coalesce("text", F.lit(""))).cast("double").alias("words")).dropDuplicates(["chunk_id"])
    unit = unit.select(F.col("chunk_id").alias("id"), F.col("note_path").alias("note"), "words", r.scaled("vector").alias("vector"))
    near, weights, names = rel.related(unit, coded=True)
    scored = written(rel.score_pairs(near, unit, with_evidence=with_evidence, near=near, weights=weights), "scored")
    name = lambda n, note: names.select(F.col("n").alias(n), F.col("note").alias(note))
    return scored.withColumnsRenamed({"a": "a_n", "b": "b_n"}).join(name("a_n", "a"), "a_n").join(name("b_n", "b"), "b_n").select(*scored.columns)


@query(_SCORE + "SELECT a, b, cover_a, cover_b FROM scored")
def greedy_reuse_coverage(spark, d):
    return _scored(spark, d, False).select("a", "b", "cover_a", "cover_b")


@query(_SCORE + "SELECT a, b, resemblance, containment, best, final_score FROM scored")
def pair_resemblance(spark, d):
    return _scored(spark, d, False).select("a", "b", "resemblance", "containment", "best", "final_score")


#: The greedy one-to-one matching of the chunks of two notes, one step for each pair of chunks.
GREEDY = """,
strong AS (SELECT a, b, i, j, row_number() OVER (PARTITION BY a, b ORDER BY round(sim, 5) DESC, i, j) AS r FROM m WHERE sim >= 0.65),
greedy AS (SELECT a, b, 0::BIGINT AS r, []::VARCHAR[] AS ui, []::VARCHAR[] AS uj FROM (SELECT DISTINCT a, b FROM strong)
  UNION ALL SELECT g.a, g.b, s.r, CASE WHEN list_contains(g.ui, s.i) OR list_contains(g.uj, s.j) THEN g.ui ELSE list_append(g.ui, s.i) END, CASE WHEN list_contains(g.ui, s.i) OR list_contains(g.uj, s.j) THEN g.uj ELSE list_append(g.uj, s.j) END
  FROM greedy g JOIN strong s ON s.a = g.a AND s.b = g.b AND s.r = g.r + 1),
matches AS (SELECT a, b, max(len(ui))::BIGINT AS n_matches FROM greedy GROUP BY a, b)
"""


@query(_SCORE.replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY + """SELECT a, b, CASE WHEN cont >= 0.5 AND (least(n_i, n_j) <= 2 OR cont >= 1.8 * greatest(res, 1e-4)) THEN 'CONTAINMENT' WHEN (res >= 0.18 AND low >= 0.12) OR (n_matches >= 3 AND res >= 0.14) THEN 'DEEP_OVERLAP'
  WHEN best >= 0.72 THEN 'SHARED_CONCEPT' ELSE 'WEAK_OVERLAP' END AS kind FROM s JOIN matches USING (a, b)""")
def relationship_label(spark, d):
    return _scored(spark, d, True).select("a", "b", "kind")


_FAR = _SCORE + "," + _NOTES + """,
two AS (SELECT u AS a, v AS b FROM edges UNION SELECT e.u, k.v FROM edges e JOIN edges k ON k.u = e.v),
far AS (SELECT s.* FROM scored s LEFT JOIN two t ON t.a = s.a AND t.b = s.b WHERE t.a IS NULL AND final_score >= 0.15)
"""

@query(_FAR + "SELECT a, b, final_score FROM far")
def gap_antijoin(spark, d):
    return discover.gaps(unit_chunks(spark, d), graph_now(spark, d), with_evidence=False).select("a", "b", "final_score")


@query(_FAR + ", f AS (SELECT min(a) AS a FROM far) SELECT a, b, final_score FROM far WHERE a = (SELECT a FROM f) OR b = (SELECT a FROM f)")
def gap_focus_scan(spark, d):
    unit, graph = written(unit_chunks(spark, d), "unit"), graph_now(spark, d)
    first = discover.gaps(unit, graph, with_evidence=False).agg(F.min("a")).first()[0]
    return discover.gaps(unit, graph, focus=first or "", with_evidence=False).select("a", "b", "final_score")


@query(_FAR + r"SELECT a, b, final_score FROM far WHERE regexp_replace(a, '[^/]*$', '') <> regexp_replace(b, '[^/]*$', '')")
def dismissed_filter(spark, d):
    """Pairs of one folder count as dismissed."""
    unit = unit_chunks(spark, d)
    known = rel.related(unit)
    same = known[0].select("a", "b").distinct().where(text.parent("a") == text.parent("b")).select(text.pair_key("a", "b").alias("key"))
    return discover.gaps(unit, graph_now(spark, d), dismissed=same, with_evidence=False, known=known).select("a", "b", "final_score")


@query()
def gaps_enriched(spark, d):
    graph = graph_now(spark, d)
    found = written(discover.gaps(unit_chunks(spark, d), graph), "gaps")
    return discover.enrich(found, graph.links).withColumn("bridge_path", F.array_join("bridge_path", " > "))


@query("WITH " + _CH + " SELECT count(*) AS n_pairs, coalesce(sum(greatest(1, floor(length(text) / 3.8)::INT + 10) + greatest(1, floor(length(coalesce(heading, '')) / 3.8)::INT + 10) + 150), 0)::BIGINT AS prompt_tokens, count(*) * 120 AS completion_tokens FROM ch WHERE text IS NOT NULL")
def discovery_estimate(spark, d):
    return discover.estimate(chunks_now(spark, d, "heading", "text").where("text IS NOT NULL").select(F.col("text").alias("prompt"), F.coalesce("heading", F.lit("")).alias("system")))


# --- delta ---------------------------------------------------------------------------------------------------

_DELTA = f"""WITH {_NOTES},
old AS (SELECT path, max(hash) AS hash FROM notes WHERE trim(path) <> '' AND NOT is_unresolved AND ingested_at <= TIMESTAMP '{BEFORE}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{BEFORE}') GROUP BY path),
new AS (SELECT path, max(hash) AS hash FROM notes WHERE trim(path) <> '' AND NOT is_unresolved AND deleted_at IS NULL GROUP BY path),
status AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.path = n.path)
"""


def _status(spark, d) -> DataFrame:
    return delta.classify(notes_at(spark, d, BEFORE), notes_at(spark, d, None))


@query(_DELTA + "SELECT path, status FROM status")
def delta_classify(spark, d):
    return _status(spark, d)


@query(_DELTA + """, gone AS (SELECT path FROM status WHERE status IN ('deleted', 'modified')), c AS (SELECT DISTINCT chunk_id, note_path, mtime FROM chunks WHERE chunk_id IS NOT NULL)
SELECT chunk_id, note_path, mtime FROM c WHERE note_path IS NULL OR note_path NOT IN (FROM gone)
UNION ALL SELECT chunk_id || '/new', note_path, mtime + 1 FROM c WHERE note_path IN (SELECT path FROM status WHERE status = 'modified')""")
def chunk_upsert(spark, d):
    """Chunks of deleted and modified notes go, new ones of the modified notes come."""
    rows = table(spark, d, "chunks", "chunk_id", "note_path", "mtime").where("chunk_id IS NOT NULL").distinct()
    of = lambda *s: _status(spark, d).where(F.col("status").isin(*s)).select(F.col("path").alias("note_path"))
    new = rows.join(of("modified"), "note_path", "left_semi").select(F.concat("chunk_id", F.lit("/new")).alias("chunk_id"), "note_path", (F.col("mtime") + 1).alias("mtime"))
    return delta.replace_chunks(rows, of("deleted", "modified"), new)


_OLDG = _DELTA + """,
og AS (SELECT path, hash, false AS is_unresolved FROM old UNION ALL SELECT DISTINCT dst, '', true FROM links WHERE dst NOT IN (SELECT path FROM old)),
gone AS (SELECT path FROM status WHERE status = 'deleted'),
kept AS (SELECT * FROM links WHERE src NOT IN (FROM gone)),
dn AS (SELECT path, CASE WHEN path IN (FROM gone) THEN '' ELSE hash END AS hash, is_unresolved OR path IN (FROM gone) AS is_unresolved FROM og WHERE path NOT IN (FROM gone) OR path IN (SELECT dst FROM kept))
"""


def _old_graph(spark, d) -> g.Graph:
    links = links_now(spark, d)
    notes = notes_at(spark, d, BEFORE).select("path", text.stem("path").alias("title"), "hash", F.lit(1.0).alias("mtime"), "is_unresolved")
    return g.Graph(notes.unionByName(g.ghosts(links, notes)), links, tags_now(spark, d))


@query(_OLDG + "SELECT path, hash, is_unresolved FROM dn")
def delete_to_ghost(spark, d):
    return g.delete_notes(_old_graph(spark, d), _status(spark, d).where("status = 'deleted'")).notes.select("path", "hash", "is_unresolved")


_STEM = "lower(regexp_replace(string_split({}, '/')[-1], '(.)\\.[^./]*$', '\\1'))"


@query(_OLDG + f""", added AS (SELECT {_STEM.format('path')} AS key, min(path) AS real FROM status WHERE status = 'added' GROUP BY 1),
moved AS (SELECT path AS ghost, real FROM og JOIN added ON key = {_STEM.format('path')} WHERE is_unresolved AND path <> real)
SELECT DISTINCT src, coalesce(real, dst) AS dst, anchor, alias, is_embed FROM links LEFT JOIN moved ON dst = ghost""")
def ghost_reconcile(spark, d):
    return g.reconcile(_old_graph(spark, d), _status(spark, d).where("status = 'added'")).links


@query(_DELTA + """, tr AS (SELECT note_path AS path, max(mtime) AS m FROM chunks WHERE note_path IS NOT NULL GROUP BY 1)
SELECT coalesce(t.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'delete' WHEN t.path IS NULL OR t.m <> c.mtime THEN 'embed' ELSE 'keep' END AS status FROM tr t FULL JOIN cur c ON t.path = c.path""")
def vector_delta(spark, d):
    return delta.vector_changes(vault.tracked_notes(table(spark, d, "chunks", "note_path", "mtime")).withColumnRenamed("note_path", "path"), notes_now(spark, d))


# --- cache, limits, streams ----------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT link_id, sha256(concat_ws('|', regexp_replace(lower(trim(coalesce(target, ''))), '\s+', ' ', 'g'), 'hybrid', lower(trim(source_path)), '10', regexp_replace(lower(trim(coalesce(anchor, ''))), '^/+|/+$', '', 'g'),
array_to_string(list_sort(list_transform([coalesce(alias, ''), '#' || source_path], lambda t: lower(trim(regexp_replace(t, '^#+', ''))))), ','))) AS cache_key FROM wikilinks WHERE source_path IS NOT NULL""")
def cache_key(spark, d):
    rows = table(spark, d, "wikilinks", "link_id", "source_path", "target", "anchor", "alias").where("source_path IS NOT NULL").distinct()
    tags = F.array(F.coalesce("alias", F.lit("")), F.concat(F.lit("#"), "source_path"))
    return rows.select("link_id", text.cache_key(F.col("target"), F.lit("Hybrid"), F.col("source_path"), F.lit(10), F.col("anchor"), tags).alias("cache_key")).distinct()


@query("WITH e AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, max(ts) AS last_accessed_at FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM e) SELECT cache_key FROM (SELECT cache_key, row_number() OVER (ORDER BY last_accessed_at, cache_key) AS k FROM e), n WHERE n > 100 AND k <= greatest(1, n - 100 + 10)")
def cache_lru_prune(spark, d):
    entries = table(spark, d, "events", "user_id", "ts").groupBy(F.col("user_id").cast("string").alias("cache_key")).agg(F.max("ts").alias("last_accessed_at"))
    return cache.lru_victims(entries, 100)


@query(_DELTA + "SELECT DISTINCT src AS cache_key FROM links WHERE dst IN (SELECT path FROM status WHERE status = 'deleted')")
def cache_dep_evict(spark, d):
    needs = links_now(spark, d).select(F.col("src").alias("cache_key"), F.col("dst").alias("note_path"))
    return cache.dependents(needs, _status(spark, d).where("status = 'deleted'").select(F.col("path").alias("note_path")))


@query("WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS hits, count(*) AS misses, round(sum(n - 1) / sum(n), 4) AS hit_rate FROM k")
def cache_hit_rate(spark, d):
    return cache.hit_rate(table(spark, d, "events", "user_id", "event_type", "ts").select(F.concat_ws("-", "user_id", "event_type").alias("cache_key"), "ts"))


_AUDIT = "SELECT event_id, count(*) OVER w AS in_minute, CAST(sum(floor(abs(value))::BIGINT) OVER w AS BIGINT) AS tokens_in_minute FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)"


def _audit(spark, d) -> DataFrame:
    calls = table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", "user_id", "ts", F.floor(F.abs("value")).cast("bigint").alias("tokens"))
    return limiter.audit(calls, 1, 100)


@query(f"SELECT event_id, in_minute, in_minute <= 1 AS kept FROM ({_AUDIT})")
def rpm_sliding_audit(spark, d):
    return _audit(spark, d).select("event_id", "in_minute", (F.col("in_minute") <= 1).alias("kept"))


@query(f"SELECT event_id, tokens_in_minute, tokens_in_minute <= 100 AS kept FROM ({_AUDIT})")
def tpm_sliding_audit(spark, d):
    return _audit(spark, d).select("event_id", "tokens_in_minute", (F.col("tokens_in_minute") <= 100).alias("kept"))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*) AS n_saves FROM s GROUP BY path, k""")
def debounce_sessions(spark, d):
    saves = table(spark, d, "events", "user_id", "ts").select(F.col("user_id").cast("string").alias("path"), "ts")
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return debounce(saves, "30 minutes").select("path", form("first_at"), form("last_at"), "n_saves")


_KINDS = "['extends', 'Supports', 'CONTRADICTS', 'unknown', 'NONE']"


@query(f"""WITH x AS (SELECT event_id, {_KINDS}[(user_id % 5 + 1)::INT] AS k, floor(abs(value)) / 100 AS c FROM events)
SELECT event_id, CASE WHEN k <> 'unknown' AND c <= 1 THEN upper(k) END AS rel_type, CASE WHEN k <> 'unknown' AND c <= 1 THEN c END AS confidence FROM x""")
def json_relation_validate(spark, d):
    kinds = F.array(*map(F.lit, ("extends", "Supports", "CONTRADICTS", "unknown", "NONE")))
    rows = table(spark, d, "events", "event_id", "user_id", "value").select("event_id", F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("k"), (F.floor(F.abs("value")) / 100).alias("c"))
    said = F.concat(F.lit("The answer is ```json\n"), F.to_json(F.struct(F.col("k").alias("rel_type"), F.col("c").alias("confidence"), F.lit("so").alias("reason"))), F.lit("\n```"))
    return rows.select("event_id", relations.parsed_relation(said).alias("x")).select("event_id", "x.rel_type", "x.confidence")


# --- measures ------------------------------------------------------------------------------------------------

_IR = _BM + r""",
exp0 AS (SELECT DISTINCT target_path AS query_id, lower(ltrim(trim(source_path), '/')) AS note FROM resolved_links WHERE target_path IN (SELECT path FROM hub_notes) AND trim(source_path) <> ''),
nr AS (SELECT s.query_id, lower(ltrim(trim(c.note_path), '/')) AS note, min(struct_pack(s := -round(score, 9), id := s.id)) AS r FROM bm s JOIN ch c ON c.chunk_id = s.id GROUP BY ALL),
ret AS (SELECT * FROM (SELECT query_id, note, row_number() OVER (PARTITION BY query_id ORDER BY r, note) AS rank FROM nr) WHERE rank <= 100),
ne AS (SELECT query_id, count(*) AS n_expected FROM exp0 GROUP BY 1), ng AS (SELECT query_id, count(*) AS n_retrieved FROM ret GROUP BY 1),
hit AS (SELECT query_id, min(rank) AS first, count(*) AS hits, sum(k / rank) AS parts FROM (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS k FROM ret r JOIN exp0 USING (query_id, note)) GROUP BY 1),
pq AS (SELECT query_id, coalesce(round(1 / first, 4), 0) AS rr, coalesce(first, 0) AS first_hit_rank, round(coalesce(hits, 0) / n_expected, 4) AS recall, coalesce(round(coalesce(hits, 0) / n_retrieved, 4), 0) AS precision, round(coalesce(parts, 0) / n_expected, 4) AS ap, n_expected, coalesce(n_retrieved, 0) AS n_retrieved FROM ne LEFT JOIN ng USING (query_id) LEFT JOIN hit USING (query_id))
"""


def _measured(spark, d) -> DataFrame:
    """Hub titles as queries, graded down to 100 notes; expected are the notes that link to the hub."""
    found = _sparse(spark, d, None).join(chunks_now(spark, d, "note_path").select(F.col("chunk_id").alias("id"), F.col("note_path").alias("note")), "id")
    hub = table(spark, d, "hub_notes", "path").distinct()
    links = table(spark, d, "resolved_links", "source_path", "target_path").where("trim(source_path) <> ''").distinct()
    expected = links.join(F.broadcast(hub), F.col("target_path") == F.col("path"), "left_semi").select(F.col("target_path").alias("query_id"), F.col("source_path").alias("note"))
    return evalir.per_query(evalir.ranked_notes(found, 100), expected)


@query(_IR + "SELECT query_id, rr, first_hit_rank FROM pq")
def ir_reciprocal_rank(spark, d):
    return _measured(spark, d).select("query_id", "rr", "first_hit_rank")


@query(_IR + "SELECT query_id, recall, precision, n_expected, n_retrieved FROM pq")
def ir_recall_precision(spark, d):
    return _measured(spark, d).select("query_id", "recall", "precision", "n_expected", "n_retrieved")


@query(_IR + "SELECT query_id, ap FROM pq")
def ir_average_precision(spark, d):
    return _measured(spark, d).select("query_id", "ap")


@query(_IR + """SELECT count(*) AS n_queries, round(avg(CASE WHEN first_hit_rank > 0 THEN 1 / first_hit_rank ELSE 0 END), 4) AS mrr, round(avg((first_hit_rank = 1)::INT), 4) AS hits_at_1, round(avg((first_hit_rank BETWEEN 1 AND 3)::INT), 4) AS hits_at_3, round(avg((first_hit_rank BETWEEN 1 AND 5)::INT), 4) AS hits_at_5,
round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(ap), 4) AS map, count(*) FILTER (n_expected >= 2) AS multi_hop_queries, coalesce(round(avg((recall >= 1)::INT) FILTER (n_expected >= 2), 4), 0) AS multi_hop_completeness FROM pq""")
def ir_aggregate(spark, d):
    return evalir.aggregate(_measured(spark, d))


