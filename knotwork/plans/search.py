"""The search plan (Q06, Q09): candidates of both kinds, fusion, boost by distance, filters and limit in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.config import Settings, clamp
from knotwork.operators import evalir
from knotwork.operators import graph as g
from knotwork.operators import retrieval as r
from knotwork.operators.cache import QueryCache, key_of

MODES = ("hybrid", "dense", "sparse")


@dataclass
class Library:
    """chunks(chunk_id, note_path, note_title, heading, text, vector), its lexical index, and the graph if there is one.

    edges are the graph's neighbours() where they are kept.
    """

    chunks: DataFrame
    index: r.LexicalIndex
    embedder: r.Embedder
    graph: g.Graph | None = None
    edges: DataFrame | None = None
    #: id, note, text and unit vector of the chunks that have one.
    unit: DataFrame | None = None


def search(lib: Library, query: str, near: str | None = None, mode: str = "hybrid", limit: int = 5, folder: str | None = None, tags: list[str] | None = None, metric: str = "l2", filters: str = "post", vector: list[float] | None = None, lenient: bool = False, settings: Settings | None = None) -> DataFrame:
    """The best chunks: chunk_id, note_path, note_title, heading, text, score, dense_score, sparse_score, factor, hop_distance, rank.

    filters "post" takes the filters to the over-fetched candidates, so fewer than limit rows may come; "pre" takes them
    before. Without a graph, near and tags are refused unless lenient, and then have no effect. vector takes the place
    of the embedded query.
    """
    if mode not in MODES:
        raise ValueError("mode must be hybrid, dense or sparse")
    s = settings or Settings()
    query = query.strip()
    if (near or tags) and lib.graph is None:
        if not lenient:
            raise ValueError("near and tags need the graph")
        near, tags = None, None
    few = max(5 * limit, 50) if folder or tags else max(3 * limit, 20)
    chunks, spark = lib.chunks, lib.chunks.sparkSession
    tag_table = lib.graph.note_tags.select(F.col("path").alias("note_path"), "tag") if lib.graph else None
    if filters == "pre":
        chunks = chunks.where(r.in_folder(F.col("note_path"), folder))
        chunks = r.with_any_tag(chunks, tag_table, tags) if tags else chunks
    if not query:
        chunks = chunks.where("false")
    q = spark.createDataFrame([(0, query)], "query_id int, text string")
    dense = sparse = None
    if mode != "sparse":
        v = vector or r.embed_query(lib.embedder, query, s.query_prefix)
        dim = len(v)
        dense = r.dense_top(chunks.where(r.usable("vector", dim)), v, few, metric, "chunk_id").withColumn("query_id", F.lit(0))
    if mode != "dense":
        sparse = r.bm25(lib.index.only(query), q, few if filters == "post" else None, s)
        if filters == "pre":
            sparse = r.top_k(sparse.drop("rank").join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi"), "query_id", [F.col("score").desc(), F.col("id")], few)
    if mode == "hybrid":
        ranked = r.fuse(dense, sparse, s.rrf_k)
    else:
        ranked = r.single_mode(dense if mode == "dense" else sparse, mode)
        ranked = ranked.withColumn("dense_score", F.col("score") if mode == "dense" else F.lit(None).cast("double")).withColumn("sparse_score", F.col("score") if mode == "sparse" else F.lit(None).cast("double"))
    # at most some dozens of rows are ranked; chunks are told apart only among those
    about = lib.chunks.select(F.col("chunk_id").alias("id"), "note_path", "note_title", "heading", "text")
    rows = about.join(F.broadcast(ranked), "id").dropDuplicates(["id"])
    if near:
        focus = g.find_note(lib.graph.notes, near)
        rows = r.boost(rows, g.hops(lib.graph.links, focus, 2, edges=lib.edges))
    else:
        rows = rows.withColumn("factor", F.lit(1.0)).withColumn("hop_distance", F.lit(None).cast("int"))
    if filters == "post":
        rows = rows.where(r.in_folder(F.col("note_path"), folder))
        rows = r.with_any_tag(rows, tag_table, tags) if tags else rows
    return rows.select(F.col("id").alias("chunk_id"), "note_path", "note_title", "heading", "text", "score", "dense_score", "sparse_score", "factor", "hop_distance", "rank").orderBy("rank").limit(limit)


def query_vault(lib: Library, query: str, limit: int = 5, cache: QueryCache | None = None, **kw) -> list[dict]:
    """Rows of search() with limit clamped to 1..20, by way of the cache."""
    limit = clamp(limit, 1, 20)
    key = key_of(query, kw.get("mode", "hybrid"), kw.get("near"), limit, kw.get("folder"), kw.get("tags"))
    if cache and (known := cache.get(key)) is not None:
        return known
    rows = [x.asDict() for x in search(lib, query, limit=limit, **kw).collect()]
    if cache:
        focus = [x["path"] for x in g.find_note(lib.graph.notes, kw["near"]).collect()] if kw.get("near") and lib.graph else []
        cache.put(key, query, rows, {x["note_path"] for x in rows} | set(focus))
    return rows


#: A benchmark is a list made by hand; a longer one is refused.
MOST_QUERIES = 2_000


def evaluate(lib: Library, benchmark: DataFrame, limit: int = 5, least_mrr: float = 0.80, least_recall: float = 0.80, **kw) -> tuple[DataFrame, dict, bool]:
    """(a row for each query, the measures of all, whether they pass the gate) of benchmark(id, query, near, mode, expected).

    Every query is one search; what it finds counts by note, and a query without any expected note takes no part.
    """
    spark = lib.chunks.sparkSession
    asked = benchmark.select("id", "query", "near", "mode", "expected").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    found = [(q["id"], x["note_path"], x["rank"]) for q in asked for x in search(lib, q["query"], near=q["near"], mode=q["mode"], limit=limit, **kw).collect()]
    hits = spark.createDataFrame(found, "query_id string, note string, rank int")
    expected = benchmark.select(F.col("id").cast("string").alias("query_id"), F.explode("expected").alias("note"))
    rows = evalir.per_query(evalir.dedupe(hits), expected)
    measures = evalir.aggregate(rows).first().asDict()
    return rows, measures, evalir.passes(measures, least_mrr, least_recall)
