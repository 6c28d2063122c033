"""Lexical and dense retrieval, fusion and filters (Q01-Q10, E01-E03), for one query or a whole table of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.config import HOP_FACTORS, Settings
from knotwork.functions.text import search_terms
from knotwork.store import written


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def embed_query(embedder: Embedder, query: str, prefix: str = "") -> list[float]:
    """The vector of a query. Models that were trained with a prefix for queries get it; documents have none."""
    return embedder.embed([prefix + (query if query.strip() else " ")])[0].tolist()


class HashingEmbedder:
    """Unit vectors of signed hashed terms: deterministic, without a model."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for term in (text or " ").lower().split():
                h = xxhash.xxh64_intdigest(term)
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class PrecomputedEmbedder:
    """Vectors looked up by text; unknown texts get zeros."""

    def __init__(self, vectors: dict[str, list[float]], dimension: int):
        self.vectors, self.dimension = vectors, dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors.get(t, [0.0] * self.dimension) for t in texts], np.float32).reshape(-1, self.dimension)


def embed_column(df: DataFrame, text: str, embedder: Embedder, name: str = "vector", batch: int = 64) -> DataFrame:
    """df with the vectors of a text column; blank texts count as one blank. In Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [t if isinstance(t, str) and t.strip() else " " for t in s]
            yield pd.Series([r.tolist() for k in range(0, len(texts), batch) for r in embedder.embed(texts[k : k + batch])])

    return df.withColumn(name, run(text))


# --- lexical -------------------------------------------------------------------------------------------------


@dataclass
class LexicalIndex:
    """postings(term, id, tf, dl) and terms(term, df); n documents of mean length avgdl."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, postings: DataFrame, totals: DataFrame) -> LexicalIndex:
        return cls(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)

    def only(self, text: str) -> LexicalIndex:
        """The part that a query needs. Kept postings are sorted by term, so the scan skips all other row groups."""
        terms = sorted({t for t in re.split("[^a-z0-9]+", text.lower()) if t})
        return LexicalIndex.of(self.postings.where(F.col("term").isin(terms or [None])), self.totals)


def postings(docs: DataFrame, id_column: str = "id", text: str = "text", *more: str) -> DataFrame:
    """term, id, dl, tf (and further columns of docs) for each term of each document; ids are distinct."""
    split = docs.select(F.col(id_column).alias("id"), *more, search_terms(F.coalesce(text, F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    return split.select("id", "dl", *more, F.explode("ts").alias("term")).groupBy("term", "id", "dl", *more).agg(F.count(F.lit(1)).alias("tf"))


def totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """n and avgdl. Texts without a term count as documents of length 0."""
    return docs.select(F.size(search_terms(F.coalesce(text, F.lit("")))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def lexical_index(docs: DataFrame, id_column: str = "id", text: str = "text", keep: bool = True) -> LexicalIndex:
    """Of docs; ids are distinct. Texts without a term count as documents of length 0.

    With keep, postings are a written table sorted by term, so that documents are split once for any number of queries
    and a query reads the row groups of its terms only.
    """
    rows, sums = postings(docs, id_column, text), totals(docs, text)
    if keep:
        rows, sums = written(rows.repartitionByRange("term").sortWithinPartitions("term", "id"), "postings"), written(sums, "totals")
    return LexicalIndex.of(rows, sums)


def bm25(index: LexicalIndex, queries: DataFrame, k: int | None, settings: Settings | None = None) -> DataFrame:
    """query_id, id, score, rank of queries(query_id, text); without k all hits, not ranked. Blank queries find nothing; ties go to the smaller id.

    Terms of the queries restrict the postings before anything is aggregated; idf and length are
    joined once a term.
    """
    s = settings or Settings()
    asked = queries.select("query_id", F.explode(F.array_distinct(search_terms("text"))).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (s.bm25_k1 + 1) / (F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.col("avgdl")))
    used = asked.select("term").distinct()
    terms = index.terms.join(used, "term", "left_semi").crossJoin(F.broadcast(index.totals)).select("term", "df", "n", "avgdl")
    hits = index.postings.join(terms, "term").join(asked, "term")
    scored = hits.groupBy("query_id", "id").agg(F.sum(idf * weight).alias("score"))
    return scored if k is None else top_k(scored, "query_id", [F.round("score", 9).desc(), F.col("id")], k)


def top_k(df: DataFrame, by: str, order: list[Column], k: int | None) -> DataFrame:
    """The k first rows of each group with their rank; partial limits run before the shuffle."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


# --- dense ---------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(vector: str) -> Column:
    """The unit vector; the norm is made once a row, not for each number."""
    return F.transform(F.array(norm(F.col(vector))), lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2, l2sq or cosine."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    squared = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2sq":
        return squared
    if metric == "l2":
        return F.sqrt(squared)
    raise ValueError("metric must be l2, l2sq or cosine")


def usable(vector: str, dim: int) -> Column:
    return (F.size(vector) == dim) & F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull())


def dense_top(docs: DataFrame, query: list[float] | Column, k: int, metric: str = "l2", id_column: str = "id", vector: str = "vector") -> DataFrame:
    """id, distance, rank of the k nearest rows; a scan with a top-k, nothing is shuffled but k rows a task."""
    q = F.lit([float(x) for x in query]) if isinstance(query, list) else query
    near = docs.select(F.col(id_column).alias("id"), distance(F.col(vector), q, metric).alias("distance")).orderBy(F.round("distance", 9), "id").limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")))


def knn_join(docs: DataFrame, k: int | None, floor: float | None = None, block: int = 4096, id_column: str = "id", vector: str = "vector", dim: int = 64, queries: DataFrame | None = None) -> DataFrame:
    """a, b, similarity, rank: exact nearest rows by dot product, a itself included, of at least the floor.

    Rows are cut into blocks; every pair of blocks is one matrix product in one cell, so no cell grows with the
    data and no pair of rows is made unless it can be among the k best of its block or reaches the floor. Without k and
    queries, each pair of blocks is multiplied once.
    """
    base = docs.where(usable(vector, dim)).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = base if queries is None else queries.where(usable(vector, dim)).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_base, n_asked = base.count(), asked.count()
    nb, na = max(1, -(-n_base // block)), max(1, -(-n_asked // block))
    # all rows against all by a floor: each pair of blocks once
    mirror = queries is None and k is None

    def placed(df: DataFrame, n: int, other: int, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(n))
        low, high = (F.col("own"), F.lit(other - 1).cast("bigint")) if mirror and side == 0 else (F.lit(0).cast("bigint"), F.col("own") if mirror else F.lit(other - 1).cast("bigint"))
        rows = df.withColumn("own", own).withColumn("copy", F.explode(F.sequence(low, high)))
        cell = (F.col("own") * nb + F.col("copy")) if side == 0 else (F.col("copy") * nb + F.col("own"))
        return rows.select(cell.alias("cell"), F.lit(side).alias("side"), "id", "v")

    kind = dict(base.dtypes)["id"]
    rows = placed(asked, na, nb, 0).unionByName(placed(base, nb, na, 1))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = t.column("id").combine_chunks()
        vectors = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        qa, ba = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(qa) or not len(ba):
            return pa.table({"a": ids[:0], "b": ids[:0], "similarity": pa.array([], pa.float64())})
        s = vectors[qa] @ vectors[ba].T
        if k is not None and k < len(ba):
            p = np.argpartition(-s, k - 1, axis=1)[:, :k]
            edge = np.take_along_axis(s, p, 1).min(axis=1)
            keep = s >= edge[:, None] - 1e-12  # ties at the edge stay, they are settled by id
        else:
            keep = np.ones(s.shape, bool)
        if floor is not None:
            keep &= s >= floor
        i, j = np.nonzero(keep)
        v, x, y = s[i, j], qa[i], ba[j]
        cell = key[0].as_py()
        if mirror and cell // nb != cell % nb:
            v, x, y = np.concatenate([v, v]), np.concatenate([x, y]), np.concatenate([y, x])
        return pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "similarity": pa.array(v)})

    found = rows.groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}, similarity double")

    return top_k(found, "a", [F.round("similarity", 9).desc(), F.col("b")], k)


# --- fusion --------------------------------------------------------------------------------------------------


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of two ranked streams (by..., id, rank, and distance or score).

    Scores are rounded to 6 places before they are compared; ties go to the better dense rank, then to the better
    sparse rank. Columns: by, id, score, dense_score, sparse_score, dense_rank, sparse_rank, rank.
    """
    keys = [*by, "id"]
    d = dense.select(*keys, F.col("rank").alias("dense_rank"), F.col("distance").alias("dense_score"))
    s = sparse.select(*keys, F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, keys, "full")
    score = F.round(F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("sparse_rank")), F.lit(0.0)), 6)
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def single_mode(ranked: DataFrame, mode: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores of one stream alone: 1 / (1 + distance) if dense, the score itself if sparse."""
    if mode not in ("dense", "sparse"):
        raise ValueError("mode must be dense or sparse")
    score = F.round(1 / (1 + F.col("distance")), 6) if mode == "dense" else F.round("score", 6)
    return ranked.select(*by, "id", score.alias("score"), F.col("rank").alias("stream_rank")).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "stream_rank", "id")))


def hop_factor(hop: Column) -> Column:
    out = F
    for h, f in HOP_FACTORS.items():
        out = out.when(hop == h, F.lit(f))
    return out.otherwise(F.lit(1.0))


def boost(results: DataFrame, hops: DataFrame, note: str = "note_path", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """results(by..., id, note, score, rank) re-ranked by their note's distance from the focus; hops(path, hop)."""
    near = hops.select(F.col("path").alias(note), F.col("hop").alias("hop_distance"))
    joined = results.join(near, note, "left").withColumn("factor", hop_factor(F.col("hop_distance"))).withColumn("boosted", F.round(F.col("score") * F.col("factor"), 6))
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("boosted").desc(), "rank", "id"))).drop("rank", "score").withColumnRenamed("boosted", "score").withColumnRenamed("new_rank", "rank")


def in_folder(path: Column, folder: str | None) -> Column:
    """The folder itself or anything below, without regard to case; no folder means all."""
    f = (folder or "").strip().strip("/").lower()
    return F.lit(True) if not f else (F.lower(path) == f) | F.startswith(F.lower(path), F.lit(f + "/"))


def with_any_tag(results: DataFrame, note_tags: DataFrame, tags: list[str] | None, note: str = "note_path") -> DataFrame:
    """Rows whose note has one of the tags, without regard to case."""
    wanted = sorted({t.strip().lstrip("#").lower() for t in tags or []} - {""})
    if not wanted:
        return results
    notes = note_tags.where(F.lower("tag").isin(wanted)).select(F.lower("note_path").alias("__path")).distinct()
    return results.join(notes, F.lower(results[note]) == F.col("__path"), "left_semi")


