"""Queries of the problems tagged llm, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import canon, encode, leak, neardup, quality, split, vectors
from knotwork.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.close_pairs(table(spark, d, "chunks", "chunk_id", "vector"), "chunk_id", 0.93)


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every row whose hash of the id is divisible by 50, out of all rows."""
    near, _ = vectors.neighbours(table(spark, d, "chunks", "chunk_id", "vector"), "chunk_id")
    paths = table(spark, d, "chunks", "chunk_id", "note_path").groupBy("chunk_id").agg(F.min("note_path").alias("note_path"))
    return near.join(paths, near["b"] == paths["chunk_id"], "left").select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), "note_path", F.round("cosine", 5).alias("cosine"), "place")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(table(spark, d, "chunks", "chunk_id", "heading", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("chunk_id", "cut_kind")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_values(table(spark, d, "wikilinks", "link_id", "target", "alias"), table(spark, d, "source_index", "basename", "paths"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).where("NOT exact").select("link_id", "basename")


def p4_mapped(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).withColumn("distance", F.round("distance", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "chunks", "chunk_id", "heading", "text"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.version_groups(table(spark, d, "chunks", "chunk_id", "heading", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(table(spark, d, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts out of their ids: null and empty texts both give the empty text."""
    return encode.decode_documents(p7_ids(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents", "doc_id", "text", "boxes"), table(spark, d, "eval_items", "item_id", "text"), common=table(spark, d, "common_words", "word"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return leak.scrub(table(spark, d, "documents", "doc_id", "text", "boxes"), _leaks(spark, d))


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every document that is not blank, prose included."""
    return quality.classify(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words", "word")).select("doc_id", "kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_kinds(spark, d).where("kind <> 'prose'")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words", "word"))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_mapped, p6_found, p6_groups, p7_ids, p7_decoded, p8_found, p8_spans, p8_scrubbed, p9_found, p9_kinds, p9_stats)}

_RATIO = "CASE WHEN {b} > 0 THEN round({a}::DOUBLE / {b}, 6) END AS {name}"

_BODY = r"""
once AS (SELECT chunk_id, any_value(coalesce(heading, '')) AS heading, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id),
bodies AS (SELECT chunk_id, CASE WHEN heading <> '' AND starts_with(text, heading) THEN regexp_replace(substr(text, length(heading) + 1), '^[ \t\r\n]+', '') ELSE text END AS body FROM once)
"""

ORACLE = {
    "p3_found": "WITH " + _BODY + r""",
big AS (SELECT chunk_id, regexp_replace(body, '\r\n?', chr(10), 'g') AS body FROM bodies WHERE len(regexp_extract_all(body, '[^ \t\r\n]+')) > 320),
paras AS (SELECT chunk_id, unnest(string_split_regex(body, '\n(?:[ \t]*\n)+')) AS p FROM big),
sentences AS (SELECT chunk_id, p, string_split(regexp_replace(p, '([.!?]["'')\]”]*)[ \t\n]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM paras),
sizes AS (SELECT chunk_id, max(len(regexp_extract_all(p, '[^ \t\r\n]+'))) AS longest, max(list_max(list_transform(ss, lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+'))))) AS sentence FROM sentences GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN longest <= 320 THEN 'paragraph' WHEN sentence <= 320 THEN 'sentence' ELSE 'word' END AS cut_kind FROM sizes""",
    "p6_found": "WITH " + _BODY + r""",
words AS (SELECT chunk_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS ws FROM bodies),
runs AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS s FROM words WHERE len(ws) >= 20),
n AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY 1),
shared AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.5 * (x.n + y.n - k)""",
    "p9_stats": r"""
WITH parts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\r\n]+', '', 'g') AS solid,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda s: s <> '') AS lines,
    regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS runs FROM documents),
common AS (SELECT list(DISTINCT lower(word)) AS ws FROM common_words WHERE trim(word) <> ''),
counted AS (
  SELECT doc_id, n, length(solid) AS chars, length(regexp_replace(solid, '[\p{L}\p{N}]+', '', 'g')) AS marks, len(lines) AS nl,
    len(list_filter(lines, lambda s: regexp_matches(s, '[.!?]["''”)\]]*$'))) AS ends, len(runs) AS nr, len(list_filter(runs, lambda w: list_contains(ws, w))) AS known FROM parts, common)
SELECT doc_id, n::BIGINT AS word_count, """
    + ", ".join(_RATIO.format(a=a, b=b, name=n) for a, b, n in (("chars", "n", "mean_word_length"), ("marks", "chars", "symbol_ratio"), ("ends", "nl", "punct_line_share"), ("known", "nr", "common_word_share")))
    + " FROM counted",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
