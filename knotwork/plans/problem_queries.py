"""Queries of the general problems (1 and 5) and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import keycounts, orphans
from knotwork.sources.tables import table
from knotwork.store import written


def _counts(spark: SparkSession, d: str) -> DataFrame:
    rows = keycounts.vault_key_rows(table(spark, d, "resolved_links", "link_id", "target_path"), table(spark, d, "note_tags", "note_path", "tag"))
    return keycounts.dense_key_counts(written(rows, "key-rows"), "key_kind", "key_value")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return keycounts.heavy_keys(written(_counts(spark, d), "key-counts"), "key_kind", 0.04).select("key_kind", "key_value")


def _state(spark: SparkSession, d: str) -> orphans.OrphanState:
    refs = orphans.vault_references(table(spark, d, "resolved_links", "link_id", "target_path", "extracted_at", "loaded_at"), table(spark, d, "chunks", "chunk_id", "note_path", "indexed_at"))
    lives = orphans.vault_parents(table(spark, d, "notes", "path", "is_unresolved", "ingested_at", "deleted_at"))
    return orphans.replay(spark, refs, lives)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_state(spark, d))


def p5_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).snapshot().select("ref_table", "ref_month", "reason", F.col("n").cast("bigint").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p5_found": p5_found, "p5_snapshot": p5_snapshot}

_P1 = """
WITH rows AS (
  SELECT 'target' AS key_kind, target_path AS key_value FROM (SELECT DISTINCT link_id, target_path FROM resolved_links WHERE trim(target_path) <> '' AND link_id IS NOT NULL)
  UNION ALL SELECT 'tag', tag FROM (SELECT DISTINCT note_path, tag FROM note_tags WHERE trim(tag) <> '')),
counts AS (SELECT key_kind, key_value, CAST(count(*) AS BIGINT) AS n FROM rows GROUP BY ALL)
"""
_P5 = r"""
WITH refs AS (
  SELECT ref_table, ref_key, arg_min(ref, (arrived, t, ref)) AS ref, arg_min(t, (arrived, t, ref)) AS t FROM (
    SELECT 'resolved_links' AS ref_table, CAST(link_id AS VARCHAR) AS ref_key, target_path AS ref, extracted_at AS t, coalesce(loaded_at, extracted_at) AS arrived FROM resolved_links
    UNION ALL SELECT 'chunks', chunk_id, note_path, indexed_at, indexed_at FROM chunks)
  WHERE trim(ref) <> '' AND ref_key IS NOT NULL AND t IS NOT NULL GROUP BY ref_table, ref_key),
keyed AS (SELECT *, lower(regexp_replace(replace(nfc_normalize(ref), '\', '/'), '^(\./|/)', '')) AS p FROM refs),
lives AS (SELECT DISTINCT lower(regexp_replace(replace(nfc_normalize(path), '\', '/'), '^(\./|/)', '')) AS p, NOT coalesce(is_unresolved, false) AS is_real, ingested_at AS b, deleted_at AS e FROM notes WHERE trim(path) <> '' AND ingested_at IS NOT NULL),
judged AS (
  SELECT ref_table, ref_key, any_value(t) AS t, count(l.p) AS n, count(*) FILTER (is_real) AS reals, count(*) FILTER (is_real AND b <= t AND (e IS NULL OR t < e)) AS covers, min(CASE WHEN is_real THEN b END) AS first_real
  FROM keyed k LEFT JOIN lives l ON k.p = l.p GROUP BY ref_table, ref_key),
orphans AS (
  SELECT ref_table, ref_key, strftime(t, '%Y-%m') AS ref_month,
    CASE WHEN n = 0 THEN 'missing' WHEN reals = 0 THEN 'ghost' WHEN first_real > t THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE covers = 0)
"""
ORACLE = {
    "p1_counts": _P1 + "SELECT * FROM counts",
    "p1_found": _P1 + "SELECT key_kind, key_value FROM counts c JOIN (SELECT key_kind, sum(n) AS total FROM counts GROUP BY 1) USING (key_kind) WHERE n >= 0.04 * total",
    "p5_found": _P5 + "SELECT * FROM orphans",
    "p5_snapshot": _P5 + "SELECT ref_table, ref_month, reason, CAST(count(*) AS BIGINT) AS n FROM orphans GROUP BY ALL",
}
