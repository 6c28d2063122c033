"""Joins that hold when one key has a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only below these measured sizes.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20


def measured(df: DataFrame, width: str) -> tuple[int, int]:
    """Rows, and bytes of the string column named by width (16 bytes a row on top)."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(width)), F.lit(0))).first()
    return n, size + 16 * n


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys with about that share of all rows or more, as (key, __hot); at most 1 / share of them.

    By a sketch of frequent hashes, built where the rows are: to the driver come only those hashes, and no
    row is shuffled by its key.
    """
    most = max(16, int(2 / share))
    hashed = F.xxhash64(key)
    sketch = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(xxhash64(`{key}`), {most}, {64 * most})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    found = [r["item"] for r in sketch["top"] or [] if r["count"] > share * sketch["n"]]
    return df.where(hashed.isin(found or [None])).select(key).distinct().withColumn("__hot", F.lit(True)) if found else df.sparkSession.createDataFrame([], df.select(key).schema).withColumn("__hot", F.lit(True))


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", size: tuple[int, int] | None = None, salts: int = 32, hot_share: float = 0.01) -> DataFrame:
    """left joined with right on key, where right has one row a key.

    right is broadcast if its measured size allows. Otherwise rows of left under a hot key
    (more than hot_share of all rows, see hot_keys) are spread over
    salts, and only the rows of right under those keys are replicated as often.
    Salts come from the row's own values, so a task run again sends its rows the same way.
    Null keys of left find nothing.
    """
    rows, size_bytes = size or measured(right, key)
    if rows <= BROADCAST_ROWS and size_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    hot = F.broadcast(hot_keys(left, key, hot_share))
    spread = left.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns, F.lit(7)), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = right.join(hot, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.drop("__hot").join(copies.drop("__hot"), [key, "__salt"], how).drop("__salt")
