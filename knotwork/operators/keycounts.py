"""Problem 1: counts per key when a few keys hold most rows.

Method: every equal split of the input dictionary-encodes its keys and counts the codes by numpy.bincount
into an accumulator array; the distinct keys get dense ids from one dictionary; the splits' counts are scattered
into blocks of dense arrays, and the blocks are summed by a distributed reduction in two levels. No row
of the input is shuffled, and a key reaches the shuffle at most once for each split and flush, so the work of a task depends
on the size of its split and on the number of keys, never on the share of a key. There is one path for all
sizes, and nothing is broadcast that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.joins import lookup_join
from knotwork.store import written

#: Ids in a block of the accumulator, lanes of the first level of the reduction, keys a split holds before it gives out their counts.
BLOCK, LANES, HELD_KEYS = 4096, 16, 200_000


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a split with their counts w. At most about HELD_KEYS keys are held; then the counts go out."""
    held: list[pa.RecordBatch | pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield from _bincount(pa.concat_tables(held), "w").to_batches()
            held.clear()

    for b in batches:
        if not len(b):
            continue
        held.append(_bincount(pa.Table.from_batches([b]), None))
        size += len(held[-1])
        if size > HELD_KEYS:
            merged = _bincount(pa.concat_tables(held), "w")
            held[:] = [merged]
            size = len(merged)
            if size > HELD_KEYS // 2:
                yield from flush()
                size = 0
    yield from flush()


def _bincount(t: pa.Table, weight: str | None) -> pa.Table:
    """The distinct keys of a table with their (weighted) number of rows, by dictionary codes and bincount."""
    names = [c for c in t.column_names if c != "w"]
    code = np.zeros(len(t), np.int64)
    for name in names:  # a code for each combination seen: nulls are values of their own
        own = t.column(name).combine_chunks().dictionary_encode("encode")
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        _, code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    n = int(code.max()) + 1
    first = np.empty(n, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    counts = np.bincount(code, minlength=n) if weight is None else _scatter(code, t.column(weight).to_numpy(), n)
    return t.select(names).take(pa.array(first)).append_column("w", pa.array(counts.astype(np.int64)))


def split_counts(rows: DataFrame, *key: str) -> DataFrame:
    """key and w: for each split of rows and each of its distinct keys the number of rows. Nothing is shuffled."""
    few = rows.select(*key)
    return few.mapInArrow(_count_rows, T.StructType([*few.schema.fields, T.StructField("w", T.LongType())]))


def key_dictionary(rows: DataFrame, *key: str) -> DataFrame:
    """A row for each distinct key with its dense id (column __id).

    Ids are dense over the partitions of the written dictionary: the place in the partition plus
    the sizes of those before it. To the driver come only the partitions' sizes.
    """
    distinct = rows.select(*key).distinct().withColumn("__row", F.monotonically_increasing_id())
    kept = written(distinct, "dictionary")
    part = F.shiftright("__row", 33)
    starts, n = {}, 0
    for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts[r["part"]] = n
        n += r["n"]
    if not n:
        return kept.select(*key, F.lit(0).cast("bigint").alias("__id"))
    offsets = F.broadcast(kept.sparkSession.createDataFrame(list(starts.items()), "__part bigint, __start bigint"))
    dense = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")
    return kept.join(offsets, part == F.col("__part")).select(*key, dense.cast("bigint").alias("__id"))


def _scatter(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, weights)
    return out


def _packed(block: int, sums: np.ndarray) -> tuple[int, bytes | None, bytes]:
    """A block as it is, or, where few of its ids occur, their places and sums."""
    at = np.flatnonzero(sums)
    return (block, None, sums.tobytes()) if len(at) > BLOCK // 2 else (block, at.astype(np.uint16).tobytes(), sums[at].tobytes())


_BLOCKS = "block bigint, places binary, sums binary"


def _block_batch(rows: list[tuple[int, bytes | None, bytes]]) -> pa.RecordBatch:
    block, places, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(places, pa.binary()), pa.array(sums, pa.binary())], ["block", "places", "sums"])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accumulator blocks of rows (__id, w) sorted by id: each is done once a later one begins."""
    block, sums = -1, np.zeros(BLOCK, np.int64)
    for b in batches:
        if not len(b):
            continue
        ids, w = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        of = ids // BLOCK
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        done = []
        for a, e in zip(cuts, cuts[1:]):
            if of[a] != block:
                if block >= 0:
                    done.append(_packed(block, sums))
                block, sums = int(of[a]), np.zeros(BLOCK, np.int64)
            np.add.at(sums, ids[a:e] % BLOCK, w[a:e])
        if done:
            yield _block_batch(done)
    if block >= 0:
        yield _block_batch([_packed(block, sums)])


def _add_blocks(key: tuple, t: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for at, x in zip(t.column("places"), t.column("sums")):
        own = np.frombuffer(x.as_py(), np.int64)
        if at.is_valid:
            total[np.frombuffer(at.as_py(), np.uint16)] += own
        else:
            total += own
    return pa.Table.from_batches([_block_batch([_packed(key[0].as_py(), total)])])


def _blocks_to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, places, sums in zip(*(c.to_pylist() for c in b.columns)):
            counts = np.frombuffer(sums, np.int64)
            at = np.flatnonzero(counts) if places is None else np.frombuffer(places, np.uint16).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at, pa.int64()), pa.array(counts[at] if places is None else counts, pa.int64())], ["__id", "n"])


def dense_key_counts(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of each distinct key: columns key and n. rows is read once.

    A null in a key column makes a key of its own; drop such rows before if they are none. Empty
    input gives an empty result; other columns of rows play no part.
    """
    counted = written(split_counts(rows, *key), "split-counts")
    ids = key_dictionary(counted, *key)
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    coded = counted.alias("l").join(ids.alias("r"), on).select("__id", "w")
    blocks = coded.sortWithinPartitions("__id").mapInArrow(_to_blocks, _BLOCKS)
    lanes = blocks.withColumn("lane", F.spark_partition_id() % LANES)
    first = lanes.groupBy("block", "lane").applyInArrow(_add_blocks, _BLOCKS)
    summed = first.groupBy("block").applyInArrow(_add_blocks, _BLOCKS)
    return summed.mapInArrow(_blocks_to_rows, "__id bigint, n bigint").join(ids, "__id").select(*key, "n")


def heavy_keys(counts: DataFrame, kind: str, least_share: float) -> DataFrame:
    """The keys with at least least_share of the rows of their kind. counts is read twice."""
    totals = counts.groupBy(kind).agg(F.sum("n").alias("total"))
    return lookup_join(counts, totals, kind, "inner").where(F.col("n") >= F.lit(least_share) * F.col("total")).select(*counts.columns)


def vault_key_rows(links: DataFrame, note_tags: DataFrame) -> DataFrame:
    """A row for each distinct case: (target, target_path) per link_id, (tag, tag) per (note_path, tag).

    A row delivered twice counts once. Null and blank targets and tags are no keys.
    """
    target = links.where("target_path IS NOT NULL AND trim(target_path) <> '' AND link_id IS NOT NULL").select("link_id", "target_path").distinct()
    tag = note_tags.where("tag IS NOT NULL AND trim(tag) <> ''").select("note_path", "tag").distinct()
    return target.select(F.lit("target").alias("key_kind"), F.col("target_path").alias("key_value")).unionByName(tag.select(F.lit("tag").alias("key_kind"), F.col("tag").alias("key_value")))
