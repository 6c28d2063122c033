"""Problem 5: references to records that do not exist, kept up incrementally.

State: a log of the parents' lives and a log of the references' standings, in a folder that outlives the process.
A batch of arrivals appends to both only what it changes: new references probe the parent index; references that wait
(or were covered) under a key whose parents changed are probed again, so an arriving parent resolves waiting
orphans and a deletion reopens covered references. Both logs are partitioned by a hash of the path, and a batch reads the
partitions of its own paths; nothing that is stored is written again. A batch counts once its state file is
written, so one that failed half-way is repeated. Every batch also keeps a snapshot of the counts per
table, month and reason, made from the last one and the batch's changes.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.joins import lookup_join, measured
from knotwork.store import Files, drop_written, shared_dir, written

LIFE = "p string, life bigint, real boolean, b timestamp_ntz, e timestamp_ntz"
REF = "ref_table string, ref_key string, p string, t timestamp_ntz, reason string"
SNAPSHOT = "ref_table string, ref_month string, reason string, n bigint"
KEY = ["ref_table", "ref_key"]
#: Parts of the logs by hash of the path.
BUCKETS = 16


def same_path(path: str | None) -> str | None:
    """The form in which two spellings of one path are equal."""
    if path is None:
        return None
    if not path.isascii():
        path = unicodedata.normalize("NFC", path)
    path = path.replace("\\", "/")
    if path.startswith("./"):
        path = path[2:]
    elif path.startswith("/"):
        path = path[1:]
    return path.lower()


@F.pandas_udf(T.StringType())
def path_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map({x: same_path(x) for x in s.unique() if isinstance(x, str)})


def _bucket():
    return F.pmod(F.xxhash64("p", F.lit(17)), F.lit(BUCKETS)).cast("int").alias("bucket")


class OrphanState:
    """The logs in a folder, as of the last batch that was finished.

    lives: LIFE, a row for each event of a life. refs: REF, a row each time a reference's standing changed, with the reason
    before; a null reason means that a parent covers it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/knotwork/orphans-{uuid.uuid4().hex}").rstrip("/")
        self.files = Files(spark)
        done = [x for x in self.files.names(self.folder) if x.startswith("state-") and x.endswith(".json")]
        self.state = json.loads(self.files.read(f"{self.folder}/{done[-1]}")) if done else {"seq": 0, "batch": -1, "lives": ["lives", []], "refs": ["refs", []], "snapshots": ["snapshots", []]}

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(spark)

    @property
    def batch(self) -> int:
        """The last batch that is part of the state; -1 before the first."""
        return self.state["batch"]

    def log(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        base, batches = self.state[name]
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch int, bucket int")
        df = self.spark.read.schema(f"{schema}, batch int, bucket int").option("basePath", f"{self.folder}/{base}").parquet(*[f"{self.folder}/{base}/batch={n}" for n in batches])
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def append(self, name: str, number: int, rows: DataFrame) -> str:
        """Written, but part of the state only after commit(); parts of a hot path are split by their size."""
        path = f"{self.folder}/{self.state[name][0]}/batch={number}"
        rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return path

    def commit(self, number: int, state: dict) -> None:
        state = state | {"seq": self.state["seq"] + 1, "batch": number}
        if not self.files.create(f"{self.folder}/state-{state['seq']:010d}.json", json.dumps(state)):
            raise RuntimeError("another writer has changed the state")
        self.state = state

    def refs(self) -> DataFrame:
        """Every reference with its present standing: REF."""
        last = self.log("refs", REF).groupBy(*KEY).agg(F.max_by(F.struct("p", "t", "reason"), "batch").alias("x"))
        return last.select(*KEY, "x.p", "x.t", "x.reason")

    def pending(self) -> DataFrame:
        return self.refs().where("reason IS NOT NULL")

    def snapshots(self) -> DataFrame:
        """Orphans by table, month and reason after each batch: SNAPSHOT with the batch."""
        base, batches = self.state["snapshots"]
        if not batches:
            return self.spark.createDataFrame([], f"{SNAPSHOT}, batch int")
        return self.spark.read.schema(f"{SNAPSHOT}, batch int").option("basePath", f"{self.folder}/{base}").parquet(*[f"{self.folder}/{base}/batch={n}" for n in batches])

    def snapshot(self) -> DataFrame:
        """Orphans by table, month and reason now; no reference is read for it."""
        return self.snapshots().where(F.col("batch") == self.batch).drop("batch")

    def compact(self) -> None:
        """One row for each life and reference again, in new folders; to be called now and then, as logs grow by changes only."""
        seq, old = self.state["seq"] + 1, self.state
        lives = merged_lives(self.log("lives", LIFE))
        refs = self.refs().withColumn("before", F.lit(None).cast("string"))
        self.state = old | {"lives": [f"lives-{seq}", []], "refs": [f"refs-{seq}", []]}
        try:
            self.append("lives", old["batch"], lives)
            self.append("refs", old["batch"], refs)
            self.commit(old["batch"], self.state | {"lives": [f"lives-{seq}", [old["batch"]]], "refs": [f"refs-{seq}", [old["batch"]]]})
        except Exception:
            self.state = old
            raise
        for name in ("lives", "refs"):
            self.files.delete(f"{self.folder}/{old[name][0]}")

    def drop(self) -> None:
        self.files.delete(self.folder)


def merged_lives(events: DataFrame) -> DataFrame:
    return events.groupBy("p", "life").agg(F.max("real").alias("real"), F.min("b").alias("b"), F.max("e").alias("e"))


def parent_index(lives: DataFrame) -> DataFrame:
    """A row for each path: whether it has a real row, when the first begins, and its distinct real lives."""
    life = F.when(F.col("real"), F.struct("b", "e"))
    return lives.groupBy("p").agg(F.max("real").alias("any_real"), F.min(F.when(F.col("real"), F.col("b"))).alias("first_real"), F.collect_set(life).alias("real_lives"))


def probe(refs: DataFrame, index: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """refs with their reason at their own time."""
    at = lookup_join(refs.drop("reason"), index, "p", "left", size)
    covered = F.exists("real_lives", lambda x: (x["b"] <= F.col("t")) & (x["e"].isNull() | (F.col("t") < x["e"])))
    reason = F.when(F.col("any_real").isNull(), "missing").when(~F.col("any_real"), "ghost").when(covered, F.lit(None).cast("string")).when(F.col("first_real") > F.col("t"), "late").otherwise("deleted")
    return at.select(*[c for c in refs.columns if c != "reason"], reason.alias("reason"))


def _changes(rows: DataFrame) -> DataFrame:
    """By how much the counts change: one more of each new reason, one less of each reason before."""
    both = rows.select("ref_table", F.date_format("t", "yyyy-MM").alias("ref_month"), F.explode(F.array(F.struct(F.col("reason").alias("reason"), F.lit(1).alias("n")), F.struct(F.col("before").alias("reason"), F.lit(-1).alias("n")))).alias("x"))
    return both.where("x.reason IS NOT NULL").groupBy("ref_table", "ref_month", "x.reason").agg(F.sum("x.n").alias("n"))


def apply_batch(state: OrphanState, refs: DataFrame, parents: DataFrame, number: int | None = None) -> OrphanState:
    """The state after a batch of new references (REF without reason) and parent events (LIFE).

    A parent event is the begin of a life (e null) or its end (the same life with e). A reference
    that is known already, by table and key, is a redelivery and changes nothing. A batch whose number
    is part of the state already changes nothing either.
    """
    number = state.batch + 1 if number is None else number
    if number <= state.batch:
        return state
    once = refs.groupBy(*KEY).agg(F.min(F.struct("p", "t")).alias("x")).select(*KEY, "x.p", "x.t")
    if state.state["refs"][1]:
        known = state.log("refs", REF).select(*KEY).join(once.select(*KEY), KEY, "left_semi").distinct()
        once = once.join(known, KEY, "left_anti")
    fresh = written(once.select("*", _bucket()), "orphan-fresh")
    arrived = state.append("lives", number, parents)
    base, batches = state.state["lives"]
    state.state = state.state | {"lives": [base, [*batches, number]]}
    try:
        touched = state.log("lives", LIFE).where(F.col("batch") == number).select("p", "bucket").distinct()
        changed = sorted(int(x.split("=")[1]) for x in state.files.names(arrived) if x.startswith("bucket="))
        asked = sorted(set(changed) | {r[0] for r in fresh.select("bucket").distinct().collect()})
        index = written(parent_index(merged_lives(state.log("lives", LIFE, asked))), "orphan-index")
        waiting = lookup_join(state.log("refs", REF, changed), touched.select("p", F.lit(True).alias("touched")), "p", "inner")
        again = waiting.groupBy(*KEY).agg(F.max_by(F.struct("p", "t", "reason"), "batch").alias("x")).select(*KEY, "x.p", "x.t", F.col("x.reason").alias("before"), F.lit(False).alias("fresh"))
        new = fresh.select(*KEY, "p", "t", F.lit(None).cast("string").alias("before"), F.lit(True).alias("fresh"))
        probed = probe(new.unionByName(again), index, measured(index, "p"))
        path = state.append("refs", number, probed.where("fresh OR NOT (reason <=> before)").select(*KEY, "p", "t", "reason", "before"))
        last = state.snapshot()
        now = last.unionByName(_changes(state.spark.read.schema(f"{REF}, before string").parquet(path)).select(*last.columns))
        now = now.groupBy("ref_table", "ref_month", "reason").agg(F.sum("n").alias("n")).where("n <> 0")
        now.coalesce(1).write.mode("overwrite").parquet(f"{state.folder}/{state.state['snapshots'][0]}/batch={number}")
        state.commit(number, state.state | {k: [state.state[k][0], [*state.state[k][1], number]] for k in ("refs", "snapshots")})
    except Exception:
        state.state = state.state | {"lives": [base, batches]}
        raise
    for old in (fresh, index):
        drop_written(old)
    return state


def vault_references(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """References of both tables: ref_table, ref_key, p, t and when they arrived.

    A redelivered key counts once, by its earliest arrival. Null and blank references, keys and times are none.
    """
    one = links.select(F.lit("resolved_links").alias("ref_table"), F.col("link_id").cast("string").alias("ref_key"), F.col("target_path").alias("ref"), F.col("extracted_at").alias("t"), F.coalesce("loaded_at", "extracted_at").alias("arrived"))
    two = chunks.select(F.lit("chunks").alias("ref_table"), F.col("chunk_id").alias("ref_key"), F.col("note_path").alias("ref"), F.col("indexed_at").alias("t"), F.col("indexed_at").alias("arrived"))
    both = one.unionByName(two).where("trim(ref) <> '' AND ref_key IS NOT NULL AND t IS NOT NULL")
    once = both.groupBy("ref_table", "ref_key").agg(F.min_by(F.struct("ref", "t"), F.struct("arrived", "t", "ref")).alias("x"), F.min("arrived").alias("arrived"))
    return once.select("ref_table", "ref_key", path_key("x.ref").alias("p"), F.col("x.t").alias("t"), "arrived")


def vault_parents(notes: DataFrame) -> DataFrame:
    """Lives with p and a number that is the same for replayed rows."""
    rows = notes.where("trim(path) <> '' AND ingested_at IS NOT NULL").select(path_key("path").alias("p"), (~F.coalesce("is_unresolved", F.lit(False))).alias("real"), F.col("ingested_at").alias("b"), F.col("deleted_at").alias("e"))
    return rows.withColumn("life", F.xxhash64("p", "real", F.col("b").cast("string"), F.coalesce(F.col("e").cast("string"), F.lit("-")))).distinct()


def replay(spark, references: DataFrame, lives: DataFrame, batches: int = 3, folder: str | None = None) -> OrphanState:
    """The state after all arrivals, applied in so many batches of equal span of arrival time.

    A life arrives at its begin, its end arrives when it ends. batches only sets how often the state
    is brought up to date; the last state is the same for any number.
    """
    references, lives = written(references, "orphan-in"), written(lives, "lives-in")
    a, b = references.agg(F.min("arrived"), F.max("arrived")).first()
    state = OrphanState(spark, folder)
    cuts = [a + (b - a) * k / batches for k in range(1, batches)] if a is not None else []
    begins = lives.select("p", "life", "real", "b", F.lit(None).cast("timestamp_ntz").alias("e"))
    ends = lives.where("e IS NOT NULL")
    for low, high in zip([None, *cuts], [*cuts, None]):

        def within(c: str, low=low, high=high):
            x = F.lit(True)
            if low is not None:
                x = x & (F.col(c) >= F.lit(low).cast("timestamp_ntz"))
            if high is not None:
                x = x & (F.col(c) < F.lit(high).cast("timestamp_ntz"))
            return x

        state = apply_batch(state, references.where(within("arrived")).drop("arrived"), begins.where(within("b")).unionByName(ends.where(within("e"))))
    drop_written(references)
    drop_written(lives)
    return state


def orphans(state: OrphanState) -> DataFrame:
    return state.pending().select("ref_table", "ref_key", F.date_format("t", "yyyy-MM").alias("ref_month"), "reason")
