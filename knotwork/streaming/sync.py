"""Streams (I07, X03): a vault kept up to date from a stream of manifests, and bursts of saves as sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators import delta
from knotwork.operators.orphans import OrphanState, apply_batch

MANIFEST = "path string, mtime double, hash string"


def debounce(saves: DataFrame, quiet: str = "1500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """path, first_at, last_at, n_saves of each burst: saves(path, ts) with no pause longer than quiet between them.

    Batch or streaming; a burst comes out once the watermark has passed its end.
    """
    rows = saves.withWatermark("ts", watermark) if saves.isStreaming else saves
    grouped = rows.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_saves"))
    return grouped.select("path", "first_at", "last_at", "n_saves")


def follow_manifests(spark: SparkSession, folder: str, checkpoint: str, stored: Callable[[], DataFrame], on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each manifest file in the folder lists the whole vault; its difference to what is stored goes to on_change(status, batch).

    A file source sees only new files, so changes and deletions of notes are read out of the manifests.
    Of manifests in one batch the last counts. on_change must be idempotent by batch number.
    """
    stream = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(folder)

    def run(batch: DataFrame, number: int) -> None:
        on_change(delta.classify(stored(), batch), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OrphanStream:
    """Orphan references as a stream: batches of references and parent events go into the state in a folder.

    Columns of the stream: kind ('ref' or 'parent'), ref_table, ref_key, p, t, life, real, b, e. The folder holds
    the number of the last batch, so a stream that starts again from its checkpoint goes on where it was, and a
    batch that is delivered again changes nothing.
    """

    SCHEMA = "kind string, ref_table string, ref_key string, p string, t timestamp_ntz, life bigint, real boolean, b timestamp_ntz, e timestamp_ntz"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.state = OrphanState(spark, folder)

    def __call__(self, batch: DataFrame, number: int) -> None:
        refs = batch.where("kind = 'ref'").select("ref_table", "ref_key", "p", "t")
        parents = batch.where("kind = 'parent'").select("p", "life", "real", "b", "e")
        apply_batch(self.state, refs, parents, number)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
