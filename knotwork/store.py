"""Written tables: lineage is cut by Parquet in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[DataFrame]] = {}
_kept: dict[tuple, dict[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and all runs on one machine.

    On a cluster without that setting this is an error: tasks and driver do not share a local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read from there.

    What follows reads files instead of recomputing, also after executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knotwork/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._knotwork_path = path
    _made.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


def kept(spark: SparkSession, key: tuple, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Written tables by key, built once in a session; built again if one of them was deleted."""
    at = (spark.sparkContext.applicationId, *key)
    files = Files(spark)
    if at not in _kept or not all(files.exists(df._knotwork_path) for df in _kept[at].values()):
        _kept[at] = build()
    return _kept[at]


def drop_all_written(spark: SparkSession) -> int:
    """Deletes every table that written() made in this session; call it when their results are stored. How many."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for df in made:
        drop_written(df)
    return len(made)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    path = getattr(df, "_knotwork_path", None)
    if path:
        Files(df.sparkSession).delete(path)


class Files:
    """Small files and folders by way of the cluster's file system, so that driver and tasks see the same ones."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def changed(self, path: str) -> int:
        """When the file or folder was last changed, in milliseconds; 0 if there is none."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file, whole or not at all; False if there is one of that name already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        new = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return bool(fs.rename(new, p))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
