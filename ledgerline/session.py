"""Session settings the jobs rely on, and durable cutting of long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Streaming state on local disk with snapshots in the checkpoint, not on the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on (all of them SQL options)."""
    for option, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Counting state rows costs a look-up for every row that is put.
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        # Merge sessions before the shuffle, so that a hot key is small after it.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }.items():
        spark.conf.set(option, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
    return sc.getCheckpointDir()


# The tables written inside the innermost ``scratch_tables`` block.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it there.

    Later reads see exactly these rows, also after executors were lost, and read only
    the columns they need. The table stays until the folder is cleaned, or until the
    end of the ``scratch_tables`` block around the call.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes in this block when it ends.

    Put it around building a result and writing it out.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            delete(spark, path)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    if not exists(spark, path):
        return []
    return [f.getPath().getName() for f in _files(spark, path).listStatus(_path(spark, path))]


def _unfinished(path: str) -> str:
    """Where a folder or file is written before it is renamed: a name that readers skip."""
    folder, _, name = path.rpartition("/")
    # Without "=": readers take such folders for partitions, also under an underscore.
    return f"{folder}/_unfinished-{name.replace("=", "-")}"


def _rename(spark: SparkSession, unfinished: str, path: str) -> None:
    if not _files(spark, path).rename(_path(spark, unfinished), _path(spark, path)):
        raise OSError(f"cannot rename {unfinished} to {path}")


def write_once(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None
) -> None:
    """Write a folder that readers see whole or not at all; leave one that is there alone.

    The rows are written beside it under a name that readers skip, and the folder is
    renamed at the end: one step in a file system such as HDFS.
    """
    spark = df.sparkSession
    if exists(spark, path):
        return
    writer = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(_unfinished(path))
    _rename(spark, _unfinished(path), path)


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file, seen whole or not at all; one that is there is left alone."""
    if exists(spark, path):
        return
    out = _files(spark, path).create(_path(spark, _unfinished(path)), True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    _rename(spark, _unfinished(path), path)


def read_text(spark: SparkSession, path: str) -> str:
    file = _files(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def set_times(spark: SparkSession, folder: str, seconds: int) -> None:
    """Give a folder's files a modification time, by which file streams put them in order."""
    files = _files(spark, folder)
    for file in files.listStatus(_path(spark, folder)):
        if not file.getPath().getName().startswith(("_", ".")):
            files.setTimes(file.getPath(), 1000 * seconds, -1)


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
