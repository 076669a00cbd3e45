"""Topics as parquet or JSON folders, read as tables or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas

# Undecoded records: text key and value with the envelope.
RECORDS = schemas.with_envelope(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)


def _read(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    stream: bool,
    files_per_batch: int | None,
    format: str,
) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema).format(format)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_topic(
    spark: SparkSession,
    path: str,
    topic: str,
    stream: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A topic's typed records with ``ts`` and ``seq``.

    On parquet, filters on status, product or id reach the files.
    """
    schema = schemas.with_envelope(schemas.TOPICS[topic])
    return _read(spark, path, schema, stream, files_per_batch, "parquet")


def read_records(
    spark: SparkSession,
    path: str,
    stream: bool = False,
    files_per_batch: int | None = None,
    format: str = "json",
) -> DataFrame:
    """Undecoded (key, value, ts, seq) records; see ``plans.topics.decode``."""
    return _read(spark, path, RECORDS, stream, files_per_batch, format)


def append_topic(df: DataFrame, path: str) -> None:
    """Append typed records to a topic folder."""
    df.write.mode("append").parquet(path)


def append_records(df: DataFrame, path: str, format: str = "json") -> None:
    """Append encoded (key, value, ts, seq) records to a folder."""
    df.select("key", "value", "ts", "seq").write.mode("append").format(format).save(path)


def write_state(state: DataFrame, path: str, files: int) -> None:
    """Write an order state table for point lookups.

    Sorted by id into ranges, so that a lookup's filter on id skips all files and row
    groups but the one that can hold it.
    """
    (
        state.repartitionByRange(files, F.col("id"))
        .sortWithinPartitions("id")
        .write.mode("overwrite")
        .parquet(path)
    )
