"""Kafka topics: reading and writing, and the envelope around their records.

The connector is a separate Spark package (spark-sql-kafka); without it ``read_kafka``
and ``write_kafka`` fail, while the envelope functions work on any frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline import schemas

# Offsets are unique per partition only; this many partitions share a topic's seq. More
# are an error, as two records would have the same seq.
PARTITIONS = 4096


def read_kafka(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str],
    stream: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """One or several topics as the connector's rows, with record headers."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    return (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .options(**(options or {}))
        .load()
    )


def _envelope():
    seq = (F.col("offset") * PARTITIONS + F.col("partition")).cast("bigint")
    too_many = F.raise_error(F.lit(f"a topic has more than {PARTITIONS} partitions"))
    checked = F.when(F.col("partition") < PARTITIONS, seq).otherwise(too_many.cast("bigint"))
    return [F.col("timestamp").alias("ts"), checked.alias("seq")]


def _product() -> Column:
    """An inventory key: the product as a JSON string."""
    return F.trim(F.col("key").cast("string"), F.lit('"'))


def _stock() -> Column:
    """An inventory value: a big-endian 4-byte integer, or null for a delete."""
    unsigned = F.conv(F.hex("value"), 16, 10).cast("bigint")
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int")


def text_records(rows: DataFrame) -> DataFrame:
    """(topic, key, value, ts, seq) of any of the topics, keys and values as text."""
    inventory = F.col("topic") == schemas.WAREHOUSE_INVENTORY
    return rows.select(
        "topic",
        F.when(inventory, _product()).otherwise(F.col("key").cast("string")).alias("key"),
        F.when(inventory, _stock().cast("string"))
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
        *_envelope(),
    )


def inventory_records(rows: DataFrame) -> DataFrame:
    """(product, stock, ts, seq) of the inventory topic; a delete has no stock."""
    return rows.select(_product().alias("product"), _stock().alias("stock"), *_envelope())


def kafka_rows(records: DataFrame, topic: str) -> DataFrame:
    """Encoded (key, value[, headers]) records as rows the connector writes."""
    kept = [c for c in ("headers",) if c in records.columns]
    return records.select(
        F.lit(topic).alias("topic"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        *kept,
    )


def write_kafka(
    rows: DataFrame,
    servers: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery | None:
    """Append ``kafka_rows`` to their topics; a stream needs a checkpoint folder."""
    options = {"kafka.bootstrap.servers": servers, "includeHeaders": "true"}
    if not rows.isStreaming:
        rows.write.format("kafka").options(**options).save()
        return None
    return (
        rows.writeStream.format("kafka")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
