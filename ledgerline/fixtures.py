"""Order-flow inputs as views over the given ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import CHECKS

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """The events as a stream; one file per micro-batch keeps the batches bounded."""
    return (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", files)
        .parquet(folder)
    )


def orders_from(events: DataFrame) -> DataFrame:
    """Orders with null products and customers, non-positive quantities and prices."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "signup", "SHIPPED")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("CREATED")
        .alias("status"),
        F.when(k == 9, None)
        .when(k < 3, "SHOES")
        .when(k < 6, "WATCH")
        .otherwise("GUITAR")
        .alias("product"),
        ((F.col("event_id") % 13).cast("int") - 1).alias("quantity"),
        (F.floor("value").cast("bigint") * 5).alias("price"),
        F.when(F.col("user_id") % 25 == 0, None).otherwise(F.col("user_id")).alias("customer_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_from(events(spark, sf_dir))


def inventory(orders: DataFrame) -> DataFrame:
    """Three stock changes per product, the second of which deletes WATCH."""
    steps = [
        (1, 3, datetime(2024, 1, 2)),
        (2, 4, datetime(2024, 1, 10)),
        (3, 6, datetime(2024, 1, 15)),
    ]
    step = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).cast("bigint").alias("seq"),
                    F.lit(tenths).alias("tenths"),
                    F.lit(str(at)).cast("timestamp").alias("ts"),
                )
                for n, tenths, at in steps
            ]
        )
    )
    deleted = (F.col("step.seq") == 2) & (F.col("product") == "WATCH")
    return (
        orders.where((F.col("status") == "CREATED") & F.col("product").isNotNull())
        .groupBy("product")
        .agg(F.sum("quantity").alias("demand"))
        .select("product", "demand", step.alias("step"))
        .select(
            "product",
            F.when(
                ~deleted, F.floor(F.col("demand") * F.col("step.tenths") / 10).cast("int")
            ).alias("stock"),
            F.col("step.ts").alias("ts"),
            F.col("step.seq").alias("seq"),
        )
    )


def validations(orders: DataFrame) -> DataFrame:
    """A verdict log with time jitter around the session gap and the join tolerance."""
    jitter = [timedelta(milliseconds=ms) for ms in (0, 2, 4, 5, 11, 400_000)]
    types = [*CHECKS, CHECKS[0]]
    kind = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(name).alias("type"))
                for i, name in enumerate(types)
            ]
        )
    )
    i = F.col("kind.i")
    delay = F.element_at(
        F.array(*[F.lit(d) for d in jitter]), ((F.col("id") + 3 * i) % 6 + 1).cast("int")
    )
    return (
        orders.where(F.col("status") == "CREATED")
        .select("id", "ts", kind.alias("kind"))
        .where((i < 3) | (F.col("id") % 4 == 0))
        .select(
            F.col("id").alias("order_id"),
            F.col("kind.type").alias("type"),
            F.when((F.col("id") + i) % 7 < 2, "FAIL").otherwise("PASS").alias("result"),
            (F.col("ts") + delay).alias("ts"),
            (F.col("id") * 4 + i).alias("seq"),
        )
    )
