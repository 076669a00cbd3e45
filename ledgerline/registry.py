"""Every query by name, over the order-flow views of a folder of test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerline import fixtures, schemas
from ledgerline.functions import encode_order, is_sane_order
from ledgerline.operators import last_per_key, route
from ledgerline.operators.blocks import ROWS_PER_BLOCK
from ledgerline.plans import checks, customers, outcomes, topics
from ledgerline.session import checkpoint_dir, listed, prepare, set_times
from ledgerline.sources import KeyedTable, append_topic, read_topic
from ledgerline.streaming import batches, jobs

Query = Callable[[SparkSession, str], DataFrame]
ORDER = [*outcomes.ORDER_COLUMNS, "ts"]
# Blocks small enough that the test data's keys are cut as a cluster's hot keys are.
SMALL_BLOCK = 100
# Micro-batches of the streaming queries, and the partitions of their state at least.
SLICES = 5
STATE_PARTITIONS = 4
# Events from which there is another partition of state, up to one for each core.
STATE_ROWS = 50_000
# Rows of a micro-batch from which there is another file to read it from.
FILE_ROWS = 200_000


class Inputs:
    """The views a query reads, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    @cached_property
    def orders(self) -> DataFrame:
        return fixtures.orders(self.spark, self.sf_dir)

    @cached_property
    def inventory(self) -> DataFrame:
        return fixtures.inventory(self.orders)

    @cached_property
    def validations(self) -> DataFrame:
        return fixtures.validations(self.orders)

    @cached_property
    def inventory_latest(self) -> DataFrame:
        return last_per_key(self.inventory, ["product"], ["ts", "seq"]).where("stock is not null")

    @cached_property
    def log(self) -> DataFrame:
        return outcomes.order_log(
            self.orders,
            outcomes.validated_orders(self.validations, self.orders),
            outcomes.failed_orders(self.validations, self.orders),
        )

    @cached_property
    def state(self) -> DataFrame:
        return outcomes.order_state(self.log)

    def folder(self, name: str) -> str:
        return f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4()}"

    def stored(self, rows: DataFrame, topic: str) -> DataFrame:
        """The rows written to a topic folder and read from it; there ids are text."""
        schema = schemas.with_envelope(schemas.TOPICS[topic])
        path = self.folder("topic")
        append_topic(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]), path)
        read = read_topic(self.spark, path, topic)
        return read.select(
            *[F.col(f.name).cast(f.dataType) for f in rows.schema if f.name in read.columns]
        )

    @cached_property
    def stored_state(self) -> KeyedTable:
        """The order table as kept for lookups."""
        table = KeyedTable(self.spark, self.folder("state"), ["id"], buckets=8, bloom=True)
        table.upsert(self.state)
        return table

    @cached_property
    def wire(self) -> DataFrame:
        """Orders as JSON text, some of it cut off, misspelt or without numbers."""
        start = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","status":'))
        bare = F.concat(start, F.lit('"'), F.col("status"), F.lit('"}'))
        value = (
            F.when(F.col("id") % 17 == 0, start)
            .when(F.col("id") % 11 == 0, bare)
            .when(F.col("id") % 19 == 0, F.concat(start, F.lit('"LOST","quantity":1}')))
            .otherwise(encode_order())
        )
        return self.orders.select("id", value.alias("value"), "ts", "seq")

    @cached_property
    def topics(self) -> dict[str, DataFrame]:
        return {
            schemas.ORDERS: topics.encode_orders(self.orders),
            schemas.ORDER_VALIDATIONS: topics.encode_validations(self.validations),
            schemas.WAREHOUSE_INVENTORY: topics.encode_inventory(self.inventory),
        }


def _plain(df: DataFrame) -> DataFrame:
    """Event times as plain timestamps, the way the given tables hold them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _query(build: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(build(Inputs(spark, sf_dir)))


def _fraud_sessions(i: Inputs, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return checks.fraud_sessions(i.orders, rows_per_block).select(
        "customer_id",
        "first_ts",
        "last_ts",
        "total",
        F.col("order.id").alias("last_order_id"),
        F.col("order.quantity").alias("last_quantity"),
    )


def _running(i: Inputs, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return checks.fraud_running_total(i.orders, rows_per_block).select(
        "id", "customer_id", "total", "ts"
    )


def _asof(i: Inputs, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return checks.orders_asof_stock(i.orders, i.inventory, rows_per_block).select(
        "id", "product", "quantity", "stock", "ts"
    )


def _route(i: Inputs) -> DataFrame:
    created = F.col("status") == "CREATED"
    branches = [created & is_sane_order(), created, F.col("status") == "FAILED"]
    return route(i.orders, branches).select("id", "branch")


def _ingest(i: Inputs) -> DataFrame:
    """Made-up customers are random: only that they are UUIDs of 36 characters is shown."""
    generated = F.length("customer_id") == 36
    requests = i.orders.select("id", "product", "quantity", "price", "customer_id")
    rows = topics.ingest_orders(requests).join(i.orders.select("id", "ts", "seq"), "id")
    return i.stored(rows, schemas.ORDERS).select(
        "id",
        "status",
        "product",
        "quantity",
        "price",
        F.when(~generated, F.col("customer_id")).alias("customer_id"),
        F.when(generated, 36).otherwise(0).alias("generated_length"),
    )


def _history(records: DataFrame) -> DataFrame:
    return records.select(
        "key",
        "value",
        "from_topic",
        F.col("headers")[0]["key"].alias("header_key"),
        F.col("headers")[0]["value"].cast("string").alias("header_value"),
        "ts",
    )


def _lookup_failed(i: Inputs) -> DataFrame:
    failing = i.validations.where(F.col("result") == "FAIL")
    return i.stored_state.lookup(failing.select(F.col("order_id").alias("id")))


BATCH: dict[str, Callable[[Inputs], DataFrame]] = {
    # Sources, filters, projections
    "scan_orders": lambda i: i.stored(i.orders, schemas.ORDERS).select(ORDER),
    "scan_validations": lambda i: i.stored(i.validations, schemas.ORDER_VALIDATIONS).drop("seq"),
    "filter_created": lambda i: checks.created(i.orders).select(ORDER),
    "rekey_by_product": lambda i: checks.created(i.orders).select(
        F.col("product").alias("key"), *ORDER
    ),
    "route_orders": _route,
    "ingest_orders": _ingest,
    "encode_orders": lambda i: topics.encode_orders(i.orders).select("key", "value"),
    "encode_validations": lambda i: topics.encode_validations(i.validations).select(
        "key", "value"
    ),
    "decode_orders": lambda i: topics.accepted(topics.decode_orders(i.wire)).drop("seq"),
    "decode_rejects": lambda i: topics.rejected(topics.decode_orders(i.wire)).drop("seq"),
    "history_union": lambda i: _history(topics.order_history(i.topics)),
    # Tables
    "inventory_latest": lambda i: i.inventory_latest,
    "order_log": lambda i: i.log.drop("seq"),
    "order_state": lambda i: i.state.select(ORDER),
    "lookup_order": lambda i: _lookup_failed(i).select(ORDER),
    "lookup_validated": lambda i: i.stored_state.lookup(
        i.orders.select("id"), F.col("status") == "VALIDATED"
    ).select(ORDER),
    # Checks
    "details_check": lambda i: checks.details_check(i.orders),
    "fraud_sessions": _fraud_sessions,
    "fraud_running_total": _running,
    "fraud_check": lambda i: checks.fraud_check(i.orders),
    "orders_with_stock": lambda i: checks.orders_with_stock(i.orders, i.inventory_latest).select(
        "id", "product", "quantity", "stock"
    ),
    "orders_asof_stock": _asof,
    "inventory_check": lambda i: checks.inventory_check(i.orders, i.inventory),
    "all_validations": lambda i: checks.all_validations(i.orders, i.inventory),
    # Outcomes
    "pass_count_sessions": lambda i: outcomes.pass_count_sessions(i.validations),
    "pass_count_running": lambda i: outcomes.pass_count_running(i.validations),
    "validated_orders": lambda i: outcomes.validated_orders(i.validations, i.orders).select(ORDER),
    "validated_distinct_types": lambda i: outcomes.validated_orders(
        i.validations, i.orders, distinct_types=True
    ).select("id", "status", "ts"),
    "validated_sessions": lambda i: outcomes.validated_sessions(i.validations, i.orders).select(
        "id", "status", "ts"
    ),
    "failed_orders_raw": lambda i: outcomes.failed_orders_raw(i.validations, i.orders),
    "failed_orders": lambda i: outcomes.failed_orders(i.validations, i.orders),
    "order_lifecycle": lambda i: outcomes.order_lifecycle(i.orders, i.inventory).select(ORDER),
    # User functions
    "customer_profiles": lambda i: customers.customer_profiles(i.orders),
    "product_changes": lambda i: customers.product_changes(i.orders),
    "basket_sessions": lambda i: customers.baskets(i.orders),
    # The same with small blocks, so that the test data's keys are cut into several
    "fraud_sessions_split": lambda i: _fraud_sessions(i, 10),
    "fraud_running_total_split": lambda i: _running(i, 10),
    "orders_asof_stock_split": lambda i: _asof(i, SMALL_BLOCK),
    "inventory_check_split": lambda i: checks.inventory_check(i.orders, i.inventory, SMALL_BLOCK),
    "basket_sessions_split": lambda i: customers.baskets(i.orders, 10),
    "pass_count_sessions_split": lambda i: outcomes.pass_count_sessions(i.validations, 4),
    "pass_count_running_split": lambda i: outcomes.pass_count_running(i.validations, 4),
    "order_lifecycle_split": lambda i: outcomes.order_lifecycle(
        i.orders, i.inventory, SMALL_BLOCK
    ).select(ORDER),
}


class Streams:
    """Runs streaming jobs over the same inputs, read as streams, to their end.

    Orders and stock changes arrive in SLICES micro-batches, slice by slice of event time.
    """

    def __init__(self, inputs: Inputs):
        self.inputs, self.spark = inputs, inputs.spark
        self.folder = f"{checkpoint_dir(self.spark)}/streams-{uuid.uuid4()}"

    def sliced(
        self, rows: DataFrame, name: str, files: int | None = None, late: Column | None = None
    ) -> DataFrame:
        """The rows as a stream of SLICES micro-batches, in the order of their ts.

        Those that are ``late`` arrive a micro-batch after the one of their time. A micro-batch
        is read from ``files`` files, or from as many as the smallest slice fills.
        """
        path = f"{self.folder}/{name}"
        first, last = self.span
        passed = F.unix_micros(F.col("ts").cast("timestamp")) - first
        slice = F.least(F.expr("passed * slices div (span + 1)"), F.lit(SLICES - 1))
        placed = rows.withColumns({"passed": passed, "slices": F.lit(SLICES), "span": F.lit(last - first)})
        placed = placed.withColumn("slice", slice).select(*rows.columns, "slice")
        if late is not None:
            moved = F.least(F.col("slice") + late.cast("int"), F.lit(SLICES - 1))
            placed = placed.withColumn("slice", moved)
        if files is None:
            # A slice without some part would take files of the next one into its micro-batch.
            least = placed.groupBy("slice").count().agg(F.min("count")).first()[0]
            files = max(1, (least or 0) // FILE_ROWS)
        # One file per slice and part, so that a micro-batch takes a slice.
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
        task = (F.greatest("slice", F.lit(0)) * files + part).cast("int")
        placed.repartitionById(SLICES * files, task).write.partitionBy("slice").parquet(path)
        for n, name in enumerate(sorted(x for x in listed(self.spark, path) if x.startswith("slice="))):
            set_times(self.spark, f"{path}/{name}", n)
        reader = self.spark.readStream.schema(rows.schema)
        return reader.option("maxFilesPerTrigger", files).parquet(f"{path}/slice=*")

    @cached_property
    def told(self) -> tuple[int, int, int]:
        """The first and last event time in microseconds, and the number of events."""
        ts = F.unix_micros(F.col("ts").cast("timestamp"))
        return tuple(self.events_table.agg(F.min(ts), F.max(ts), F.count("*")).first())

    @property
    def span(self) -> tuple[int, int]:
        return self.told[:2]

    @property
    def state_partitions(self) -> int:
        cores = self.spark.sparkContext.defaultParallelism
        return max(STATE_PARTITIONS, min(cores, self.told[2] // STATE_ROWS))

    @cached_property
    def events_table(self) -> DataFrame:
        return fixtures.events(self.spark, self.inputs.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return self.sliced(self.events_table, "events")

    @cached_property
    def late_orders(self) -> DataFrame:
        """The orders as a stream in which every fifth event arrives a slice late."""
        late = F.col("event_id") % 5 == 0
        return fixtures.orders_from(self.sliced(self.events_table, "late-events", late=late))

    @property
    def orders(self) -> DataFrame:
        return fixtures.orders_from(self.events)

    @property
    def validations(self) -> DataFrame:
        return fixtures.validations(self.orders)

    @cached_property
    def inventory(self) -> DataFrame:
        """The stock changes as a topic, in the same slices."""
        return self.sliced(self.inputs.inventory, "inventory")

    def run(
        self, job: Callable[..., StreamingQuery], *streams, state: bool = False, **options
    ) -> DataFrame:
        """Run a job to the end of its input and read what it wrote."""
        path = f"{self.folder}/{job.__name__}"
        places = [path, f"{path}-state"] if state else [path]
        with batches.state_partitions(self.spark, self.state_partitions):
            query = job(*streams, *places, f"{path}-checkpoint", **options)
        query.awaitTermination()
        return batches.read_batches(self.spark, path)

    def written(self, rows: DataFrame, job: Callable[..., StreamingQuery]) -> DataFrame:
        """What ``job`` wrote, as the stream a later job reads."""
        path = f"{self.folder}/{job.__name__}"
        if any(name.startswith("batch=") for name in listed(self.spark, path)):
            return batches.stream_batches(self.spark, path, rows.schema)
        return self.spark.readStream.schema(rows.schema).parquet(path)

    def after(self, job: Callable[..., StreamingQuery], *streams, state: bool = False) -> DataFrame:
        """What a job writes, as the stream of a job after it."""
        return self.written(self.run(job, *streams, state=state), job)

    def checked(self) -> DataFrame:
        """The verdict log that the three checks write."""
        return self.run(
            jobs.all_validations,
            self.after(jobs.details_check, self.orders),
            self.after(jobs.fraud_check, self.orders, state=True),
            self.after(jobs.inventory_check, self.orders, self.inventory, state=True),
        )

    def validated(self, verdicts: DataFrame) -> DataFrame:
        counts = self.after(jobs.pass_counts, verdicts, state=True)
        return self.run(jobs.validated_orders, counts, self.orders)

    def failed(self, verdicts: DataFrame) -> DataFrame:
        return self.run(jobs.failed_orders, verdicts, self.orders, state=True)

    def changed(self, verdicts: DataFrame) -> DataFrame:
        """The change feed of the order table; the table itself is ``order_table`` after it."""
        log = outcomes.order_log(
            self.orders,
            self.written(self.validated(verdicts), jobs.validated_orders),
            self.written(self.failed(verdicts), jobs.failed_orders),
        )
        return self.run(jobs.order_state, log, state=True)

    def state(self, verdicts: DataFrame) -> DataFrame:
        self.changed(verdicts)
        return outcomes.orders_now(self.order_table.rows())

    @property
    def order_table(self) -> KeyedTable:
        return jobs.order_table(self.spark, f"{self.folder}/{jobs.order_state.__name__}-state")

    def looked_up(self) -> DataFrame:
        """Orders with a failing verdict, from the table that the stream keeps."""
        self.changed(self.validations)
        failing = self.inputs.validations.where(F.col("result") == "FAIL")
        return outcomes.orders_now(self.order_table.lookup(failing.select(F.col("order_id").alias("id"))))

    def too_late(self) -> DataFrame:
        """Spend verdicts, and LATE for the orders that came too late for one."""
        late = f"{self.folder}/too-late"
        verdicts = self.run(jobs.fraud_check, self.late_orders, state=True, late=late)
        dropped = batches.read_batches(self.spark, late)
        told = dropped.select(F.col("id").alias("order_id"), F.lit("LATE").alias("result"), "ts")
        return verdicts.select("order_id", "result", "ts").unionByName(told)

    def lifecycle(self) -> DataFrame:
        """From orders and stock to the state of every order, all on streams."""
        return self.state(self.written(self.checked(), jobs.all_validations))

    def history(self) -> DataFrame:
        records = {
            schemas.ORDERS: topics.encode_orders(self.orders),
            schemas.ORDER_VALIDATIONS: topics.encode_validations(self.validations),
            schemas.WAREHOUSE_INVENTORY: topics.encode_inventory(self.inventory),
        }
        return self.run(jobs.order_history, records)


STREAMING: dict[str, Callable[[Streams], DataFrame]] = {
    "stream_details_check": lambda s: s.run(jobs.details_check, s.orders),
    "stream_fraud_check": lambda s: s.run(jobs.fraud_check, s.orders, state=True),
    "stream_inventory_check": lambda s: s.run(
        jobs.inventory_check, s.orders, s.inventory, state=True
    ),
    "stream_history_union": lambda s: _history(s.history()),
    "stream_pass_count_running": lambda s: s.run(jobs.pass_counts, s.validations, state=True),
    "stream_validated_orders": lambda s: s.validated(s.validations).select(ORDER),
    "stream_failed_orders": lambda s: s.failed(s.validations),
    "stream_order_state": lambda s: s.state(s.validations).select(ORDER),
    "stream_order_changes": lambda s: outcomes.folded_changes(s.changed(s.validations)).select(ORDER),
    "stream_lookup_order": lambda s: s.looked_up().select(ORDER),
    "stream_fraud_late": lambda s: s.too_late(),
    "stream_customer_profiles": lambda s: s.run(jobs.customer_profiles, s.orders, state=True),
    "stream_all_validations": lambda s: s.checked(),
    "stream_order_lifecycle": lambda s: s.lifecycle().select(ORDER),
}


def queries() -> dict[str, Query]:
    batch = {name: _query(build) for name, build in BATCH.items()}
    streaming = {
        name: _query(lambda inputs, build=build: build(Streams(inputs)))
        for name, build in STREAMING.items()
    }
    return batch | streaming
