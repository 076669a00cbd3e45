"""Streaming jobs that hand each micro-batch to a batch operator.

Running totals and the stock fold emit a row per input row in event order, which
Spark's streaming sessions cannot. Here the batch operators do it, hot keys split as
ever, and what they must remember about each key is kept in a ``KeyedTable``. A micro-batch
reads the buckets of the keys that it touches, replaces the state of these keys, and writes
its results into a folder of its own, each only once and seen only whole: a batch that is
run again after a failure leaves finished folders alone, so readers of the results see
every row exactly once.

How far event time has come stands in the state's version. What counts as too old depends
on it alone: what is still stored is cut whenever it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.session import scratch_tables, write_once
from ledgerline.sources.keyed_table import BUCKET, COMPACT_EVERY, KeyedTable, Version

# Below this many rows a micro-batch is planned by hand: see ``sized_for``.
SMALL_BATCH = 200_000
ROWS_PER_TASK = 5_000
# A micro-batch's state is small beside its stream's, so few buckets do.
STATE_BUCKETS = 8


class Arrived(NamedTuple):
    """A micro-batch's number of rows with a key, and the newest event time before and after it."""

    rows: int
    before: datetime | None
    newest: datetime | None

    def block(self, rows_per_block: int) -> float:
        """``rows_per_block``, or infinity if there are too few rows for a hot key."""
        return rows_per_block if self.rows >= rows_per_block else float("inf")


class Outcome(NamedTuple):
    """What a step makes of a micro-batch."""

    results: DataFrame
    # All state rows of the keys that the micro-batch touches.
    state: DataFrame
    # Rows that came too late to count.
    late: DataFrame | None = None
    # To be let go of once everything is written.
    cached: Sequence[DataFrame] = ()


class Step(NamedTuple):
    """What to do with a micro-batch; the state of its buckets is given, or None at first.

    ``clock`` is the event time of rows that carry it, null for others. State rows whose
    ``expires`` lies more than ``keep`` before the newest event time are forgotten.
    """

    apply: Callable[[DataFrame, DataFrame | None, Arrived], Outcome]
    keys: Sequence[str]
    clock: Column
    expires: str | None = None
    keep: timedelta = timedelta(0)

    def kept(self, newest: datetime | None) -> Column | None:
        if self.expires is None or newest is None:
            return None
        return F.col(self.expires) >= F.lit(newest) - F.lit(self.keep)


@contextmanager
def sized_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plan for so many rows: with few of them few shuffle partitions, no adaptive steps and
    no code generated.

    Such a micro-batch's time is that of planning and of starting tasks, not of its rows.
    Nothing changes beyond SMALL_BATCH rows, where adaptive plans and code are worth their
    price. The options are put back at the end, since the stream's own state goes by them.
    """
    options = {}
    if rows < SMALL_BATCH:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        options["spark.sql.shuffle.partitions"] = str(max(1, min(most, -(-rows // ROWS_PER_TASK))))
        options["spark.sql.adaptive.enabled"] = "false"
        options["spark.sql.codegen.wholeStage"] = "false"
    before = {name: spark.conf.get(name) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_batches(
    stream: DataFrame,
    step: Step,
    results: str,
    state: str,
    checkpoint: str,
    trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
    late: str | None = None,
    buckets: int = STATE_BUCKETS,
    lookups: bool = False,
) -> StreamingQuery:
    """Start a query that applies ``step`` to each micro-batch and its state.

    ``results`` gets a folder per micro-batch, and so does ``late`` if the step tells late
    rows; see ``read_batches``. ``state`` is a ``KeyedTable``, with Bloom filters if it is for
    ``lookups`` too. The source's rate limits (maxFilesPerTrigger, maxOffsetsPerTrigger) bound
    a micro-batch.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in step.keys])

    def apply(batch: DataFrame, number: int, table: KeyedTable, version: Version | None) -> None:
        spark, frontier = batch.sparkSession, version and version.frontier
        with sized_for(spark, 0):
            # One row per bucket.
            found = (
                batch.where(present)
                .groupBy(table.bucket())
                .agg(F.count("*").alias("n"), F.max(step.clock).alias("newest"))
                .collect()
            )
        touched = [r[BUCKET] for r in found]
        times = [t for t in (frontier, *(r["newest"] for r in found)) if t is not None]
        arrived = Arrived(sum(r["n"] for r in found), frontier, max(times, default=None))
        with sized_for(spark, arrived.rows):
            known = table.rows(version, touched) if version is not None else None
            if known is not None and (kept := step.kept(frontier)) is not None:
                known = known.where(kept)
            outcome = step.apply(batch, known, arrived)
            try:
                write_once(outcome.results, f"{results}/batch={number}")
                if late is not None and outcome.late is not None:
                    write_once(outcome.late, f"{late}/batch={number}")
                state_now, kept = outcome.state, step.kept(arrived.newest)
                if kept is not None:
                    state_now = state_now.where(kept)
                table.write(number, state_now, touched, arrived.newest, kept, version)
            finally:
                for frame in outcome.cached:
                    frame.unpersist()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = KeyedTable(spark, state, step.keys, buckets, compact_every, lookups)
        if table.has(number):
            return
        batch = batch.persist()
        try:
            with scratch_tables(spark):
                apply(batch, number, table, table.version(number - 1) if number else None)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start queries with this many state partitions; None leaves the session's number.

    A query keeps the number that it first started with.
    """
    option = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(option)
    if partitions is not None:
        spark.conf.set(option, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(option, configured)


def read_batches(spark: SparkSession, results: str) -> DataFrame:
    """All rows written so far, as a table."""
    return spark.read.parquet(results).drop("batch")


def stream_batches(spark: SparkSession, results: str, schema) -> DataFrame:
    """The rows as a stream, for a query after this one."""
    return spark.readStream.schema(schema).parquet(f"{results}/batch=*")
