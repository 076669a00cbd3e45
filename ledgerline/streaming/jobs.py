"""The order flow's jobs on streams of topic records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline import schemas
from ledgerline.functions import spend
from ledgerline.operators import (
    Transformer,
    first_per_key,
    session_aggregate,
    session_running,
    transform,
)
from ledgerline.operators.blocks import ROWS_PER_BLOCK, hot_keys, listed_keys
from ledgerline.operators.custom import LAST, STATE
from ledgerline.operators.times import interval_text
from ledgerline.plans import checks, customers, outcomes, topics
from ledgerline.session import materialize
from ledgerline.sources.keyed_table import BUCKETS, COMPACT_EVERY, KeyedTable
from ledgerline.streaming.batches import Arrived, Outcome, Step, run_batches


def append(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream's rows to a topic folder, each exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def running_step(
    keys: Sequence[str],
    gap: timedelta,
    amount: Column,
    total: str,
    delay: timedelta,
    emit: Callable[[DataFrame], DataFrame],
    rows_per_block: int = ROWS_PER_BLOCK,
    grace: timedelta | None = None,
) -> Step:
    """Running session totals over micro-batches; the state is each key's sessions.

    Sessions are remembered until their last row is ``gap + delay`` older than the newest.
    Rows of a micro-batch follow (ts, seq). A row's total is that of all remembered
    sessions that belong to its session by now, and of the micro-batch's rows of the
    session up to it: a late row counts into the sessions it lies in, touches or joins,
    also where it reaches them only through other rows of the micro-batch.

    With ``grace`` a row is too late if its session ends more than that before the newest
    event time of earlier micro-batches: it counts nowhere and is told among the late rows.

    A micro-batch's rows and the remembered sessions of their keys are read as one sequence
    of intervals per key: one shuffle. Keys with ``rows_per_block`` rows in a micro-batch
    take the path in blocks.
    """
    keys = list(keys)

    def closing(arrived: Arrived) -> datetime | None:
        if grace is None or arrived.before is None:
            return None
        return arrived.before - grace

    def whole_keys(rows: DataFrame, known: DataFrame | None, close: datetime | None) -> Outcome:
        """Keys whose rows of a micro-batch fit one task."""
        both = rows.withColumns(
            {"began": F.col("ts"), "ended": F.col("ts"), "amount": amount.cast("bigint"), "new": F.lit(True)}
        )
        if known is not None:
            old = known.select(
                *keys, "began", F.col("last_ts").alias("ended"), F.col("total").alias("amount"),
                F.lit(False).alias("new"),
            )
            both = both.unionByName(old, allowMissingColumns=True)
        along = W.partitionBy(*keys).orderBy("began", "ended", "new")
        before = along.rowsBetween(W.unboundedPreceding, -1)
        so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
        opens = F.col("began") - F.max("ended").over(before) > F.lit(gap)
        both = both.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(0)))
        both = both.withColumn("session", F.sum("opens").over(so_far)).drop("opens")
        session = W.partitionBy(*keys, "session")
        # Remembered sessions have no (ts, seq) and so come first.
        running = session.orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumns(
            {
                total: F.sum("amount").over(running),
                "touched": F.max("new").over(W.partitionBy(*keys)),
                "closed": F.lit(False) if close is None else F.max("ended").over(session) < F.lit(close),
            }
        ).persist()
        state = (
            both.where("touched and not closed")
            .groupBy(*keys, "session")
            .agg(
                F.min("began").alias("began"), F.max("ended").alias("last_ts"),
                F.sum("amount").alias("total"),
            )
            .drop("session")
        )
        late = None
        if close is not None:
            late = both.where("new and closed").select(rows.columns)
            untold = both.where("touched and closed and not new")
            state = state.unionByName(
                untold.select(*keys, "began", F.col("ended").alias("last_ts"), F.col("amount").alias("total"))
            )
        results = emit(both.where("new and not closed").select(*rows.columns, total))
        return Outcome(results, state, late, [both])

    def arrived_sessions(rows: DataFrame) -> DataFrame:
        """The micro-batch's own sessions, with the place of their first rows."""
        return session_aggregate(
            rows,
            keys,
            "ts",
            "seq",
            gap,
            sums={"total": amount.cast("bigint")},
            mins={"first": F.struct("ts", "seq")},
            rows_per_block=rows_per_block,
        ).select(
            *keys, F.col("first.ts").alias("began"), "last_ts", "total",
            F.col("first.seq").alias("seq"),
        )

    def merged(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        """Remembered and new sessions, numbered by the session they now belong to.

        A few rows per key: the sessions that a key has within the delay.
        """
        sessions = arrived_sessions(rows).withColumn("new", F.lit(True))
        if known is not None:
            old = known.select(*keys, "began", "last_ts", "total").withColumn("new", F.lit(False))
            sessions = sessions.unionByName(old, allowMissingColumns=True)
        along = W.partitionBy(*keys).orderBy("began", "last_ts", "new")
        before = along.rowsBetween(W.unboundedPreceding, -1)
        opens = F.col("began") - F.max("last_ts").over(before) > F.lit(gap)
        so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
        numbered = sessions.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(0)))
        return numbered.withColumn("session", F.sum("opens").over(so_far)).drop("opens")

    def in_blocks(rows: DataFrame, known: DataFrame | None, close: datetime | None) -> Outcome:
        """Hot keys: their rows are cut into blocks, only sessions are read along a key."""
        late = None
        if close is not None:
            ends = merged(rows, known).groupBy(*keys, "session").agg(
                F.min("began").alias("from_ts"), F.max("last_ts").alias("to_ts")
            )
            # Only rows from before the close can be too late: few, as rows go.
            closed = materialize(ends.where(F.col("to_ts") < F.lit(close)).drop("session"))
            old = rows.where(F.col("ts") < F.lit(close))
            within = [rows[k] == closed[k] for k in keys] + [rows["ts"].between(closed["from_ts"], closed["to_ts"])]
            late = old.join(closed, within, "left_semi")
            in_time = old.join(closed, within, "left_anti")
            rows = materialize(rows.where(F.col("ts") >= F.lit(close)).unionByName(in_time))
        sessions = materialize(merged(rows, known))
        state = sessions.groupBy(*keys, "session").agg(
            F.min("began").alias("began"), F.max("last_ts").alias("last_ts"),
            F.sum("total").alias("total"),
        ).drop("session")
        rows = rows.withColumn("amount", amount.cast("bigint"))
        if known is not None:
            whole = W.partitionBy(*keys, "session")
            earlier = whole.orderBy("began").rowsBetween(W.unboundedPreceding, -1)
            old_total = F.sum(F.when(~F.col("new"), F.col("total"))).over(whole)
            new_total = F.sum(F.when(F.col("new"), F.col("total"))).over(earlier)
            brought = sessions.withColumn(
                "brought", F.coalesce(old_total, F.lit(0)) + F.coalesce(new_total, F.lit(0))
            )
            brought = brought.where("new").select(
                *keys, F.col("began").alias("ts"), "seq", "brought"
            )
            # The first row of each new session brings in what its session had before.
            rows = rows.join(brought, [*keys, "ts", "seq"], "left").withColumn(
                "amount",
                F.when(F.col("brought").isNull(), F.col("amount")).otherwise(
                    F.coalesce("amount", F.lit(0)) + F.col("brought")
                ),
            )
        told = session_running(rows, keys, "ts", "seq", gap, {total: F.col("amount")}, rows_per_block)
        return Outcome(emit(told), state, late)

    def apply(batch: DataFrame, known: DataFrame | None, arrived: Arrived) -> Outcome:
        rows, close = batch.where(" and ".join(f"`{c}` is not null" for c in (*keys, "ts"))), closing(arrived)
        hot = None
        if arrived.rows >= 0.9 * rows_per_block:
            hot = hot_keys(rows, keys, rows_per_block)
        if hot is None:
            return whole_keys(rows, known, close)
        # At most (rows of the micro-batch / rows_per_block) keys.
        listed = listed_keys(hot, keys)

        def part(how: str) -> tuple[DataFrame, DataFrame | None]:
            return rows.join(listed, keys, how), known and known.join(listed, keys, how)

        cold = whole_keys(*part("left_anti"), close)
        warm = in_blocks(*part("left_semi"), close)
        return Outcome(
            cold.results.unionByName(warm.results),
            cold.state.unionByName(warm.state),
            cold.late and cold.late.unionByName(warm.late),
            cold.cached,
        )

    keep = gap + (delay if grace is None else max(delay, grace))
    return Step(apply, keys, F.col("ts"), "last_ts", keep)


def reservation_step(
    delay: timedelta = schemas.STOCK_DELAY,
    rows_per_block: int = ROWS_PER_BLOCK,
    positive_only: bool = False,
) -> Step:
    """Stock reservation over micro-batches of ``stock_events``.

    The state holds, per product, its versions as intervals (``valid_from`` to
    ``valid_to``, null for the one that holds now), so that a late order meets the stock of
    its own time, and a row with what is reserved (``start``). Versions that ended more than
    ``delay`` before the newest order are forgotten. Only the products that a micro-batch
    touches are read and written.
    """

    def changes(batch: DataFrame, known: DataFrame | None) -> DataFrame:
        arrived = batch.where(F.col("topic") == schemas.WAREHOUSE_INVENTORY)
        arrived = arrived.select("product", "stock", "ts", "seq")
        if known is None:
            return arrived
        versions = known.where("valid_from is not null")
        return arrived.unionByName(versions.select("product", "stock", F.col("valid_from").alias("ts"), "seq"))

    def apply(batch: DataFrame, known: DataFrame | None, arrived: Arrived) -> Outcome:
        reserved = known and known.where("start is not null").select("product", "start")
        rows = checks.reservations(
            batch.where(F.col("topic") == schemas.ORDERS),
            changes(batch, known),
            arrived.block(rows_per_block),
            positive_only,
            reserved,
        ).persist()
        taken = rows.where("granted").select("product", F.col("quantity").alias("start"))
        if reserved is not None:
            taken = taken.unionByName(reserved)
        starts = taken.groupBy("product").agg(F.sum("start").cast("bigint").alias("start"))
        versions = checks.stock_versions(changes(batch, known))
        if arrived.newest is not None:
            ended = F.col("valid_to") <= F.lit(arrived.newest) - F.lit(delay)
            versions = versions.where(F.col("valid_to").isNull() | ~ended)
        state = versions.unionByName(starts, allowMissingColumns=True)
        touched = batch.where("product is not null").select("product").distinct()
        state = state.join(touched, "product", "left_semi")
        return Outcome(checks.inventory_verdicts(rows), state, cached=[rows])

    return Step(apply, ["product"], F.when(F.col("topic") == schemas.ORDERS, F.col("ts")))


def stock_events(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """The two topics the stock check reads, as one stream."""
    return (
        checks.created(orders)
        .select("id", "status", "product", "quantity", "ts", "seq")
        .withColumn("topic", F.lit(schemas.ORDERS))
        .unionByName(
            inventory.withColumn("topic", F.lit(schemas.WAREHOUSE_INVENTORY)),
            allowMissingColumns=True,
        )
    )


def details_check(orders: DataFrame, path: str, checkpoint: str, trigger=None) -> StreamingQuery:
    return append(checks.details_check(orders), path, checkpoint, trigger)


def fraud_check(
    orders: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    delay: timedelta = schemas.SPEND_DELAY,
    rows_per_block: int = ROWS_PER_BLOCK,
    trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
    late: str | None = None,
) -> StreamingQuery:
    """Spend verdicts per order.

    With a folder ``late`` orders whose session ended more than SPEND_GRACE before the newest
    order are dropped and written there; without it they count into a session of their own.
    """
    created = checks.created(orders).select("id", "customer_id", "price", "quantity", "ts", "seq")
    step = running_step(
        ["customer_id"],
        schemas.SPEND_GAP,
        spend(),
        "total",
        delay,
        checks.fraud_verdicts,
        rows_per_block,
        None if late is None else schemas.SPEND_GRACE,
    )
    return run_batches(created, step, path, state, checkpoint, trigger, compact_every, late)


def inventory_check(
    orders: DataFrame,
    inventory: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    delay: timedelta = schemas.STOCK_DELAY,
    rows_per_block: int = ROWS_PER_BLOCK,
    positive_only: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    step = reservation_step(delay, rows_per_block, positive_only)
    return run_batches(stock_events(orders, inventory), step, path, state, checkpoint, trigger)


def all_validations(
    details: DataFrame,
    fraud: DataFrame,
    inventory: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The verdict log: what the three checks wrote, as one topic."""
    verdicts = details.unionByName(fraud).unionByName(inventory)
    return append(verdicts, path, checkpoint, trigger)


def pass_counts(
    validations: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    delay: timedelta = schemas.COUNT_DELAY,
    rows_per_block: int = ROWS_PER_BLOCK,
    trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
    late: str | None = None,
) -> StreamingQuery:
    """Each verdict with its order's running PASS count, for ``validated_orders``.

    ``late`` is as for ``fraud_check``, with COUNT_GRACE.
    """
    verdicts = validations.select("order_id", "type", "result", "ts", "seq")
    step = running_step(
        ["order_id"],
        schemas.COUNT_GAP,
        outcomes.passed(),
        "passes",
        delay,
        lambda rows: rows.select("order_id", "passes", "ts", "seq"),
        rows_per_block,
        None if late is None else schemas.COUNT_GRACE,
    )
    return run_batches(verdicts, step, path, state, checkpoint, trigger, compact_every, late)


def validated_orders(
    counts: DataFrame,
    orders: DataFrame,
    path: str,
    checkpoint: str,
    delay: timedelta = schemas.COUNT_DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """VALIDATED updates, by an interval join of the pass counts with the orders."""
    updates = outcomes.validated_updates(
        counts.withWatermark("ts", interval_text(delay)),
        orders.withWatermark("ts", interval_text(delay)),
    )
    return append(updates, path, checkpoint, trigger)


def validated_sessions(
    validations: DataFrame,
    orders: DataFrame,
    path: str,
    checkpoint: str,
    delay: timedelta = schemas.COUNT_DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """VALIDATED updates per closed session, in one query with native session windows."""
    sessions = outcomes.pass_count_sessions(validations.withWatermark("ts", interval_text(delay)))
    # The window's end is the event time after the aggregate: last verdict plus gap.
    counts = sessions.select(
        "order_id",
        "passes",
        F.window_time("session").alias("ts"),
        F.col("last_seq").alias("seq"),
    )
    after_last = schemas.COUNT_GAP - timedelta(microseconds=1)
    updates = outcomes.validated_updates(
        counts, orders.withWatermark("ts", interval_text(delay)), shift=after_last
    )
    return append(updates, path, checkpoint, trigger)


def first_step(keys: Sequence[str], order: Sequence[str], ts: str, delay: timedelta) -> Step:
    """Each key's first row, once; the state is the keys seen within ``delay``."""
    keys = list(keys)

    def apply(batch: DataFrame, known: DataFrame | None, arrived: Arrived) -> Outcome:
        firsts = first_per_key(batch, keys, order)
        if known is not None:
            firsts = firsts.join(known, keys, "left_anti")
        firsts = firsts.persist()
        return Outcome(firsts.drop(ts), firsts.select(*keys, ts), cached=[firsts])

    return Step(apply, keys, F.col(ts), ts, delay)


def failed_orders(
    validations: DataFrame,
    orders: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    delay: timedelta = schemas.COUNT_DELAY,
    trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """FAILED updates, one per order, by an interval join of FAILs with the orders.

    Within a micro-batch an order's first update by (ts, seq) is kept.
    """
    updates = outcomes.failed_updates(
        validations.withWatermark("ts", interval_text(delay)),
        orders.withWatermark("ts", interval_text(delay)),
    )
    # The join pairs a verdict with an order up to a tolerance on either side of it, and the
    # watermark trails by the delay: no order is forgotten before its last verdict.
    keep = delay + 3 * schemas.JOIN_TOLERANCE
    step = first_step(["id"], ["ts", "seq"], "order_ts", keep)
    return run_batches(updates, step, path, state, checkpoint, trigger, compact_every)


def table_step() -> Step:
    """The order table: each micro-batch's changed orders, told as changes and kept.

    A deleted order stays as its delete, since an older record of it may still come.
    """

    def apply(batch: DataFrame, known: DataFrame | None, arrived: Arrived) -> Outcome:
        changes = outcomes.order_changes(batch, known).persist()
        state = changes.select("after.*")
        return Outcome(changes.where("change is not null"), state, cached=[changes])

    return Step(apply, ["id"], F.col("ts"))


def order_state(
    log: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the order table in the folder ``state`` and write its changes to ``path``.

    ``log`` has the columns of ``plans.outcomes.order_log``. The table is read by
    ``order_table``; a change has the order before and after it, see
    ``plans.outcomes.order_changes``.
    """
    return run_batches(
        log, table_step(), path, state, checkpoint, trigger, compact_every, None, buckets, lookups=True
    )


def order_table(spark: SparkSession, state: str) -> KeyedTable:
    """The table that ``order_state`` keeps; ``outcomes.orders_now`` hides deleted orders."""
    return KeyedTable(spark, state, ["id"])


def transformer_step(
    keys: Sequence[str],
    order: Sequence[str],
    transformer: Transformer,
    column: str,
    emit: Callable[[DataFrame], DataFrame],
    ts: str = "ts",
    keep: timedelta | None = None,
) -> Step:
    """A user's transformer over micro-batches; its state, of any type, is kept per key.

    Within a micro-batch a key's rows follow ``order``. With ``keep`` the state of keys
    without a row for that long, in event time, is forgotten.
    """

    def apply(batch: DataFrame, known: DataFrame | None, arrived: Arrived) -> Outcome:
        rows = transform(batch, keys, order, transformer, column, known).persist()
        state = rows.where(LAST).select(*keys, STATE, ts)
        return Outcome(emit(rows.drop(STATE, LAST)), state, cached=[rows])

    return Step(apply, list(keys), F.col(ts), None if keep is None else ts, keep or timedelta(0))


def customer_profiles(
    orders: DataFrame, path: str, state: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Each order with its customer's profile after it."""
    step = transformer_step(
        ["customer_id"], ["ts", "seq"], customers.PROFILE, "profile", customers.profile_rows
    )
    return run_batches(customers.spending(orders), step, path, state, checkpoint, trigger)


def order_history(
    records: Mapping[str, DataFrame], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return append(topics.order_history(records), path, checkpoint, trigger)
