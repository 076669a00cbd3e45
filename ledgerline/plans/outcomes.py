"""From verdicts to validated and failed orders, and the state of every order."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import (
    first_per_key,
    interval_join,
    last_per_key,
    session_aggregate,
    session_running,
)
from ledgerline.operators.blocks import ROWS_PER_BLOCK
from ledgerline.plans.checks import all_validations, created
from ledgerline.session import materialize

ORDER_COLUMNS = [f.name for f in schemas.ORDER.fields]


def passed() -> Column:
    return F.coalesce(F.col("result") == "PASS", F.lit(False)).cast("int")


def pass_count_sessions(
    validations: DataFrame, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """PASS verdicts per order and session."""
    return session_aggregate(
        validations,
        ["order_id"],
        "ts",
        "seq",
        schemas.COUNT_GAP,
        sums={"passes": passed()},
        lasts={"last_seq": F.col("seq")},
        rows_per_block=rows_per_block,
    )


def pass_count_running(
    validations: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    distinct_types: bool = False,
) -> DataFrame:
    """Each verdict with its order's number of PASSes so far in the session.

    All PASSes count; with ``distinct_types`` each check counts once per session.
    """
    if distinct_types:
        sums = {
            check: F.when(F.col("type") == check, passed()).otherwise(0)
            for check in schemas.CHECKS
        }
        passes = sum(F.least(F.col(check), F.lit(1)) for check in schemas.CHECKS)
    else:
        sums, passes = {"passes": passed()}, F.col("passes")
    return session_running(
        validations.select("order_id", "type", "result", "ts", "seq"),
        ["order_id"],
        "ts",
        "seq",
        schemas.COUNT_GAP,
        sums,
        rows_per_block,
    ).select("order_id", passes.cast("bigint").alias("passes"), "ts", "seq")


def _updates(
    verdicts: DataFrame, orders: DataFrame, status: str, shift: timedelta = timedelta(0)
) -> DataFrame:
    """The orders the verdicts are about, with a new status, once per verdict.

    An update takes the later of both times and the verdict's sequence number. The
    verdicts' event time is ``shift`` later than the verdict, see ``validated_updates``.
    """
    pairs = interval_join(
        verdicts.select(
            F.col("order_id").alias("id"),
            F.col("ts").alias("verdict_ts"),
            F.col("seq").alias("verdict_seq"),
        ),
        created(orders).select(*ORDER_COLUMNS, F.col("ts").alias("order_ts")),
        ["id"],
        "verdict_ts",
        "order_ts",
        schemas.JOIN_TOLERANCE,
        shift,
        tiled=False,
    )
    verdict_ts = F.col("verdict_ts") - F.lit(shift)
    return pairs.withColumn("status", F.lit(status)).select(
        *ORDER_COLUMNS,
        F.greatest(verdict_ts, "order_ts").alias("ts"),
        F.col("verdict_seq").alias("seq"),
        "order_ts",
    )


def validated_orders(
    validations: DataFrame,
    orders: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    distinct_types: bool = False,
) -> DataFrame:
    """One VALIDATED update per verdict that brings the running count to three or more."""
    counts = pass_count_running(validations, rows_per_block, distinct_types)
    return validated_updates(counts, orders)


def validated_updates(
    counts: DataFrame, orders: DataFrame, shift: timedelta = timedelta(0)
) -> DataFrame:
    """VALIDATED updates for the counts that reach the number of checks.

    ``shift`` is how far the counts' event time lies behind the last verdict: none for
    running counts, and for streamed sessions the rest of their window.
    """
    enough = counts.where(F.col("passes") >= len(schemas.CHECKS))
    return _updates(enough, orders, "VALIDATED", shift).drop("order_ts")


def validated_sessions(
    validations: DataFrame, orders: DataFrame, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """One VALIDATED update per closed session with three or more PASSes."""
    sessions = pass_count_sessions(validations, rows_per_block)
    counts = sessions.select(
        "order_id", "passes", F.col("last_ts").alias("ts"), F.col("last_seq").alias("seq")
    )
    return validated_updates(counts, orders)


def failed_orders_raw(validations: DataFrame, orders: DataFrame) -> DataFrame:
    """One FAILED update per failing verdict."""
    return failed_updates(validations, orders).drop("order_ts")


def failed_updates(validations: DataFrame, orders: DataFrame) -> DataFrame:
    """``failed_orders_raw`` with the order's own time as ``order_ts``."""
    return _updates(validations.where(F.col("result") == "FAIL"), orders, "FAILED")


def failed_orders(validations: DataFrame, orders: DataFrame) -> DataFrame:
    """One FAILED update per order: its first."""
    return first_per_key(failed_orders_raw(validations, orders), ["id"], ["ts", "seq"])


def order_log(orders: DataFrame, validated: DataFrame, failed: DataFrame) -> DataFrame:
    """The order log with the status updates appended.

    ``step`` is 0 for orders, 1 for VALIDATED and 2 for FAILED updates: at one instant
    updates follow orders, and of one verdict's updates FAILED comes last.
    """
    columns = [*ORDER_COLUMNS, "ts", "seq"]
    steps = [frame.select(*columns) for frame in (orders, validated, failed)]
    return reduce(
        DataFrame.unionByName,
        [frame.withColumn("step", F.lit(step)) for step, frame in enumerate(steps)],
    )


def _log_order() -> list[Column]:
    """What puts the records of an order in a row."""
    return [F.col("ts"), (F.col("step") > 0).alias("updates"), F.col("seq"), F.col("step")]


def is_delete() -> Column:
    """Whether a record has an id and nothing else, see ``topics.deleted_orders``."""
    values = [F.col(c).isNull() for c in ORDER_COLUMNS if c != "id"]
    return reduce(lambda a, b: a & b, values)


def orders_now(table: DataFrame) -> DataFrame:
    """The orders of a table of last records: those whose last record is not a delete."""
    return table.where(~is_delete())


def order_state(log: DataFrame) -> DataFrame:
    """The current record of every order; one whose last record is a delete has none."""
    return orders_now(last_per_key(log, ["id"], _log_order()))


def order_changes(log: DataFrame, known: DataFrame | None) -> DataFrame:
    """What the records of ``log`` change in a table of last records, ``known``.

    (id, change, before, after) for each order whose last record changes. ``change`` is
    insert, update or delete, and null for a delete of what was not there; ``before`` is
    null for an insert, ``after`` the new record, of a delete the delete itself.
    """
    record = F.struct(*log.columns)
    order = F.struct(*_log_order())
    keyed = log.where("id is not null").withColumn("new", F.lit(True))
    if known is not None:
        keyed = keyed.unionByName(known.select(log.columns).withColumn("new", F.lit(False)))
    present = ~F.col("new") & ~is_delete()
    changed = (
        keyed.groupBy("id")
        .agg(
            F.max_by(record, order).alias("after"),
            F.max_by("new", F.struct(order, ~F.col("new"))).alias("changed"),
            F.first(F.when(present, record), ignorenulls=True).alias("before"),
        )
        .where("changed")
    )
    gone = changed.select("*", "after.*").select("before", "after", is_delete().alias("gone"))
    kind = (
        F.when(~F.col("gone"), F.when(F.col("before").isNull(), "insert").otherwise("update"))
        .when(F.col("before").isNotNull(), "delete")
    )
    return gone.select("after.id", kind.alias("change"), "before", "after")


def folded_changes(changes: DataFrame) -> DataFrame:
    """The orders that a feed of ``order_changes`` leaves: its last word on each of them."""
    last = last_per_key(changes.select("change", "after.*"), ["id"], _log_order())
    return last.where("change <> 'delete'").drop("change")


def lookup(
    state: DataFrame, ids: DataFrame | int | str, predicate: Column | None = None
) -> DataFrame:
    """Orders by id, one or a frame of ids, that also meet ``predicate``."""
    if isinstance(ids, DataFrame):
        found = state.join(ids.select("id"), "id", "left_semi")
    else:
        found = state.where(F.col("id") == F.lit(ids))
    return found if predicate is None else found.where(predicate)


def order_lifecycle(
    orders: DataFrame, inventory: DataFrame, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Run all checks, turn the verdicts into updates and give every order's state."""
    # The verdict log feeds both branches below; it is written once.
    verdicts = materialize(all_validations(orders, inventory, rows_per_block))
    return order_state(
        order_log(
            orders,
            validated_orders(verdicts, orders, rows_per_block),
            failed_orders(verdicts, orders),
        )
    )
