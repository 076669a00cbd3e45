"""The three checks of a created order, each giving PASS or FAIL verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import is_sane_order, spend, verdict
from ledgerline.operators import (
    asof_join,
    asof_parts,
    ordered_fold,
    session_aggregate,
    session_running,
)
from ledgerline.operators.blocks import ROWS_PER_BLOCK
from ledgerline.operators.fold import StockReservation


def created(orders: DataFrame) -> DataFrame:
    """New orders only; this also keeps status updates from being checked again."""
    return orders.where(F.col("status") == "CREATED")


def _verdicts(orders: DataFrame, check: str, passed: Column) -> DataFrame:
    """Verdicts carry their order's time and a sequence number of their own."""
    number = schemas.CHECKS.index(check)
    return orders.select(
        F.col("id").alias("order_id"),
        *verdict(check, passed),
        "ts",
        (F.col("seq") * len(schemas.CHECKS) + number).alias("seq"),
    )


def details_check(orders: DataFrame) -> DataFrame:
    return _verdicts(created(orders), "ORDER_DETAILS_CHECK", is_sane_order())


def fraud_sessions(orders: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each customer's spend per session and its latest order."""
    order = F.struct(*[f.name for f in schemas.ORDER.fields])
    return session_aggregate(
        created(orders),
        ["customer_id"],
        "ts",
        "seq",
        schemas.SPEND_GAP,
        sums={"total": spend()},
        lasts={"order": order},
        rows_per_block=rows_per_block,
    )


def fraud_running_total(orders: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each order with its customer's spend so far in the session."""
    return session_running(
        created(orders).select("id", "customer_id", "price", "quantity", "ts", "seq"),
        ["customer_id"],
        "ts",
        "seq",
        schemas.SPEND_GAP,
        {"total": spend()},
        rows_per_block,
    ).where(F.col("total").isNotNull())


def fraud_check(orders: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return fraud_verdicts(fraud_running_total(orders, rows_per_block))


def fraud_verdicts(totals: DataFrame) -> DataFrame:
    return _verdicts(totals, "FRAUD_CHECK", F.col("total") < schemas.FRAUD_LIMIT)


def orders_with_stock(orders: DataFrame, inventory_now: DataFrame) -> DataFrame:
    """Created orders with today's stock of their product (a snapshot, not as-of)."""
    return created(orders).join(inventory_now.select("product", "stock"), "product")


def stock_versions(changes: DataFrame) -> DataFrame:
    """Stock changes as versions (product, stock, seq, valid_from, valid_to).

    A version holds from its change until before the next one of its product, and its
    ``valid_to`` is null while there is none. Of changes at one instant, by ``seq``, all but
    the last hold for no time.
    """
    along = W.partitionBy("product").orderBy("ts", "seq")
    changes = changes.where("product is not null")
    return changes.withColumn("valid_to", F.lead("ts").over(along)).select(
        "product", "stock", "seq", F.col("ts").alias("valid_from"), "valid_to"
    )


def _stock_inputs(orders: DataFrame) -> DataFrame:
    quantity = F.coalesce("quantity", F.lit(0)).alias("quantity")
    return created(orders).select("id", "product", quantity, "ts", "seq")


def orders_asof_stock(
    orders: DataFrame, inventory: DataFrame, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Created orders with the stock of their product at the order's time."""
    return asof_join(
        _stock_inputs(orders), inventory, ["product"], "ts", "seq", ["stock"], rows_per_block
    )


def reservations(
    orders: DataFrame,
    inventory: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    positive_only: bool = False,
    reserved: DataFrame | None = None,
) -> DataFrame:
    """Reserve stock per product in order time; ``granted`` says which orders got it.

    Refused orders reserve nothing, and one with a negative quantity gives stock back
    unless ``positive_only`` refuses it. Orders without a stock row are left out.
    ``reserved`` (product, start) is what was reserved before.
    """
    stocked = asof_parts(
        _stock_inputs(orders), inventory, ["product"], "ts", "seq", ["stock"], rows_per_block
    )
    reservation = StockReservation(positive_only)
    return ordered_fold(
        stocked, ["product"], ["ts", "seq"], reservation, "granted", starts=reserved
    )


def inventory_check(
    orders: DataFrame,
    inventory: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    positive_only: bool = False,
) -> DataFrame:
    return inventory_verdicts(reservations(orders, inventory, rows_per_block, positive_only))


def inventory_verdicts(reservations: DataFrame) -> DataFrame:
    return _verdicts(reservations, "INVENTORY_CHECK", F.col("granted"))


def all_validations(
    orders: DataFrame, inventory: DataFrame, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """The verdict log: every check's verdicts."""
    return reduce(
        DataFrame.unionByName,
        [
            details_check(orders),
            fraud_check(orders, rows_per_block),
            inventory_check(orders, inventory, rows_per_block),
        ],
    )
