"""What customers buy, by user functions: a profile with state, reduced habits, baskets per session."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas
from ledgerline.operators import SessionAggregate, Transformer, reduce_per_key, session_fold, transform
from ledgerline.operators.blocks import ROWS_PER_BLOCK
from ledgerline.plans.checks import created

# Workers get this module's code with each task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How much an order's spend weighs against the average before it.
WEIGHT = 0.5
# The place of a product in a basket's bits (fixed by the product type's order).
PRODUCTS = {"SHOES": 1, "WATCH": 2, "GUITAR": 4}


def _profile(state: dict, product: str | None, spent: int | None) -> tuple[dict, dict]:
    """One order: whether the product is another than before, and the average spend so far."""
    average = (1 - WEIGHT) * state["average"] + WEIGHT * (spent or 0)
    changed = None not in (product, state["product"]) and product != state["product"]
    state = {"product": product or state["product"], "average": average}
    return state, {"changed": changed, "average": average}


PROFILE = Transformer(
    ("product", "spent"),
    _profile,
    {"product": None, "average": 0.0},
    T.StructType([T.StructField("product", T.StringType()), T.StructField("average", T.DoubleType())]),
    T.StructType([T.StructField("changed", T.BooleanType()), T.StructField("average", T.DoubleType())]),
)


def spending(orders: DataFrame) -> DataFrame:
    spent = (F.col("price") * F.col("quantity")).cast("bigint").alias("spent")
    return created(orders).select("id", "customer_id", "product", spent, "ts", "seq")


def customer_profiles(orders: DataFrame) -> DataFrame:
    """Each order with its customer's profile after it."""
    return profile_rows(transform(spending(orders), ["customer_id"], ["ts", "seq"], PROFILE, "profile"))


def profile_rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", "customer_id", "profile.changed", "profile.average", "ts")


def _after(earlier: dict, later: dict) -> dict:
    turned = later["first_product"] != earlier["last_product"]
    return {
        "first_product": earlier["first_product"],
        "last_product": later["last_product"],
        "changes": earlier["changes"] + later["changes"] + turned,
    }


def product_changes(orders: DataFrame) -> DataFrame:
    """Each customer's first and last product, and how often it changed from order to order."""
    bought = created(orders).where("product is not null")
    record = {"first_product": F.col("product"), "last_product": F.col("product"), "changes": F.lit(0).cast("bigint")}
    return reduce_per_key(bought, ["customer_id"], ["ts", "seq"], record, _after)


def _add(state: dict, product: str | None, spent: int | None) -> dict:
    return _both(state, {"products": PRODUCTS.get(product, 0), "dearest": spent})


def _both(a: dict, b: dict) -> dict:
    known = [s["dearest"] for s in (a, b) if s["dearest"] is not None]
    return {"products": a["products"] | b["products"], "dearest": max(known, default=None)}


BASKET = SessionAggregate(
    ("product", "spent"),
    {"products": 0, "dearest": None},
    _add,
    _both,
    T.StructType([T.StructField("products", T.LongType()), T.StructField("dearest", T.LongType())]),
)


def baskets(orders: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per customer and session: which products were ordered, as bits, and the dearest order."""
    found = session_fold(
        spending(orders), ["customer_id"], "ts", "seq", schemas.SPEND_GAP, BASKET, "basket", rows_per_block
    )
    return found.select("customer_id", "first_ts", "last_ts", "basket.products", "basket.dearest")
