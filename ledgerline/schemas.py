"""Topics, record schemas and the constants of the order flow."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import types as T

# They must equal the reference's for right results.
STATUSES = ("CREATED", "VALIDATED", "FAILED", "SHIPPED")
PRODUCTS = ("SHOES", "WATCH", "GUITAR")
CHECKS = ("FRAUD_CHECK", "ORDER_DETAILS_CHECK", "INVENTORY_CHECK")
RESULTS = ("PASS", "FAIL")
ORDERS = "orders"
ORDER_VALIDATIONS = "order-validations"
WAREHOUSE_INVENTORY = "warehouse-inventory"
ORDERS_HISTORY = "orders-history"
HISTORY_HEADER = "from"
FRAUD_LIMIT = 2000
SPEND_GAP = timedelta(hours=1)
COUNT_GAP = timedelta(milliseconds=5)
JOIN_TOLERANCE = timedelta(minutes=5)
JSON_ORDER = {
    "id": "id",
    "status": "status",
    "product": "product",
    "quantity": "quantity",
    "price": "price",
    "customer_id": "customerId",
}
JSON_VALIDATION = {"order_id": "orderId", "type": "type", "result": "result"}

# How far behind the newest record one may arrive and still count: a day from the
# start of its session or join. A session's end includes the gap, hence 24 h less two.
SPEND_DELAY = timedelta(hours=22)
COUNT_DELAY = timedelta(hours=24)
STOCK_DELAY = timedelta(hours=24)
# How long after its end a session still takes late rows, where those beyond are dropped and
# told: a day less the gap.
SPEND_GRACE = timedelta(hours=24) - SPEND_GAP
COUNT_GRACE = timedelta(hours=24) - COUNT_GAP

ORDER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.LongType()),
        T.StructField("customer_id", T.StringType()),
    ]
)
VALIDATION = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("result", T.StringType()),
    ]
)
INVENTORY = T.StructType(
    [
        T.StructField("product", T.StringType()),
        T.StructField("stock", T.IntegerType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("from_topic", T.StringType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField("value", T.BinaryType()),
                    ]
                )
            ),
        ),
    ]
)
# The ingest request: what a client sends; the customer is optional.
ORDER_REQUEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.LongType()),
        T.StructField("customer_id", T.StringType()),
    ]
)
# Event time and a unique tie-break, carried next to every record.
ENVELOPE = [
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
]

TOPICS = {
    ORDERS: ORDER,
    ORDER_VALIDATIONS: VALIDATION,
    WAREHOUSE_INVENTORY: INVENTORY,
}


def with_envelope(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + ENVELOPE)
