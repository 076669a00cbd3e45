"""Ingest, JSON encoding and decoding of topics, and the merged history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas
from ledgerline.functions import (
    encode_order,
    encode_validation,
    history_header,
    parse_json,
    parsed_field,
)
from ledgerline.operators import tag_and_union


def _envelope(df: DataFrame) -> list[str]:
    return [c for c in ("ts", "seq") if c in df.columns]


def ingest_orders(requests: DataFrame) -> DataFrame:
    """New orders from requests; a customer is made up where a request names none."""
    given = (
        F.col("customer_id").cast("string")
        if "customer_id" in requests.columns
        else F.lit(None).cast("string")
    )
    return requests.select(
        "id",
        F.lit("CREATED").alias("status"),
        "product",
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.coalesce("price", F.lit(0)).cast("bigint").alias("price"),
        F.coalesce(given, F.uuid()).alias("customer_id"),
        *_envelope(requests),
    )


def decode(
    records: DataFrame,
    schema: T.StructType,
    names: Mapping[str, str],
    domains: Mapping[str, tuple[str, ...]],
    deletes: bool = False,
) -> DataFrame:
    """Decode ``value`` of (key, value, ts, seq) records; ``reject`` marks bad ones.

    A record is rejected when it is not JSON of its type or has a value outside a
    field's list; ``reject`` then holds its text. Nothing is dropped here, but that with
    ``deletes`` a null value under a key is a delete and left out, see ``deleted_orders``.
    """
    names = dict(names)
    # A generated column is not inlined into filters on it: each record is parsed once.
    parsed = records.withColumn(
        "parsed", F.explode(F.array(parse_json(F.col("value"), schema, names)))
    )
    if deletes and "key" in records.columns:
        parsed = parsed.where(F.col("value").isNotNull() | F.col("key").isNull())
    valid = F.col("value").isNotNull() & F.col("parsed.corrupt").isNull()
    for column, values in domains.items():
        field = F.col(f"parsed.{names[column]}")
        valid = valid & (field.isNull() | field.isin(*values))
    return parsed.select(
        *[F.when(valid, parsed_field("parsed", f, names)).alias(f.name) for f in schema.fields],
        *_envelope(records),
        F.when(~valid, F.coalesce("value", F.lit(""))).alias("reject"),
    )


def deleted_orders(records: DataFrame) -> DataFrame:
    """The deletes among (key, value, ts, seq) order records: a key without a value.

    An order record without status, for ``outcomes.order_state``. Ids are taken from keys.
    """
    gone = records.where(F.col("value").isNull() & F.col("key").isNotNull())
    fields = [
        F.lit(None).cast(f.dataType).alias(f.name) if f.name != "id" else F.col("key").alias("id")
        for f in schemas.ORDER.fields
    ]
    return gone.select(*fields, *_envelope(records))


def decode_orders(records: DataFrame) -> DataFrame:
    return decode(
        records,
        schemas.ORDER,
        schemas.JSON_ORDER,
        {"status": schemas.STATUSES, "product": schemas.PRODUCTS},
        deletes=True,
    )


def decode_validations(records: DataFrame) -> DataFrame:
    return decode(
        records,
        schemas.VALIDATION,
        schemas.JSON_VALIDATION,
        {"type": schemas.CHECKS, "result": schemas.RESULTS},
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject").isNull()).drop("reject")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject").isNotNull()).select("reject", *_envelope(decoded))


def encode_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("id").cast("string").alias("key"), encode_order().alias("value"), *_envelope(orders)
    )


def encode_validations(validations: DataFrame) -> DataFrame:
    return validations.select(
        F.col("order_id").cast("string").alias("key"),
        encode_validation().alias("value"),
        *_envelope(validations),
    )


def encode_inventory(inventory: DataFrame) -> DataFrame:
    """Stock as text; a delete keeps its null value."""
    return inventory.select(
        F.col("product").alias("key"),
        F.col("stock").cast("string").alias("value"),
        *_envelope(inventory),
    )


def order_history(topics: Mapping[str, DataFrame]) -> DataFrame:
    """All topics' (key, value) records as one, each marked with where it came from."""
    return history_records(tag_and_union(topics))


def history_records(records: DataFrame) -> DataFrame:
    """The history of (topic, key, value) records, as read from several topics at once."""
    text = F.coalesce(F.col("value"), F.lit("null"))
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.concat(F.col("topic"), F.lit(": "), text).alias("value"),
        F.col("topic").alias("from_topic"),
        history_header(F.col("topic")).alias("headers"),
        *_envelope(records),
    )
