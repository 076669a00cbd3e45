"""Column expressions over order, verdict and inventory records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas


def is_sane_order() -> Column:
    """Customer and product present, quantity and price positive; never null."""
    sane = (
        F.col("customer_id").isNotNull()
        & F.col("product").isNotNull()
        & (F.col("quantity") > 0)
        & (F.col("price") > 0)
    )
    return F.coalesce(sane, F.lit(False))


def spend() -> Column:
    return F.col("price") * F.col("quantity")


def verdict(check: str, passed: Column) -> list[Column]:
    """The (type, result) columns of a verdict record."""
    return [
        F.lit(check).alias("type"),
        F.when(passed, "PASS").otherwise("FAIL").alias("result"),
    ]


def _to_json(names: dict[str, str]) -> Column:
    fields = F.struct(*[F.col(column).alias(name) for column, name in names.items()])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def encode_order() -> Column:
    return _to_json(schemas.JSON_ORDER)


def encode_validation() -> Column:
    return _to_json(schemas.JSON_VALIDATION)


def parse_json(value: Column, schema: T.StructType, names: dict[str, str]) -> Column:
    """Parse a JSON value by its field ``names``, a struct of the fields and ``corrupt``.

    ``corrupt`` holds the text of a value that is not a record of that type, else null.
    """
    fields = [T.StructField(names[f.name], f.dataType) for f in schema.fields]
    wire = T.StructType([*fields, T.StructField("corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    return F.from_json(value, wire, options)


def parsed_field(parsed: str, field: T.StructField, names: dict[str, str]) -> Column:
    """A field of a parsed value; absent numbers are 0, as they are never null."""
    column = F.col(f"{parsed}.{names[field.name]}")
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        column = F.coalesce(column, F.lit(0).cast(field.dataType))
    return column


def history_header(topic: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(schemas.HISTORY_HEADER).alias("key"),
            topic.cast("binary").alias("value"),
        )
    )
