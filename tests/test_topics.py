"""Ingest, JSON, history, topic folders and the Kafka envelope."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from conftest import at
from ledgerline import schemas, sources
from ledgerline.plans import checks, topics


def test_ingest(spark):
    requests = spark.createDataFrame(
        [("a", "SHOES", 2, 30, "c1"), ("b", "WATCH", None, None, None)], schemas.ORDER_REQUEST
    )
    rows = {r.id: r for r in topics.ingest_orders(requests).collect()}
    assert rows["a"].customer_id == "c1"
    assert rows["a"].status == rows["b"].status == "CREATED"
    assert (rows["b"].quantity, rows["b"].price) == (0, 0)
    assert str(uuid.UUID(rows["b"].customer_id)) == rows["b"].customer_id
    bare = topics.ingest_orders(requests.drop("customer_id"))
    assert bare.select("customer_id").distinct().count() == 2
    assert [f.dataType for f in bare.schema] == [f.dataType for f in schemas.ORDER]


def test_encode_and_decode(spark, orders, verdicts):
    rows = orders((1, at(), {}), (2, at(), {"product": None, "customer_id": None}))
    encoded = topics.encode_orders(rows)
    values = [json.loads(r.value) for r in encoded.orderBy("seq").collect()]
    assert list(values[0]) == ["id", "status", "product", "quantity", "price", "customerId"]
    assert values[1]["customerId"] is None and "product" in values[1]
    back = topics.accepted(topics.decode_orders(encoded))
    typed = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "customer_id")})
    expected = typed.select(back.columns).collect()
    assert sorted(map(str, back.collect())) == sorted(map(str, expected))

    log = topics.encode_validations(verdicts((7, "FRAUD_CHECK", "PASS", at())))
    record = topics.accepted(topics.decode_validations(log)).first()
    assert (record.order_id, record.type, record.result) == ("7", "FRAUD_CHECK", "PASS")


def test_bad_records_are_set_aside(spark):
    values = [
        '{"id":"1","status":"CREATED"}',
        '{"id":"2","status":',
        '{"id":"3","status":"LOST"}',
        '{"id":"4","product":"HAT"}',
        '{"id":"5","quantity":"many"}',
        "[1]",
        None,
    ]
    records = spark.createDataFrame(
        [(str(n), v, at(), n) for n, v in enumerate(values)],
        "key string, value string, ts timestamp, seq bigint",
    )
    decoded = topics.decode_orders(records)
    good = topics.accepted(decoded).collect()
    assert [(r.id, r.quantity, r.price, r.customer_id) for r in good] == [("1", 0, 0, None)]
    assert {r.seq for r in topics.rejected(decoded).collect()} == {1, 2, 3, 4, 5}
    # A null value under a key is no bad record but a delete.
    assert [(r.id, r.seq) for r in topics.deleted_orders(records).collect()] == [("6", 6)]


def test_history(orders, stock):
    history = topics.order_history(
        {
            schemas.ORDERS: topics.encode_orders(orders((1, at(), {}))),
            schemas.WAREHOUSE_INVENTORY: topics.encode_inventory(
                stock(("SHOES", 5, at()), ("SHOES", None, at()))
            ),
        }
    )
    rows = {(r.key, r.seq): r for r in history.collect() if r.key == "SHOES"}
    assert rows["SHOES", 0].value == "warehouse-inventory: 5"
    assert rows["SHOES", 1].value == "warehouse-inventory: null"
    order = history.where("key = '1'").first()
    assert order.value.startswith('orders: {"id":1,')
    assert [(h.key, bytes(h.value)) for h in order.headers] == [("from", b"orders")]
    assert history.select("key", "value", "from_topic", "headers").schema.simpleString() == (
        schemas.HISTORY.simpleString()
    )


def test_topic_folders(spark, orders, tmp_path):
    path = str(tmp_path / "orders")
    typed = orders((1, at(), {}), (2, at(), {"status": "FAILED"})).withColumns(
        {c: F.col(c).cast("string") for c in ("id", "customer_id")}
    )
    sources.append_topic(typed, path)
    sources.append_topic(typed.withColumn("seq", F.col("seq") + 10), path)
    table = sources.read_topic(spark, path, schemas.ORDERS)
    assert table.count() == 4
    plan = checks.created(table)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,CREATED)" in plan.split("PushedFilters")[1]

    text = str(tmp_path / "records")
    sources.append_records(topics.encode_orders(typed), text)
    records = sources.read_records(spark, text)
    assert topics.accepted(topics.decode_orders(records)).count() == 2
    assert sources.read_records(spark, text, stream=True, files_per_batch=1).isStreaming


def test_state_table_lookup(spark, tmp_path):
    path = str(tmp_path / "state")
    state = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    sources.write_state(state, path, 4)
    table = spark.read.parquet(path)
    assert table.where("id = '77'").count() == 1
    bounds = table.groupBy(F.input_file_name()).agg(F.min("id").alias("a"), F.max("id").alias("b"))
    spans = sorted((r.a, r.b) for r in bounds.collect())
    assert len(spans) == 4 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_kafka_envelope(spark):
    inventory = schemas.WAREHOUSE_INVENTORY
    rows = spark.createDataFrame(
        [
            (bytearray(b"k"), bytearray(b"v"), "orders", 3, 7, at()),
            (bytearray(b'"SHOES"'), bytearray(b"\x00\x00\x00\x05"), inventory, 0, 8, at()),
            (bytearray(b'"SHOES"'), bytearray(b"\xff\xff\xff\xfe"), inventory, 0, 9, at()),
            (bytearray(b'"WATCH"'), None, inventory, 1, 9, at()),
        ],
        "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp",
    )
    text = sources.text_records(rows.where("topic = 'orders'")).first()
    assert (text.topic, text.key, text.value, text.ts) == ("orders", "k", "v", at())
    stock = sources.inventory_records(rows.where("topic <> 'orders'"))
    assert stock.select("seq").distinct().count() == 3
    assert [(r.product, r.stock) for r in stock.orderBy("seq").collect()] == [
        ("SHOES", 5),
        ("SHOES", -2),
        ("WATCH", None),
    ]
    history = topics.history_records(sources.text_records(rows)).orderBy("seq")
    assert [(r.key, r.value) for r in history.collect()] == [
        ("k", "orders: v"),
        ("SHOES", "warehouse-inventory: 5"),
        ("SHOES", "warehouse-inventory: -2"),
        ("WATCH", "warehouse-inventory: null"),
    ]
    out = sources.kafka_rows(sources.text_records(rows), "copy").first()
    assert (out.topic, out.key) == ("copy", "k")
