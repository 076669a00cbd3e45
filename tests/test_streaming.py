"""Streaming jobs over several micro-batches against the batch jobs."""

from __future__ import annotations

import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, at
from ledgerline import registry, schemas
from ledgerline.operators import last_per_key
from ledgerline.plans import checks, outcomes, topics
from ledgerline.session import checkpoint_dir, listed, write_once
from ledgerline.sources import KeyedTable
from ledgerline.streaming import batches, jobs
from test_checks import make_orders, make_stock


class Topic:
    """A folder to which files are appended, read one file per micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.files = spark, str(path), schema, 0

    def append(self, df):
        part = f"{self.path}-{self.files}"
        df.coalesce(1).write.parquet(part)
        os.makedirs(self.path, exist_ok=True)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.link(f"{part}/{name}", f"{self.path}/{self.files}.parquet")
        now = time.time() - 1000 + self.files
        os.utime(f"{self.path}/{self.files}.parquet", (now, now))
        self.files += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.path)

    def table(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


def sliced(spark, tmp_path, name, df, hours):
    """A topic whose files hold successive spans of event time."""
    topic = Topic(spark, tmp_path / name, df.schema)
    for start in range(0, hours, 4):
        span = (F.col("ts") >= F.lit(at(hours=start))) & (F.col("ts") < F.lit(at(hours=start + 4)))
        topic.append(df.where(span))
    return topic


def text(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted(map(str, df.select(columns).collect()))


def places(tmp_path, name):
    return [str(tmp_path / f"{name}-{kind}") for kind in ("out", "state", "checkpoint")]


@pytest.mark.parametrize("block,compact_every", [(20, 3), (10**6, 1), (10**6, 20)])
def test_fraud_check(spark, tmp_path, block, compact_every):
    rows = make_orders(spark, 11, 400)
    topic = sliced(spark, tmp_path, "orders", rows, 32)
    assert topic.table().count() == rows.count()
    out, state, checkpoint = places(tmp_path, "fraud")
    scratch = checkpoint_dir(spark)
    before = os.listdir(scratch)
    jobs.fraud_check(
        topic.stream(),
        out,
        state,
        checkpoint,
        rows_per_block=block,
        compact_every=compact_every,
    ).awaitTermination()
    assert os.listdir(scratch) == before
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == topic.files
    assert len([d for d in os.listdir(f"{state}/data") if d.startswith("batch=")]) <= 2 * compact_every + 1
    assert len([d for d in os.listdir(f"{state}/versions") if d.endswith(".json") and d[0] != "."]) == 2
    assert text(batches.read_batches(spark, out)) == text(checks.fraud_check(rows))


@pytest.mark.parametrize("block", [20, 10**6])
def test_inventory_check(spark, tmp_path, block):
    rows, changes = make_orders(spark, 12, 400), make_stock(spark, 12, 24)
    orders = sliced(spark, tmp_path, "orders", rows, 32)
    # All changes arrive with the first orders: later orders must not see them early.
    inventory = Topic(spark, tmp_path / "inventory", changes.schema)
    inventory.append(changes)
    out, state, checkpoint = places(tmp_path, "inventory")
    jobs.inventory_check(
        orders.stream(), inventory.stream(), out, state, checkpoint, rows_per_block=block
    ).awaitTermination()
    assert text(batches.read_batches(spark, out)) == text(checks.inventory_check(rows, changes))


def test_resumes_and_repeats_nothing(spark, tmp_path):
    rows = make_orders(spark, 13, 200)
    topic = Topic(spark, tmp_path / "orders", rows.schema)
    out, state, checkpoint = places(tmp_path, "fraud")
    for start in (0, 100):
        topic.append(rows.where((F.col("seq") >= start) & (F.col("seq") < start + 100)))
        jobs.fraud_check(topic.stream(), out, state, checkpoint).awaitTermination()
    first = batches.read_batches(spark, out)
    files = sorted(first.inputFiles())
    assert first.count() == checks.fraud_running_total(rows).count()
    # A batch that is run again finds its folders complete and leaves them.
    commits = f"{checkpoint}/commits"
    for name in os.listdir(commits):
        if name.strip(".crc").lstrip(".") == "1":
            os.remove(f"{commits}/{name}")
    jobs.fraud_check(topic.stream(), out, state, checkpoint).awaitTermination()
    assert sorted(batches.read_batches(spark, out).inputFiles()) == files


def test_late_order_joins_the_open_session(spark, tmp_path, orders):
    early = orders(
        (1, at(minutes=0), {"price": 100}),
        (2, at(minutes=50), {"price": 100}),
        (3, at(minutes=100), {"price": 100}),
    )
    late = orders(
        (4, at(minutes=20), {"price": 1700}),  # within the open session
        (5, at(minutes=-70), {"price": 1999}),  # more than an hour before it
        (6, at(minutes=110), {"price": 1}),
    )
    topic = Topic(spark, tmp_path / "orders", early.schema)
    topic.append(early)
    topic.append(late)
    out, state, checkpoint = places(tmp_path, "fraud")
    jobs.fraud_check(topic.stream(), out, state, checkpoint).awaitTermination()
    results = {r.order_id: r.result for r in batches.read_batches(spark, out).collect()}
    assert results == {1: "PASS", 2: "PASS", 3: "PASS", 4: "FAIL", 5: "PASS", 6: "FAIL"}
    newest = KeyedTable(spark, state, ["customer_id"]).rows().orderBy("began").collect()
    assert [(r.total, r.began) for r in newest] == [(1999, at(minutes=-70)), (2001, at())]


def test_old_sessions_leave_the_state(spark, tmp_path, orders):
    rows = orders((1, at(), {}), (2, at(hours=40), {"customer_id": 2}))
    topic = Topic(spark, tmp_path / "orders", rows.schema)
    topic.append(rows)
    out, state, checkpoint = places(tmp_path, "fraud")
    jobs.fraud_check(topic.stream(), out, state, checkpoint).awaitTermination()
    assert [r.customer_id for r in KeyedTable(spark, state, ["customer_id"]).rows().collect()] == [2]


def spent(spark, tmp_path, *parts, name="fraud", every=20, delay=None):
    """The fraud verdicts of orders that arrive in these parts."""
    topic = Topic(spark, tmp_path / f"{name}-orders", parts[0].schema)
    out, state, checkpoint = places(tmp_path, name)
    more = {} if delay is None else {"delay": delay}
    for part in parts:
        topic.append(part)
    jobs.fraud_check(
        topic.stream(), out, state, checkpoint, compact_every=every, **more
    ).awaitTermination()
    return {r.order_id: r.result for r in batches.read_batches(spark, out).collect()}


def test_late_order_joins_an_earlier_session(spark, tmp_path, orders):
    early = orders((1, at(), {"price": 1900}), (2, at(hours=3), {"price": 10}))
    late = orders((3, at(minutes=10), {"price": 500}))
    found = spent(spark, tmp_path, early, late)
    assert found == {1: "PASS", 2: "PASS", 3: "FAIL"}


def test_late_orders_reach_a_session_through_each_other(spark, tmp_path, orders):
    early = orders((1, at(hours=2), {"price": 1900}))
    late = orders(
        (2, at(minutes=70), {"price": 50}),
        (3, at(minutes=20), {"price": 500}),
    )
    after = orders((4, at(hours=2, minutes=5), {"price": 1}))
    found = spent(spark, tmp_path, early, late, after)
    assert found == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "FAIL"}


@pytest.mark.parametrize("every", [1, 2, 20])
def test_lateness_does_not_depend_on_how_state_is_kept(spark, tmp_path, orders, every):
    parts = [
        orders((1, at(), {"price": 1900})),
        orders((2, at(hours=5), {"customer_id": 2})),
        orders((3, at(hours=9), {"customer_id": 3})),
        orders((4, at(minutes=10), {"price": 500})),
    ]
    found = spent(spark, tmp_path, *parts, every=every, delay=timedelta(hours=4))
    assert found[4] == "PASS"  # its session ended more than gap and delay before the newest
    found = spent(spark, tmp_path, *parts, name="wide", every=every, delay=timedelta(hours=12))
    assert found[4] == "FAIL"


def test_restart_with_another_number_of_states(spark, tmp_path, orders):
    topic = Topic(spark, tmp_path / "orders", orders((1, at(), {})).schema)
    out, state, checkpoint = places(tmp_path, "fraud")
    for n, every in ((0, 20), (1, 20), (2, 20), (3, 2)):
        price = {0: 1900, 3: 500}.get(n, 1)
        customer = {} if n in (0, 3) else {"customer_id": 2}
        topic.append(orders((n, at(minutes=n), {"price": price} | customer)))
        jobs.fraud_check(
            topic.stream(), out, state, checkpoint, compact_every=every
        ).awaitTermination()
    results = {r.order_id: r.result for r in batches.read_batches(spark, out).collect()}
    assert results[3] == "FAIL"


def test_a_half_written_folder_is_not_read(spark, tmp_path, orders):
    rows = orders((1, at(), {}))
    results = str(tmp_path / "results")
    rows.write.parquet(f"{results}/_unfinished-batch-0")
    write_once(rows, f"{results}/batch=0")
    write_once(rows.union(rows), f"{results}/batch=0")
    rows.write.parquet(f"{results}/_unfinished-batch-1")
    assert batches.read_batches(spark, results).count() == 1
    assert sorted(os.listdir(results)) == ["_unfinished-batch-1", "batch=0"]


def test_an_order_fails_once_across_the_delay(spark, tmp_path, orders, verdicts):
    placed = orders((1, at(), {}), (2, at(hours=24, minutes=2), {}))
    failing = [
        verdicts((1, "FRAUD_CHECK", "FAIL", at())),
        verdicts((2, "FRAUD_CHECK", "FAIL", at(hours=24, minutes=2))),
        verdicts((1, "FRAUD_CHECK", "FAIL", at(minutes=4))),
    ]
    topic = Topic(spark, tmp_path / "orders", placed.schema)
    topic.append(placed)
    log = Topic(spark, tmp_path / "verdicts", failing[0].schema)
    for part in failing:
        log.append(part)
    out, state, checkpoint = places(tmp_path, "failed")
    jobs.failed_orders(log.stream(), topic.stream(), out, state, checkpoint).awaitTermination()
    assert sorted(r.id for r in batches.read_batches(spark, out).collect()) == [1, 2]


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    """Orders with their verdict log, each as a topic of several files."""
    folder = tmp_path_factory.mktemp("flow")
    rows, changes = make_orders(spark, 14, 300), make_stock(spark, 14, 24)
    log = checks.all_validations(rows, changes)
    log = spark.createDataFrame(log.collect(), log.schema)
    return (
        rows,
        log,
        sliced(spark, folder, "orders", rows, 32),
        sliced(spark, folder, "verdicts", log, 32),
    )


def test_outcomes(spark, tmp_path, flow):
    rows, log, orders, verdicts = flow
    out, state, checkpoint = places(tmp_path, "counts")
    jobs.pass_counts(verdicts.stream(), out, state, checkpoint).awaitTermination()
    counts = batches.read_batches(spark, out)
    assert text(counts) == text(outcomes.pass_count_running(log))

    validated, _, checkpoint = places(tmp_path, "validated")
    streamed = batches.stream_batches(spark, out, counts.schema)
    jobs.validated_orders(streamed, orders.stream(), validated, checkpoint).awaitTermination()
    updates = spark.read.parquet(validated)
    assert text(updates) == text(outcomes.validated_orders(log, rows))
    assert updates.count() > 0

    failed, state, checkpoint = places(tmp_path, "failed")
    jobs.failed_orders(
        verdicts.stream(), orders.stream(), failed, state, checkpoint
    ).awaitTermination()
    failures = batches.read_batches(spark, failed)
    assert text(failures, outcomes.ORDER_COLUMNS) == text(
        outcomes.failed_orders(log, rows), outcomes.ORDER_COLUMNS
    )

    changed, table, checkpoint = places(tmp_path, "changed")
    order_log = outcomes.order_log(
        orders.stream(),
        spark.readStream.schema(updates.schema).parquet(validated),
        batches.stream_batches(spark, failed, failures.schema),
    )
    jobs.order_state(order_log, changed, table, checkpoint).awaitTermination()
    expected = outcomes.order_state(outcomes.order_log(rows, updates, failures))
    assert text(outcomes.orders_now(jobs.order_table(spark, table).rows())) == text(expected)
    changes = batches.read_batches(spark, changed)
    assert text(outcomes.folded_changes(changes)) == text(expected)
    # Each change begins where the one before it ended.
    assert changes.where("change = 'insert' and before is not null").isEmpty()
    told = changes.groupBy("id").agg(F.count_if(F.col("change") == "insert").alias("n")).where("n <> 1")
    assert told.isEmpty()


def test_closed_sessions_validate(spark, tmp_path, flow, verdicts, orders):
    """Session windows close once the watermark passes; a far later record closes all."""
    rows, log, _, _ = flow
    end = verdicts((-1, "FRAUD_CHECK", "PASS", at(days=60)))
    last = orders((-1, at(days=60), {}))
    verdict_topic = Topic(spark, tmp_path / "verdicts", log.schema)
    order_topic = Topic(spark, tmp_path / "orders", rows.schema)
    for topic, first, close in ((verdict_topic, log, end), (order_topic, rows, last)):
        topic.append(first)
        topic.append(close)
        topic.append(close.withColumn("seq", F.lit(-2).cast("bigint")))
    out, _, checkpoint = places(tmp_path, "sessions")
    jobs.validated_sessions(
        verdict_topic.stream(), order_topic.stream(), out, checkpoint
    ).awaitTermination()
    assert text(spark.read.schema(rows.schema).parquet(out)) == text(
        outcomes.validated_sessions(log, rows).select(rows.columns)
    )


def test_stateless_jobs(spark, tmp_path, flow):
    rows, log, orders, verdicts = flow
    out, _, checkpoint = places(tmp_path, "details")
    jobs.details_check(orders.stream(), out, checkpoint).awaitTermination()
    assert text(spark.read.parquet(out)) == text(checks.details_check(rows))

    def encoded(orders, verdicts):
        return {
            schemas.ORDERS: topics.encode_orders(orders),
            schemas.ORDER_VALIDATIONS: topics.encode_validations(verdicts),
        }

    out, _, checkpoint = places(tmp_path, "history")
    streams = encoded(orders.stream(), verdicts.stream())
    jobs.order_history(streams, out, checkpoint).awaitTermination()
    assert text(spark.read.parquet(out)) == text(topics.order_history(encoded(rows, log)))


def test_changelog_table_on_a_stream(spark, tmp_path):
    changes = make_stock(spark, 15, 24)
    topic = sliced(spark, tmp_path, "stock", changes, 24)
    query = (
        last_per_key(topic.stream(), ["product"], ["ts", "seq"])
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("stock_now")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    latest = last_per_key(changes, ["product"], ["ts", "seq"])
    assert text(spark.table("stock_now")) == text(latest)


def late_parts(orders):
    """Orders within and beyond the grace of 23 hours, by arrival."""
    return [
        orders((1, at(), {"price": 1900}), (2, at(hours=10), {"customer_id": 2}), (3, at(hours=1), {"price": 1})),
        orders((4, at(hours=30), {"customer_id": 3})),
        orders(
            (5, at(minutes=30), {"price": 500}),  # its session ended 29 hours before order 4
            (6, at(hours=8), {"price": 70}),  # 22 hours before it
            (7, at(hours=9, minutes=30), {"customer_id": 2, "price": 3000}),
            (8, at(hours=10, minutes=45), {"customer_id": 2, "price": 1}),
            (9, at(hours=6), {"customer_id": 2}),
            (10, at(hours=6, minutes=50), {"customer_id": 5}),  # a chain to within the grace
            (11, at(hours=7, minutes=40), {"customer_id": 5, "price": 1995}),
        ),
    ]


@pytest.mark.parametrize("block", [1, 10**6])
def test_too_late_orders_are_told(spark, tmp_path, orders, block):
    parts = late_parts(orders)
    topic = Topic(spark, tmp_path / "orders", parts[0].schema)
    for part in parts:
        topic.append(part)
    out, state, checkpoint = places(tmp_path, "fraud")
    late = str(tmp_path / "late")
    jobs.fraud_check(
        topic.stream(), out, state, checkpoint, rows_per_block=block, late=late
    ).awaitTermination()
    found = {r.order_id: r.result for r in batches.read_batches(spark, out).collect()}
    assert found == {1: "PASS", 2: "PASS", 3: "PASS", 4: "PASS", 6: "PASS", 7: "FAIL", 8: "FAIL", 10: "PASS", 11: "FAIL"}
    assert sorted(r.id for r in batches.read_batches(spark, late).collect()) == [5, 9]


def test_state_of_untouched_keys_is_not_read(spark, tmp_path, orders, monkeypatch):
    parts = [orders(*[(n, at(minutes=n), {"customer_id": n}) for n in range(200)])]
    parts += [orders((300 + n, at(minutes=201 + n), {"customer_id": 7})) for n in range(3)]
    topic = Topic(spark, tmp_path / "orders", parts[0].schema)
    for part in parts:
        topic.append(part)
    opened = []
    read = KeyedTable.rows

    def spy(self, version=None, buckets=None, where=None):
        found = read(self, version, buckets, where)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket#" in plan
        opened.append(list(buckets))
        return found

    monkeypatch.setattr(KeyedTable, "rows", spy)
    out, state, checkpoint = places(tmp_path, "fraud")
    jobs.fraud_check(topic.stream(), out, state, checkpoint).awaitTermination()
    monkeypatch.undo()
    table = KeyedTable(spark, state, ["customer_id"])
    version = table.version()
    (bucket,) = spark.createDataFrame([(7,)], "customer_id bigint").select(table.bucket()).first()
    assert opened == [[bucket]] * 3
    # Only that bucket was written after the first micro-batch.
    assert version.batches.pop(bucket)[-1] == 3 and set(map(tuple, version.batches.values())) == {(0,)}
    assert table.rows().count() == 201


def test_versions_of_stock_by_product(spark, tmp_path, orders, stock):
    """A late order meets the stock of its time; products without news are not rewritten."""
    placed = [
        orders((1, at(hours=2), {"quantity": 4}), (2, at(hours=2), {"product": "WATCH", "quantity": 1})),
        orders((3, at(hours=9), {"quantity": 3})),
        orders((4, at(hours=3), {"quantity": 2})),
    ]
    changes = [
        stock(("SHOES", 6, at(hours=1)), ("WATCH", 5, at(hours=1))),
        stock(("SHOES", 5, at(hours=8))),
        stock(("SHOES", 1, at(hours=20))),
    ]
    topic, inventory = (Topic(spark, tmp_path / n, parts[0].schema) for n, parts in (("o", placed), ("s", changes)))
    for part, change in zip(placed, changes, strict=True):
        topic.append(part)
        inventory.append(change)
    out, state, checkpoint = places(tmp_path, "inventory")
    jobs.inventory_check(topic.stream(), inventory.stream(), out, state, checkpoint).awaitTermination()
    found = {r.order_id: r.result for r in batches.read_batches(spark, out).collect()}
    # Order 3 finds 5 with 4 taken; order 4 comes late and finds the 6 of its time, 4 taken.
    assert found == {1: "PASS", 2: "PASS", 3: "FAIL", 4: "PASS"}
    table = KeyedTable(spark, state, ["product"])
    versions = table.rows().where("valid_from is not null").orderBy("product", "valid_from").collect()
    assert [(r.product, r.stock, r.valid_from, r.valid_to) for r in versions] == [
        ("SHOES", 6, at(hours=1), at(hours=8)),
        ("SHOES", 5, at(hours=8), at(hours=20)),
        ("SHOES", 1, at(hours=20), None),
        ("WATCH", 5, at(hours=1), None),
    ]
    watch = spark.createDataFrame([("WATCH",)], "product string").select(table.bucket()).first()[0]
    shoes = spark.createDataFrame([("SHOES",)], "product string").select(table.bucket()).first()[0]
    assert watch != shoes and table.version().batches[watch] == [0]


def test_micro_batches_of_several_files_and_more_state(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 50)
    monkeypatch.setattr(registry, "STATE_ROWS", 100)
    monkeypatch.setattr(registry, "STATE_PARTITIONS", 1)
    streams = registry.Streams(registry.Inputs(spark, SF_DIR))
    assert streams.state_partitions > 1
    counted = streams.run(jobs.pass_counts, streams.validations, state=True)
    plain = outcomes.pass_count_running(streams.inputs.validations)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
    (events,) = [n for n in listed(spark, streams.folder) if n == "events"]
    slices = [n for n in listed(spark, f"{streams.folder}/{events}") if n.startswith("slice=")]
    files = {len([f for f in listed(spark, f"{streams.folder}/{events}/{n}") if f.endswith(".parquet")]) for n in slices}
    assert len(slices) == registry.SLICES and len(files) == 1 and files.pop() > 1
