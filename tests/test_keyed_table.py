"""The table that is replaced key by key."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import at
from ledgerline.plans import outcomes
from ledgerline.sources import KeyedTable

LOG = (
    "id bigint, status string, product string, quantity int, price bigint, customer_id bigint, "
    "ts timestamp, seq bigint, step int"
)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_write_replaces_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=4, compact_every=3)
    assert table.version() is None
    with pytest.raises(FileNotFoundError):
        table.rows()
    expected = {}
    for n in range(12):
        changed = {k: [(k, f"{n}-{i}") for i in range(1 + (k + n) % 2)] for k in range(n % 5, 40, 1 + n % 7)}
        expected |= changed
        table.upsert(spark.createDataFrame([r for v in changed.values() for r in v], "k long, v string"))
        assert rows(table.rows()) == sorted(r for v in expected.values() for r in v)
        folders = [d for d in os.listdir(tmp_path / "data") if d.startswith("batch=")]
        assert len(folders) <= 8
        assert all(len(v) <= 3 for v in table.version().batches.values())


def test_files_stay_bounded(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=2, compact_every=8)
    for n in range(100):
        table.upsert(spark.createDataFrame([(n % 10, n)], "k long, v long").coalesce(1))
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith((".parquet", ".json")) and f[0] != "."]
    assert len(files) <= 2 * 2 * 8
    assert rows(table.rows()) == [(k, 90 + k) for k in range(10)]


def test_a_number_is_written_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=2)
    first = table.write(0, spark.createDataFrame([(1, "a")], "k long, v string"))
    table.write(0, spark.createDataFrame([(1, "b")], "k long, v string"))
    assert rows(table.rows()) == [(1, "a")]
    # Data of a write that never got its version is not seen, and is taken up by the next try.
    os.makedirs(tmp_path / "data" / "_unfinished-batch-1")
    table.write(1, spark.createDataFrame([(2, "c")], "k long, v string"), before=first)
    assert rows(table.rows()) == [(1, "a"), (2, "c")]
    assert rows(table.rows(first)) == [(1, "a")]


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"], buckets=16, bloom=True)
    table.upsert(spark.range(2000).select("id", (F.col("id") % 3).alias("kind")))
    files = {r.f for r in table.lookup(7).select("id", F.input_file_name().alias("f")).collect()}
    (own,) = spark.range(7, 8).select(table.bucket()).first()
    assert [f.split("bucket=")[1].split("/")[0] for f in files] == [str(own)]
    table.upsert(spark.range(100).select("id", F.lit(9).cast("bigint").alias("kind")))
    found = table.lookup(1234)
    assert rows(found) == [(1234, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1234)]" in plan
    many = spark.createDataFrame([("5",), ("1500",), ("-1",), (None,)], "id string")
    assert rows(table.lookup(many)) == [(5, 9), (1500, 0)]
    assert rows(table.lookup(many, F.col("kind") == 9)) == [(5, 9)]
    assert rows(table.lookup(10**9)) == []


def test_changes_of_orders(spark):
    def log(*records):
        full = [(i, s, p, 1 if s else None, 1 if s else None, 1 if s else None, ts, seq, 0) for i, s, p, ts, seq in records]
        return spark.createDataFrame(full, LOG)

    first = log((1, "CREATED", "a", at(), 1), (2, "CREATED", "a", at(), 2), (3, None, None, at(), 3), (None, "CREATED", "a", at(), 4))
    changes = outcomes.order_changes(first, None)
    assert {r.id: (r.change, r.before, r.after.status) for r in changes.collect()} == {
        1: ("insert", None, "CREATED"), 2: ("insert", None, "CREATED"), 3: (None, None, None),
    }
    known = changes.select("after.*")
    second = log(
        (1, "FAILED", "a", at(hours=1), 5),
        (2, None, None, at(hours=1), 6),
        (3, "CREATED", "late", at(hours=-1), 7),
        (4, "CREATED", "a", at(), 8),
        (4, None, None, at(hours=1), 9),
    )
    changes = outcomes.order_changes(second, known)
    found = {r.id: (r.change, r.before and r.before.status, r.after.status) for r in changes.collect()}
    # The record of 3 is older than its delete and changes nothing.
    assert found == {1: ("update", "CREATED", "FAILED"), 2: ("delete", "CREATED", None), 4: (None, None, None)}
    assert outcomes.order_changes(second, known.unionByName(changes.select("after.*"))).where("id < 3").isEmpty()
