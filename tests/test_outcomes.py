"""Hand-made rows at the edges of the verdict aggregation and the order state."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import VERDICT, at
from ledgerline import schemas
from ledgerline.operators import first_per_key, interval_join, last_per_key, route, tag_and_union
from ledgerline.plans import outcomes, topics

MS5 = {"milliseconds": 5}


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_three_passes_validate(orders, verdicts):
    rows = orders(*[(n, at(), {}) for n in (1, 2, 3, 4)])
    log = verdicts(
        (1, "FRAUD_CHECK", "PASS", at()),
        (1, "ORDER_DETAILS_CHECK", "PASS", at(**MS5)),  # exactly the gap
        (1, "INVENTORY_CHECK", "PASS", at(milliseconds=10)),
        (2, "FRAUD_CHECK", "PASS", at()),
        (2, "ORDER_DETAILS_CHECK", "PASS", at()),
        (2, "INVENTORY_CHECK", "PASS", at(milliseconds=5, microseconds=1)),  # too late
        (3, "FRAUD_CHECK", "PASS", at()),  # one check three times
        (3, "FRAUD_CHECK", "PASS", at()),
        (3, "FRAUD_CHECK", "PASS", at()),
        (4, "FRAUD_CHECK", "PASS", at()),
        (4, "ORDER_DETAILS_CHECK", "FAIL", at()),
        (4, "INVENTORY_CHECK", "PASS", at()),
    )
    assert pairs(outcomes.validated_orders(log, rows), "id", "status") == [
        (1, "VALIDATED"),
        (3, "VALIDATED"),
    ]
    distinct = outcomes.validated_orders(log, rows, distinct_types=True)
    assert pairs(distinct, "id") == [(1,)]
    assert pairs(outcomes.validated_sessions(log, rows), "id", "ts") == [
        (1, at(milliseconds=10)),
        (3, at()),
    ]
    assert pairs(outcomes.pass_count_sessions(log).where("order_id = 2"), "passes") == [(1,), (2,)]


def test_a_fourth_pass_validates_again(orders, verdicts):
    log = verdicts(*[(1, "FRAUD_CHECK", "PASS", at()) for _ in range(4)])
    rows = orders((1, at(), {}))
    assert pairs(outcomes.validated_orders(log, rows), "seq") == [(2,), (3,)]
    assert outcomes.validated_sessions(log, rows).count() == 1


def test_session_counts_add_up_across_an_out_of_order_record(verdicts):
    """A record between two runs joins them; counts of both add up."""
    log = verdicts(
        (1, "FRAUD_CHECK", "PASS", at()),
        (1, "INVENTORY_CHECK", "PASS", at(milliseconds=8)),
        (1, "ORDER_DETAILS_CHECK", "PASS", at(milliseconds=4)),
    )
    assert pairs(outcomes.pass_count_sessions(log), "passes") == [(3,)]


def test_join_tolerance(orders, verdicts):
    rows = orders(
        (1, at(minutes=5), {}),
        (2, at(minutes=5, microseconds=1), {}),
        (3, at(), {}),
        (4, at(), {}),
        (5, at(), {"status": "VALIDATED"}),
        (None, at(), {}),
    )
    late, too_late = at(minutes=5), at(minutes=5, microseconds=1)
    log = verdicts(
        (1, "FRAUD_CHECK", "FAIL", at()),
        (2, "FRAUD_CHECK", "FAIL", at()),
        (3, "FRAUD_CHECK", "FAIL", late),
        (4, "FRAUD_CHECK", "FAIL", too_late),
        (5, "FRAUD_CHECK", "FAIL", at()),
        (None, "FRAUD_CHECK", "FAIL", at()),
    )
    failed = outcomes.failed_orders_raw(log, rows)
    assert pairs(failed, "id", "ts") == [(1, at(minutes=5)), (3, late)]


def test_failed_once_and_state(orders, verdicts):
    rows = orders((1, at(), {}), (2, at(), {}), (3, at(), {}))
    log = verdicts(
        (1, "FRAUD_CHECK", "PASS", at()),
        (1, "ORDER_DETAILS_CHECK", "PASS", at()),
        (1, "INVENTORY_CHECK", "PASS", at()),
        (1, "FRAUD_CHECK", "FAIL", at()),  # after validation: FAILED stands
        (2, "FRAUD_CHECK", "FAIL", at(milliseconds=9)),
        (2, "FRAUD_CHECK", "FAIL", at()),
    )
    validated = outcomes.validated_orders(log, rows)
    failed = outcomes.failed_orders(log, rows)
    assert pairs(failed, "id", "ts", "seq") == [(1, at(), 3), (2, at(), 5)]
    # The failing fourth verdict still carries a count of three.
    assert pairs(validated, "id", "seq") == [(1, 2), (1, 3)]
    state = outcomes.order_state(outcomes.order_log(rows, validated, failed))
    assert pairs(state, "id", "status") == [(1, "FAILED"), (2, "FAILED"), (3, "CREATED")]
    assert pairs(outcomes.lookup(state, 3), "id") == [(3,)]
    assert pairs(outcomes.lookup(state, 3, F.col("status") == "VALIDATED"), "id") == []
    assert pairs(outcomes.lookup(state, rows.select("id").where("id > 1")), "id") == [(2,), (3,)]


def test_lifecycle(orders, stock):
    rows = orders(
        (1, at(hours=1), {}),
        (2, at(hours=2), {"quantity": 9}),  # does not fit
        (3, at(hours=3), {"customer_id": None}),  # details fail, no fraud verdict
        (4, at(hours=4), {"product": "WATCH"}),  # sane but not stocked: stays CREATED
        (5, at(hours=5), {"status": "SHIPPED"}),
        (6, at(hours=6), {"price": 2000, "customer_id": 2}),
    )
    state = outcomes.order_lifecycle(rows, stock(("SHOES", 5, at())))
    assert pairs(state, "id", "status") == [
        (1, "VALIDATED"),
        (2, "FAILED"),
        (3, "FAILED"),
        (4, "CREATED"),
        (5, "SHIPPED"),
        (6, "FAILED"),
    ]


@pytest.mark.parametrize("seed,block", [(1, 5), (2, 40)])
def test_split_counts(spark, seed, block):
    r = random.Random(seed)
    log = spark.createDataFrame(
        [
            (
                1 if r.random() < 0.5 else r.randrange(50),
                r.choice(schemas.CHECKS),
                r.choice(schemas.RESULTS),
                at(milliseconds=r.randrange(3000)),
                n,
            )
            for n in range(500)
        ],
        VERDICT,
    )
    for job in (
        lambda n: outcomes.pass_count_running(log, n),
        lambda n: outcomes.pass_count_running(log, n, distinct_types=True),
        lambda n: outcomes.pass_count_sessions(log, n),
    ):
        whole, split = job(10**6), job(block)
        assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_interval_join_meets_each_pair_once(spark):
    r = random.Random(3)
    left = [(r.randrange(3), at(seconds=r.randrange(20_000)), n) for n in range(300)]
    right = [(r.randrange(3), at(seconds=r.randrange(20_000)), n) for n in range(300)]
    joined = interval_join(
        spark.createDataFrame(left, "k int, a timestamp, n int"),
        spark.createDataFrame(right, "k int, b timestamp, m int"),
        ["k"],
        "a",
        "b",
        schemas.JOIN_TOLERANCE,
    )
    expected = [
        (n, m)
        for k, a, n in left
        for j, b, m in right
        if k == j and abs(a - b) <= schemas.JOIN_TOLERANCE
    ]
    assert pairs(joined, "n", "m") == sorted(expected)


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame(
        [(1, 5, "b"), (1, 3, "a"), (2, 1, None), (None, 9, "x")], "k int, seq int, v string"
    )
    assert pairs(last_per_key(df, ["k"], ["seq"]), "k", "v") == [(1, "b"), (2, None)]
    assert pairs(first_per_key(df, ["k"], ["seq"]), "k", "v") == [(1, "a"), (2, None)]


def test_route_first_match(spark):
    df = spark.createDataFrame([(1,), (5,), (12,), (None,)], "n int")
    branches = [F.col("n") > 10, F.col("n") > 3, F.col("n") > 4]
    assert pairs(route(df, branches), "n", "branch") == [(5, 1), (12, 0)]


def test_tag_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "n int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, n int")
    assert pairs(tag_and_union({"a": a, "b": b}), "topic", "n", "v") == [
        ("a", 1, "x"),
        ("b", 2, "y"),
    ]


def test_interval_join_of_equal_times(spark):
    left = spark.sql("select 1 id, timestamp '2024-01-01 00:00:00' lts")
    right = spark.sql("select 1 id, timestamp '2024-01-01 00:00:00' rts")
    for tiled in (True, False):
        joined = interval_join(left, right, ["id"], "lts", "rts", timedelta(0), tiled=tiled)
        assert joined.count() == 1


def test_a_delete_removes_the_order(spark, orders):
    log = orders((1, at(), {}), (2, at(), {}), (1, at(minutes=1), {}))
    records = topics.encode_orders(log.where("seq < 2")).union(
        spark.createDataFrame([("1", None, at(minutes=2), 5)], "key string, value string, ts timestamp, seq bigint")
    )
    decoded = topics.decode_orders(records)
    assert topics.rejected(decoded).count() == 0
    kept = topics.accepted(decoded).unionByName(topics.deleted_orders(records))
    state = outcomes.order_state(kept.withColumn("step", F.lit(0)))
    assert [r.id for r in state.collect()] == ["2"]
