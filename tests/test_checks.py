"""Hand-made rows at the edges of the three checks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import ORDER, STOCK, at
from ledgerline import schemas
from ledgerline.operators import blocks
from ledgerline.operators.blocks import hot_keys, split_hot
from ledgerline.operators.fold import RowFold, StockReservation, ordered_fold
from ledgerline.plans import checks
from ledgerline.session import materialize


def results(df, key="order_id", value="result"):
    return {r[key]: r[value] for r in df.collect()}


def test_details_check(orders):
    rows = orders(
        (1, at(), {}),
        (2, at(), {"customer_id": None}),
        (3, at(), {"product": None}),
        (4, at(), {"quantity": 0}),
        (5, at(), {"quantity": -1}),
        (6, at(), {"price": 0}),
        (7, at(), {"status": "VALIDATED"}),
        (8, at(), {"status": None}),
        (9, at(), {"quantity": None}),
    )
    assert results(checks.details_check(rows)) == {
        1: "PASS",
        **dict.fromkeys((2, 3, 4, 5, 6, 9), "FAIL"),
    }


def test_fraud_limit_and_session_gap(orders):
    rows = orders(
        (1, at(), {"price": 1999}),
        (2, at(hours=1), {"price": 1}),  # exactly the gap: same session, 2000
        (3, at(hours=2, microseconds=1), {"price": 1999}),  # one more: a new session
        (4, at(), {"price": 5000, "customer_id": None}),
        (5, at(), {"price": 2000, "customer_id": 2}),
        (6, at(), {"price": 5000, "customer_id": 3, "status": "FAILED"}),
    )
    assert results(checks.fraud_check(rows)) == {1: "PASS", 2: "FAIL", 3: "PASS", 5: "FAIL"}
    sessions = checks.fraud_sessions(rows).where("customer_id = 1").orderBy("first_ts").collect()
    assert [(r.total, r.order.id) for r in sessions] == [(2000, 2), (1999, 3)]
    assert (sessions[0].first_ts, sessions[0].last_ts) == (at(), at(hours=1))


def test_running_total_follows_ts_then_seq(orders):
    rows = orders((1, at(minutes=2), {}), (2, at(minutes=1), {}), (3, at(minutes=2), {}))
    totals = checks.fraud_running_total(rows)
    assert results(totals, "id", "total") == {2: 10, 1: 20, 3: 30}


def test_stock_edges(orders, stock):
    rows = orders(
        (1, at(hours=1), {"quantity": 6}),  # 4 left
        (2, at(hours=2), {"quantity": 5}),  # refused, reserves nothing
        (3, at(hours=3), {"quantity": 4}),  # exactly 0 left
        (4, at(hours=4), {"quantity": 1}),  # refused
        (5, at(hours=5), {"quantity": -2}),  # gives two back
        (6, at(hours=6), {"quantity": 2}),
        (7, at(), {"quantity": 1}),  # same instant as the stock change: sees it
        (8, at(hours=1), {"product": "WATCH"}),  # no stock row
        (9, at(hours=1), {"product": None}),
    )
    inventory = stock(("SHOES", 11, at()))
    expected = {1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL", 5: "PASS", 6: "PASS", 7: "PASS"}
    assert results(checks.inventory_check(rows, inventory)) == expected
    positive = checks.inventory_check(rows, inventory, positive_only=True)
    assert results(positive) == expected | {5: "FAIL", 6: "FAIL"}


def test_stock_changes_deletes_and_returns(orders, stock):
    rows = orders(*[(n, at(hours=n), {"quantity": 3}) for n in range(1, 7)])
    inventory = stock(
        ("SHOES", 3, at()),
        ("SHOES", 9, at(hours=2)),  # order 2 sees 9, three of them reserved
        ("SHOES", None, at(hours=3)),  # order 3 meets no stock
        ("SHOES", 6, at(hours=4)),  # the reservations still stand
        ("SHOES", 9, at(hours=5, minutes=1)),
    )
    assert results(checks.inventory_check(rows, inventory)) == {
        1: "PASS",
        2: "PASS",
        4: "FAIL",
        5: "FAIL",
        6: "PASS",
    }


def test_snapshot_stock(orders, stock):
    rows = orders((1, at(), {}), (2, at(), {"product": "WATCH"}), (3, at(), {"product": None}))
    now = stock(("SHOES", 4, at(hours=9)), ("GUITAR", 1, at()))
    assert results(checks.orders_with_stock(rows, now), "id", "stock") == {1: 4}


def make_orders(spark, seed, n, start=0):
    """Random orders of which two thirds are of one customer and one product."""
    r = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        product = "SHOES" if r.random() < 0.66 else r.choice(["WATCH", "GUITAR", None])
        customer = 1 if r.random() < 0.66 else r.choice([2, 3, 4, None])
        moment = at(minutes=i * r.choice([1, 1, 1, 1, 2]), seconds=r.randrange(3))
        if r.random() < 0.02:
            moment = at(minutes=2 * i, hours=3)
        quantity, price = r.randrange(-1, 9), r.randrange(200)
        rows.append((i, "CREATED", product, quantity, price, customer, moment, i))
    return spark.createDataFrame(rows, ORDER)


def make_stock(spark, seed, hours):
    r = random.Random(seed)
    rows = []
    for n, hour in enumerate(range(0, hours, 2)):
        for product in schemas.PRODUCTS:
            level = None if r.random() < 0.1 else r.randrange(hour * 30 + 60)
            rows.append((product, level, at(hours=hour), n))
    return spark.createDataFrame(rows, STOCK)


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 25), (3, 100)])
def test_split_keys_give_the_same_rows(spark, seed, block):
    """Hot keys cut into small blocks against the plain plans."""
    rows, inventory = make_orders(spark, seed, 600), make_stock(spark, seed, 24)
    for job in (
        lambda n: checks.fraud_running_total(rows, n),
        lambda n: checks.fraud_sessions(rows, n),
        lambda n: checks.orders_asof_stock(rows, inventory, n),
        lambda n: checks.inventory_check(rows, inventory, n),
        lambda n: checks.inventory_check(rows, inventory, n, positive_only=True),
    ):
        whole, split = job(10**6), job(block)
        assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def reserve(state, stock, quantity):
    granted = []
    for level, wanted in zip(stock, quantity):
        ok = level - state - wanted >= 0
        granted.append(ok)
        state += wanted if ok else 0
    return granted, state


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 60), st.integers(-3, 12)), min_size=1, max_size=60),
    st.integers(-20, 80),
)
def test_reservation_and_its_piece(rows, state):
    stock, quantity = (np.array(c, dtype=np.int64) for c in zip(*rows))
    fold = StockReservation()
    granted, piece = fold.run(state, stock, quantity)
    expected, after = reserve(state, stock, quantity)
    assert granted.tolist() == expected
    assert state + piece.shift == after
    # The same rows are granted from every start state of the piece, and not beyond.
    for start in range(max(piece.low, -40), min(piece.high, 120) + 1):
        assert reserve(start, stock, quantity)[0] == expected
    for start in (piece.low - 1, piece.high + 1):
        if -(10**9) < start < 10**9:
            assert reserve(start, stock, quantity)[0] != expected


@pytest.mark.parametrize("wanted", [[2], [2, -2], [3, 5, -1]])
def test_fold_where_guesses_do_not_meet(spark, wanted):
    """Start states that never run together must still be told apart exactly."""
    r = random.Random(5)
    quantity = [r.choice(wanted) for _ in range(400)]
    quantity[0] = 1
    stock = [40 if n < 200 else 61 for n in range(400)]
    rows = [("SHOES", n, q, s) for n, (q, s) in enumerate(zip(quantity, stock))]
    df = spark.createDataFrame(rows, "product string, seq bigint, quantity bigint, stock bigint")
    folded = ordered_fold(df, ["product"], ["seq"], StockReservation(), "granted", 20)
    got = [row.granted for row in folded.orderBy("seq").collect()]
    assert got == reserve(0, stock, quantity)[0]


def test_fold_starts(spark):
    df = spark.createDataFrame(
        [("A", n, 1, 10) for n in range(40)] + [("B", n, 1, 10) for n in range(5)],
        "product string, seq bigint, quantity bigint, stock bigint",
    )
    starts = spark.createDataFrame([("A", 7)], "product string, start bigint")
    for block in (10, 1000):
        folded = ordered_fold(
            df, ["product"], ["seq"], StockReservation(), "granted", block, starts
        )
        counts = folded.where("granted").groupBy("product").agg(F.count("*").alias("n"))
        assert results(counts, "product", "n") == {"A": 3, "B": 5}


def test_blocks_are_even_and_in_order(spark):
    """Also where one instant holds most of a hot key's rows."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 15_000, F.lit(at())).otherwise(F.lit(at(hours=1))).alias("ts"),
        F.col("id").alias("seq"),
    )
    split = split_hot(df, ["k"], ["ts", "seq"], 1000)
    hot = materialize(split.hot)
    assert hot.count() + split.cold.count() == 20_000
    assert hot.select("k").distinct().count() == 1
    blocks = (
        hot.groupBy("block")
        .agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
        .orderBy("block")
        .collect()
    )
    assert len(blocks) >= 10 and max(r.n for r in blocks) < 3000
    assert all(x.b < y.a for x, y in zip(blocks, blocks[1:]))
    assert split_hot(df, ["k"], ["ts", "seq"], 20_000).hot is None
    # Far larger blocks are found in a sample.
    assert hot_keys(df, ["k"], 10_000).count() == 1


@pytest.mark.parametrize("broadcast", [100, 0])
def test_many_small_blocks_share_tasks(spark, monkeypatch, broadcast):
    """Tasks go by the rows; blocks are still consecutive and no larger than asked for."""
    monkeypatch.setattr(blocks, "BROADCAST_KEYS", broadcast)
    df = spark.range(12_000).select(
        F.when(F.col("id") < 11_990, F.col("id") % 40).otherwise(F.col("id")).alias("k"),
        F.lit(at()).alias("ts"),
        F.col("id").alias("seq"),
    )
    split = split_hot(df, ["k"], ["ts", "seq"], 10)
    assert split.hot.rdd.getNumPartitions() <= 4
    assert split.cold.count() == 10
    hot = materialize(split.hot)
    assert hot.count() == 11_990
    found = hot.groupBy("block").agg(
        F.count("*").alias("n"), F.min(F.struct("k", "seq")).alias("a"), F.max(F.struct("k", "seq")).alias("b")
    )
    found = found.orderBy("block").collect()
    assert max(r.n for r in found) == 10 and len(found) <= 1199 + 4
    assert all(x.b < y.a for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("block", [50, 1000])
def test_fold_of_single_rows(spark, block):
    """Tickets numbered from a counter that starts anew after every seventh value."""
    df = spark.createDataFrame(
        [("A" if n % 3 else "B", n, n % 7) for n in range(300)], "k string, seq bigint, v bigint"
    )

    def step(state, value):
        state = 0 if value == 0 else state + value
        return state, f"{value}/{state}"

    fold = RowFold(["v"], step, T.StringType())
    got = ordered_fold(df, ["k"], ["seq"], fold, "ticket", block).orderBy("seq").collect()
    states = {"A": 0, "B": 0}
    for row in got:
        states[row.k], ticket = step(states[row.k], row.v)
        assert row.ticket == ticket


@pytest.mark.parametrize("block", [15, 1000])
def test_fold_of_any_columns(spark, block):
    """Doubles, text, nulls and a small integer result; the state is an integer."""
    data = [("A", n, None if n % 5 == 0 else n + 0.5, "xy"[n % 2]) for n in range(60)]
    df = spark.createDataFrame(data, "k string, seq bigint, v double, w string")

    def step(state, value, word):
        state += int((value or 0) * 2) * (word == "x")
        return state, state % 1000

    fold = RowFold(["v", "w"], step, T.IntegerType())
    got = ordered_fold(df, ["k"], ["seq"], fold, "out", block).orderBy("seq").collect()
    state = 0
    for row, (_, _, value, word) in zip(got, data, strict=True):
        state, out = step(state, value, word)
        assert (row.v, row.w, row.out) == (value, word, out)


def test_fold_refuses_other_states():
    with pytest.raises(TypeError):
        RowFold(["v"], lambda state, v: (state, v), T.LongType(), start=0.5)


def test_stock_snapshot_keeps_every_product(spark, orders):
    now = spark.createDataFrame([("LAMP", 4)], "product string, stock int")
    placed = orders((1, at(), {"product": "LAMP"}))
    assert checks.orders_with_stock(placed, now).count() == 1
