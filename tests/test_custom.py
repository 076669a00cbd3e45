"""Operators that run user functions, against plain versions."""

from __future__ import annotations

import random
import sys
from datetime import timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import at
from ledgerline.operators import SessionAggregate, Transformer, fold, reduce_per_key, session_fold, transform
from ledgerline.operators.fold import StockReservation
from ledgerline.sources import KeyedTable
from ledgerline.streaming import batches, jobs
from test_streaming import Topic, places

# Workers do not have the tests' folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "k string, ts timestamp, seq bigint, word string, x double"


def make(spark, seed, n, hot=0.4):
    """Rows of a few keys, one of them hot; some without key, word or number."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        minutes = rng.randrange(n) * 7
        rows.append((key, at(minutes=minutes), seq, rng.choice(["x", "y", None]), rng.choice([1.5, -2.0, None])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, ROWS)


def by_key(rows):
    found = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        found.setdefault(r[0], []).append(r)
    return found


def remember(state, word, x):
    words = (state["words"] + (word or "-"))[-5:]
    total = state["total"] + (x or 0.0)
    return {"words": words, "total": total}, f"{words}:{total}"


def transformer(start="", total=0.0):
    state = T.StructType([T.StructField("words", T.StringType()), T.StructField("total", T.DoubleType())])
    return Transformer(("word", "x"), remember, {"words": start, "total": total}, state, T.StringType())


@pytest.mark.parametrize("size", [3, 10_000])
def test_transform(spark, size):
    rows, df = make(spark, 1, 300)
    starts = spark.createDataFrame([("a", {"words": "zz", "total": 10.0}), ("q", {"words": "", "total": 0.0})],
                                   "k string, state struct<words: string, total: double>")
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, str(size))
    try:
        found = transform(df, ["k"], ["ts", "seq"], transformer(), "told", starts).collect()
    finally:
        spark.conf.set(option, before)
    expected = {}
    for key, group in by_key(rows).items():
        state = {"words": "zz", "total": 10.0} if key == "a" else {"words": "", "total": 0.0}
        for r in group:
            state, told = remember(state, r[3], r[4])
            expected[r[2]] = [told, None, False]
        expected[group[-1][2]][1:] = [(state["words"], state["total"]), True]
    assert {r.seq: [r.told, r.state and tuple(r.state), r["last"]] for r in found} == expected
    empty = transform(df.limit(0), ["k"], ["ts", "seq"], transformer(), "told")
    assert empty.collect() == [] and empty.columns == [*df.columns, "told", "state", "last"]


def test_transformer_on_a_stream(spark, tmp_path):
    rows, df = make(spark, 2, 120)
    topic = Topic(spark, tmp_path / "rows", df.schema)
    for part in range(4):
        since, until = at(minutes=210 * part), at(minutes=210 * (part + 1))
        topic.append(df.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until))))
    step = jobs.transformer_step(["k"], ["ts", "seq"], transformer(), "told", lambda r: r.select("seq", "told"))
    out, state, checkpoint = places(tmp_path, "told")
    batches.run_batches(topic.stream(), step, out, state, checkpoint).awaitTermination()
    whole = transform(df, ["k"], ["ts", "seq"], transformer(), "told")
    assert sorted(map(tuple, batches.read_batches(spark, out).collect())) == sorted(
        map(tuple, whole.select("seq", "told").collect())
    )
    kept = {r.k: r.state for r in KeyedTable(spark, state, ["k"]).rows().collect()}
    assert kept == {r.k: r.state for r in whole.where("last").collect()}


def joined(earlier, later):
    return {"words": earlier["words"] + later["words"], "n": earlier["n"] + later["n"]}


def test_reduce_in_order(spark):
    rows, df = make(spark, 3, 400)
    record = {"words": F.coalesce("word", F.lit("-")), "n": F.lit(1).cast("bigint")}
    found = {r.k: (r.words, r.n) for r in reduce_per_key(df, ["k"], ["ts", "seq"], record, joined).collect()}
    assert found == {k: ("".join(r[3] or "-" for r in g), len(g)) for k, g in by_key(rows).items()}
    assert reduce_per_key(df.limit(0), ["k"], ["ts", "seq"], record, joined).collect() == []


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """Ranges cut through the key; each stretch is one record when rows are dealt by key."""
    df = spark.range(40_000).select(
        F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = reduce_per_key(df, ["k"], ["ts", "seq"], {"n": F.lit(1).cast("bigint"), "words": F.lit("")}, joined)
        assert [r.n for r in found.collect()] == [40_000]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_hash, by_range = plan.index("hashpartitioning(k"), plan.index("rangepartitioning(")
    assert by_hash < plan.index("MapInArrow", by_hash) < by_range


def added(state, word, x):
    return {"words": state["words"] + (word or "-"), "high": max(v for v in (state["high"], x or 0.0) if v is not None)}


def merged(a, b):
    return {"words": a["words"] + b["words"], "high": max(a["high"], b["high"])}


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_session_fold(spark, block):
    rows, df = make(spark, 4, 300)
    state = T.StructType([T.StructField("words", T.StringType()), T.StructField("high", T.DoubleType())])
    aggregate = SessionAggregate(("word", "x"), {"words": "", "high": None}, added, merged, state)
    found = session_fold(df, ["k"], "ts", "seq", timedelta(minutes=20), aggregate, "told", block).collect()
    expected = []
    for key, group in by_key(rows).items():
        now = None
        for r in group:
            if now is None or r[1] - now[2] > timedelta(minutes=20):
                now = [key, r[1], r[1], {"words": "", "high": None}]
                expected.append(now)
            now[2], now[3] = r[1], added(now[3], r[3], r[4])
    assert sorted((r.k, r.first_ts, r.last_ts, r.told.words, r.told.high) for r in found) == sorted(
        (k, a, b, s["words"], s["high"]) for k, a, b, s in expected
    )


def test_reservations_equal_the_row_loop(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(400):
        monkeypatch.setattr(fold, "STRETCH", int(rng.choice([3, 16, 1 << 14])))
        n = int(rng.integers(1, 80))
        quantity = rng.integers(int(rng.choice([-3, 0, 1])), 8, n)
        stock = np.repeat(rng.integers(0, 100, n // 5 + 1), 5)[:n]
        headroom = stock - quantity if rng.random() < 0.6 else rng.integers(0, 200, n)
        state = begin = int(rng.integers(0, 50))
        expected = []
        for room, wanted in zip(headroom.tolist(), quantity.tolist()):
            expected.append(state <= room)
            state += wanted if expected[-1] else 0
        assert StockReservation._granted(begin, headroom, quantity).tolist() == expected
