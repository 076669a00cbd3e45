from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import prepare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
START = datetime(2024, 3, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def at(**passed) -> datetime:
    """A time after the start of the hand-made rows."""
    return START + timedelta(**passed)


ORDER = (
    "id bigint, status string, product string, quantity int, price bigint, "
    "customer_id bigint, ts timestamp, seq bigint"
)
VERDICT = "order_id bigint, type string, result string, ts timestamp, seq bigint"
STOCK = "product string, stock int, ts timestamp, seq bigint"


@pytest.fixture
def orders(spark):
    """Orders from (id, ts, changed fields); seq is the position in the list."""

    def build(*rows):
        full = []
        for seq, (id, ts, changes) in enumerate(rows):
            record = {
                "status": "CREATED",
                "product": "SHOES",
                "quantity": 1,
                "price": 10,
                "customer_id": 1,
            } | changes
            full.append((id, *record.values(), ts, seq))
        return spark.createDataFrame(full, ORDER)

    return build


@pytest.fixture
def verdicts(spark):
    def build(*rows):
        return spark.createDataFrame([(*row, seq) for seq, row in enumerate(rows)], VERDICT)

    return build


@pytest.fixture
def stock(spark):
    def build(*rows):
        return spark.createDataFrame([(*row, seq) for seq, row in enumerate(rows)], STOCK)

    return build
