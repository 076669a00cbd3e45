"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots of the filter that keeps rows out of a shuffle, see ``only_ids``: at most
# 8 MB of longs are broadcast, however many ids there are.
FILTER_SLOTS = 2**20
# Entries of a cache in a task. Beyond it the cache starts anew.
CACHE_ENTRIES = 300_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Cache(dict):
    """What ``make`` gives for a key, computed once while it is kept; bounded."""

    def __init__(self, make: Callable[[Any], Any], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        self[key] = made = self.make(key)
        return made


def slot(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(FILTER_SLOTS))


def only_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in ``ids`` (one column): a filter before a join.

    Compares hash slots, so it lets some other rows through, more of them the more ids
    there are. What it broadcasts is at most FILTER_SLOTS longs.
    """
    slots = ids.select(slot(F.col(ids.columns[0])).alias("_slot")).distinct()
    return df.withColumn("_slot", slot(F.col(key))).join(
        F.broadcast(slots), "_slot", "left_semi"
    ).drop("_slot")


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of ``rows`` rows at least, but for the last."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting)


def held_out(of: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``. A null id is held out."""
    crc = F.crc32(F.encode((F.col(of) if isinstance(of, str) else of).cast("string"), "utf-8"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(True))
