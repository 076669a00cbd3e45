"""First and last record per key: changelog tables and keep-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The newest record of each key by ``order``, its columns or expressions.

    Each map task already reduces a key to one row, so a hot key costs no more than
    others. On a stream it runs in update mode and emits each changed key.
    """
    return _pick(df, list(keys), _columns(order), newest=True)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The oldest record of each key."""
    return _pick(df, list(keys), _columns(order), newest=False)


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _pick(df: DataFrame, keys: list[str], order: list[Column], newest: bool) -> DataFrame:
    keyed = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    if df.isStreaming:
        pick = F.max_by if newest else F.min_by
        record = F.struct(*[c for c in df.columns if c not in keys])
        picked = keyed.groupBy(*keys).agg(pick(record, F.struct(*order)).alias("picked"))
        return picked.select(*keys, "picked.*").select(*df.columns)
    # Spark limits the ranks before the shuffle, too (WindowGroupLimit).
    along = W.partitionBy(*keys).orderBy(*[c.desc() if newest else c.asc() for c in order])
    return keyed.withColumn("rank", F.row_number().over(along)).where("rank = 1").drop("rank")
