"""Session windows per key: final aggregates and running totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.blocks import BLOCK, ROWS_PER_BLOCK, split_hot
from ledgerline.operators.times import interval_text
from ledgerline.session import materialize


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a key or event time belong to no session."""
    return df.where(" and ".join(f"`{k}` is not null" for k in keys))


def _breaks(ts: Column, previous: Column, gap: timedelta) -> Column:
    """1 where a row more than ``gap`` after its predecessor opens a session, else 0."""
    return F.coalesce((ts - previous > F.lit(gap)).cast("int"), F.lit(0))


def session_running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    gap: timedelta,
    sums: Mapping[str, Column],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add each of ``sums``: the session's total up to and including each row.

    Rows of a key follow (ts, seq); a row more than ``gap`` after the one before it
    opens a new session. One row comes out per row with a key.
    """
    keys, names = list(keys), list(sums)
    rows = _present(df, [*keys, ts]).select(
        *df.columns, *[value.cast("bigint").alias(name) for name, value in sums.items()]
    )
    cold, hot = split_hot(rows, keys, [ts, seq], rows_per_block)
    columns = [*df.columns, *names]
    result = _local_running(cold, keys, ts, seq, gap, names).select(columns)
    if hot is not None:
        blocked = _blocked_running(hot, keys, ts, seq, gap, names)
        result = result.unionByName(blocked.select(columns))
    return result


def _sessions(df: DataFrame, group: list[str], ts: str, seq: str, gap: timedelta) -> DataFrame:
    """Number the sessions of each group; 0 is the one open at the group's start."""
    along = W.partitionBy(*group).orderBy(ts, seq)
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = _breaks(F.col(ts), F.lag(ts).over(along), gap)
    return df.withColumn("opens", opens).withColumn("session", F.sum("opens").over(so_far))


def _local_running(
    df: DataFrame, group: list[str], ts: str, seq: str, gap: timedelta, names: list[str]
) -> DataFrame:
    within = (
        W.partitionBy(*group, "session")
        .orderBy(ts, seq)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return _sessions(df, group, ts, seq, gap).withColumns(
        {name: F.sum(name).over(within) for name in names}
    )


def _blocked_running(
    hot: DataFrame, keys: list[str], ts: str, seq: str, gap: timedelta, names: list[str]
) -> DataFrame:
    local = materialize(_local_running(hot, [*keys, BLOCK], ts, seq, gap, names))
    # What the session still open at a block's end gathered in that block.
    blocks = (
        local.groupBy(*keys, BLOCK)
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.max("session").alias("sessions"),
            F.max_by(F.struct(*names), F.struct(ts, seq)).alias("tail"),
        )
    )
    along = W.partitionBy(*keys).orderBy(BLOCK)
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    through = (
        W.partitionBy(*keys, "chain")
        .orderBy(BLOCK)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # A chain is a run of blocks that one open session reaches through.
    chained = (
        blocks.withColumn("apart", _breaks(F.col("first_ts"), F.lag("last_ts").over(along), gap))
        .withColumn("ends", F.greatest("apart", F.least("sessions", F.lit(1))))
        .withColumn("chain", F.sum("ends").over(so_far))
        .withColumns({f"open_{n}": F.sum(f"tail.{n}").over(through) for n in names})
    )
    carry = chained.select(
        *keys,
        BLOCK,
        *[
            F.when(F.col("apart") == 0, F.lag(f"open_{n}").over(along)).alias(f"carried_{n}")
            for n in names
        ],
    )
    carried = {
        n: F.col(n)
        + F.when(F.col("session") == 0, F.coalesce(f"carried_{n}", F.lit(0))).otherwise(0)
        for n in names
    }
    return local.join(carry, [*keys, BLOCK]).withColumns(carried)


def session_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    gap: timedelta,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per key and session: first_ts, last_ts and the named aggregates.

    ``sums`` are added up over the session, ``mins`` are its smallest values and
    ``lasts`` come from its newest row by (ts, seq). On a stream the rows come out once
    the watermark closes the session, together with its window as ``session``.
    """
    keys, sums, lasts, mins = list(keys), dict(sums or {}), dict(lasts or {}), dict(mins or {})
    rows = _present(df, [*keys, ts]).select(
        *keys,
        ts,
        seq,
        *[value.cast("bigint").alias(name) for name, value in sums.items()],
        *[value.alias(name) for name, value in [*mins.items(), *lasts.items()]],
    )
    merges = [*[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in mins]]
    names = [*sums, *mins, *lasts]
    if df.isStreaming:
        return _window_sessions(rows, keys, ts, seq, gap, merges, lasts, names)
    cold, hot = split_hot(rows, keys, [ts, seq], rows_per_block)
    result = _window_sessions(cold, keys, ts, seq, gap, merges, lasts, names)
    if hot is not None:
        blocked = _blocked_sessions(hot, keys, ts, seq, gap, merges, lasts, names)
        result = result.unionByName(blocked)
    return result


def _window_sessions(df, keys, ts, seq, gap, merges, lasts, names) -> DataFrame:
    window = F.session_window(ts, interval_text(gap)).alias("session")
    bounds = [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    newest = [F.max_by(name, F.struct(ts, seq)).alias(name) for name in lasts]
    # A stream keeps the window: its end is the event time of what follows.
    kept = ["session"] if df.isStreaming else []
    return (
        df.groupBy(*keys, window)
        .agg(*bounds, *merges, *newest)
        .select(*keys, *kept, "first_ts", "last_ts", *names)
    )


def _blocked_sessions(hot, keys, ts, seq, gap, merges, lasts, names) -> DataFrame:
    group = [*keys, BLOCK]
    parts = materialize(
        _sessions(hot, group, ts, seq, gap)
        .groupBy(*group, "session")
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.max(F.struct(ts, seq)).alias("newest"),
            *merges,
            *[F.max_by(name, F.struct(ts, seq)).alias(name) for name in lasts],
        )
    )
    # Only a block's first and last session can reach into a neighbouring block:
    # at most two rows per block take part in the merge along the key.
    ends = parts.groupBy(*group).agg(F.max("session").alias("last_session"))
    placed = parts.join(ends, group)
    at_end = (F.col("session") == 0) | (F.col("session") == F.col("last_session"))
    inner = placed.where(~at_end)
    by_key = W.partitionBy(*keys).orderBy(BLOCK, "session")
    merged = (
        placed.where(at_end)
        .withColumn(
            "apart",
            F.when(F.col("session") > 0, 1).otherwise(
                _breaks(F.col("first_ts"), F.lag("last_ts").over(by_key), gap)
            ),
        )
        .withColumn(
            "chain",
            F.sum("apart").over(by_key.rowsBetween(W.unboundedPreceding, W.currentRow)),
        )
        .groupBy(*keys, "chain")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *merges,
            *[F.max_by(name, "newest").alias(name) for name in lasts],
        )
    )
    columns = [*keys, "first_ts", "last_ts", *names]
    return inner.select(*columns).unionByName(merged.select(*columns))
